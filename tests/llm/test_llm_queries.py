"""The numbered queries against their SQL, or against brute force where there is none."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from oracle import compare, connect
from tabulon.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


def shingles(text, length):
    w = words(text)
    return frozenset(zip(*[w[i:] for i in range(length)])) if len(w) >= length else frozenset([tuple(w)] if w else [])


def components(sets):
    """The least id that each reaches over links of similarity 0.8."""
    owners, parent = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for g in s:
            owners[g].append(d)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = Counter(e for g in s for e in owners[g] if e < d)
        for e, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[e]) - k):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: find(d) for d in sets}


def test_near_duplicates(spark, texts):
    sets = {d: shingles(t, 4) for d, t in texts.items()}
    want = {d: (len(sets[d]), c, c == d) for d, c in components(sets).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op7_near_duplicates"](spark, FOLDER).collect()}
    assert got == want


def test_secrets(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    patterns = [(assign, lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    for r in QUERIES["op5_secrets"](spark, FOLDER).collect():
        spans = sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(patterns) for m in p.finditer(texts[r.doc_id]) if good(m))
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(told.split(",")) <= set(r.spans.split(",")) or not told


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_personal_data(spark, texts):
    count = lambda m: len(re.sub("[^0-9]", "", m[0]))
    patterns = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= count(m) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= count(m) <= 15),
    ]
    names = ("email", "ip", "card", "phone")
    for r in QUERIES["op6_personal_data"](spark, FOLDER).collect():
        spans = [(k, m.start(), m.end()) for k, (p, good) in enumerate(patterns) for m in re.finditer(p, texts[r.doc_id]) if good(m)]
        told = ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in spans) for i in range(4)]


def test_language_model(spark, texts):
    tokens = {d: [*words(t), None] for d, t in texts.items()}
    training = [d for d in tokens if zlib.crc32(str(d).encode()) % 10]
    seen = Counter(w for d in training for w in tokens[d])
    pairs = Counter(p for d in training for p in zip(["<s>", *tokens[d]], tokens[d], strict=False))
    total, kinds = sum(seen.values()), len(seen)
    below = total + 0.1 * (kinds + 1)
    gap = 0.0
    for r in QUERIES["op10_lm_scores"](spark, FOLDER).collect():
        w = tokens[r.doc_id]
        assert math.isclose(r.base_score, sum(math.log10((seen[x] + 0.1) / below) for x in w), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(seen[x] > 0 for x in w), total)
        assert r.held_out == (r.doc_id not in set(training))
        exact, before = 0.0, "<s>"
        for x in w:
            n = len(training) if before == "<s>" else seen[before]
            exact += math.log10((pairs[before, x] + 5 * min(1, (seen[x] + 0.1) / below)) / (n + 5))
            before = x
        gap += abs(exact - r.score) / len(w)
    assert gap / len(texts) < 0.1  # counts are read back to within their level


def labelled(name, column):
    t = pq.read_table(f"/root/testdata/sf0.01/{name}.parquet").to_pydict()
    return dict(zip(t["doc_id"], t[column], strict=True))


def test_language_accuracy(spark):
    lang = labelled("documents", "lang")
    rows = [r for r in QUERIES["op9_language"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows)


def test_quality_accuracy(spark):
    quality = labelled("labels", "quality")
    rows = [r for r in QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in quality]
    assert len(rows) > 50 and sum(r.predicted == quality[r.doc_id] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def check_shards(rows, texts_of_rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [sum(r.size for r in own) for own in by.values()]
    assert set(by) == set(range(40)) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    homes = defaultdict(set)
    for r in rows:
        raw = (texts_of_rows[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        homes[raw].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    groups = Counter()
    for r in rows:
        groups[texts_of_rows[r.doc_id]] += r.size
    largest = max(groups.values())
    assert max(sizes) <= max(largest, 1.1 * sum(sizes) / 40)


def test_shards(spark, texts):
    check_shards(QUERIES["op8_shards"](spark, FOLDER).collect(), texts)


def test_pipeline(spark, texts):
    """Every stage against its brute-force counterpart."""
    contaminated = {
        r.doc_id for r in QUERIES["op2_decontaminate"](spark, FOLDER).where("contaminated").collect()
    }  # compared with SQL above
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_copies", "benchmark_passages", "mixture", "shards"]
    columns = docs.columns

    def step(name, docs):
        out = corpus_pipeline.cut(stages[name](spark, docs, FOLDER), name)
        return out, [r.doc_id for r in out.select("doc_id").collect()] if name != "shards" else out.collect()

    docs, kept = step("language", docs)
    assert docs.columns == columns and sorted(kept) == sorted(texts)
    docs, kept = step("near_copies", docs)
    want = [d for d, c in components({d: shingles(t, 5) for d, t in texts.items()}).items() if d == c]
    assert docs.columns == columns and sorted(kept) == sorted(want)
    docs, kept = step("benchmark_passages", docs)
    want = [d for d in want if d not in contaminated]
    assert docs.columns == columns and sorted(kept) == sorted(want)
    docs, kept = step("mixture", docs)
    times = Counter(kept)
    assert docs.columns == columns and set(times) == set(want) and max(times.values()) <= 2
    docs, rows = step("shards", docs)
    assert Counter(r.doc_id for r in rows) == times
    check_shards(rows, texts)
