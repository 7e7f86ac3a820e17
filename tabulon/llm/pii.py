"""Personal data in texts: four fixed patterns, and a semi-Markov conditional random field.

Zones are stretches of words with a digit or an at sign. A zone is cut into units (runs of
letters, runs of digits, single other characters); a segment is a run of at most MAX_UNITS
units with one type. The field scores whole segments by features of type and span, and
neighbouring types; its weights maximise the likelihood of a bounded sample of zones in
which the fixed patterns say what is personal. Dynamic programming over segments of bounded
length chooses boundaries and types together. Segments that are probable enough and touch
no base span are added to the base spans.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from tabulon.llm.common import col, fresh

KINDS = ["email", "ip", "card", "phone"]
OTHER = 4  # the type of units that belong to no entity
MAX_UNITS = 24
SAMPLE = 200  # zones of each kind learned from, and as many without any
EPOCHS, RATE, DECAY = 6, 0.2, 1e-3
LEAST_PROBABILITY = 0.9

# The base patterns. A digit run is entered at its beginning only and never given
# back in part, which finds the same leftmost matches in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

HIT = re.compile(r"[0-9@]")
UNIT = re.compile(r"[A-Za-z]+|[0-9]+|(?s:.)")

RESULT = "base array<struct<kind: int, start: int, end: int, text: string>>, added array<struct<kind: int, start: int, end: int, text: string>>"
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping: to the left of each domain as far as the local part may
    go, but not into the match before."""
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    found: list[Span] = []
    if "@" in text:
        found += [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit or an at sign; those that only one space parts are one zone, and a
    plus or bracket that stands alone before one belongs to it."""
    at, open_ = 0, None
    while hit := HIT.search(text, at):
        begin = hit.start()
        while begin > at and not text[begin - 1].isspace():
            begin -= 1
        end = hit.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        if open_ and begin == open_[1] + 1 and text[open_[1]] == " ":
            open_ = open_[0], end
        else:
            if open_:
                yield open_
            open_ = begin, end
        at = end
    if open_:
        yield open_


def _allowed(kind: int, piece: str, digits: int, units: list[str]) -> bool:
    """Whether a span can be of a kind at all: a necessary form, wider than the patterns."""
    if kind == 0:
        return piece.count("@") == 1 and units[0][0].isalnum() and units[-1][0].isalnum() and not any(u.isspace() for u in units)
    if kind == 1:
        return len(units) == 7 and piece.count(".") == 3 and all(u.isdigit() for u in units[::2])
    if any(u[0] not in "0123456789 -().+" for u in units) or not units[-1].isdigit():
        return False
    if kind == 2:
        return 12 <= digits <= 19 and units[0].isdigit()
    return 7 <= digits <= 15 and (units[0].isdigit() or units[0] in "+(")


def _neighbour(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def features(kind: int, piece: str, units: list[str], left: str, right: str) -> list[str]:
    """Features of a whole segment; `left` and `right` are the characters beside it."""
    names = ["bias", "left " + _neighbour(left), "right " + _neighbour(right)]
    if kind == OTHER:
        unit = units[0]
        names += ["digits" if unit.isdigit() else "letters" if unit.isalpha() else "space" if unit.isspace() else "sign " + unit]
        names.append(f"length {min(len(unit), 8)}")
    else:
        groups = [u for u in units if u.isdigit()]
        digits = "".join(groups)
        names += [f"digits {min(len(digits), 20)}", f"groups {min(len(groups), 8)}", "first " + _neighbour(piece[0])]
        names += sorted({"sign " + u for u in units if not u.isalnum()})
        names.append(f"shape {'-'.join(str(min(len(g), 5)) for g in groups[:6])}")
        if kind in (2, 3):
            names.append("luhn" if luhn(digits) else "no luhn")
            names.append("one digit throughout" if len(set(digits)) == 1 else "several digits")
        if kind == 1:
            names.append("octets" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "no octets")
        if kind == 0:
            tail = piece.rpartition("@")[2]
            names += [f"dots {min(tail.count('.'), 4)}", f"last {'letters' if units[-1].isalpha() else 'other'}"]
    return [f"{kind} {n}" for n in names]


class Lattice:
    """A zone's units and all segments that may end at each of them."""

    def __init__(self, text: str, start: int, end: int):
        cuts = [(m.start(), m.end()) for m in UNIT.finditer(text, start, end)]
        self.cuts = cuts
        words = [text[a:b] for a, b in cuts]
        self.segments: list[list[tuple[int, int, list[str]]]] = []  # by last unit: first unit, kind, features
        for j, (_, b) in enumerate(cuts):
            right = text[b : b + 1]
            own = [(j, OTHER, features(OTHER, words[j], words[j : j + 1], text[cuts[j][0] - 1 : cuts[j][0]], right))]
            digits, plain = 0, words[j].isalnum()
            for i in range(j, max(-1, j - MAX_UNITS), -1):
                if words[i].isspace() and words[i] != " " or not plain:
                    break
                digits += len(words[i]) * words[i].isdigit()
                a = cuts[i][0]
                if digits > 4 * MAX_UNITS or not (digits or "@" in words[i : j + 1]):
                    continue
                piece = text[a:b]
                for kind in range(OTHER):
                    if _allowed(kind, piece, digits, words[i : j + 1]):
                        own.append((i, kind, features(kind, piece, words[i : j + 1], text[a - 1 : a] if a else "", right)))
            self.segments.append(own)

    def scored(self, weights: dict[str, float]) -> list[list[tuple[int, int, float]]]:
        return [[(i, k, sum(weights.get(f, 0.0) for f in names)) for i, k, names in own] for own in self.segments]


def _log_sum(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def _transition(weights: dict[str, float], before: int, kind: int) -> float:
    return weights.get(f"{before}>{kind}", 0.0)


def marginals(lattice: Lattice, weights: dict[str, float]) -> tuple[dict[tuple[int, int, int], float], dict[str, float]]:
    """Probability of each segment (first unit, last unit, kind), and expected transitions."""
    scored, n = lattice.scored(weights), len(lattice.cuts)
    kinds = range(OTHER + 1)
    forward = [[-math.inf] * (OTHER + 1) for _ in range(n + 1)]
    forward[0][OTHER] = 0.0
    for j, own in enumerate(scored):
        ways = defaultdict(list)
        for i, k, s in own:
            ways[k] += [forward[i][p] + s + _transition(weights, p, k) for p in kinds if forward[i][p] > -math.inf]
        for k, v in ways.items():
            forward[j + 1][k] = _log_sum(v)
    backward = [[[] for _ in kinds] for _ in range(n + 1)]
    backward[n] = [[0.0] for _ in kinds]
    done = [[-math.inf] * (OTHER + 1) for _ in range(n + 1)]
    for j in range(n, -1, -1):
        done[j] = [_log_sum(v) for v in backward[j]]
        if j:
            for i, k, s in scored[j - 1]:
                for p in kinds:
                    backward[i][p].append(s + _transition(weights, p, k) + done[j][k])
    total = _log_sum([f + b for f, b in zip(forward[n], done[n], strict=True)])
    out, moves = {}, defaultdict(float)
    for j, own in enumerate(scored):
        for i, k, s in own:
            mass = 0.0
            for p in kinds:
                if forward[i][p] > -math.inf:
                    v = math.exp(min(0.0, forward[i][p] + s + _transition(weights, p, k) + done[j + 1][k] - total))
                    moves[f"{p}>{k}"] += v
                    mass += v
            out[i, j, k] = mass
    return out, moves


def decode(lattice: Lattice, weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """The best segmentation: (first unit, last unit, kind), without those of no entity."""
    scored, n = lattice.scored(weights), len(lattice.cuts)
    best = [[(-math.inf, None)] * (OTHER + 1) for _ in range(n + 1)]
    best[0][OTHER] = (0.0, None)
    for j, own in enumerate(scored):
        for i, k, s in own:
            for p in range(OTHER + 1):
                value = best[i][p][0] + s + _transition(weights, p, k)
                if value > best[j + 1][k][0]:
                    best[j + 1][k] = (value, (i, p))
    kind = max(range(OTHER + 1), key=lambda k: best[n][k][0])
    out, j = [], n
    while j:
        i, before = best[j][kind][1]
        if kind != OTHER:
            out.append((i, j - 1, kind))
        j, kind = i, before
    return out[::-1]


def gold(lattice: Lattice, spans: list[Span]) -> list[tuple[int, int, int]]:
    """The base spans of a zone as segments, then units of no entity; of spans that overlap
    the first kind counts. None where a span is no segment of the lattice."""
    first = {a: u for u, (a, _) in enumerate(lattice.cuts)}
    last = {b: u for u, (_, b) in enumerate(lattice.cuts)}
    taken, out = [False] * len(lattice.cuts), []
    for kind, a, b in sorted(spans):
        i, j = first.get(a), last.get(b)
        if i is None or j is None or any(taken[i : j + 1]) or not any((x[0], x[1]) == (i, kind) for x in lattice.segments[j]):
            continue
        taken[i : j + 1] = [True] * (j + 1 - i)
        out.append((i, j, kind))
    return sorted(out + [(u, u, OTHER) for u, t in enumerate(taken) if not t])


def train(examples: list[str]) -> dict[str, float]:
    """Weights that maximise the penalised likelihood of the base spans in the examples, by
    stochastic gradient steps in a fixed order."""
    weights: dict[str, float] = defaultdict(float)
    prepared = []
    for text in examples:
        spans = base_spans(text)
        for start, end in zones(text):
            lattice = Lattice(text, start, end)
            prepared.append((lattice, gold(lattice, [s for s in spans if start <= s[1] and s[2] <= end])))
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for lattice, truth in prepared:
            expected, moves = marginals(lattice, weights)
            names = {(i, j, k): f for j, own in enumerate(lattice.segments) for i, k, f in own}
            change: dict[str, float] = defaultdict(float)
            before = OTHER
            for segment in truth:
                for f in names[segment]:
                    change[f] += 1
                change[f"{before}>{segment[2]}"] += 1
                before = segment[2]
            for segment, mass in expected.items():
                for f in names[segment]:
                    change[f] -= mass
            for move, mass in moves.items():
                change[move] -= mass
            for f, c in change.items():
                weights[f] += rate * (c - DECAY * weights[f])
    return dict(weights)


def find(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and the further ones of the field, by kind and start."""
    if not HIT.search(text):
        return [], []
    base, added = base_spans(text), []
    edges = sorted((a, b) for _, a, b in base)
    at = 0
    for start, end in zones(text):
        while at < len(edges) and edges[at][1] <= start:
            at += 1
        inside = [e for e in edges[at : at + 64] if e[0] < end]
        if inside and all(any(a <= m.start() < b for a, b in inside) for m in HIT.finditer(text, start, end)):
            continue  # nothing is left that could be added
        lattice = Lattice(text, start, end)
        if not any(len(own) > 1 for own in lattice.segments):
            continue
        chosen = decode(lattice, weights)
        if chosen:
            probable, _ = marginals(lattice, weights)
            for i, j, kind in chosen:
                a, b = lattice.cuts[i][0], lattice.cuts[j][1]
                if probable[i, j, kind] >= LEAST_PROBABILITY and not any(x < b and a < y for x, y in edges):
                    added.append((kind, a, b))
    return base, sorted(added)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The zones of a task with their surroundings: of each kind those of the least hashes."""
    held: dict[int, dict[str, int]] = defaultdict(dict)
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py() or ""
            if not HIT.search(text):
                continue
            spans = base_spans(text)
            for start, end in zones(text):
                if end - start > 400:
                    continue  # an example, not a result: such a zone teaches little
                kind = next((k for k, a, b in spans if start <= a and b <= end), OTHER)
                example = text[max(0, start - 10) : end + 10]
                held[kind][example] = zlib.crc32(example.encode())
        for kind, examples in held.items():
            if len(examples) > 4 * SAMPLE:
                held[kind] = dict(sorted(examples.items(), key=lambda x: (x[1], x[0]))[:SAMPLE])
    rows = [(k, h, e) for k, examples in held.items() for e, h in sorted(examples.items(), key=lambda x: (x[1], x[0]))[:SAMPLE]]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string()), strict=True)], names=["kind", "hash", "example"])


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Weights learned from at most SAMPLE zones of each kind and of none, those of the least
    hashes among all texts. Without any zone there are no weights, and nothing is added."""
    found = docs.select(col(text_col).alias("text")).mapInArrow(_examples, "kind int, hash bigint, example string").distinct()
    # A task gives at most SAMPLE of each kind.
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("hash", "example"))
    chosen = found.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).orderBy("hash", "example").collect()
    return train([r["example"] for r in chosen])


def _finder(shared) -> Column:
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = shared.value
        for batch in batches:
            columns: list[list] = [[], []]
            for value in batch:
                text = value.as_py() or ""
                for column, spans in zip(columns, find(text, weights), strict=True):
                    column.append([{"kind": k, "start": a, "end": b, "text": text[a:b]} for k, a, b in spans])
            yield pa.StructArray.from_arrays([pa.array(c, span) for c in columns], names=["base", "added"])

    return run.asNondeterministic()  # evaluated once, although a filter reads it too


def find_personal_data(
    docs: DataFrame, weights: dict[str, float], text_col: str = "text", result: str = "personal"
) -> tuple[DataFrame, str]:
    """`docs` with one more struct column, and that column's name (`result`, made longer
    where the input has such a column). Its fields base and added are arrays of (kind, start,
    end, text) in code points, by kind and start.

    Null and empty texts have no spans. Rows that repeat get equal spans.
    """
    name = fresh(docs, result)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.withColumn(name, _finder(shared)(col(text_col))), name
