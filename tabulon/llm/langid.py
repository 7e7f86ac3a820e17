"""Language identification with one interpolated Kneser-Ney character model per language.

Counts of character n-grams come from a bounded sample of labelled rows; the smoothed
probabilities of all languages stand side by side in sorted arrays of n-gram hashes. The
language with the lowest cross-entropy per character wins. Limits for rejection come from
sample rows that the counts have not seen.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tabulon.llm.common import col, fresh
from tabulon.llm.words import U, mix

ORDER = 4
ROWS_PER_LANGUAGE = 4000  # about so many labelled rows of each language are learned from
GRAMS_PER_LANGUAGE = 200_000  # of the highest order; beyond it, the rarest counts go first
CALIBRATION = 8  # one sample row in so many sets the limits and is not counted
SLACK = 2.0  # the limit, in times the largest cross-entropy of such a row: text in two languages passes
SHORT = 20  # texts of fewer characters are never rejected for their cross-entropy
EVIDENCE = 50  # characters that count as independent in the score
RESULT = "lang string, score double, cross_entropy double, n_symbols bigint, rejected boolean"
UNDETERMINED = "und"

_LETTERS = 0x33480  # code points from here on are no letters
_SYMBOL: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """For each code point: its lower-case letter's code point, or 0."""
    if not _SYMBOL:
        out = np.zeros(0x110000, dtype=np.uint32)
        for code in range(_LETTERS):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                out[code] = ord(low) if len(low) == 1 else code
        _SYMBOL.append(out)
    return _SYMBOL[0]


def sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row and where each text begins. Runs of other characters
    are one 0; each text begins with a 0 of its own."""
    codes = np.frombuffer("".join("\n" + t for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    symbols = _symbols()[codes]
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    keep[begins] = True
    return symbols[keep], np.cumsum(keep)[begins] - 1


def gram_keys(symbols: np.ndarray, order: int) -> list[np.ndarray]:
    """keys[n - 1][i]: hash of the n symbols that end at i; meaningful from i = n - 1 on."""
    with np.errstate(over="ignore"):
        wide = (symbols.astype(np.uint64) + U(1)) * U(0xD1342543DE82EF95)
        keys = [mix(wide)]
        for n in range(2, order + 1):
            longer = np.zeros_like(wide)
            longer[n - 1 :] = mix(keys[-1][n - 1 :] ^ (wide[: len(wide) - n + 1] + U(n)))
            keys.append(longer)
    return keys


def text_groups(column: pa.Array, characters: int = 1 << 18) -> Iterator[list[str]]:
    """Runs of texts of about so many characters; a null is an empty text."""
    group, size = [], 0
    for value in column:
        text = value.as_py() or ""
        group.append(text)
        size += len(text)
        if size >= characters:
            yield group
            group, size = [], 0
    if group:
        yield group


@dataclass
class Grams:
    """A sorted hash array: keys, a row of values for each, and an index of the top bits."""

    keys: np.ndarray
    values: np.ndarray
    shift: int = 0
    start: np.ndarray = field(default=None)

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Grams:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        bits = max(4, int(len(keys)).bit_length() + 1)
        start = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        keys = np.concatenate([keys, [U(0)]])  # a place to look for what lies behind the last key
        return Grams(keys, values, 64 - bits, start)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = (wanted >> U(self.shift)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        found = np.where((self.keys[at] == wanted) & (at < end), at, -1)
        open_ = np.flatnonzero((found < 0) & (at + 1 < end))
        step = 1
        while len(open_):
            here = at[open_] + step
            hit = self.keys[here] == wanted[open_]
            found[open_[hit]] = here[hit]
            open_ = open_[~hit & (here + 1 < end[open_])]
            step += 1
        return found


@dataclass
class Model:
    langs: list[str]
    order: int
    root: np.ndarray  # log probability of a symbol that no language has seen
    grams: list[Grams]  # by order from 1: log probabilities
    backoff: list[Grams]  # by length of the context from 1: log weights of the next lower order
    limits: np.ndarray

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol by text and language, and the number of symbols."""
        symbols, begins = sequence(texts)
        ends = np.concatenate([begins[1:], [len(symbols)]])
        if not self.langs:
            return np.zeros((len(texts), 1)), ends - begins - 1
        keys = gram_keys(symbols, self.order)
        place = np.arange(len(symbols))
        place -= np.repeat(begins, ends - begins)  # symbols that stand before, in the same text
        logs = np.empty((len(symbols), len(self.langs)), dtype=np.float32)
        self._fill(logs, keys, place, np.arange(len(symbols)), self.order)
        logs[begins] = 0
        n = ends - begins - 1
        total = np.add.reduceat(logs, begins, axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n

    def _fill(self, logs: np.ndarray, keys: list[np.ndarray], place: np.ndarray, rows: np.ndarray, order: int) -> None:
        """Log probabilities of the symbols at `rows`, given up to order - 1 before each."""
        if not len(rows):
            return
        if order == 0:
            logs[rows] = self.root
            return
        able = place[rows] >= order - 1
        found = np.where(able, self.grams[order - 1].find(keys[order - 1][rows]), -1)
        hit = found >= 0
        logs[rows[hit]] = self.grams[order - 1].values[found[hit]]
        lower = rows[~hit]
        self._fill(logs, keys, place, lower, order - 1)
        if order > 1:
            weighted = lower[place[lower] >= order - 1]
            context = self.backoff[order - 2].find(keys[order - 2][weighted - 1])
            known = context >= 0
            logs[weighted[known]] += self.backoff[order - 2].values[context[known]]


def _key(gram: str) -> np.ndarray:
    return np.array([ord(c) if c != " " else 0 for c in gram], dtype=np.uint32)


def _keys_of(grams: list[str], n: int) -> np.ndarray:
    if not grams:
        return np.zeros(0, dtype=np.uint64)
    symbols = np.concatenate([_key(g) for g in grams])
    return gram_keys(symbols, n)[n - 1][n - 1 :: n]


def kneser_ney(counts: dict[str, dict[str, int]], order: int) -> Model:
    """The model of counts of n-grams of the highest order, by language; a space in an
    n-gram stands for a run of characters that are no letters."""
    langs = sorted(counts)
    by_order: list[list[dict[str, int]]] = []
    level = [counts[lang] for lang in langs]
    by_order.append(level)
    for _ in range(order - 1):  # below the highest order, distinct continuations count
        lower = []
        for grams in level:
            seen: dict[str, int] = defaultdict(int)
            for g in grams:
                seen[g[1:]] += 1
            lower.append(dict(seen))
        by_order.append(lower)
        level = lower
    by_order.reverse()
    alphabet = set().union(*[set(g) for g in by_order[0]]) if langs else set()
    below = [defaultdict(lambda p=1.0 / (len(alphabet) + 1): p) for _ in langs]
    grams_out, backoff_out, root = [], [], np.zeros(len(langs), dtype=np.float32)
    for n, per_lang in enumerate(by_order, start=1):
        union = sorted(set().union(*per_lang)) if langs else []
        contexts = sorted({g[:-1] for g in union})
        values = np.empty((len(union), len(langs)), dtype=np.float32)
        weights = np.zeros((len(contexts), len(langs)), dtype=np.float32)
        above = []
        for k, seen in enumerate(per_lang):
            once = sum(c == 1 for c in seen.values())
            twice = sum(c == 2 for c in seen.values())
            cut = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            total, types = defaultdict(int), defaultdict(int)
            for g, c in seen.items():
                total[g[:-1]] += c
                types[g[:-1]] += 1
            weight = {h: cut * types[h] / total[h] for h in total}
            own = {
                g: max(seen.get(g, 0) - cut, 0) / total.get(g[:-1], 1) + weight.get(g[:-1], 1.0) * below[k][g[1:]]
                for g in union
            }
            above.append(own)
            values[:, k] = np.log([own[g] for g in union])
            weights[:, k] = np.log([weight.get(h, 1.0) for h in contexts])
            if n == 1:
                root[k] = np.log(weight.get("", 1.0) / (len(alphabet) + 1))
        grams_out.append(Grams.of(_keys_of(union, n), values))
        if n > 1:
            backoff_out.append(Grams.of(_keys_of(contexts, n - 1), weights))
        below = above
    return Model(langs, order, root, grams_out, backoff_out, np.full(max(1, len(langs)), np.inf))


def _count_grams(order: int):
    """From (lang, text) to (lang, gram, n): sums within each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                for texts in text_groups(batch.column(1).filter(pa.array(langs == lang)), 1 << 22):
                    symbols, begins = sequence(texts)
                    keys = gram_keys(symbols, order)[order - 1]
                    full = np.ones(len(symbols), dtype=bool)
                    for k in range(order - 1):
                        full[np.minimum(begins + k, len(symbols) - 1)] = False
                    at = np.flatnonzero(full)
                    _, first, n = np.unique(keys[at], return_index=True, return_counts=True)
                    windows = symbols[at[first][:, None] + np.arange(1 - order, 1)]
                    windows = np.where(windows == 0, 32, windows).astype(np.uint32)
                    grams = [row.tobytes().decode("utf-32-le") for row in windows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())],
                        names=["lang", "gram", "n"],
                    )

    return run


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    order: int = ORDER,
    rows_per_language: int = ROWS_PER_LANGUAGE,
    grams_per_language: int = GRAMS_PER_LANGUAGE,
) -> Model:
    """Learn from the rows of `docs` that have a language. About `rows_per_language` rows of
    each language are taken, by a hash of id and text: the same ones at any partitioning."""
    rows = docs.select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text"), col(id_col).alias("id")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return kneser_ney({}, order)
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20))
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1 << 20, -(-rows_per_language * (1 << 20) // n))).otherwise(share)
    sample = rows.where(place < share).withColumn("check", F.pmod(F.xxhash64("id", "text", F.lit(1)), F.lit(CALIBRATION)) == 0)
    counted = (
        sample.where(~F.col("check")).select("lang", "text")
        .mapInArrow(_count_grams(order), "lang string, gram string, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .persist()
    )
    try:
        spectrum = counted.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("grams")).collect()
        least = {}
        for lang in sizes:
            held, least[lang] = 0, 1
            for r in sorted((r for r in spectrum if r["lang"] == lang), key=lambda r: -r["n"]):
                held += r["grams"]
                if held > grams_per_language:
                    least[lang] = r["n"] + 1
                    break
        bound = F.lit(1)
        for lang, n in least.items():
            bound = F.when(F.col("lang") == lang, n).otherwise(bound)
        counts: dict[str, dict[str, int]] = defaultdict(dict)
        for r in counted.where(F.col("n") >= bound).collect():
            counts[r["lang"]][r["gram"]] = r["n"]
    finally:
        counted.unpersist()
    model = kneser_ney(counts, order)
    seen = sample.where("check").select("lang", predict(sample.sparkSession, model)(F.col("text")).alias("p"))
    largest = {
        r["lang"]: r["most"]
        for r in seen.where((F.col("p.lang") == F.col("lang")) & (F.col("p.n_symbols") >= SHORT))
        .groupBy("lang").agg(F.max("p.cross_entropy").alias("most")).collect()
    }
    model.limits = np.array([largest.get(lang, np.inf) * SLACK for lang in model.langs])
    return model


def predict(spark, model: Model) -> Column:
    """An Arrow function from a text to its language, score, cross-entropy (nats per
    symbol), number of symbols and whether it is rejected."""
    shared = spark.sparkContext.broadcast(model)
    names = [f.split()[0] for f in RESULT.split(", ")]

    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        langs = np.array([*model.langs, UNDETERMINED], dtype=object)
        for batch in batches:
            parts = []
            for texts in text_groups(batch):
                entropy, n = model.cross_entropies(texts)
                empty = n == 0  # one run of other characters: no letter
                best = entropy.argmin(axis=1)
                lowest = entropy[np.arange(len(texts)), best]
                weight = np.exp(-(entropy - lowest[:, None]) * np.minimum(n, EVIDENCE)[:, None])
                unknown = empty | (not model.langs)
                score = np.where(unknown, 0.0, 1.0 / weight.sum(axis=1))
                lang = langs[np.where(unknown, -1, best)]
                rejected = empty | ((lowest > model.limits[best]) & (n >= SHORT))
                parts.append((lang, score, np.where(unknown, 0.0, lowest), n, rejected))
            types = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(x) if parts else [], t) for x, t in zip(zip(*parts) if parts else [[]] * 5, types, strict=True)],
                names=names,
            )

    return run.asNondeterministic()  # evaluated once, although a filter reads it too


def identify(docs: DataFrame, model: Model, text_col: str = "text", result: str = "language") -> tuple[DataFrame, str]:
    """`docs` with one more struct column, and that column's name (`result`, made longer
    where the input has such a column): lang, score (0 to 1), cross_entropy, n_symbols and
    rejected.

    Null texts and texts without a letter get the language `und` with score 0 and are
    rejected. Equal cross-entropies go to the language first in alphabetical order. A model
    that has learned no language says `und` everywhere and rejects only texts without letters.
    """
    name = fresh(docs, result)
    return docs.withColumn(name, predict(docs.sparkSession, model)(col(text_col))), name
