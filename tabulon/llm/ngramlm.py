"""Language-model scores from a log-frequency Bloom filter.

Words and word pairs of the training texts are counted in sorted runs of hashes that Spark
deals out by their leading bits. Each merged bucket becomes one stretch of the filter: an
n-gram of count c is entered once for each level 1 .. floor(log2 c) + 1, so a count is read
back by probing level after level until one is missing. Each stretch is as long as its
entries need, so no word and no pair is left out. A small filter is broadcast for scoring.
A larger one stays a table: the texts are taken in chunks, the distinct words and pairs of
a chunk are dealt to the stretches, and the levels found are brought back to the chunk.
The filter knows n-grams by the upper 48 bits of their hashes, so that sorted runs pack well.

Beside the model, an exact add-a-tenth word score is made: counts of the most frequent
words are broadcast, the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.common import col, cut
from tabulon.llm.langid import Grams
from tabulon.llm.words import U, mix, text_blocks, word_keys

START, END = U(0x5354415254), U(0x454E44)  # contexts and tokens that are no words
FILTER_BITS = 1 << 24  # the largest filter that is broadcast: 2 MB
CHUNK = 1_000_000  # tokens, about, whose words and pairs are looked up together
BITS_PER_ENTRY = 10
PROBES = 4
BUCKET_BYTES = 32 << 20  # runs that one task merges, about
LEAST_BUCKETS = 256
FREQUENT = 1 << 19  # words whose counts are broadcast
PRIOR = 5.0  # weight of the word's own probability beside the pairs seen
ADD = 0.1
KEY = ~U(0xFFFF)  # the bits of a hash by which the filter knows an n-gram
RUN = 1_500_000  # entries a task keeps before it sorts them together

RUNS = "bucket int, words boolean, keys binary, counts binary"


def _tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word keys of a block with an end after each text, and where each text begins."""
    keys, bounds = word_keys(offsets, data)
    return np.insert(keys, bounds[1:], END), bounds[:-1] + np.arange(len(bounds) - 1)


def _pairs(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A key for each token together with the one before it."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begins] = START
    with np.errstate(over="ignore"):
        return mix(before * U(0xD1342543DE82EF95) + tokens) & KEY


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers with the bytes of one weight side by side, packed behind their number."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _widen(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, n).T).view("<u8").ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys of 48 bits by the steps between them."""
    return _squeeze(np.diff(keys >> U(16), prepend=U(0)))


def _walk(raw: bytes) -> np.ndarray:
    return np.cumsum(_widen(raw), dtype=np.uint64) << U(16)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _runs(words: bool, bits: int):
    """Texts to sorted runs: one row for each bucket with the keys and counts of a task."""

    def emit(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        edges = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(edges))
        counts = counts.astype(np.uint32)
        pack = [np.ndarray.tobytes] * 2 if words else [_steps, _squeeze]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int32()),
                pa.array(np.full(len(full), words)),
                pa.array([pack[0](keys[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
                pa.array([pack[1](counts[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
            ],
            names=["bucket", "words", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, offsets, data in text_blocks(batch.column(0)):
                tokens, begins = _tokens(offsets, data)
                keys, counts = np.unique(tokens if words else _pairs(tokens, begins), return_counts=True)
                held.append((keys, counts.astype(np.int64)))
                n += len(keys)
                if n > RUN:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    n = len(held[0][0])
                    if n > RUN // 2:
                        yield emit(*held[0])
                        held, n = [], 0
        if held:
            yield emit(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    return run


def _unpack(keys: pa.Array, counts: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    both = [
        np.concatenate([np.frombuffer(x.as_py(), dtype=t) for x in column] or [np.zeros(0, dtype=t)]) for column, t in ((keys, np.uint64), (counts, kind))
    ]
    return both[0], both[1].astype(np.int64)


def _merge_words(table: pa.Table) -> pa.Table:
    """All runs of a bucket as one, with its sums: words, tokens, and words by level."""
    keys, counts = _summed(*_unpack(table["keys"], table["counts"], np.uint32))
    levels = np.bincount(level_of(counts), minlength=64)
    return pa.table(
        {
            "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()),
            "keys": pa.array([keys.tobytes()], pa.binary()),
            "counts": pa.array([counts.astype(np.uint64).tobytes()], pa.binary()),
            "n_words": pa.array([len(keys)], pa.int64()),
            "n_tokens": pa.array([int(counts.sum())], pa.int64()),
            "levels": pa.array([levels.tolist()], pa.list_(pa.int64())),
        }
    )


def level_of(counts: np.ndarray) -> np.ndarray:
    """floor(log2 c) + 1, and 0 for 0."""
    return np.frexp(counts.astype(np.float64))[1] * (counts > 0)


def _places(keys: np.ndarray, level: np.ndarray | int, probe: int, stretch: np.ndarray) -> np.ndarray:
    """A bit of the bucket's stretch by level and probe."""
    with np.errstate(over="ignore"):
        spread = mix(keys ^ (np.asarray(level).astype(np.uint64) * U(0xA0761D6478BD642F)))
        step = (spread >> U(32)) | U(1)
        return ((((spread & U(0xFFFFFFFF)) + U(probe) * step) & U(0xFFFFFFFF)) * stretch) >> U(32)


STRETCHES = "bucket int, stretch bigint, bitmap binary, entries bigint"


def _fill(table: pa.Table) -> pa.Table:
    """The stretch of the filter for one bucket, from its words and runs of pairs."""
    is_word = table["words"]
    chosen = table.filter(is_word)
    words, word_counts = _unpack(chosen["keys"], chosen["counts"], np.uint64)
    rest = table.filter(pa.compute.invert(is_word))
    none = [np.zeros(0, dtype=np.uint64)]
    pairs = np.concatenate([_walk(x.as_py()) for x in rest["keys"]] or none)
    pairs, pair_counts = _summed(pairs, np.concatenate([_widen(x.as_py()) for x in rest["counts"]] or none).astype(np.int64))
    words = words & KEY
    word_levels, pair_levels = level_of(word_counts), level_of(pair_counts)
    entries = int(word_levels.sum() + pair_levels.sum())
    stretch = 64 * max(1, -(-entries * BITS_PER_ENTRY // 64))
    if stretch >> 32:
        raise ValueError("a bucket has more entries than its stretch can address")
    bitmap = np.zeros(stretch, dtype=np.uint8)
    for keys, levels in ((words, word_levels), (pairs, pair_levels)):
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = keys[levels >= level]
            for probe in range(PROBES):
                bitmap[_places(own, level, probe, U(stretch))] = 1
    return pa.table(
        {
            "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()),
            "stretch": pa.array([stretch], pa.int64()),
            "bitmap": pa.array([np.packbits(bitmap).tobytes()], pa.binary()),
            "entries": pa.array([entries], pa.int64()),
        }
    )


def _levels(keys: np.ndarray, bitmap: np.ndarray, start: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """The highest level up to which all levels of each key are in its stretch of the bitmap."""
    out = np.zeros(len(keys), dtype=np.int64)
    active, level = np.arange(len(keys)), 1
    while len(active) and level < 64:
        for probe in range(PROBES):
            at = start[active] + _places(keys[active], level, probe, stretch[active])
            # packbits puts the first bit highest.
            set_ = (bitmap[(at >> U(3)).astype(np.int64)] >> (U(7) - (at & U(7))).astype(np.uint8)) & 1
            active = active[set_.astype(bool)]
            if not len(active):
                break
        out[active] = level
        level += 1
    return out


@dataclass
class Filter:
    bits: int  # buckets, as a power of two
    starts: np.ndarray  # where the stretch of each bucket begins; buckets without entries share an empty one
    stretches: np.ndarray  # bits of each bucket
    bitmap: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        bucket = (keys >> U(64 - self.bits)).astype(np.int64)
        return _levels(keys & KEY, self.bitmap, self.starts[bucket], self.stretches[bucket])


def count_at(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level: 1, 2.5, 5.5, 11.5, ..."""
    return np.where(levels > 0, 1.5 * np.exp2(levels - 1.0) - 0.5, 0.0)


@dataclass
class Model:
    """What fit() has made. `vocabulary` holds the exact word counts, packed by bucket."""

    filter: Broadcast | None  # None if the filter is larger than what is broadcast
    stretches: DataFrame  # the filter by bucket
    bits: int
    frequent: Broadcast
    vocabulary: DataFrame
    least: int  # counts from here on are in `frequent`
    n_docs: int
    n_tokens: int
    n_words: int

    @property
    def denominator(self) -> float:
        return self.n_tokens + ADD * (self.n_words + 1)


def fit(docs: DataFrame, text_col: str = "text", filter_bits: int = FILTER_BITS, frequent: int = FREQUENT) -> Model:
    """Count the words and word pairs of all texts of `docs`; a null text has an end only.
    An empty table gives a model without counts."""
    spark = docs.sparkSession
    texts = docs.select(col(text_col).alias("text"))
    n_docs, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("bigint"))).first()
    # Entries are about 12 bytes each, and there is one for every six bytes of text at most, or so.
    buckets = max(LEAST_BUCKETS, 2 * (size or 0) // BUCKET_BYTES)
    bits = (buckets - 1).bit_length()
    vocabulary = cut(
        texts.mapInArrow(_runs(True, bits), RUNS).groupBy("bucket").applyInArrow(
            _merge_words, "bucket int, keys binary, counts binary, n_words bigint, n_tokens bigint, levels array<bigint>"
        ),
        "vocabulary",
    )
    n_words, n_tokens = vocabulary.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    by_level = {r["level"]: r["n"] for r in vocabulary.select(F.posexplode("levels").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()}
    level, held = 64, 0
    while level > 1 and held + by_level.get(level - 1, 0) <= frequent:
        level -= 1
        held += by_level.get(level, 0)
    least = 1 << (level - 1)

    pairs = texts.mapInArrow(_runs(False, bits), RUNS)
    words = vocabulary.select("bucket", F.lit(True).alias("words"), "keys", "counts")
    stretches = cut(pairs.unionByName(words).groupBy("bucket").applyInArrow(_fill, STRETCHES), "filter")
    size = stretches.agg(F.sum("stretch")).first()[0] or 0
    shared = _gathered(stretches, bits, size) if size <= filter_bits else None
    top = vocabulary.select("keys", "counts").mapInArrow(_rows_of(least, None), "key bigint, c bigint").toArrow()
    table = Grams.of(top["key"].to_numpy().view(np.uint64), top["c"].to_numpy())
    context = spark.sparkContext
    shared = context.broadcast(shared) if shared else None
    return Model(shared, stretches, bits, context.broadcast(table), vocabulary, least, n_docs, n_tokens or 0, n_words or 0)


def _gathered(stretches: DataFrame, bits: int, size: int) -> Filter:
    """The whole filter on the driver, behind an empty stretch for buckets without entries."""
    starts, lengths = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, 64, dtype=np.uint64)
    bitmap, at = np.zeros((64 + size) >> 3, dtype=np.uint8), 64
    for r in stretches.select("bucket", "stretch", "bitmap").toLocalIterator():
        starts[r["bucket"]], lengths[r["bucket"]] = at, r["stretch"]
        bitmap[at >> 3 : (at + r["stretch"]) >> 3] = np.frombuffer(r["bitmap"], dtype=np.uint8)
        at += r["stretch"]
    return Filter(bits, starts, lengths, bitmap)


def _rows_of(low: int, high: int | None):
    """Packed words to (key, c), those with low <= c < high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys, counts = _unpack(batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), np.uint64)
                own = (counts >= low) & (counts < high if high is not None else True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), pa.array(counts[own])], names=["key", "c"])

    return run


RARE = "rare array<struct<key: bigint, m: bigint>>"
SCORED = "id {id}, extra boolean, digest bigint, n_tokens bigint, n_known bigint, base double, " + RARE + ", score double"
SENT = "chunk bigint, bucket int, packed binary, docs array<struct<id: {id}, extra: boolean, n_tokens: bigint>>"
_NAMES = ["id", "extra", "digest", "n_tokens", "n_known", "base", "rare"]


def _exact(tokens: np.ndarray, begins: np.ndarray, table: Grams, denominator: float) -> list[pa.Array]:
    """digest, n_tokens, n_known, base and rare of each text of a block."""
    lengths = np.diff(np.append(begins, len(tokens)))
    distinct, inverse = np.unique(tokens, return_inverse=True)
    # Exact counts of frequent words; the others are left for a join.
    row = table.find(distinct)
    exact = np.where(row >= 0, table.values[np.maximum(row, 0)], 0) if len(table.values) else np.zeros(len(distinct), dtype=np.int64)
    known = exact > 0
    base = np.where(known, np.log10((exact + ADD) / denominator), 0.0)[inverse]
    place = np.arange(len(tokens), dtype=np.uint64) - np.repeat(begins, lengths).astype(np.uint64)
    with np.errstate(over="ignore"):
        digest = np.add.reduceat(mix(tokens + place * U(0xA0761D6478BD642F)), begins)
    # Rare words by text, each once with its number.
    at = np.flatnonzero(~known[inverse])
    doc = np.searchsorted(begins, at, side="right") - 1
    order = np.lexsort((inverse[at], doc))
    doc, word_at = doc[order], inverse[at][order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word_at[1:] != word_at[:-1])])) if len(doc) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(first, len(doc)))
    ends = np.searchsorted(doc[first], np.arange(len(begins) + 1)).astype(np.int32)
    rare = pa.ListArray.from_arrays(
        pa.array(ends), pa.StructArray.from_arrays([pa.array(distinct[word_at[first]].view(np.int64)), pa.array(times, pa.int64())], names=["key", "m"])
    )
    return [
        pa.array(digest.view(np.int64)), pa.array(lengths, pa.int64()), pa.array(np.add.reduceat(known[inverse].astype(np.int64), begins)),
        pa.array(np.add.reduceat(base, begins)), rare.cast(pa.list_(pa.struct([("key", pa.int64()), ("m", pa.int64())]))),
    ]


def _sums(word: np.ndarray, both: np.ndarray, begins: np.ndarray, n_docs: int, denominator: float) -> np.ndarray:
    """The model's score of each text from the quantised counts of its words and pairs."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[begins] = n_docs
    both = np.minimum(both, np.minimum(before, word))
    own = np.minimum(1.0, (word + ADD) / denominator)
    return np.add.reduceat(np.log10((both + PRIOR * own) / (before + PRIOR)), begins)


def _score(model_filter: Broadcast, frequent: Broadcast, n_docs: int, denominator: float):
    """(id, extra, text) to SCORED with a filter that is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = model_filter.value
        for batch in batches:
            for row, offsets, data in text_blocks(batch.column(2)):
                tokens, begins = _tokens(offsets, data)
                distinct, inverse = np.unique(tokens, return_inverse=True)
                word, both = count_at(bloom.levels(distinct))[inverse], count_at(bloom.levels(_pairs(tokens, begins)))
                sums = pa.array(_sums(word, both, begins, n_docs, denominator))
                own = [batch.column(i).slice(row, len(begins)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *_exact(tokens, begins, frequent.value, denominator), sums], names=[*_NAMES, "score"])

    return run


def _send(bits: int):
    """(id, extra, text) to SENT: for each chunk a row for every bucket with the chunk's keys
    in it, and one with a bucket below 0 that has the texts, as numbers of words."""

    def emit(chunk: int, tokens: list[np.ndarray], columns: list[list[pa.Array]]) -> pa.RecordBatch:
        tokens, columns = np.concatenate(tokens), [pa.concat_arrays(c) for c in zip(*columns, strict=True)]
        lengths = columns[2].to_numpy()
        words, inverse, times = np.unique(tokens, return_inverse=True, return_counts=True)
        keys = np.unique(np.concatenate([words & KEY, _pairs(tokens, np.cumsum(lengths) - lengths)]))
        edges = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(edges))
        # Frequent words have small numbers, which pack well.
        order = np.argsort(-times, kind="stable")
        number = np.empty(len(words), dtype=np.uint64)
        number[order] = np.arange(len(words), dtype=np.uint64)
        numbers = _squeeze(number[inverse])
        packed = [_steps(keys[edges[b] : edges[b + 1]]) for b in full]
        packed.append(len(words).to_bytes(8, "little") + words[order].tobytes() + numbers)
        ends = np.append(np.zeros(len(full) + 1), len(lengths)).astype(np.int32)
        docs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=["id", "extra", "n_tokens"]))
        buckets = np.append(full, -1 - (chunk ^ (chunk >> 32) * 65_537) % (1 << 31)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(buckets), chunk), pa.int64()), pa.array(buckets), pa.array(packed, pa.binary()), docs], names=["chunk", "bucket", "packed", "docs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, columns, n = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for row, offsets, data in text_blocks(batch.column(2)):
                tokens, begins = _tokens(offsets, data)
                held.append(tokens)
                columns.append([*[batch.column(i).slice(row, len(begins)) for i in (0, 1)], pa.array(np.diff(np.append(begins, len(tokens))), pa.int64())])
                n += len(tokens)
                if n >= CHUNK:
                    yield emit(chunk, held, columns)
                    chunk, held, columns, n = chunk + 1, [], [], 0
        if held:
            yield emit(chunk, held, columns)

    return run


def _look_up(sent: pa.Table, stretches: pa.Table) -> pa.Table:
    """The keys of a bucket to their levels, a byte each; the texts of a chunk as they are."""
    if not len(sent) or sent["bucket"][0].as_py() < 0:
        return sent
    packed = []
    for raw in sent["packed"]:
        keys = _walk(raw.as_py())
        if len(stretches):
            bitmap = np.frombuffer(stretches["bitmap"][0].as_buffer(), dtype=np.uint8)
            stretch = np.broadcast_to(U(stretches["stretch"][0].as_py()), len(keys))
            packed.append(_levels(keys, bitmap, np.zeros(len(keys), dtype=np.uint64), stretch).astype(np.uint8).tobytes())
        else:
            packed.append(bytes(len(keys)))
    return sent.set_column(sent.schema.get_field_index("packed"), "packed", pa.array(packed, pa.binary()))


def _bring_back(frequent: Broadcast, n_docs: int, denominator: float):
    """All rows of a chunk to SCORED."""

    def run(table: pa.Table) -> pa.Table:
        buckets, packed = table["bucket"].to_numpy(), table["packed"].to_pylist()
        home = int(np.argmin(buckets))
        order = [int(i) for i in np.argsort(buckets) if i != home]
        counts = count_at(np.frombuffer(b"".join(packed[i] for i in order), dtype=np.uint8).astype(np.int64))
        ids, extra, lengths = table["docs"].slice(home, 1).combine_chunks().flatten().flatten()
        n = int.from_bytes(packed[home][:8], "little")
        words, numbers = np.frombuffer(packed[home], dtype=np.uint64, count=n, offset=8), _widen(packed[home][8 + 8 * n :])
        tokens, begins = words[numbers], np.cumsum(lengths.to_numpy()) - lengths.to_numpy()
        _, place = np.unique(np.concatenate([words & KEY, _pairs(tokens, begins)]), return_inverse=True)
        sums = _sums(counts[place[:n]][numbers], counts[place[n:]], begins, n_docs, denominator)
        return pa.table([ids, extra, *_exact(tokens, begins, frequent.value, denominator), pa.array(sums)], names=[*_NAMES, "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: Column | None = None) -> DataFrame:
    """One row (id, extra, n_tokens, n_known, base_score, score) for each row of `docs`.

    `score` is the model's log10 probability of the words and the end of the text,
    `base_score` that of the exact add-a-tenth word model, n_known the number of tokens that
    the training texts hold. `extra` is a boolean to carry along. Null and empty texts are
    one end. Rows that repeat id and words get equal results each; ids may be null.
    """
    flag = extra if extra is not None else F.lit(None).cast("boolean")
    id_type = docs.select(col(id_col)).schema[0].dataType.simpleString()
    read = docs.select(col(id_col).alias("id"), flag.alias("extra"), col(text_col).alias("text"))
    if model.filter is not None:
        found = read.mapInArrow(_score(model.filter, model.frequent, model.n_docs, model.denominator), SCORED.format(id=id_type))
    else:
        sent = read.mapInArrow(_send(model.bits), SENT.format(id=id_type))
        stretches = model.stretches.select("bucket", "stretch", "bitmap")
        levels = sent.groupBy("bucket").cogroup(stretches.groupBy("bucket")).applyInArrow(_look_up, SENT.format(id=id_type))
        found = levels.groupBy("chunk").applyInArrow(_bring_back(model.frequent, model.n_docs, model.denominator), SCORED.format(id=id_type))
    scored = cut(found, "scored")
    rows = scored.drop("rare")
    if model.n_words == 0 and model.n_tokens == 0:
        counts = docs.sparkSession.createDataFrame([], "key bigint, c bigint")
    else:
        counts = model.vocabulary.select("keys", "counts").mapInArrow(_rows_of(1, model.least), "key bigint, c bigint")
    # Rows that repeat id and words meet in one group, each with its own copy of the rare words.
    listed = scored.where(F.size("rare") > 0)
    words = listed.select("id", "digest", F.explode("rare").alias("w")).groupBy("id", "digest", F.col("w.key").alias("key")).agg(F.max("w.m").alias("m"))
    term = F.col("m") * F.log10((F.coalesce("c", F.lit(0)) + ADD) / F.lit(model.denominator))
    found = words.join(counts, "key", "left").groupBy(F.col("id").alias("of"), F.col("digest").alias("named")).agg(
        F.sum(term).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("also")
    )
    out = rows.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("named")), "left")
    return out.select(
        "id", "extra", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
