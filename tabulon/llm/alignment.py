"""Alignment of two tokenizers, with corpus-wide counts of the token pairs that overlap.

Two tokens of a text are linked if their byte ranges overlap. Counting in how many
documents a pair of ids is linked goes by external spill counting:

1. Tasks turn documents into pair-document records. When a chunk of documents is full its
   records are sorted by first id, second id and document, dealt to radix partitions by
   the first id, and each partition's run is written, compressed, to the shared folder.
2. The runs of a partition are merged through a heap over their first ids. Equal pairs
   meet there and are counted; as all pairs of a first id come out together, its highest
   count is known at once. Partitions with many runs are merged in parts first.
3. The runs are read once more beside the counts, and what each document gains by its
   records is summed within its chunk and sent back to it.

Only runs, counts and sums of chunks are moved; a text is read once. A first id that most
documents hold makes longer runs, whose parts are merged by different tasks; the counts of
one first id are never more than the second vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import uuid
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.common import col, cut
from tabulon.llm.units import SEGMENT, SPACE_MARK, Cutter, safe_blanks

RADIX = 64  # partitions by first id
CHUNK_RECORDS = 1 << 20  # records of a chunk, to which the last document may add its own
CHUNK_DOCS = 1 << 16
PART_BYTES = 32 << 20  # compressed runs that a task merges together
KEPT_UNITS = 1 << 19  # aligned units that a worker keeps, some 500 bytes each
SECOND = np.uint64(32)  # a pair is its first id, shifted by so many bits, and its second one

DOC_FIELDS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string"


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones as they
    are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, with the bytes of their ids."""

    def __init__(self, first: str, second: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first)
        self.first.encode_special_tokens = True  # their strings in a text are plain text
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        model, alphabet = json.loads(first)["model"]["vocab"], _byte_alphabet()
        self.first_bytes = [b""] * (max(model.values()) + 1)
        for entry, token in model.items():
            if all(c in alphabet for c in entry):
                self.first_bytes[token] = bytes(alphabet[c] for c in entry)
        self.second_bytes = []
        pieces = []
        for token in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(token)
            if self.second.is_byte(token):
                self.second_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.second.is_control(token) or self.second.is_unknown(token):
                self.second_bytes.append(b"")
            else:
                pieces.append(piece)
                self.second_bytes.append(piece.replace(SPACE_MARK, " ").encode("utf-8"))
        self.first_lengths = np.array([len(b) for b in self.first_bytes], dtype=np.int64)
        self.second_lengths = np.array([len(b) for b in self.second_bytes], dtype=np.int64)
        self.cutter = Cutter(safe_blanks(pieces))
        self.stem = len(self.second.encode("x"))

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units that each begin with a blank. The second library adds a space in front
        by itself; other blanks are put behind a letter, which no piece joins to them."""
        first = [e.ids for e in self.first.encode_batch(units, add_special_tokens=False)]
        spaced = [u[0] == " " and len(u) > 1 for u in units]
        second = self.second.encode([u[1:] if s else "x" + u for u, s in zip(units, spaced, strict=True)], num_threads=1)
        return first, [ids if s else ids[self.stem :] for ids, s in zip(second, spaced, strict=True)]


class Aligner:
    """Aligned units and their linked pairs, kept while a worker has room for them."""

    def __init__(self, vocabularies: Vocabularies) -> None:
        self.v = vocabularies
        self.clear()

    def clear(self) -> None:
        # unit -> tokens, tokens, groups, links (-1 if its bytes are not kept), groups as text,
        # where its links are among all
        self.kept: dict[str, tuple[int, int, int, int, str, int]] = {}
        self.pairs: dict[int, int] = {}  # pair -> its number
        self.links, self.n_links = np.zeros(1 << 16, dtype=np.int32), 0  # numbers of pairs

    def full(self) -> bool:
        return len(self.kept) >= KEPT_UNITS

    def learn(self, units: list[str]) -> None:
        """Encode new units with both tokenizers and cut them where tokens of both end."""
        v = self.v
        first, second = v.encode(units)
        good = [
            b"".join([v.first_bytes[i] for i in a]) == b"".join([v.second_bytes[i] for i in b]) == u.encode("utf-8")
            for u, a, b in zip(units, first, second, strict=True)
        ]
        for unit, fits in zip(units, good, strict=True):
            if not fits:
                self.kept[unit] = (0, 0, 0, -1, "", 0)
        units, first, second = ([x for x, fits in zip(xs, good, strict=True) if fits] for xs in (units, first, second))
        if not units:
            return
        a = np.array([i for ids in first for i in ids], dtype=np.int64)
        b = np.array([i for ids in second for i in ids], dtype=np.int64)
        a_ends, b_ends = np.cumsum(v.first_lengths[a]), np.cumsum(v.second_lengths[b])
        ends = np.union1d(a_ends, b_ends)  # between two of them lies one token of each: a link
        in_a, in_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        shared = (a_ends[in_a] == ends) & (b_ends[in_b] == ends)
        pairs = (a[in_a] << int(SECOND)) | b[in_b]
        distinct, where = np.unique(pairs, return_inverse=True)
        numbers = np.array([self.pairs.setdefault(p, len(self.pairs)) for p in distinct.tolist()], dtype=np.int32)[where]
        if self.n_links + len(numbers) > len(self.links):
            grown = np.zeros(2 * (self.n_links + len(numbers)), dtype=np.int32)
            grown[: self.n_links] = self.links[: self.n_links]
            self.links = grown
        self.links[self.n_links : self.n_links + len(numbers)] = numbers
        # Groups as text, cut at the shared ends.
        stop_a, stop_b = (in_a[shared] + 1).tolist(), (in_b[shared] + 1).tolist()
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, at_a, at_b = [], 0, 0
        for x, y in zip(stop_a, stop_b, strict=True):
            groups.append(f"{','.join(names_a[at_a:x])}|{','.join(names_b[at_b:y])}")
            at_a, at_b = x, y
        link, group, size_a, size_b = self.n_links, 0, 0, 0
        unit_ends = np.cumsum([len(ids) for ids in first])  # in tokens of the first kind
        link_stops = np.searchsorted(in_a, unit_ends).tolist()
        group_stops = np.searchsorted(np.array(stop_a), unit_ends, side="right").tolist()
        for unit, ids_a, ids_b, link_stop, group_stop in zip(units, first, second, link_stops, group_stops, strict=True):
            link_stop += self.n_links
            self.kept[unit] = (len(ids_a), len(ids_b), group_stop - group, link_stop - link, ";".join(groups[group:group_stop]), link)
            link, group = link_stop, group_stop
        self.n_links = link

    def find(self, units: list[str]) -> list[tuple[int, int, int, int, str, int]]:
        return list(map(self.kept.__getitem__, units))

    def linked(self, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Pair numbers of the links from each start on."""
        total = int(counts.sum())
        at = np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        return self.links[at].astype(np.int64)


class Chunk:
    """Documents, and the records of which pair is linked how often in which of them."""

    def __init__(self, aligner: Aligner, groups: bool) -> None:
        self.aligner, self.groups = aligner, groups
        self.name = uuid.uuid4().int >> 65
        self.docs: list[tuple] = []
        self.records: list[tuple[np.ndarray, np.ndarray]] = []  # pair number and document, count
        self.n_records = 0

    def full(self) -> bool:
        return self.n_records >= CHUNK_RECORDS or len(self.docs) >= CHUNK_DOCS or self.aligner.full()

    def add(self, rows: list[tuple[object, str]]) -> None:
        """Documents short enough to be looked at together."""
        aligner, cutter = self.aligner, self.aligner.v.cutter
        cut_up = [cutter.units(" " + text) if text else [] for _, text in rows]
        missing = list(set().union(*cut_up).difference(aligner.kept))
        if missing:
            aligner.learn(missing)
        starts, counts, numbers = [], [], []
        for (key, _), units in zip(rows, cut_up, strict=True):
            found = aligner.find(units)
            links = [f[3] for f in found]
            if -1 in links:
                found, links = [], []
            starts += [f[5] for f in found]
            counts += links
            numbers += [len(self.docs)] * len(found)
            digest = hashlib.sha256()
            self._finish(key, found, links, digest)
        if counts:
            counts = np.array(counts, dtype=np.int64)
            linked = aligner.linked(np.array(starts, dtype=np.int64), counts)
            self._record(linked * CHUNK_DOCS + np.repeat(np.array(numbers, dtype=np.int64), counts))

    def _finish(self, key: object, found: list[tuple], links: list[int], digest: hashlib._Hash) -> None:
        if not found:
            self.docs.append((key, 0, 0, 0, 0, "", "" if self.groups else None))
            return
        text = ";".join([f[4] for f in found])
        digest.update(text.encode())
        sums = [sum(map(itemgetter(k), found)) for k in range(3)]
        self.docs.append((key, *sums, sum(links), digest.hexdigest(), text if self.groups else None))

    def add_long(self, key: object, text: str) -> None:
        """A long document, a segment at a time; it counts only if all its bytes are kept."""
        aligner, cutter = self.aligner, self.aligner.v.cutter
        digest, sums, parts, whole, first = hashlib.sha256(), [0, 0, 0, 0], [], [], True
        number, n_records, before = len(self.docs), self.n_records, len(self.records)
        for segment in cutter.segments(" " + text):
            units = cutter.units(segment)
            missing = list(set(units).difference(aligner.kept))
            if missing:
                aligner.learn(missing)
            found = aligner.find(units)
            counts = np.array([f[3] for f in found], dtype=np.int64)
            if (counts < 0).any():
                self.records, self.n_records = self.records[:before], n_records
                self._finish(key, [], [], digest)
                return
            sums = [s + sum(map(itemgetter(k), found)) for k, s in enumerate(sums)]
            names = ";".join([f[4] for f in found])
            digest.update((names if first else ";" + names).encode())
            first = False
            if self.groups:
                whole.append(names)
            self._record(aligner.linked(np.array([f[5] for f in found], dtype=np.int64), counts) * CHUNK_DOCS + number)
            parts = self.records[before:]
            if len(parts) > 8:  # what the document has so far, each pair once
                self.records[before:] = [_summed(parts)]
                self.n_records = n_records + len(self.records[before][0])
        if len(self.records) - before > 1:
            self.records[before:] = [_summed(self.records[before:])]
            self.n_records = n_records + len(self.records[before][0])
        self.docs.append((key, *sums, digest.hexdigest(), ";".join(whole) if self.groups else None))

    def _record(self, linked: np.ndarray) -> None:
        linked.sort()
        first = np.flatnonzero(np.concatenate([[True], linked[1:] != linked[:-1]]))
        self.records.append((linked[first], np.diff(np.append(first, len(linked)))))
        self.n_records += len(first)

    def rows(self) -> Iterator[dict]:
        """The documents, then the run of each radix partition."""
        for index, doc in enumerate(self.docs):
            yield {"chunk": self.name, "bucket": -1, "index": index, "doc": doc}
        if not self.records:
            return
        key = np.concatenate([r[0] for r in self.records])
        times = np.concatenate([r[1] for r in self.records])
        number, doc = key // CHUNK_DOCS, key % CHUNK_DOCS
        pair_of = np.fromiter(self.aligner.pairs, dtype=np.uint64, count=len(self.aligner.pairs))
        used = np.unique(number)
        pairs = pair_of[used]
        bucket = (pairs >> SECOND) % np.uint64(RADIX)
        order = np.lexsort((pairs, bucket))
        rank = np.zeros(int(used[-1]) + 1, dtype=np.int64)
        rank[used[order]] = np.arange(len(used))
        pairs, bucket = pairs[order], bucket[order]
        order = np.argsort(rank[number] * CHUNK_DOCS + doc, kind="stable")
        place, doc, times = rank[number][order], doc[order], times[order]
        holders = np.bincount(place, minlength=len(pairs))
        stops = np.cumsum(holders)
        edges = np.searchsorted(bucket, np.arange(RADIX + 1, dtype=np.uint64)).tolist()
        for b, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if low < high:
                a, z = int(stops[low] - holders[low]), int(stops[high - 1])
                yield {
                    "chunk": self.name, "bucket": b,
                    "pairs": pack(pairs[low:high], holders[low:high]), "records": pack_records(doc[a:z], times[a:z]),
                }


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    times = np.zeros(len(key), dtype=np.int64)
    np.add.at(times, where, np.concatenate([p[1] for p in parts]))
    return key, times


def pack(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """A run of rising pairs with their counts."""
    steps = np.diff(pairs.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(steps.tobytes() + counts.astype(np.int64).tobytes(), 1)


def unpack(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(run)
    return np.cumsum(np.frombuffer(raw, np.uint64, len(raw) // 16)), np.frombuffer(raw, np.int64, offset=len(raw) // 2)


def pack_records(docs: np.ndarray, times: np.ndarray) -> bytes:
    """Documents of a run's pairs, one after the other, and how often each has the pair."""
    return zstandard.compress(docs.astype(np.uint16).tobytes() + times.astype(np.uint32).tobytes(), 1)


def unpack_records(records: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(records)
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint16, n), np.frombuffer(raw, np.uint32, n, 2 * n)


def merge(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the runs with their summed counts, rising. A heap hands out the runs by
    their next first id; the pairs of one first id are summed together."""
    unpacked = [unpack(r) for r in runs]
    if len(unpacked) == 1:
        return unpacked[0]
    blocks = []
    for pairs, _ in unpacked:
        first = pairs >> SECOND
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        blocks.append((first[starts].tolist(), np.append(starts, len(pairs)).tolist()))
    heap = [(ids[0], run, 0) for run, (ids, _) in enumerate(blocks)]
    heapq.heapify(heap)
    out_pairs, out_counts = [], []
    while heap:
        current, pieces = heap[0][0], []
        while heap and heap[0][0] == current:
            _, run, block = heap[0]
            ids, edges = blocks[run]
            pieces.append((unpacked[run][0][edges[block] : edges[block + 1]], unpacked[run][1][edges[block] : edges[block + 1]]))
            if block + 1 < len(ids):
                heapq.heapreplace(heap, (ids[block + 1], run, block + 1))
            else:
                heapq.heappop(heap)
        if len(pieces) == 1:
            pairs, counts = pieces[0]
        else:
            pairs, where = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
            counts = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(counts, where, np.concatenate([p[1] for p in pieces]))
        out_pairs.append(pairs)
        out_counts.append(counts)
    return np.concatenate(out_pairs), np.concatenate(out_counts)


def highest(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each pair whether its count is the highest of its first id."""
    first = pairs >> SECOND
    starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    top = np.maximum.reduceat(counts, starts)
    return counts == np.repeat(top, np.diff(np.append(starts, len(pairs))))


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(key: str, first: str, second: bytes) -> Aligner:
    """What a worker keeps from task to task; the next pair of tokenizers takes its place."""
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(Vocabularies(first, second))
    return _ALIGNERS[key]


def spill(docs: DataFrame, first_path: str, second_path: str, id_col: str, text_col: str, groups: bool) -> DataFrame:
    """Documents (bucket -1) and runs of pair-document records (bucket 0 to RADIX - 1)."""
    with open(first_path, encoding="utf-8") as a, open(second_path, "rb") as b:
        shared = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    key = uuid.uuid4().hex
    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"chunk bigint, bucket int, `index` int, id {id_type}, {DOC_FIELDS}, pairs binary, records binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(key, *shared.value)
        target = None
        chunk = Chunk(aligner, groups)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            rows = list(chunk.rows())
            for at in range(0, len(rows), 4096):
                yield _batch(rows[at : at + 4096], target)
            if aligner.full():
                aligner.clear()
            chunk = Chunk(aligner, groups)

        for batch in batches:
            target = batch.schema.field("id").type
            held, size = [], 0
            for key_value, text in zip(batch.column("id"), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if len(text) > SEGMENT:
                    chunk.add(held)
                    held, size = [], 0
                    if len(chunk.docs) >= CHUNK_DOCS:
                        yield from flush()
                    chunk.add_long(key_value, text)
                else:
                    held.append((key_value, text))
                    size += len(text)
                if size >= SEGMENT or chunk.full() or len(chunk.docs) + len(held) >= CHUNK_DOCS:
                    chunk.add(held)
                    held, size = [], 0
                    if chunk.full():
                        yield from flush()
            chunk.add(held)
            if chunk.full():
                yield from flush()
        if target is not None:
            yield from flush()

    return source.mapInArrow(run, schema)


def _batch(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    docs = [r.get("doc") or (None,) * 7 for r in rows]
    columns = {
        "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
        "index": pa.array([r.get("index") for r in rows], pa.int32()),
        "id": pa.array([None if d[0] is None else d[0].as_py() for d in docs], id_type),
    }
    for k, name in enumerate(["n_a", "n_b", "n_groups", "n_links"], 1):
        columns[name] = pa.array([d[k] for d in docs], pa.int64())
    for k, name in enumerate(["groups_sha256", "groups"], 5):
        columns[name] = pa.array([d[k] for d in docs], pa.string())
    for name in ("pairs", "records"):
        columns[name] = pa.array([r.get(name) for r in rows], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def _part(sizes: dict[int, int], by: Column) -> tuple[list[int], Column]:
    """How many parts each partition has, so that a part is about PART_BYTES, and a run's part."""
    parts = [max(1, -(-sizes.get(b, 0) // PART_BYTES)) for b in range(RADIX)]
    return parts, F.pmod(F.xxhash64(by), F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("bucket") + 1)).cast("int")


def count(runs: DataFrame) -> DataFrame:
    """One run (bucket, pairs) a partition, with the documents of each pair."""
    def merged(table: pa.Table) -> pa.Table:
        out = pack(*merge(table.column("pairs").to_pylist()))
        return pa.table({"bucket": table.column("bucket")[:1], "part": table.column("part")[:1], "pairs": pa.array([out], pa.binary())})

    sizes = {r["bucket"]: r["size"] for r in runs.groupBy("bucket").agg(F.sum(F.octet_length("pairs")).alias("size")).collect()}
    parts, part = _part(sizes, F.col("chunk"))
    level = runs.select("bucket", part.alias("part"), "pairs")
    while True:
        level = cut(level.groupBy("bucket", "part").applyInArrow(merged, "bucket int, part int, pairs binary"), "counts")
        if max(parts) == 1:
            return level.select("bucket", "pairs")
        sizes = {r["bucket"]: r["size"] for r in level.groupBy("bucket").agg(F.sum(F.octet_length("pairs")).alias("size")).collect()}
        # At least halved: a part of several runs is shorter than they are together.
        parts = [min(-(-sizes.get(b, 0) // PART_BYTES) or 1, -(-p // 2)) for b, p in enumerate(parts)]
        fold = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("bucket") + 1)
        level = level.withColumn("part", F.pmod(F.col("part"), fold).cast("int"))


def _gains(runs: pa.Table, counted: pa.Table) -> pa.Table:
    """What the documents of each run gain: links with the best count, and the sum of counts."""
    chunks, out = [], []
    if runs.num_rows:
        pairs, counts = unpack(counted.column("pairs")[0].as_py())
        best = highest(pairs, counts)
        for chunk, own, records in zip(runs.column("chunk"), runs.column("pairs"), runs.column("records"), strict=True):
            mine, holders = unpack(own.as_py())
            docs, times = unpack_records(records.as_py())
            at = np.repeat(np.searchsorted(pairs, mine), holders)
            sums = np.zeros((2, int(docs.max()) + 1), dtype=np.int64)
            np.add.at(sums[0], docs, np.where(best[at], times, 0).astype(np.int64))
            np.add.at(sums[1], docs, counts[at] * times)
            found = np.flatnonzero(sums[1])
            chunks.append(chunk.as_py())
            out.append(zstandard.compress(found.astype(np.int64).tobytes() + sums[:, found].tobytes(), 1))
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "gains": pa.array(out, pa.binary())})


def _settled(docs: pa.Table, gains: pa.Table) -> pa.Table:
    sums = np.zeros((2, CHUNK_DOCS), dtype=np.int64)
    for gain in gains.column("gains"):
        found, best, total = np.frombuffer(zstandard.decompress(gain.as_py()), np.int64).reshape(3, -1)
        sums[0, found] += best
        sums[1, found] += total
    at = docs.column("index").to_numpy()
    columns = {name: docs.column(name) for name in ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]}
    return pa.table(columns | {"n_best": pa.array(sums[0, at]), "count_sum": pa.array(sums[1, at])})


def align(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """One row a document: id, n_a, n_b (tokens), n_groups (stretches between places where
    tokens of both end), n_links, groups_sha256, groups (null unless asked for), n_best (links
    whose count is the highest of their first id, ties included) and count_sum (counts over
    links). A pair's count is the number of documents that hold it linked.

    `first_path` is a byte-level tokenizer file, `second_path` a piece model without
    normalisation that puts a space in front; both are read on the driver. Texts that are
    null or empty, or that one of the tokenizers does not keep byte by byte, have no tokens:
    zeros, and '' for both texts. Every row is a document, whether its id is null, repeated
    or not; other columns are not looked at. No rows give no rows.
    """
    spilled = cut(spill(docs, first_path, second_path, id_col, text_col, groups), "runs")
    runs = spilled.where(F.col("bucket") >= 0).select("bucket", "chunk", "pairs", "records")
    counted = count(runs)
    size = F.sum(F.octet_length("pairs") + F.octet_length("records"))
    parts, part = _part({r["bucket"]: r["size"] for r in runs.groupBy("bucket").agg(size.alias("size")).collect()}, F.col("chunk"))
    last = F.element_at(F.array(*[F.lit(p - 1) for p in parts]), F.col("bucket") + 1)
    beside = counted.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    gains = cut(
        runs.withColumn("part", part).groupBy("bucket", "part").cogroup(beside.groupBy("bucket", "part")).applyInArrow(_gains, "chunk bigint, gains binary"),
        "gains",
    )
    own = spilled.where(F.col("bucket") < 0).select("chunk", "index", "id", *[f.split()[0] for f in DOC_FIELDS.split(", ")])
    id_type = own.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, {DOC_FIELDS}, n_best bigint, count_sum bigint"
    return own.groupBy("chunk").cogroup(gains.groupBy("chunk")).applyInArrow(_settled, schema)
