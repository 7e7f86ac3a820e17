"""Benchmark decontamination with one Aho-Corasick automaton.

Texts of questions and answers become windows of 13 consecutive normalised words (all
the words of a shorter item). An automaton over all windows, spelt in short codes of the
benchmark's words, reads each document once; normalising keeps the length in bytes, so
every matched word maps back to the original text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tabulon.llm.common import col, fresh

WINDOW = 13
SHARE = 20  # contaminated from one hit word in so many
# What a worker may hold for one automaton, and what a node takes there; 256 MB are some 70,000 words of
# questions and answers. Larger benchmarks take several automata, one after the other.
AUTOMATON_BYTES = 256 << 20
NODE_BYTES = 96
DIGITS = 32  # letters of a place in the code of a word
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RESULT = (
    "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start: int, end: int>>"
)


def _normal_bytes() -> bytes:
    """A-Z lowered; ASCII other than letters and digits becomes a space; other bytes stay."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isascii() and c.isalnum() else 32
    return bytes(out)


NORMAL = _normal_bytes()


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def _parts(benchmark: DataFrame, id_col: str, text_col: str, length: int, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in groups whose automaton takes about `limit` bytes at most (a single larger
    item is a group of its own), each group sent to the driver by itself."""
    items = benchmark.select(col(id_col).cast("string").alias("item"), col(text_col).alias("text")).where(F.col("text").isNotNull())
    # A word stands in at most `length` windows, in each of them a node a letter of its code.
    words = items.select(F.sum(F.regexp_count("text", F.lit(WORDS)).cast("long"))).first()[0] or 0
    parts = max(1, -(-words * length * _width(words) * NODE_BYTES // limit))
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        yield [(r.item, r.text) for r in own.collect()]


def _table(items: list[tuple[str | None, str]], length: int) -> tuple[list[tuple[bytes, int]], list[tuple[int, ...]], list[str | None]]:
    """Distinct normalised texts with the length of a window, the items of each, and the
    names of the items. Workers cut the texts into windows themselves."""
    names = _in_order({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    owners: dict[bytes, set[int]] = {}
    for name, text in items:
        words = normal_words(text)
        if words:
            owners.setdefault(b" ".join(words), set()).add(number[name])
    keys = sorted(owners)
    return [(k, length) for k in keys], [tuple(sorted(owners[k])) for k in keys], names


def _in_order(names: set[str | None]) -> list[str | None]:
    """Sorted as strings; the items without an id are one, and come last."""
    return [*sorted(names - {None}), *([None] if None in names else [])]


_AUTOMATA: dict[tuple[str, int], tuple[dict[bytes, str], int, object]] = {}


def _width(words: int) -> int:
    """Letters of the code of each of so many words."""
    width = 1
    while DIGITS**width < words:
        width += 1
    return width


def _code(number: int, width: int) -> str:
    """A word's number in letters; each place has letters of its own, so that codes match at words only."""
    return "".join(chr(1 + DIGITS * place + number // DIGITS**place % DIGITS) for place in range(width))


def _automaton(run: str, part: int, keys: list[tuple[bytes, int]]):
    """The codes of the benchmark's words, their width, and the automaton over its windows
    spelt in these codes: a node has few followers, and a word few nodes. A window leads to
    its number of words and the texts it occurs in. Built once in each Python worker and
    kept for the whole run, as are those of the other parts; another run takes their place."""
    if (run, part) not in _AUTOMATA:
        import ahocorasick

        for other in [k for k in _AUTOMATA if k[0] != run]:
            del _AUTOMATA[other]
        words = sorted({w for key, _ in keys for w in key.split(b" ")})
        width = _width(len(words))
        codes = {w: _code(i, width) for i, w in enumerate(words)}
        texts: dict[str, list[int]] = {}
        for i, (key, length) in enumerate(keys):
            spelt = [codes[w] for w in key.split(b" ")]
            for window in {"".join(spelt[j : j + length]) for j in range(max(1, len(spelt) - length + 1))}:
                texts.setdefault(window, []).append(i)
        machine = ahocorasick.Automaton()
        for window, found in texts.items():
            machine.add_word(window, (len(window) // width, tuple(found)))
        if texts:
            machine.make_automaton()
        _AUTOMATA[run, part] = codes, width, machine
    return _AUTOMATA[run, part]


class _Text:
    """A text and what has matched in it so far."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""
        self.words = self.raw.translate(NORMAL).split()
        self.n_words = len(self.words)
        self.steps = None
        self.items: set[str | None] = set()

    def match(self, machine, owners: list, names: list) -> None:
        codes, width, automaton = machine
        for end, (length, texts) in automaton.iter("".join(map(codes.get, self.words, repeat("\0" * width)))):
            last = end // width
            if self.steps is None:
                self.steps = np.zeros(self.n_words + 1, dtype=np.int32)
            self.steps[last - length + 1] += 1
            self.steps[last + 1] -= 1
            self.items.update(names[o] for i in texts for o in owners[i])

    def result(self) -> tuple[int, int, list[str], list[dict]]:
        if self.steps is None:
            return self.n_words, 0, [], []
        return self.n_words, *_located(self.raw, np.cumsum(self.steps[:-1]) > 0, _in_order(self.items))


def _scan(tables: list) -> Column:
    """An Arrow function from a text to its result."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    run = uuid.uuid4().hex

    @arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            known = [(part, *table.value) for part, table in enumerate(tables)]
            machines = [(_automaton(run, part, keys), owners, names) for part, keys, owners, names in known if keys]
            rows = []
            for value in batch.cast(pa.binary()):  # one text at a time is held beside the batch
                text = _Text(value.as_py())
                if text.n_words:
                    for machine in machines:
                        text.match(*machine)
                rows.append(text.result())
            sha = [hashlib.sha256(",".join(i for i in r[2] if i is not None).encode()).hexdigest() for r in rows]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([len(r[2]) for r in rows], pa.int64()),
                    pa.array(sha, pa.string()),
                    pa.array([r[1] > 0 and SHARE * r[1] >= r[0] for r in rows], pa.bool_()),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                    pa.array([r[3] for r in rows], spans_type),
                ],
                names=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    return scan.asNondeterministic()  # evaluated once, although a filter reads it too


def _located(raw: bytes, hit: np.ndarray, items: list[str]) -> tuple[int, list[str], list[dict]]:
    """Runs of hit words as code points of the original text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.frombuffer(raw.translate(NORMAL), dtype=np.uint8) != 32
    change = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = change[::2], change[1::2]
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    spans = [
        {"start": int(point[starts[a]]), "end": int(point[ends[b - 1]])} for a, b in zip(edge[::2], edge[1::2], strict=True)
    ]
    return int(hit.sum()), items, spans


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    result: str = "overlap",
    window: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> tuple[DataFrame, str]:
    """`docs` with one more struct column, and that column's name (`result`, made longer
    where the input has such a column). Its fields: n_words, n_hit, n_items, items_sha256,
    contaminated, items (sorted) and spans, the runs of hit words in code points.

    Null and empty texts have no words, no hits and the digest of no items. Items without
    words match nothing; rows that repeat an item change nothing; items that share an id
    count once. Items without an id count as one item, null in items and not in the digest. An empty benchmark leaves every document clean. The benchmark is counted
    first: an automaton takes about `automaton_bytes` in a worker at most.
    """
    context = docs.sparkSession.sparkContext
    tables = [
        context.broadcast(_table(items, window)) for items in _parts(benchmark, item_col, item_text_col, window, automaton_bytes)
    ]
    name = fresh(docs, result)
    return docs.withColumn(name, _scan(tables)(col(text_col))), name
