"""Encoding and decoding with a SentencePiece BPE model, by a table over prefixes.

The byte-pair encoding of a text ends, for each of its prefixes, in one certain token:
the only vocabulary entry that is a suffix of the prefix and stands without merging
behind the last token of what lies before it. An automaton over the vocabulary finds the
suffixes, a test of two neighbouring tokens decides, and the table of last tokens is
followed back from the end to give the ids. Time is linear in the text; nothing is
merged but the two tokens of a test, whose answers are kept.

Texts are cut into units that no piece crosses. The tables of many short units are filled
side by side with numpy, one column at a time; long ones and rare scripts one by one.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.functions import arrow_udf

from tabulon.llm.common import col, fresh
from tabulon.llm.units import SEGMENT, SPACE_MARK, Cutter, safe_blanks

KEPT_PAIRS = 1 << 20  # answers kept by a worker
KEPT_UNITS = 3 << 17  # encoded units of late that a worker keeps, and as many older ones; some 350 bytes each
SHORT = 64  # characters of a unit whose table is filled beside others
DENSE = 0x100  # characters below it, and the mark, have dense automaton rows
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format


@dataclass
class PieceModel:
    """A byte-fallback BPE vocabulary; what workers need of a model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    unknown_surface: str = " ⁇ "
    normal: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}

    def merges(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """Byte-pair encoding by its definition, step by step (score, parts behind it): the
        best-scored neighbours are joined, the leftmost of equal ones first. Quadratic; for
        texts as short as a token."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                token = self.normal.get(parts[i] + parts[i + 1])
                if token is not None and (best is None or self.scores[token] > best):
                    best, where = self.scores[token], i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
            yield best, parts


def read_model(path: str) -> PieceModel:
    """Read a model file on the driver. BPE without normalisation and with byte fallback,
    without user-defined or unused pieces; ValueError for other models."""
    from sentencepiece import sentencepiece_model_pb2 as formats

    proto = formats.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    rules, trainer = proto.normalizer_spec, proto.trainer_spec
    kinds = [p.type for p in proto.pieces]
    if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
        raise ValueError("a BPE model with byte fallback and white space in front is needed")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("models that normalise texts are not supported")
    if kinds.count(BYTE) != 256 or not {NORMAL, UNKNOWN, CONTROL, BYTE}.issuperset(kinds):
        raise ValueError("user-defined or unused pieces are not supported")
    return PieceModel([p.piece for p in proto.pieces], [p.score for p in proto.pieces], kinds, rules.add_dummy_prefix, trainer.unk_surface)


class PairTable:
    """Answers by number of a pair, found with numpy by open addressing; emptied when half full."""

    def __init__(self, bits: int = 21) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.answers = np.zeros(1 << bits, dtype=np.int8)
        self.used = 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """0 or 1, and -1 for pairs that were not met."""
        out = np.full(len(keys), -1, dtype=np.int8)
        rest, at = np.arange(len(keys)), self._home(keys)
        while len(rest):
            seen = self.keys[at]
            hit = seen == keys[rest]
            out[rest[hit]] = self.answers[at[hit]]
            on = ~hit & (seen >= 0)
            rest, at = rest[on], (at[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, answers: np.ndarray) -> None:
        """Different pairs that are not in the table."""
        if self.used + len(keys) > len(self.keys) // 2:
            self.keys.fill(-1)
            self.used = 0
        if len(keys) > len(self.keys) // 2:
            return
        self.used += len(keys)
        rest, at = np.arange(len(keys)), self._home(keys)
        while len(rest):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[rest[free]]
            won = self.keys[at] == keys[rest]  # of those that met in a place the last one has it
            self.answers[at[won]] = answers[rest[won]]
            rest, at = rest[~won], (at[~won] + 1) & self.mask


class Encoder:
    """Prefix tables over one model."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        self.raw = [self._raw(i) for i in range(len(model.pieces))]
        self.controls = {i for i, k in enumerate(model.kinds) if k == CONTROL}
        self.lengths = np.array([1 if k == BYTE else len(p) for p, k in zip(model.pieces, model.kinds, strict=True)])
        # How a token alone is merged: the score of each step, and its edge symbols behind it.
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, token in model.normal.items():
            steps = [(score, parts[0], parts[-1]) for score, parts in model.merges(piece)]
            if len(piece) == 1 or steps and steps[-1][1] == piece:  # others never result from merges
                self.steps[token] = steps
                self.automaton.add_word(piece, (token, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self._dense()

    def _raw(self, token: int) -> bytes:
        kind, piece = self.model.kinds[token], self.model.pieces[token]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == NORMAL:
            return piece.replace(SPACE_MARK, " ").encode("utf-8")
        return self.model.unknown_surface.encode("utf-8") if kind == UNKNOWN else b""

    def _dense(self) -> None:
        """Transitions of the vocabulary's tree over the most usual characters, as one table.
        ASCII characters without a piece stand for their byte, others for no way on."""
        letters = [chr(c) for c in range(DENSE)] + [SPACE_MARK]
        self.codes = np.full(ord(SPACE_MARK) + 2, -1, dtype=np.int32)
        words = {p: t for p, t in ((self.model.pieces[t], t) for t in self.steps) if all(c == SPACE_MARK or ord(c) < DENSE for c in p)}
        for code, letter in enumerate(letters):
            if letter not in words and ord(letter) < 128:
                words[letter] = self.bytes[ord(letter)]
            if letter in words:
                self.codes[ord(letter)] = code
        rows, tokens = [[0] * len(letters)], [-1]
        for word, token in words.items():
            node = 0
            for letter in word:
                code = self.codes[ord(letter)]
                if not rows[node][code]:
                    rows.append([0] * len(letters))
                    tokens.append(-1)
                    rows[node][code] = len(rows) - 1
                node = rows[node][code]
            tokens[node] = token
        self.table = np.array(rows, dtype=np.int32)
        self.token_at = np.array(tokens, dtype=np.int32)
        self.met = PairTable()

    def compatible(self, left: int, right: int) -> bool:
        """Do the two tokens side by side stay as they are?"""
        key = left * len(self.model.pieces) + right
        known = self.pairs.get(key)
        if known is None:
            if left not in self.steps or right not in self.steps:
                return True  # bytes merge with nothing
            known = self._stay(left, right)
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _stay(self, left: int, right: int) -> bool:
        """Merge both side by side, the better step first, until the symbols at the border
        would be the next to merge, or nothing is left to merge."""
        model = self.model
        mine, other = iter(self.steps[left]), iter(self.steps[right])
        edge, border = model.pieces[left][-1], model.pieces[right][0]
        a, b = next(mine, None), next(other, None)
        while True:
            across = model.normal.get(edge + border)
            if across is not None:
                score = model.scores[across]
                if (a is None or score > a[0]) and (b is None or score >= b[0]):
                    return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] >= b[0]):
                edge, a = a[2], next(mine, None)
            else:
                border, b = b[1], next(other, None)

    def _compatible_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`compatible` of many pairs at once; those met before are looked up."""
        keys = left * len(self.model.pieces) + right
        answers = self.met.get(keys)
        unknown = answers < 0
        if unknown.any():
            some = np.unique(keys[unknown])
            found = np.array([self.compatible(*divmod(k, len(self.model.pieces))) for k in some.tolist()], dtype=np.int8)
            self.met.add(some, found)
            answers[unknown] = found[np.searchsorted(some, keys[unknown])]
        return answers > 0

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of texts that were cut where no piece crosses, with spaces unmarked."""
        marked = [u.replace(" ", SPACE_MARK) for u in units]
        out: list[list[int]] = [[]] * len(marked)
        size = np.array([len(u) for u in marked], dtype=np.int64)
        points = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32)
        code = self.codes[np.minimum(points, len(self.codes) - 1)]
        unit_of = np.repeat(np.arange(len(marked)), size)
        slow = size > SHORT
        slow[unit_of[code < 0]] = True
        keep = ~slow[unit_of]
        fast = np.flatnonzero(~slow)
        for i in np.flatnonzero(slow).tolist():
            out[i] = self.encode_marked(marked[i])
        if len(fast):
            for i, ids in zip(fast.tolist(), self._side_by_side(code[keep], size[fast]), strict=True):
                out[i] = ids
        return out

    def _side_by_side(self, code: np.ndarray, size: np.ndarray) -> list[list[int]]:
        end_of = np.cumsum(size)
        first = np.repeat(end_of - size, size)
        stop = np.repeat(end_of, size)
        # All vocabulary entries in the texts: one step of the tree at a time for all places.
        start, node, matches = np.arange(len(code)), np.zeros(len(code), dtype=np.int32), []
        step = 0
        while len(start):
            node = self.table[node, code[start + step]]
            alive = node > 0
            start, node = start[alive], node[alive]
            token = self.token_at[node]
            hit = token >= 0
            matches.append((start[hit], np.full(int(hit.sum()), step), token[hit]))
            step += 1
            alive = start + step < stop[start]
            start, node = start[alive], node[alive]
        begin, length, token = (np.concatenate(x) for x in zip(*matches, strict=True))
        end = begin + length
        place = end - first[begin]
        order = np.argsort(place.astype(np.uint16), kind="stable")
        begin, end, token, place = begin[order], end[order], token[order].astype(np.int64), place[order]
        edges = np.searchsorted(place, np.arange(int(size.max()) + 1))
        last = np.full(len(code), -1, dtype=np.int64)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            b, e, t = begin[low:high], end[low:high], token[low:high]
            fits = b == first[b]
            inner = np.flatnonzero(~fits)
            fits[inner] = self._compatible_all(last[b[inner] - 1], t[inner])
            last[e[fits]] = t[fits]
        # Back from the ends, a token of every text at a time.
        unit, at, floor = np.arange(len(size)), end_of - 1, end_of - size
        unit, at = unit[size > 0], at[size > 0]
        units, tokens = [], []
        while len(unit):
            t = last[at]
            units.append(unit)
            tokens.append(t)
            at = at - self.lengths[t]
            alive = at >= floor[unit]
            unit, at = unit[alive], at[alive]
        units, tokens = np.concatenate(units[::-1]), np.concatenate(tokens[::-1])
        order = np.argsort(units, kind="stable")
        ids, stops = tokens[order].tolist(), np.cumsum(np.bincount(units, minlength=len(size))).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def last_tokens(self, text: str) -> array:
        """For each prefix of the text (spaces marked) its last token; -1 for a character that
        the vocabulary lacks, with which nothing merges."""
        last = array("i", [-1]) * len(text)
        pairs, size, compatible = self.pairs, len(self.model.pieces), self.compatible
        for end, (token, length) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            before = end - length
            if before >= 0:
                left = last[before]
                if left >= 0:
                    known = pairs.get(left * size + token)
                    if known is None:
                        known = compatible(left, token)
                    if not known:
                        continue
            last[end] = token
        return last

    def encode_marked(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marked, without a prefix."""
        last, pieces, ids = self.last_tokens(text), self.model.pieces, []
        at = len(text) - 1
        while at >= 0:
            token = last[at]
            if token >= 0:
                ids.append(token)
                at -= len(pieces[token])
            else:
                ids.extend(self.bytes[b] for b in reversed(text[at].encode("utf-8")))
                at -= 1
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them, without begin or end."""
        if not text:
            return []
        return self.encode_marked((SPACE_MARK if self.model.dummy_prefix else "") + text.replace(" ", SPACE_MARK))

    def surface(self, ids: Iterable[int]) -> str:
        """The text of ids, a prefix included: marks become spaces, runs of byte pieces become
        characters, bytes that form none U+FFFD each, control pieces nothing."""
        ids = list(ids)
        if self.controls.isdisjoint(ids):
            try:
                return b"".join([self.raw[i] for i in ids]).decode("utf-8")
            except UnicodeDecodeError:
                pass
        out = []
        for is_byte, run in groupby(ids, lambda i: self.model.kinds[i] == BYTE):
            piece = b"".join([self.raw[i] for i in run])
            out.append(_characters(piece) if is_byte else piece.decode("utf-8"))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids as the library gives it: the space of the prefix is taken away if the
        first ids that are no control pieces begin with it."""
        ids = list(ids)
        text = self.surface(ids)
        first = next((i for i in ids if self.model.kinds[i] != CONTROL), None)
        begins = first is not None and self.model.kinds[first] == NORMAL and text.startswith(" ")
        return text[1:] if begins and self.model.dummy_prefix else text


def _characters(run: bytes) -> str:
    """UTF-8 characters of a run; a byte that begins none becomes U+FFFD, and so on behind it."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for length in (1, 2, 3, 4):
            try:
                out.append(run[at : at + length].decode("utf-8"))
            except UnicodeDecodeError:
                continue
            at += length
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


RESULT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


class _Texts:
    """Encodes the texts of a worker's batches; units are encoded once while they are kept."""

    def __init__(self, enc: Encoder, whole: bool) -> None:
        self.enc, self.whole = enc, whole
        self.cutter = Cutter(safe_blanks(enc.model.normal))
        # Units of late, and those before them.
        self.kept: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def block(self, segments: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """The units of each segment as their number of ids, the ids and the decoded bytes."""
        cut = [self.cutter.units(s) for s in segments]
        if len(self.kept) > KEPT_UNITS:
            self.older, self.kept = self.kept, {}
        kept, older, raw = self.kept, self.older, self.enc.raw
        missing = set().union(*cut).difference(kept)
        again = [u for u in missing if u in older]
        kept.update(zip(again, map(older.__getitem__, again), strict=True))
        missing = list(missing.difference(again))
        met = {}  # long units are not kept
        for unit, ids in zip(missing, self.enc.encode_units(missing), strict=True):
            found = len(ids), ",".join(map(str, ids)), b"".join([raw[i] for i in ids])
            (kept if len(unit) <= SHORT else met)[unit] = found
        if met:
            return [[kept.get(u) or met[u] for u in units] for units in cut]
        return [list(map(kept.__getitem__, units)) for units in cut]

    def rows(self, texts: list[str | None]) -> list[dict]:
        """Rows of RESULT. Ids and decoded texts go through their digests segment by segment
        and are put together only where they are wanted."""
        out = [_Row(self.whole) for _ in texts]
        waiting: list[tuple[_Row, str]] = []
        held = 0
        prefix = " " if self.enc.model.dummy_prefix else ""
        for row, text in zip(out, texts, strict=True):
            for segment in self.cutter.segments(prefix + text if text else ""):
                waiting.append((row, segment))
                held += len(segment)
                if held >= SEGMENT:
                    self._settle(waiting, prefix)
                    waiting, held = [], 0
        self._settle(waiting, prefix)
        return [row.result() for row in out]

    def _settle(self, waiting: list[tuple[_Row, str]], prefix: str) -> None:
        for (row, _), found in zip(waiting, self.block([s for _, s in waiting]), strict=True):
            n = sum([f[0] for f in found])
            surface = b"".join([f[2] for f in found])
            row.add(n, ",".join([f[1] for f in found]), surface if row.n else surface[len(prefix) :])


class _Row:
    def __init__(self, whole: bool) -> None:
        self.n, self.ids, self.decoded = 0, [] if whole else None, [] if whole else None
        self.ids_digest, self.text_digest = hashlib.sha256(), hashlib.sha256()

    def add(self, n: int, names: str, surface: bytes) -> None:
        self.ids_digest.update(("," + names if self.n else names).encode())
        self.text_digest.update(surface)
        self.n += n
        if self.ids is not None:
            self.ids += map(int, names.split(","))
            self.decoded.append(surface.decode("utf-8"))

    def result(self) -> dict:
        return {
            "n_tokens": self.n, "ids": self.ids, "ids_sha256": self.ids_digest.hexdigest(),
            "decoded": None if self.decoded is None else "".join(self.decoded), "decoded_sha256": self.text_digest.hexdigest(),
        }


_TEXTS: dict[tuple, _Texts] = {}


def _texts(key: tuple, model: PieceModel, whole: bool) -> _Texts:
    """What a worker keeps from task to task; the next model takes its place."""
    if (key, whole) not in _TEXTS:
        _TEXTS.clear()
        _TEXTS[key, whole] = _Texts(Encoder(model), whole)
    return _TEXTS[key, whole]


def encode(docs: DataFrame, path: str, text_col: str = "text", result: str = "pieces", whole: bool = True) -> tuple[DataFrame, str]:
    """`docs` with one more struct column, and that column's name (`result`, made longer where
    the input has such a column). Its fields: n_tokens, ids, decoded, and the digests of the
    ids (decimal, joined by commas) and of the decoded text. Without `whole`, ids and decoded
    are null and only their digests are made, a million characters at a time.

    A null text is empty: no ids, the digests of nothing. Texts of any length, repeated rows
    and other columns pass through as they are. No row is shuffled; the model of some 32,000
    pieces is read once on the driver and sent to the workers.
    """
    name = fresh(docs, result)
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))
    key = (path, uuid.uuid4().hex)

    @arrow_udf(RESULT)
    def scan(column: pa.Array) -> pa.Array:
        texts = _texts(key, model.value, whole)
        return pa.array(texts.rows(column.to_pylist()), type=RESULT_ARROW)

    return docs.withColumn(name, scan.asNondeterministic()(col(text_col))), name


RESULT_ARROW = pa.struct(
    [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded", pa.string()), ("decoded_sha256", pa.string())]
)
