"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

The signature is one-permutation MinHash: a shingle's hash names a coordinate (its leading
32 bits) and a value (the others), and each coordinate keeps its least value. So many
coordinates lose next to nothing: two sets of similarity s agree in as many coordinates as
they share shingles, but for the few that share a coordinate by chance (`hidden`, counted).

Two sets of a and b shingles are alike enough only if they share at least
percent / (100 + percent) * (a + b). A document is posted under its rarest coordinate-value
pairs only, in one order that all documents use: as many as it takes for two such documents
to meet. Values that a sketch of the corpus shows to be frequent come last, so their long
lists are hardly merged. In a list, the places of the pair in both orders bound the matches
still possible; a pair of documents is kept only if that bound reaches the threshold, and
is then confirmed on the full sets.

A list is never expanded into all its pairs. Each round picks hubs in every list whose
members are not yet one component, those that have the fewest pairs before this one, tests
all others against the hubs, and merges. A tested hub leaves the list. The rounds end when
no list holds two components, so every pair is either tested or inside one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabulon.llm.common import col, cut
from tabulon.llm.words import U, mix, text_blocks, word_keys

SHINGLE = 5
PERCENT = 80
COORDINATE_BITS = 32
# Two sets of similarity 0.8 agree in fewer than 32 of 64 independent minima about once in 10^8.
CHECKS = 64
AGREE = 32
SKETCH_BITS = 21  # cells of the frequency sketch that orders the coordinate-value pairs
SKETCH_LEAST = 8  # a task reports a cell from so many above four times the mean on: only frequent values matter
SKETCH_HELD = 1 << 20  # shingles that a task gathers before it counts them
HOT = 100_000  # a list that the sketch holds for longer is looked at in parts
HUBS = 8  # hubs by list: 1 in the first round, then 8, 64, ...
BROADCAST_ROWS = 500_000  # tables counted to have no more rows of a few numbers may be broadcast


def shingle_sets(offsets: np.ndarray, data: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """For each text of a block the sorted distinct hashes of its word shingles. A text of
    fewer words has one, of all its words; one without words has none."""
    keys, bounds = word_keys(offsets, data)
    with np.errstate(over="ignore"):
        joint = mix(keys + U(length))
        if len(keys) >= length:
            for k in range(1, length):
                joint = mix(joint[: len(joint) - 1] * U(0xD1342543DE82EF95) + keys[k:])
        for i in range(len(offsets) - 1):
            begin, end = int(bounds[i]), int(bounds[i + 1])
            if end - begin >= length:
                yield np.unique(joint[begin : end - length + 1])
            elif end > begin:
                one = mix(keys[begin : begin + 1] + U(end - begin))
                for k in range(begin + 1, end):
                    one = mix(one * U(0xD1342543DE82EF95) + keys[k : k + 1])
                yield one
            else:
                yield keys[:0]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The coordinate-value pairs of a sorted set: the first of those with equal leading bits."""
    coordinate = hashes >> U(64 - COORDINATE_BITS)
    return hashes[np.flatnonzero(np.concatenate([[True], coordinate[1:] != coordinate[:-1]]))] if len(hashes) else hashes


_FACTORS = mix(np.arange(1, CHECKS + 1, dtype=np.uint64) * U(0xA0761D6478BD642F)) | U(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The upper 16 bits of the least product of the set with each factor."""
    least = np.full(CHECKS, ~U(0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1024):
            products = hashes[at : at + 1024, None] * _FACTORS[None, :]
            np.minimum(least, products.min(axis=0), out=least)
    return (least >> U(48)).astype(np.uint16)


def _cells(pairs: np.ndarray) -> np.ndarray:
    return (mix(pairs) >> U(64 - SKETCH_BITS)).astype(np.int64)


FACTS = "id bigint, n_shingles bigint, set_lo bigint, set_hi bigint, cell bigint, seen bigint, minima binary"


def _describe(length: int):
    """(id, text) to (id, n_shingles, set_lo, set_hi, minima), the set's size, two sums that
    name it, and its independent minima, and at the end of a task to (cell, seen) for the cells with frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, total = np.zeros(1 << SKETCH_BITS, dtype=np.int32), 0
        held, n_held = [], 0
        for batch in batches:
            n, low, high, least = [], [], [], []
            for _, offsets, data in text_blocks(batch.column(1)):
                for hashes in shingle_sets(offsets, data, length):
                    n.append(len(hashes))
                    low.append(int(mix(hashes).sum(dtype=np.uint64).astype(np.int64)))
                    high.append(int(mix(hashes ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    least.append(minima(hashes).tobytes())
                    held.append(hashes)
                    n_held += len(hashes)
                if n_held > SKETCH_HELD:
                    cells += np.bincount(_cells(np.concatenate(held)), minlength=len(cells)).astype(np.int32)
                    held, n_held, total = [], 0, total + n_held
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (n, low, high)], none, none, pa.array(least, pa.binary())], schema=_facts_schema()
            )
        if held:
            cells += np.bincount(_cells(np.concatenate(held)), minlength=len(cells)).astype(np.int32)
        at = np.flatnonzero(cells >= SKETCH_LEAST + 4 * (total + n_held) // len(cells))
        none = pa.nulls(len(at), pa.int64())
        found = [pa.array(at, pa.int64()), pa.array(cells[at], pa.int64()), pa.nulls(len(at), pa.binary())]
        yield pa.RecordBatch.from_arrays([none] * 4 + found, schema=_facts_schema())

    return run


def _facts_schema() -> pa.Schema:
    return pa.schema([(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in FACTS.split(", ")])


def _hash_sets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in text_blocks(batch.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(offsets, data, length)]
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                values = pa.array(np.concatenate(sets) if sets else [], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "hashes"]
                )

    return run


POSTS = "pair bigint, part int, id bigint, n int, place int, hidden int"


def _post(shared, length: int, percent: int, hot: int):
    """(id, text) to the posts of each text: the coordinate-value pair, the part of its list
    (0 for a whole list, parts count from 1), the set's size, how many pairs stand before
    this one, and the shingles that share a coordinate with another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, seen = shared.value
        often = np.zeros(1 << SKETCH_BITS, dtype=np.uint64)
        often[cell] = np.minimum(seen, (1 << 24) - 1).astype(np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, offsets, data in text_blocks(batch.column(1)):
                pairs, parts, owner, sizes, places, hidden = [], [], [], [], [], []
                for i, hashes in enumerate(shingle_sets(offsets, data, length)):
                    own = signature(hashes)
                    n = len(hashes)
                    # A set alike enough is at most so large; by chance it may hide a few shingles too.
                    chance = (n * 100 / percent) ** 2 / 2 ** (COORDINATE_BITS + 1)
                    spare = 1 + (int(chance + 6 * chance**0.5) if chance > 1e-3 else 0)
                    count = min(len(own), n - -(-percent * n // 100) + 1 + spare)
                    known = often[_cells(own)]
                    first = np.argsort((known << U(40)) | (mix(own) >> U(24)), kind="stable")[:count]
                    pairs.append(own[first].view(np.int64))
                    split = known[first] // U(hot) + U(1)
                    part = mix(hashes[:1])[0] % split + U(1) if n else split
                    parts.append(np.where(split > 1, part, U(0)).astype(np.int32))
                    owner.append(np.full(count, ids[row + i]))
                    sizes.append(np.full(count, n, dtype=np.int32))
                    places.append(np.arange(count, dtype=np.int32))
                    hidden.append(np.full(count, n - len(own), dtype=np.int32))
                columns = [np.concatenate(x) for x in (pairs, parts, owner, sizes, places, hidden)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in POSTS.split(", ")])

    return run


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of a table of a few numbers a row that was counted to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of `edges` (a, b) reaches. Every round
    takes the least label among neighbours, then follows labels of labels."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        root = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        step = step.join(root, "next", "left").select("id", F.least("next", F.coalesce("jump", "next")).alias("component"), "was")
        step = cut(step, "labels")
        labels = step.select("id", "component")
        if step.where(F.col("component") != F.col("was")).isEmpty():
            return labels


def _heads(rows: DataFrame, named: DataFrame, ids: DataFrame) -> DataFrame:
    """Those rows whose id is one of `ids`, which are among those of `named`; and maybe rows without shingles.
    Texts are shuffled only if neither these ids nor the others that are named can be broadcast."""
    n_ids = ids.count()
    if n_ids > BROADCAST_ROWS:
        others = cut(named.select("id").distinct().join(ids, "id", "left_anti"), "others")
        if others.count() <= BROADCAST_ROWS:
            return rows.where(F.col("id").isNotNull()).join(F.broadcast(others), "id", "left_anti")
    return rows.join(small(ids, n_ids), "id", "left_semi")


def _hubs(active: DataFrame, count: int) -> DataFrame:
    """Up to `count` hubs of each list, from as many components as can be and, where the list
    has fewer, equally many of each: the members with the fewest pairs before this one. So a
    list of up to `count` members is done with. Long lists are cut down in salted parts first."""
    best = F.struct("place", "id", "n", "hidden").alias("hub")
    if count == 1:
        firsts = active.groupBy("pair").agg(F.min(F.struct("place", "id", "n", "hidden", "component")).alias("hub"))
        return firsts.select("pair", "hub", F.col("hub.component").alias("hub_component"))
    firsts = active.select("pair", "component", best).withColumn("salt", F.pmod(F.xxhash64("component"), F.lit(64)))
    turn = F.row_number().over(Window.partitionBy("pair", "component").orderBy("hub"))
    firsts = firsts.withColumn("turn", turn).where(F.col("turn") <= count)
    for keys in (["pair", "salt"], ["pair"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "hub"))
        firsts = firsts.withColumn("rank", rank).where(F.col("rank") <= count).drop("rank")
    return firsts.select("pair", "hub", F.col("component").alias("hub_component"))


def _may_match(percent: int):
    """Whether a member and a hub can still share enough: sizes first, then the matches that
    the places of this pair leave possible on either side."""
    least = F.col("n") + F.col("hub.n")
    return (
        (F.col("component") != F.col("hub_component"))
        & (100 * F.least("n", F.col("hub.n")) >= percent * F.greatest("n", F.col("hub.n")))
        & ((100 + percent) * (F.col("n") - F.col("place") + F.col("hub.hidden")) >= percent * least)
        & ((100 + percent) * (F.col("hub.n") - F.col("hub.place") + F.col("hidden")) >= percent * least)
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    hot: int = HOT,
) -> DataFrame:
    """One row (id, n_shingles, component, kept) for each row of `docs`; `id` has the type
    bigint. Sets of shingles A and B are linked where 100 |A and B| >= percent |A or B|; a
    component is named by its least id, and kept says that the row has that id.

    Null and empty texts and texts without words have no shingles and are linked with
    nothing. Rows of one id are one node: they share a component. Rows without an id
    take no part, get no component and are kept. Other columns are not looked at.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the minima are laid out for percent from 80 to 100")
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text"))
    described = cut(rows.mapInArrow(_describe(shingle), FACTS), "facts")
    facts = described.where(F.col("n_shingles").isNotNull()).drop("cell", "seen")
    named = facts.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    # Rows with one set are one class; its least id stands for it. Rows of one id tie classes together.
    classes = cut(named.groupBy("set_lo", "set_hi").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("minima").alias("minima")), "classes")
    same_id = (
        named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        .join(named.select("id", "set_lo", "set_hi"), "id").join(classes, ["set_lo", "set_hi"])
        .where(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    )

    sketch = described.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("seen").alias("seen")).toArrow()
    shared = spark.sparkContext.broadcast((sketch["cell"].to_numpy(), sketch["seen"].to_numpy()))
    heads = _heads(rows, named, classes.select(F.col("rep").alias("id")).distinct())
    least = classes.select(F.col("rep").alias("id"), "minima")
    posted = heads.mapInArrow(_post(shared, shingle, percent, hot), POSTS)
    # Only lists with two members or more are merged. A list in parts is kept whole: who is alone in one part may meet others
    # in another, and lists that turn out to have one member fall out of the first round.
    part = Window.partitionBy("pair", "part")
    several = (F.min("id").over(part) != F.max("id").over(part)) | (F.col("part") > 0)
    lists = cut(posted.withColumn("several", several).where("several").drop("several", "part").distinct(), "lists")

    links = cut(same_id, "links")
    labels = components(links)
    n_labels, hubs = labels.count(), 1
    while True:
        known = lists.join(small(labels, n_labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_ = known.groupBy("pair").agg(F.min("component").alias("least"), F.max("component").alias("most")).where(F.col("least") < F.col("most"))
        active = cut(known.join(open_.select("pair"), "pair", "left_semi"), "lists")
        if active.isEmpty():
            break
        chosen = cut(_hubs(active, hubs), "hubs")
        pairs = (
            active.join(chosen, (active["pair"] == chosen["pair"]) & _may_match(percent))
            .select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
        )
        alike = (
            pairs.join(least.withColumnsRenamed({"id": "a", "minima": "least_a"}), "a")
            .join(least.withColumnsRenamed({"id": "b", "minima": "least_b"}), "b")
            .where(_agreeing() >= AGREE).select("a", "b").distinct()
        )
        found = cut(_confirmed(rows, cut(alike, "pairs"), shingle, percent), "found")
        if not found.isEmpty():
            links = cut(links.union(found).distinct(), "links")
            labels = components(links)
            n_labels = labels.count()
        lists = active.drop("component").join(chosen.select("pair", F.col("hub.id").alias("id")), ["pair", "id"], "left_anti")
        hubs *= HUBS

    # From a class to its component; classes that nothing links keep their least id.
    final = classes.join(small(labels, n_labels).withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_lo", "set_hi", "rep", "last", F.coalesce("component", "rep").alias("component")
    )
    changed = final.where((F.col("component") != F.col("rep")) | (F.col("rep") != F.col("last"))).select("set_lo", "set_hi", "component")
    alone = facts.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_lo")).alias("set_lo"), "set_hi")
    out = alone.join(small(changed, changed.count()), ["set_lo", "set_hi"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", "n_shingles", component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))


def _agreeing():
    """How many of the minima least_a and least_b are equal."""
    same = [F.substring("least_a", 2 * k + 1, 2) == F.substring("least_b", 2 * k + 1, 2) for k in range(CHECKS)]
    return sum((s.cast("int") for s in same[1:]), same[0].cast("int"))


def _confirmed(rows: DataFrame, matched: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are alike enough."""
    needed = matched.select(F.col("a").alias("id")).union(matched.select(F.col("b").alias("id"))).distinct()
    texts = rows.join(small(needed, needed.count()), "id", "left_semi")
    sets = cut(texts.mapInArrow(_hash_sets(shingle), "id bigint, hashes array<bigint>"), "sets")
    both = matched.join(sets.withColumnsRenamed({"id": "a", "hashes": "ha"}), "a").join(sets.withColumnsRenamed({"id": "b", "hashes": "hb"}), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    union = F.size("ha") + F.size("hb") - shared
    return both.where((union > 0) & (100 * shared >= percent * union)).select("a", "b")
