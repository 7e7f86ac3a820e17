"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from tabulon.llm import hardneg
from tabulon.llm.queries import OP12_SQL, QUERIES

SCHEMA = "id bigint, label int, vector array<bigint>, score string, anchor string, rank string, slot string"


def brute(rows, every, positives=5, negatives=10, low=30, high=90):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for a in rows:
        if a[0] % every:
            continue
        ranked = lambda wanted: sorted((-int(np.dot(a[2], r[2])), r[0]) for r in rows if len(r[2]) == len(a[2]) and wanted(r))  # noqa: E731, B023
        for p, pid in ranked(lambda r: r[1] == a[1] and r[0] != a[0])[:positives]:  # noqa: B023
            fit = [(n, i) for n, i in ranked(lambda r: r[1] != a[1]) if low * -p <= 100 * -n <= high * -p]  # noqa: B023
            out += [(a[0], pid, k, i, -p, -n) for k, (n, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA).repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("small", [False, True])
def test_any_table(spark, monkeypatch, small):
    draw = random.Random(4)
    rows = [(i, draw.randrange(3), [draw.randrange(-9, 10) + 3 * (i % 2) for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, 1, rows[5][2]) for i in range(60)]  # one common vector: ties
    rows += [(None, 1, [1] * 12), (400, None, [1] * 12), (401, 1, None), (402, 1, [1, None]), (410, 2, []), (420, 2, []), (430, 1, [])]
    rows += [(440 + i, i % 2, [i, 2, 3]) for i in range(30)] + [(10, 0, rows[3][2]), (7, 1, rows[3][2]), (7, 1, rows[3][2])]
    if small:  # several batches, and tiles cut small
        monkeypatch.setattr(hardneg, "BATCH_ANCHORS", 7)
        monkeypatch.setattr(hardneg, "TILE", 5)
        monkeypatch.setattr(hardneg, "BUFFER", 10)
    got = found(hardneg.mine(table(spark, rows), F.col("id") % 10 == 0))
    assert got == brute(rows, 10) and len(got) > 500
    assert hardneg.mine(table(spark, rows).limit(0), F.col("id") % 10 == 0).count() == 0
    assert hardneg.mine(table(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_large_numbers(spark):
    rows = [(i, i % 2, [(1 << 28) + i, i * 7 - 50, 1 << 28]) for i in range(40)]
    assert found(hardneg.mine(table(spark, rows), F.col("id") % 10 == 0, low=-100, high=100)) == brute(rows, 10, low=-100, high=100)
    with pytest.raises(Exception, match="64-bit"):
        hardneg.mine(table(spark, [(0, 1, [1 << 40]), (1, 1, [1 << 40])]), F.col("id") == 0)


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(2)
    steps = np.repeat(draw.integers(-200, 200, (400, 8)), 8, axis=1) + draw.integers(-3, 4, (400, 64))

    def block(vectors):
        return hardneg.Block(np.arange(len(vectors)), np.zeros(len(vectors)), vectors.astype(float), *(x.astype(np.float32) for x in hardneg.summarise(vectors.astype(float))))

    a, r = block(steps[:50]), block(steps)
    exact, widths = hardneg.products(a, r), []
    for (mean, deviation), (row_mean, row_deviation) in zip(a.levels, r.levels, strict=True):
        middle, reach = mean @ row_mean.T, deviation @ row_deviation.T
        slack = hardneg.SLACK * np.outer(a.norms, r.norms)
        assert (middle - reach - slack <= exact).all() and (exact <= middle + reach + slack).all()
        widths.append(reach.mean())
    assert widths == sorted(widths, reverse=True)
    search = hardneg.Search(a, np.full((50, 1), -(1 << 62)), np.full((50, 1), 1 << 62), True, 5)
    search.add(r)
    assert search.scored < 0.5 * exact.size  # the bounds rule most pairs out
    order = np.argsort(-exact, kind="stable")
    for i in range(50):
        want = [j for j in order[i] if j != i][:5]
        assert search.kept[2][search.kept[0] == i].tolist() == want


def test_op12(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op12_hard_negatives"](spark, folder), connect(folder), OP12_SQL) is None
