"""Moments of many columns and pairwise-complete products in one pass.

Each task turns its Arrow batches into per-column sums and small k x k matrices
with numpy; Spark adds them up. The same pass feeds every 32nd of the sorted values to a
quantile sketch, where quantiles are wanted. One aggregate expression per column and pair
would grow past what the JVM compiles already at a dozen columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabulon.functions.columns import as_double

SKETCH_K = 4000
PARTS = ("n", "sx", "sy", "sxx", "syy", "sxy")
NOISE = 1e-13
SHIFT_ROWS = 1000
STRIDE = 32  # a value handed to the sketch stands for so many rows
SORTED = 8192  # rows sorted together for that


@dataclass
class Moments:
    n: int
    mean: float | None
    variance: float | None
    skewness: float | None
    low: float | None
    high: float | None

    @property
    def deviation(self) -> float | None:
        return None if self.variance is None else math.sqrt(self.variance)


def typical_values(df: DataFrame, names: Sequence[str]) -> list[float]:
    """A present value per column out of the first rows, 0 where there is none.

    Taking it off first lets sums of squares keep their digits.
    """
    head = df.select(*[as_double(df, n).alias(f"c{i}") for i, n in enumerate(names)]).limit(SHIFT_ROWS)
    row = head.agg(*[F.first(f"c{i}", True).alias(f"c{i}") for i in range(len(names))]).first()
    found = [row[i] or 0.0 for i in range(len(names))]
    return [v if math.isfinite(v) else 0.0 for v in found]


def summarise(df: DataFrame, names: Sequence[str]) -> tuple[dict[str, Moments], dict[tuple[str, str], tuple]]:
    """Moments per column, and (n, covariance, deviation x, deviation y) of every
    pair i < j over the rows where both are present."""
    return summarise_with_edges(df, names, ())[:2]


def summarise_with_edges(
    df: DataFrame, names: Sequence[str], edges: Sequence[float]
) -> tuple[dict[str, Moments], dict[tuple[str, str], tuple], dict[str, list[float] | None]]:
    """The same, and per column the sketched quantiles at ``edges``, None for few rows."""
    names = list(names)
    k = len(names)
    if not k:
        return {}, {}, {}
    centre = np.array(typical_values(df, names))
    slim = df.select(*[as_double(df, n).alias(f"c{i}") for i, n in enumerate(names)])

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros((6, k, k))
        sums = np.zeros((3, k))
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        held: list[np.ndarray] = []
        for batch in batches:
            raw = batch.to_numpy(dtype=float, na_value=np.nan)
            if edges:
                held.append(raw)
                if sum(map(len, held)) >= SORTED:
                    yield _points(np.concatenate(held))
                    held = []
            there = ~np.isnan(raw)
            x = np.where(there, raw - centre, 0.0)
            m = there.astype(float)
            squares = x * x
            sums[0] += np.where(there, raw, 0.0).sum(axis=0)
            sums[1] += (squares * x).sum(axis=0)
            low = np.minimum(low, np.where(there, raw, np.inf).min(axis=0, initial=np.inf))
            high = np.maximum(high, np.where(there, raw, -np.inf).max(axis=0, initial=-np.inf))
            pairs[0] += m.T @ m
            pairs[1] += x.T @ m
            pairs[2] += m.T @ x
            pairs[3] += squares.T @ m
            pairs[4] += m.T @ squares
            pairs[5] += x.T @ x
        if held:
            yield _points(np.concatenate(held))
        i, j = np.triu_indices(k)
        one = i == j
        yield pd.DataFrame(
            {
                "i": i,
                "j": j,
                **{p: pairs[t][i, j] for t, p in enumerate(PARTS)},
                "total": np.where(one, sums[0][i], 0.0),
                "cubes": np.where(one, sums[1][i], 0.0),
                "low": np.where(one, low[i], 0.0),
                "high": np.where(one, high[i], 0.0),
                "point": np.nan,
            }
        )

    columns = (*PARTS, "total", "cubes", "low", "high", "point")
    point = F.when(F.col("j") < 0, F.col("point"))
    sketched = F.when(
        F.count(point) > 0,
        F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(point, SKETCH_K), F.array(*[F.lit(e) for e in edges])),
    )
    rows = (
        slim.mapInPandas(accumulate, "i int, j int, " + ", ".join(f"{c} double" for c in columns))
        .groupBy("i", "j")
        .agg(
            *[F.sum(c).alias(c) for c in (*PARTS, "total", "cubes")],
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            *([sketched.alias("edges")] if edges else []),
        )
        .collect()
    )
    found = {n: None for n in names} | {names[r["i"]]: r["edges"] for r in rows if r["j"] < 0}
    rows = [r for r in rows if r["j"] >= 0]
    moments = {n: Moments(0, None, None, None, None, None) for n in names}
    pairs = {(a, b): (0, None, None, None) for i, a in enumerate(names) for b in names[i + 1 :]}
    for r in rows:
        if r["n"] < 1:
            continue
        a, b = names[r["i"]], names[r["j"]]
        if r["i"] == r["j"]:
            moments[a] = _moments(r)
        else:
            n = r["n"]
            pairs[a, b] = (
                int(n),
                (r["sxy"] - r["sx"] * r["sy"] / n) / n,
                _deviation(n, r["sx"], r["sxx"]),
                _deviation(n, r["sy"], r["syy"]),
            )
    return moments, pairs, found


def _points(raw: np.ndarray) -> pd.DataFrame:
    """Of each column's sorted values the middle one of every STRIDE."""
    parts = []
    for i in range(raw.shape[1]):
        values = np.sort(raw[:, i])[STRIDE // 2 : np.count_nonzero(~np.isnan(raw[:, i])) : STRIDE]  # NaN sorts last
        parts.append(pd.DataFrame({"i": i, "j": -1, "point": values}))
    out = pd.concat(parts)
    for c in (*PARTS, "total", "cubes", "low", "high"):
        out[c] = 0.0
    return out[["i", "j", *PARTS, "total", "cubes", "low", "high", "point"]]


def _moments(r) -> Moments:
    n, s1, s2, s3 = r["n"], r["sx"], r["sxx"], r["cubes"]
    gap = s1 / n
    spread = s2 - s1 * gap
    spread = spread if spread > NOISE * s2 else 0.0
    variance = spread / (n - 1) if n > 1 else None
    skewness = None
    if spread:
        third = s3 - 3 * gap * s2 + 2 * n * gap**3
        skewness = third / n / (spread / n) ** 1.5
    return Moments(int(n), r["total"] / n, variance, skewness, r["low"], r["high"])


def _deviation(n: float, s: float, ss: float) -> float:
    spread = ss - s * s / n
    return math.sqrt(spread / n) if spread > NOISE * ss else 0.0


def pair_statistics(df: DataFrame, names: Sequence[str]) -> dict[tuple[str, str], tuple]:
    return summarise(df, names)[1] if len(names) > 1 else {}


def pearson(statistics: tuple) -> float | None:
    """r, or None where it is undefined (constant or fewer than two rows)."""
    n, covariance, sx, sy = statistics
    if not n or n < 2 or not sx or not sy or covariance is None:
        return None
    r = covariance / (sx * sy)
    if math.isnan(r):
        return None
    return max(-1.0, min(1.0, r))
