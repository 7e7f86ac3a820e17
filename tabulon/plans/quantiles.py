"""Exact quantiles without holding a column's values in one aggregate buffer.

``percentile`` keeps every distinct value of a group in a single buffer, and a
full sort moves the whole column. Here a quantile sketch brackets each wanted
rank, one counting pass confirms how many rows lie below and inside each
bracket, and only rows inside (about 4 in 1,000) are looked at again. Brackets
that still hold too many rows are narrowed by histogram passes. The counts
prove the answer: a bracket that misses its rank is widened, so the result does
not depend on the sketch being right.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.columns import as_double, col, pick
from tabulon.plans.correlations import SKETCH_K
from tabulon.plans.ordered import ROWS_PER_TASK, running_sums

MARGIN = 0.002
COLLECT_LIMIT = 200_000
BUCKETS = 4096
LARGEST = 1.7976931348623157e308


def sketch_probabilities(probs: Sequence[float]) -> list[float]:
    edges = []
    for p in probs:
        edges += [max(0.0, p - MARGIN), min(1.0, p + MARGIN)]
    return edges


def sketch_columns(df: DataFrame, names: Sequence[str], probs: Sequence[float]) -> dict[str, Column]:
    """Aggregates of the first pass: size, range and the bracket of each quantile."""
    edges = sketch_probabilities(probs)
    out = {}
    for i, n in enumerate(names):
        v = as_double(df, n)
        out[f"q{i}_n"] = F.count(v)
        out[f"q{i}_lo"] = F.min(v)
        out[f"q{i}_hi"] = F.max(v)
        out[f"q{i}_edges"] = F.when(
            F.count(v) > 0,
            F.kll_sketch_get_quantile_double(
                F.kll_sketch_agg_double(v, SKETCH_K), F.array(*[F.lit(e) for e in edges])
            ),
        )
    return out


def _rank_pair(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    low = math.floor(h)
    high = min(low + 1, n - 1) if h > low else low
    return low, high, h - low


def _combine(low: float, high: float, fraction: float, interpolation: str) -> float:
    if low == high:
        return low
    if interpolation == "midpoint":
        return (low + high) / 2 if fraction > 0 else low
    return low + (high - low) * fraction


def exact_quantiles(
    df: DataFrame,
    names: Sequence[str],
    probs: Sequence[float],
    interpolation: str = "linear",
    sketch: dict | None = None,
    collect_limit: int = COLLECT_LIMIT,
    watch: dict[tuple, tuple] | None = None,
) -> dict[str, dict[float, float | None]]:
    """Quantiles per column; ``interpolation`` is ``linear`` or ``midpoint``.

    The keys of ``watch`` are (column, low, high); the first counting pass, if there is
    one, fills them with the rows below and the (low, high, rows) cells inside.
    """
    names, probs = list(names), list(probs)
    if not names:
        return {}
    base = pick(df, names)
    if sketch is None:
        aggs = sketch_columns(base, names, probs)
        sketch = base.agg(*[c.alias(k) for k, c in aggs.items()]).first().asDict()

    targets: dict[tuple[str, int], float | None] = {}
    brackets: dict[tuple[str, int], tuple[float, float]] = {}
    for i, n in enumerate(names):
        count = sketch[f"q{i}_n"]
        if not count:
            continue
        for j, p in enumerate(probs):
            low, high, _ = _rank_pair(count, p)
            edges = sketch[f"q{i}_edges"] or [sketch[f"q{i}_lo"], sketch[f"q{i}_hi"]] * len(probs)
            for rank in {low, high}:
                key = (n, rank)
                if key in targets:
                    continue
                targets[key] = None
                bracket = (edges[2 * j], edges[2 * j + 1])
                if rank == 0:
                    bracket = (sketch[f"q{i}_lo"], sketch[f"q{i}_lo"])
                elif rank == count - 1:
                    bracket = (sketch[f"q{i}_hi"], sketch[f"q{i}_hi"])
                brackets[key] = bracket
    whole = {n: (sketch[f"q{i}_lo"], sketch[f"q{i}_hi"]) for i, n in enumerate(names)}
    sizes = {n: sketch[f"q{i}_n"] for i, n in enumerate(names)}
    select_ranks(base, targets, brackets, whole, sizes, collect_limit, watch)

    result: dict[str, dict[float, float | None]] = {}
    for i, n in enumerate(names):
        count = sketch[f"q{i}_n"]
        result[n] = {}
        for p in probs:
            if not count:
                result[n][p] = None
                continue
            low, high, fraction = _rank_pair(count, p)
            result[n][p] = _combine(targets[n, low], targets[n, high], fraction, interpolation)
    return result


def _merge(spans: set) -> dict:
    """Map every (column, low, high) to the union of the spans it overlaps."""
    merged: dict = {}
    run: list = []
    for n, low, high in sorted(spans):
        if run and run[-1][0] == n and low <= run[-1][2]:
            run[-1][2] = max(run[-1][2], high)
            run[-1][3].append((n, low, high))
        else:
            run.append([n, low, high, [(n, low, high)]])
    for n, low, high, members in run:
        for member in members:
            merged[member] = (n, low, high)
    return merged


def select_ranks(base, targets, brackets, whole, sizes, collect_limit=COLLECT_LIMIT, watch=None) -> None:
    """Fill ``targets`` with the value at each (column, 0-based rank), and ``watch``."""
    waiting = list(watch or ())
    below: dict[tuple, int] = {}
    inside: dict[tuple, float] = {}
    for key in targets:
        if whole[key[0]][0] == whole[key[0]][1]:
            targets[key] = whole[key[0]][0]
    while open_keys := [k for k in targets if targets[k] is None]:
        merged = _merge({(n, *brackets[n, r]) for n, r in open_keys})
        spans = sorted(set(merged.values()))
        guess = {s: inside.get(s, 8 * MARGIN * sizes[s[0]] + 1) for s in spans}
        by_value = {s for s in spans if guess[s] <= collect_limit / len(spans)}
        uncounted = [s for s in spans if s not in below]
        counted, cells = _span_pass(base, list(dict.fromkeys([*spans, *waiting])), by_value, uncounted + waiting)
        below.update(counted)
        for s in waiting:
            watch[s] = (below[s], cells[s])
        waiting = []
        for n, rank in open_keys:
            span = merged[n, *brackets[n, rank]]
            seen = below[span]
            found = None
            if rank >= seen:
                for low, high, count in cells[span]:
                    if rank < seen + count:
                        found = (low, high)
                        break
                    seen += count
            if found is None:
                brackets[n, rank] = whole[n]
                below[n, *whole[n]] = 0
                inside[n, *whole[n]] = sizes[n]
            elif found[0] == found[1]:
                targets[n, rank] = found[0]
            else:
                brackets[n, rank] = found
                below[n, *found] = seen
                inside[n, *found] = count


def fences(q1: tuple[float, float], q3: tuple[float, float], factor: float) -> tuple[tuple, tuple] | None:
    """Where the two fences of a column lie if its quartiles lie in ``q1`` and ``q3``."""
    ends = (
        (q1[0] - factor * (q3[1] - q1[0]), q1[1] - factor * (q3[0] - q1[1])),
        (q3[0] + factor * (q3[0] - q1[1]), q3[1] + factor * (q3[1] - q1[0])),
    )
    return ends if all(math.isfinite(low) and low <= high for low, high in ends) else None


def rows_below(point: float, span: tuple, seen: tuple | None, or_equal: bool = False) -> int | None:
    """Rows under ``point`` from what a watched span has seen; None where that leaves it open."""
    if seen is None or not span[1] <= point <= span[2]:
        return None
    total, cells = seen
    for low, high, count in cells:
        first, last = (low <= point, high <= point) if or_equal else (low < point, high < point)
        if first != last:
            return None
        total += count * last
    return total


def _span_pass(base: DataFrame, spans, by_value, uncounted) -> tuple[dict, dict]:
    """Rows below each span, and its ordered (low, high, count) cells.

    A cell is one value where few rows are expected, else one of equal buckets.
    Everything comes from one scan; tasks combine their rows before the shuffle
    and a bounded number of cells comes back.
    """
    names = list(dict.fromkeys(s[0] for s in spans))
    slim = base.select(*[as_double(base, n).alias(f"c{i}") for i, n in enumerate(names)])
    plan = [
        (i, names.index(s[0]), s[1], s[2], s in by_value or s[1] == s[2], s in set(uncounted))
        for i, s in enumerate(spans)
    ]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below = np.zeros(len(plan), dtype="int64")
        for batch in batches:
            columns = [batch.iloc[:, i].to_numpy(dtype=float, na_value=np.nan) for i in range(len(names))]
            parts = []
            for i, column, low, high, single, wants_below in plan:
                v = columns[column]
                if wants_below:
                    below[i] += np.count_nonzero(v < low)
                hits = np.sort(v[(v >= low) & (v <= high)])
                if not hits.size:
                    continue
                bucket = hits if single else _bucket(hits, low, high)
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[starts[1:], hits.size]
                parts.append(
                    pd.DataFrame(
                        {"span": i, "bucket": bucket[starts], "low": hits[starts], "high": hits[ends - 1], "n": ends - starts}
                    )
                )
            if parts:
                yield pd.concat(parts)
        yield pd.DataFrame({"span": -1 - np.arange(len(plan)), "bucket": 0.0, "low": 0.0, "high": 0.0, "n": below})

    rows = (
        slim.mapInPandas(tally, "span int, bucket double, low double, high double, n long")
        .groupBy("span", "bucket")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        .collect()
    )
    counted: dict = {}
    cells: dict = {s: [] for s in spans}
    for row in sorted(rows, key=lambda r: (r["span"], r["low"])):
        if row["span"] >= 0:
            cells[spans[row["span"]]].append((row["low"], row["high"], row["n"]))
        elif plan[-1 - row["span"]][5]:
            counted[spans[-1 - row["span"]]] = row["n"]
    return counted, cells


def _bucket(values: np.ndarray, low: float, high: float) -> np.ndarray:
    low, high = max(low, -LARGEST), min(high, LARGEST)
    width = high / 2 - low / 2
    if width <= 0:
        return np.zeros(values.size)
    share = (values / 2 - low / 2) / width * BUCKETS
    return np.floor(np.clip(share, 0, BUCKETS - 1))


def grouped_quantiles(
    df: DataFrame,
    group_by: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    broadcast_limit: int = 100_000,
) -> DataFrame:
    """Exact linear quantiles of ``value`` per group, safe for a hot group.

    Values are counted per group, then running counts locate each wanted rank;
    a group larger than one task is spread over sorted pieces.
    """
    group_by = list(group_by)
    groups = [col(g) for g in group_by]
    slim = df.select(*groups, as_double(df, value).alias("__v")).filter(F.col("__v").isNotNull())
    total = slim.count()
    counted = slim.groupBy(*groups, "__v").agg(F.count(F.lit(1)).alias("__c"))
    placed = running_sums(
        counted,
        {"__cum": F.col("__c")},
        ["__v"],
        group_by,
        total=total,
        rows_per_task=rows_per_task,
        source=slim,
    )
    sizes = slim.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    keyed = sizes.select(*[col(g).alias(f"{g}__s") for g in group_by], "__n")
    if sizes.limit(broadcast_limit + 1).count() <= broadcast_limit:
        keyed = F.broadcast(keyed)
    condition = F.lit(True)
    for g in group_by:
        condition = condition & placed[f"`{g}`"].eqNullSafe(keyed[f"`{g}__s`"])
    ranked = placed.join(keyed, condition).drop(*[f"{g}__s" for g in group_by])

    aggs = []
    first = F.col("__cum") - F.col("__c")
    for i, p in enumerate(probs):
        h = (F.col("__n") - 1) * F.lit(float(p))
        for tag, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            holds = (first <= rank) & (rank < F.col("__cum"))
            aggs.append(F.max(F.when(holds, F.col("__v"))).alias(f"__{tag}{i}"))
    picked = ranked.groupBy(*groups).agg(F.max("__n").alias("__n"), *aggs)
    out = []
    for i, (p, n) in enumerate(zip(probs, names)):
        h = (F.col("__n") - 1) * F.lit(float(p))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((low + (high - low) * (h - F.floor(h))).alias(n))
    return picked.select(*groups, F.col("__n").alias("count"), *out)
