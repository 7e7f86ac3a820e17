"""Series preparation, seasonal decomposition and ARIMA forecasts."""

from __future__ import annotations

import functools
import json
import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.errors import AnalysisError
from tabulon.functions import special
from tabulon.functions.columns import as_double, col, require, require_numeric
from tabulon.functions.parsing import as_timestamp
from tabulon.plans import arma
from tabulon.plans.layout import settle
from tabulon.plans.ordered import ROWS_PER_TASK, largest_group, sliding, with_positions
from tabulon.plans.results import result_frame

BROADCAST_LIMIT = 100_000
PIECE_VALUES = 1 << 16  # timestamps of a series that a task fits together
STRETCH = 256  # pieces that are composed together


def prepare_series(df: DataFrame, date: str, value: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean value per timestamp, unparseable dates and missing values dropped."""
    require(df, date, value, *group_cols)
    require_numeric(df, value)
    rows = df.select(
        *[col(g) for g in group_cols], as_timestamp(df, date).alias("date"), as_double(df, value).alias("value")
    ).filter(F.col("date").isNotNull() & F.col("value").isNotNull())
    return rows.groupBy(*[col(g) for g in group_cols], "date").agg(F.avg("value").alias("value"))


def frequency(series: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> str | None:
    """D, B, MS, ME, QS, QE, YS or YE of a single series, None when irregular."""
    stepped = sliding(
        series.select("date"),
        lambda spec: {"before": F.lag("date").over(spec)},
        ["date"],
        before=1,
        rows_per_task=rows_per_task,
    )
    at, before = F.col("date"), F.col("before")
    day = F.date_trunc("day", at)
    gap = F.datediff(at, before)
    months = (F.year(at) - F.year(before)) * 12 + F.month(at) - F.month(before)
    weekend = (F.weekday(before) == 4) & (gap == 3) | (F.weekday(before) < 4) & (gap == 1)
    row = stepped.agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(at == day).alias("midnight"),
        F.min(gap).alias("g0"),
        F.max(gap).alias("g1"),
        F.min(months).alias("m0"),
        F.max(months).alias("m1"),
        F.bool_and(F.dayofmonth(at) == 1).alias("starts"),
        F.bool_and(F.last_day(at) == at.cast("date")).alias("ends"),
        F.bool_and((F.weekday(at) < 5) & F.coalesce(weekend, F.lit(True))).alias("business"),
        F.min(F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).alias("t0"),
        F.max(F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).alias("t1"),
    ).first()
    if row["n"] < 3:
        return None
    if row["t0"] == row["t1"]:
        if row["g0"] == row["g1"] == 1:
            return "D"
        if row["business"] and row["g0"] == 1:
            return "B"
        if row["m0"] == row["m1"] and row["m0"] in (1, 3, 12) and (row["starts"] or row["ends"]):
            return {1: "M", 3: "Q", 12: "Y"}[row["m0"]] + ("S" if row["starts"] else "E")
    return None


# Observations per season of each regular frequency.
SEASONS = {"MS": 12, "ME": 12, "QS": 4, "QE": 4, "D": 7, "B": 7}


def infer_period(series: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Season length from the frequency, else a sixth of the length within 2 to 12."""
    n = series.count()
    guess = SEASONS.get(frequency(series, rows_per_task) or "", max(2, min(12, n // 6)))
    return clip_period(guess, n)


def clip_period(period: int, n: int) -> int:
    return max(2, min(int(period), max(2, n // 2)))


def period_table(df: DataFrame, date: str, value: str) -> DataFrame:
    """One row: observations, frequency and season length of a series."""
    series = prepare_series(df, date, value)
    n = series.count()
    found = frequency(series)
    guess = SEASONS.get(found or "", max(2, min(12, n // 6)))
    return result_frame(
        df.sparkSession, [(n, found, clip_period(guess, n))], "n_observations long, frequency string, period int"
    )


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a per-series table once its size is known to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_LIMIT + 1).count() <= BROADCAST_LIMIT else df


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"{k}__r") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[f"`{k}`"].eqNullSafe(renamed[f"`{k}__r`"])
    return left.join(_small(renamed), condition).drop(*[f"{k}__r" for k in keys])


def _line(chosen: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Slope and intercept over the chosen rows; one row alone gives the shortest solution."""
    inside = F.when(chosen, x.cast("double"))
    value = F.when(chosen, y)
    slope = F.regr_slope(value, inside)
    one = F.max(inside)
    alone = F.max(value) / (one * one + 1)
    return F.coalesce(slope, one * alone), F.coalesce(F.regr_intercept(value, inside), alone)


def decompose(
    df: DataFrame,
    date: str,
    value: str,
    period: int | None = None,
    model: str = "additive",
    group_cols: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Trend, seasonal and residual part of each observation.

    The trend is a centred moving average, continued at both ends by a line
    through the nearest ``period`` trend values. Every step is a window by
    position or an aggregate by season, so one long series is spread over tasks.
    """
    if model not in ("additive", "multiplicative"):
        raise AnalysisError("model must be additive or multiplicative")
    keys = list(group_cols)
    series = settle(prepare_series(df, date, value, keys))
    sizes = series.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    longest = largest_group(series, keys)
    if not longest:
        raise AnalysisError("No valid rows after parsing dates")
    if period is None:
        if keys:
            raise AnalysisError("Give the period when decomposing several series")
        period = infer_period(series, rows_per_task)
    period = clip_period(period, longest)
    if longest < 2 * period:
        raise AnalysisError(f"Need at least {2 * period} observations for decomposition")
    half = period // 2

    placed = with_positions(series, ["date"], keys, name="__i", total=longest, rows_per_task=rows_per_task)
    placed = placed.withColumn("__i", F.col("__i") - 1)
    sized = _join(placed, sizes, keys)

    def averages(spec) -> dict[str, Column]:
        if period % 2:
            return {"__avg": F.avg("value").over(spec.rowsBetween(-half, half))}
        behind = F.avg("value").over(spec.rowsBetween(-half, half - 1))
        ahead = F.avg("value").over(spec.rowsBetween(1 - half, half))
        return {"__avg": (behind + ahead) / 2}

    smooth = settle(
        sliding(sized, averages, ["__i"], keys, before=half, after=half, total=longest, rows_per_task=rows_per_task)
    )
    i, n = F.col("__i"), F.col("__n")
    first, last = F.lit(half), n - 1 - half
    # A series too short for two seasons keeps its rows, without parts.
    inner = F.when((i >= first) & (i <= last) & (n >= 2 * period), F.col("__avg"))
    smooth = smooth.withColumn("__inner", inner)
    head = (i >= first) & (i < F.least(first + period, last))
    tail = (i >= F.greatest(first, last - period)) & (i < last)
    head_slope, head_level = _line(head, i, F.col("__inner"))
    tail_slope, tail_level = _line(tail, i, F.col("__inner"))
    ends = smooth.groupBy(*[col(k) for k in keys]).agg(
        head_slope.alias("__hs"), head_level.alias("__hl"), tail_slope.alias("__ts"), tail_level.alias("__tl")
    )
    full = _join(smooth, ends, keys)
    trend = (
        F.when(i < first, i * F.col("__hs") + F.col("__hl"))
        .when(i > last, i * F.col("__ts") + F.col("__tl"))
        .otherwise(F.col("__inner"))
    )
    full = full.withColumn("trend", trend).withColumn("__phase", F.col("__i") % period)
    additive = model == "additive"
    detrended = F.col("value") - F.col("trend") if additive else F.try_divide(F.col("value"), F.col("trend"))
    phases = full.groupBy(*[col(k) for k in keys], "__phase").agg(F.avg(detrended).alias("__raw"))
    centre = phases.groupBy(*[col(k) for k in keys]).agg(F.avg("__raw").alias("__centre"))
    seasons = _join(phases, centre, keys)
    raw, middle = F.col("__raw"), F.col("__centre")
    seasons = seasons.withColumn("seasonal", raw - middle if additive else F.try_divide(raw, middle))
    out = _join(full, seasons.select(*[col(k) for k in keys], "__phase", "seasonal"), [*keys, "__phase"])
    value_, trend_, seasonal = F.col("value"), F.col("trend"), F.col("seasonal")
    residual = value_ - trend_ - seasonal if additive else F.try_divide(value_, trend_ * seasonal)
    return out.select(
        *[col(k) for k in keys], "date", "value", "trend", "seasonal", residual.alias("residual"), F.lit(period).alias("period")
    )


def forecast_arima(
    df: DataFrame,
    date: str,
    value: str,
    periods: int = 12,
    p: int = 1,
    d: int = 1,
    q: int = 1,
    alpha: float = 0.05,
    group_cols: Sequence[str] = (),
    rows_per_piece: int = PIECE_VALUES,
) -> DataFrame:
    """ARIMA forecasts with intervals, one model per series, by conditional least squares.

    A series is cut into pieces of ``rows_per_piece`` timestamps. Each pass fits all pieces of
    all series side by side and composes what they found, so a series may be of any length;
    one of a single piece is fitted where it lies, by the same steps. Dates go on by the
    step of the series: equal gaps, months from their starts or ends, business days, else the
    median gap. A series of fewer than 8 timestamps gives one row without step and forecast.
    """
    if not 1 <= periods <= 120:
        raise AnalysisError("periods must be between 1 and 120")
    if min(p, d, q) < 0:
        raise AnalysisError("ARIMA orders must be non-negative")
    if not 0 < alpha < 1:
        raise AnalysisError("alpha must be between 0 and 1")
    keys = list(group_cols)
    if rows_per_piece <= p + d + 1:
        raise AnalysisError("rows_per_piece must exceed the orders")
    series = settle(prepare_series(df, date, value, keys))
    longest = largest_group(series, keys)
    if longest < 8:
        raise AnalysisError("Need at least 8 observations for ARIMA forecasting")
    orders, context = arma.Orders(p, q, d == 0), p + d + 1
    named = {k: f"__k{i}" for i, k in enumerate(keys)}
    pieces = _pieces(series, named, longest, context, rows_per_piece)
    group = list(named.values())
    types = {n: pieces.schema[n].dataType.simpleString() for n in group}
    z = special.normal_quantile(1 - alpha / 2)
    schema = _schema(types) + FORECAST

    def rows(part: pd.Series, found: arma.Fit | None, dates: list | None) -> pd.DataFrame:
        names = ["date", "step", "forecast", "lower_ci", "upper_ci", "aic", "bic", "n_observations"]
        if found is None:  # too short for a model: one row that says so
            out = pd.DataFrame({n: [None] for n in names} | {"n_observations": [part["n"]]})
        else:
            level, spread, aic, bic = predict(found, np.asarray(part["values"], dtype=float), d, part["n"], periods)
            out = pd.DataFrame(
                {
                    "date": dates, "step": np.arange(1, periods + 1), "forecast": level, "lower_ci": level - z * spread,
                    "upper_ci": level + z * spread, "aic": aic, "bic": bic, "n_observations": part["n"],
                }
            )
        for name in group:
            out[name] = part[name]
        return out[[*group, *names]]

    def at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.iterrows():
                if part["n"] < 8:
                    yield rows(part, None, None)
                else:
                    stamps = np.asarray(part["dates"], dtype=np.int64)
                    dates = future_dates(int(stamps[-1]), step_of(stamps, 0), float(np.median(np.diff(stamps))), periods)
                    yield rows(part, arma.fit(np.diff(np.asarray(part["values"], dtype=float), n=d), orders), dates)

    result = pieces.where(F.col("n") <= rows_per_piece).mapInPandas(at_once, schema)
    if longest > rows_per_piece:
        long = pieces.where(F.col("n") > rows_per_piece)
        fits = _fit_in_passes(long, group, types, orders, d)
        steps = _steps_of(long, group)

        def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, part in batch.iterrows():
                    found = arma.Fit(orders, **json.loads(part["fit"]))
                    dates = future_dates(int(part["dates"][-1]), part["found"].asDict() if hasattr(part["found"], "asDict") else dict(part["found"]), part["middle"], periods)
                    yield rows(part, found, dates)

        last = long.where(F.col("piece") == F.floor((F.col("n") - 1) / rows_per_piece))
        last = _join(_join(last, fits, group), steps, group)
        result = result.unionByName(last.mapInPandas(settled, schema))
    plain = [f.split()[0] for f in FORECAST.split(", ")]
    return result.select(*[F.col(n).alias(k) for k, n in named.items()], *plain)


FORECAST = "date timestamp_ntz, step int, forecast double, lower_ci double, upper_ci double, aic double, bic double, n_observations long"


def _schema(types: dict[str, str]) -> str:
    return "".join(f"`{n}` {t}, " for n, t in types.items())


def _pieces(series: DataFrame, named: dict[str, str], longest: int, context: int, size: int) -> DataFrame:
    """A row for each piece of each series: its number, the length n of the series, dates
    (microseconds) and values in order, and how many of them lie in front of the piece."""
    group = list(named.values())
    series = series.select(*[col(k).alias(n) for k, n in named.items()], "date", "value")
    sizes = series.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    placed = _join(with_positions(series, ["date"], group, name="__i", total=longest), sizes, group)
    index = F.col("__i") - 1
    own = F.floor(index / size)
    again = (index % size >= size - context) & (index < F.floor((F.col("n") - 1) / size) * size)
    homes = F.when(again, F.array(own, own + 1)).otherwise(F.array(own))
    placed = placed.select(*group, "n", index.alias("i"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', date)").alias("t"), "value", F.explode(homes).alias("piece"))
    # At most `size` rows and the context: a bounded list.
    found = placed.groupBy(*group, "n", "piece").agg(F.array_sort(F.collect_list(F.struct("i", "t", "value"))).alias("rows"))
    return settle(
        found.select(
            *group, "n", "piece", F.transform("rows", lambda r: r["t"]).alias("dates"), F.transform("rows", lambda r: r["value"]).alias("values"),
            (F.col("piece") * size - F.element_at("rows", 1)["i"]).alias("context"), (F.col("piece") * size).alias("start"),
        )
    )


def _fit_in_passes(pieces: DataFrame, group: list[str], types: dict[str, str], orders: arma.Orders, d: int) -> DataFrame:
    """The fit of each series as JSON, pass by pass over its pieces."""
    keys = _schema(types)

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, part in batch.iterrows():
                values = np.diff(np.asarray(part["values"], dtype=float), n=d)
                # The first piece has no context, and its first d values no difference.
                context, start = max(0, int(part["context"]) - d), max(0, int(part["start"]) - d)
                found = [arma.summarise(values, context, start, np.array(t), orders) for t in json.loads(part["fit"])["trials"]]
                out.append([*part[group], part["piece"], part["fit"], pickle.dumps(found)])
            yield pd.DataFrame(out, columns=[*group, "piece", "fit", "found"])

    def composed(found: pd.DataFrame) -> list[arma.Summary]:
        ordered = [pickle.loads(x) for x in found.sort_values("piece")["found"]]
        return [functools.reduce(arma.compose, trial) for trial in zip(*ordered, strict=True)]

    def stretch(part: pd.DataFrame) -> pd.DataFrame:
        out = part.iloc[:1][[*group, "fit"]].copy()
        out["piece"], out["found"] = part["piece"].min(), pickle.dumps(composed(part))
        return out[[*group, "piece", "fit", "found"]]

    def update(part: pd.DataFrame) -> pd.DataFrame:
        fit = arma.Fit(orders, **json.loads(part["fit"].iloc[0]))
        fit.update(composed(part))
        out = part.iloc[:1][[*group]].copy()
        out["fit"], out["done"] = _as_json(fit), fit.done
        return out

    own = F.slice("values", F.col("context") + 1, F.greatest(F.size("values") - F.col("context"), F.lit(0)).cast("int"))
    sums = pieces.select(*group, F.aggregate(own, F.lit(0.0), lambda a, x: a + x).alias("sum"), "n")
    means = sums.groupBy(*group).agg((F.sum("sum") / F.max("n")).alias("mean"))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["fit"] = [_as_json(arma.Fit.begin(orders, m)) for m in batch["mean"]]
            yield batch[[*group, "fit"]]

    open_fits = settle(means.mapInPandas(begin, f"{keys}fit string"))
    finished, found_type = None, f"{keys}piece long, fit string, found binary"
    long = pieces.agg(F.max("piece")).first()[0] >= STRETCH
    for _ in range(arma.MAX_PASSES):
        found = _join(pieces.select(*group, "piece", "context", "start", "values"), open_fits, group).mapInPandas(summaries, found_type)
        if long:
            parts = found.withColumn("stretch", F.floor(F.col("piece") / STRETCH))
            found = parts.groupBy(*group, "stretch").applyInPandas(stretch, found_type)
        state = settle(found.groupBy(*group).applyInPandas(update, f"{keys}fit string, done boolean"))
        ready = state.where("done").drop("done")
        finished = ready if finished is None else finished.unionByName(ready)
        open_fits = state.where(~F.col("done")).drop("done")
        if open_fits.isEmpty():
            break
    return finished


def _as_json(fit: arma.Fit) -> str:
    names = ["trials", "theta", "products", "state", "damping", "passes", "done"]
    return json.dumps({n: getattr(fit, n) for n in names})


DAY = 86_400_000_000  # microseconds


def step_of(stamps: np.ndarray, context: int) -> dict:
    """What the dates (microseconds) of a piece tell about the step of the series."""
    gaps = np.diff(stamps[max(0, context - 1) :])
    at = stamps[max(0, context - 1) :].astype("datetime64[us]")
    months, days = at.astype("datetime64[M]"), at.astype("datetime64[D]")
    steps = np.diff(months.astype(np.int64))
    weekday = (days.astype(np.int64) + 3) % 7
    clock = stamps[max(0, context - 1) :] % DAY
    whole = np.diff(days.astype(np.int64))
    return {
        "least_gap": int(gaps.min(initial=2**62)), "most_gap": int(gaps.max(initial=0)),
        "least_months": int(steps.min(initial=2**31)), "most_months": int(steps.max(initial=0)),
        "least_clock": int(clock.min()), "most_clock": int(clock.max()),
        "starts": bool((days == months.astype("datetime64[D]")).all()),
        "ends": bool((days == (months + 1).astype("datetime64[D]") - 1).all()),
        "business": bool((weekday < 5).all() and np.where(weekday[:-1] == 4, whole == 3, whole == 1).all()),
    }


STEP = "least_gap long, most_gap long, least_months long, most_months long, least_clock long, most_clock long, starts boolean, ends boolean, business boolean"


def _steps_of(pieces: DataFrame, group: list[str]) -> DataFrame:
    """`step_of` of whole series, and their median gap, which a histogram of gaps gives exactly."""
    names = [f.split()[0] for f in STEP.split(", ")]
    types = {n: pieces.schema[n].dataType.simpleString() for n in group}

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [step_of(np.asarray(d, dtype=np.int64), int(c)) for d, c in zip(batch["dates"], batch["context"], strict=True)]
            yield pd.concat([batch[group].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    steps = pieces.select(*group, "dates", "context").mapInPandas(look, _schema(types) + STEP)
    merged = [(F.min(n) if n.startswith("least") else F.max(n) if n.startswith("most") else F.bool_and(n)).alias(n) for n in names]
    steps = steps.groupBy(*group).agg(*merged).select(*group, F.struct(*names).alias("found"))
    here = F.slice("dates", F.greatest(F.col("context"), F.lit(1)).cast("int"), F.size("dates"))
    pairs = F.arrays_zip(F.slice(here, 2, F.size("dates")).alias("b"), here.alias("a"))
    gaps = pieces.select(*group, F.explode(F.transform(pairs, lambda p: p["b"] - p["a"])).alias("gap")).where(F.col("gap").isNotNull())
    counts = gaps.groupBy(*group, "gap").agg(F.count(F.lit(1)).alias("times"))
    middle = grouped_median(counts, group)
    return _join(steps, middle, group)


def grouped_median(counts: DataFrame, group: list[str]) -> DataFrame:
    """Median of counted values (gap, times) of each group: equal gaps are one row."""
    spec = Window.partitionBy(*group).orderBy("gap") if group else Window.orderBy("gap")
    upto = counts.withColumn("upto", F.sum("times").over(spec)).withColumn("total", F.sum("times").over(spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda rank: (F.col("upto") - F.col("times") <= rank) & (rank < F.col("upto"))
    return upto.groupBy(*group).agg(((F.max(F.when(holds(low), F.col("gap"))) + F.max(F.when(holds(high), F.col("gap")))) / 2).alias("middle"))


def future_dates(last: int, step: dict, middle: float, periods: int) -> list:
    """The dates that follow the last one (microseconds)."""
    at = pd.Timestamp(last, unit="us")
    same_clock = step["least_clock"] == step["most_clock"]
    if step["least_gap"] == step["most_gap"]:
        return [at + pd.Timedelta(step["least_gap"] * i, "us") for i in range(1, periods + 1)]
    if same_clock and step["least_months"] == step["most_months"] > 0 and (step["starts"] or step["ends"]):
        offset = pd.offsets.MonthBegin if step["starts"] else pd.offsets.MonthEnd
        return [at + offset(int(step["least_months"]) * i) for i in range(1, periods + 1)]
    if same_clock and step["business"]:
        return [at + pd.offsets.BDay(i) for i in range(1, periods + 1)]
    return [at + pd.Timedelta(middle * i, "us") for i in range(1, periods + 1)]


def predict(found: arma.Fit, values: np.ndarray, d: int, n: int, periods: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Point forecasts and standard errors on the scale of the series, AIC and BIC, from the
    fit and the last values."""
    mean, ar, ma = found.orders.split(np.array(found.theta or [0.0] * found.orders.size))
    used = n - d - found.orders.p
    variance = found.loss / used
    likelihood = -0.5 * used * (math.log(2 * math.pi * max(variance, 1e-300)) + 1)
    size = found.orders.size + 1
    history = list(np.diff(values, n=d) - mean)
    errors = list(reversed((found.state or [0.0])[: max(found.orders.q, 1)]))
    ahead = []
    for _ in range(periods):
        value = sum(a * history[-i] for i, a in enumerate(ar, 1) if i <= len(history))
        value += sum(m * errors[-j] for j, m in enumerate(ma, 1) if j <= len(errors))
        history.append(value)
        errors.append(0.0)
        ahead.append(value + mean)
    level = np.array(ahead)
    for order in range(d, 0, -1):
        level = np.diff(values, n=order - 1)[-1] + np.cumsum(level)
    psi = np.zeros(periods)
    psi[0] = 1.0
    for j in range(1, periods):
        psi[j] = (ma[j - 1] if j <= len(ma) else 0.0) + sum(a * psi[j - i] for i, a in enumerate(ar, 1) if i <= j)
    for _ in range(d):
        psi = np.cumsum(psi)
    return level, np.sqrt(variance * np.cumsum(psi**2)), 2 * size - 2 * likelihood, size * math.log(used) - 2 * likelihood
