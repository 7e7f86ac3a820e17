"""Mixing sources to target weights by temperature.

A source's share of the tokens, raised to an exponent and normalised, is its weight. The
exponent is bisected so that the weights have a target entropy, or so that no source is
repeated more often than a limit allows. Weights become budgets of tokens, and budgets
become passes over the source: each pass visits the source's blocks in a new order, and
the last pass stops at the document that would overrun the budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.llm.common import col, cut, fresh

BLOCKS = 1024  # of each source; a block is the documents whose hash says so
STEPS = 60  # of the bisection
DIGITS = 9  # the exponent and the weights are rounded to so many decimals
# Sources known by name; the rest of an unbounded key would not be a set of sources.
MAX_SOURCES = 100_000
CELLS = 1 << 20  # blocks of all sources together


@dataclass(frozen=True)
class Plan:
    exponent: float
    weights: dict[str | None, float]
    budgets: dict[str | None, int]
    tokens: dict[str | None, int]


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def weights_at(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    powers = {s: math.pow(n / total, exponent) for s, n in tokens.items()}
    norm = math.fsum(powers.values())
    return {s: round(p / norm, DIGITS) for s, p in powers.items()}


def plan_mixture(
    tokens: dict[str | None, int], ratio: float | None = 1.0, max_passes: float | None = None, entropy: float | None = None
) -> Plan:
    """Weights and budgets for `ratio` times all tokens; without a ratio, for as many as it
    takes to read every source at least once. Of the exponents from 0 (all sources alike)
    to 1 (as they come), the smallest is taken whose weights repeat no source more than
    `max_passes` times, or whose entropy in nats is at most `entropy`; 1 where none does.
    Sources without tokens get nothing."""
    if (max_passes is None) == (entropy is None):
        raise ValueError("one of max_passes and entropy says where to stop")
    own = {s: n for s, n in tokens.items() if n > 0}
    if not own:
        return Plan(1.0, {s: 0.0 for s in tokens}, {s: 0 for s in tokens}, dict(tokens))

    def total(weights: dict) -> int:
        if ratio is None:
            return math.ceil(max(n / weights[s] for s, n in own.items() if weights[s] > 0))
        return math.floor(ratio * sum(own.values()))

    def meets(exponent: float) -> bool:
        weights = weights_at(own, exponent)
        if max_passes is not None:
            budget = total(weights)
            return all(w * budget <= max_passes * own[s] for s, w in weights.items())
        return -math.fsum(w * math.log(w) for w in weights.values() if w > 0) <= entropy

    low, high = 0.0, 1.0
    if meets(low):
        high = low
    for _ in range(STEPS if high else 0):
        middle = (low + high) / 2
        low, high = (low, middle) if meets(middle) else (middle, high)
    exponent = round(high, DIGITS)
    weights = weights_at(own, exponent)
    budget = total(weights)
    budgets = {s: math.floor(weights.get(s, 0.0) * budget) for s in tokens}
    if ratio is None:  # what rounding has taken off
        budgets = {s: max(n, tokens[s]) for s, n in budgets.items()}
    return Plan(exponent, {s: weights.get(s, 0.0) for s in tokens}, budgets, dict(tokens))


def _digit(key: Column, *salt) -> Column:
    """The first 8 hexadecimal digits of an md5 as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *salt, key)), 1, 8), 16, 10).cast("bigint")


def mix_sources(
    docs: DataFrame,
    ratio: float | None = 1.0,
    max_passes: float | None = 4.0,
    entropy: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    result: str = "mixture",
) -> tuple[DataFrame, str, Plan]:
    """`docs` with one more struct column, that column's name (`result`, made longer where
    the input has such a column), and the plan. The column's fields: n_tokens, weight,
    block, turn and passes, how many times the document is read when the mixture is drawn
    (`draws` has the order).

    Each source's documents lie in blocks by hash of their id. A source with budget B and T
    tokens is read B div T times in whole; of the rest, whole blocks follow in hashed order,
    and in the block where the rest ends documents follow in hashed order while they fit. No
    source gets more than its budget; what is left is less than its next document.

    A null source is a source of its own. Null and empty texts have no tokens: they cost
    nothing and are read whenever their place in the order is reached; in a source without
    any tokens, once. Rows that repeat an id stand beside each other. More than MAX_SOURCES
    sources raise. The only rows that are shuffled are those of one block a source.
    """
    name, spark = fresh(docs, result), docs.sparkSession
    key = F.coalesce(col(id_col).cast("string"), F.lit(""))
    source = col(source_col).cast("string")
    fine = _digit(key, F.lit(seed)) % BLOCKS
    tokens_of = token_count(col(text_col))
    sums = cut(
        docs.select(source.alias("source"), fine.alias("block"), tokens_of.alias("n")).groupBy("source", "block").agg(F.sum("n").alias("in_block")),
        "blocks",
    )
    tokens = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("in_block").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(tokens) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = plan_mixture(tokens, ratio, max_passes, entropy)
    # So many cells at most are broadcast, however many sources there are.
    blocks = max(CELLS // MAX_SOURCES, min(BLOCKS, CELLS // max(1, len(tokens))))

    shares = spark.createDataFrame(
        [(s, plan.weights[s], plan.budgets[s] // n if n else 1, plan.budgets[s] % n if n else 0) for s, n in tokens.items()],
        "source string, weight double, whole bigint, rest bigint",
    )
    order = Window.partitionBy("source").orderBy("block_turn", "block")  # a source has `blocks` rows
    cells = (
        sums.groupBy("source", (F.col("block") % blocks).alias("block")).agg(F.sum("in_block").alias("in_block"))
        .withColumn("block_turn", _digit(F.col("block").cast("string"), F.lit(seed), F.coalesce("source", F.lit(""))))
        .withColumn("before", F.sum("in_block").over(order) - F.col("in_block"))
        .alias("b").join(F.broadcast(shares).alias("s"), F.col("s.source").eqNullSafe(F.col("b.source")))
        .select(F.col("b.source").alias("of"), F.col("block").alias("cell"), "weight", "whole", (F.col("rest") - F.col("before")).alias("room"), "in_block")
    )
    rows = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"), source.alias("source"), key.alias("key"), tokens_of.alias("n_tokens"),
        (fine % blocks).alias("block"), _digit(key, F.lit(seed), F.lit("turn")).alias("turn"),
    )
    rows = rows.join(F.broadcast(cells), (F.col("block") == F.col("cell")) & F.col("source").eqNullSafe(F.col("of")))
    # Only the block in which the rest ends needs an order of its documents.
    ends = (F.col("room") > 0) & (F.col("room") < F.col("in_block"))
    inside = Window.partitionBy("source", "block").orderBy("turn", "key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    part = rows.where(ends).withColumn("more", (F.sum("n_tokens").over(inside) <= F.col("room")).cast("bigint"))
    full = rows.where(~ends).withColumn("more", ((F.col("room") > 0) & (F.col("in_block") <= F.col("room"))).cast("bigint"))
    passes = (F.col("whole") + F.col("more")).alias("passes")
    found = F.struct("n_tokens", "weight", "block", "turn", passes)
    return part.unionByName(full).select(*[F.col("row")[c].alias(c) for c in docs.columns], found.alias(name)), name, plan


def draws(mixed: DataFrame, name: str, source_col: str = "source", seed: str = "mix") -> tuple[DataFrame, str]:
    """A mixture's documents, once for each reading, with a struct column and its name: pass,
    block_turn and turn, in whose order they are read. The blocks of a source have a new
    order in each pass."""
    order = fresh(mixed, "reading")
    each = mixed.withColumn(order, F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(col(name)["passes"], F.lit(1)))))
    each = each.where(col(order) <= col(name)["passes"])
    source = F.coalesce(col(source_col).cast("string"), F.lit(""))
    turn = _digit(col(name)["block"].cast("string"), F.lit(seed), source, col(order).cast("string"))
    return each.withColumn(order, F.struct(col(order).alias("pass"), turn.alias("block_turn"), col(name)["turn"].alias("turn"))), order
