"""Aggregates of the chart builder, over the whole table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.errors import AnalysisError
from tabulon.functions.columns import as_double, as_text, col, is_numeric, require, type_of
from tabulon.functions.parsing import parse_number
from tabulon.operators.encode import BROADCAST_LIMIT
from tabulon.plans.ordered import with_positions
from tabulon.plans.quantiles import grouped_quantiles


def label(df: DataFrame, name: str) -> Column:
    require(df, name)
    return F.coalesce(as_text(df, name), F.lit("null"))


def amount(df: DataFrame, name: str | None) -> Column:
    """The value as a number, 0 where it is none; 1 per row without a value column."""
    if name is None:
        return F.lit(1.0)
    require(df, name)
    dtype = type_of(df, name)
    if isinstance(dtype, T.StringType):
        value = parse_number(col(name))
    elif isinstance(dtype, T.BooleanType):
        value = col(name).cast("double")
    elif is_numeric(dtype):
        value = as_double(df, name)
        value = F.when(F.abs(value) != F.lit(math.inf), value)
    else:
        value = F.lit(None).cast("double")
    return F.coalesce(value, F.lit(0.0))


def agg_single(df: DataFrame, label_column: str, value: str | None = None) -> DataFrame:
    return df.groupBy(label(df, label_column).alias("label")).agg(F.sum(amount(df, value)).alias("value"))


def agg_pairs(df: DataFrame, first: str, second: str, value: str | None = None) -> DataFrame:
    return df.groupBy(label(df, first).alias("first"), label(df, second).alias("second")).agg(
        F.sum(amount(df, value)).alias("value")
    )


def hierarchy(df: DataFrame, parent: str, child: str | None = None, value: str | None = None) -> DataFrame:
    """Parent totals (parent is empty) and leaves, for a treemap or sunburst."""
    if child is None:
        single = agg_single(df, parent, value)
        return single.select("label", F.lit("").alias("parent"), "value")
    slim = df.select(
        label(df, parent).alias("p"), label(df, child).alias("c"), amount(df, value).alias("v")
    )
    rolled = slim.rollup("p", "c").agg(F.sum("v").alias("value"), F.grouping_id().alias("g"))
    total_row = 3
    parent_row = 1
    return rolled.filter(F.col("g") != total_row).select(
        F.when(F.col("g") == parent_row, F.col("p")).otherwise(F.col("c")).alias("label"),
        F.when(F.col("g") == parent_row, F.lit("")).otherwise(F.col("p")).alias("parent"),
        "value",
    )


def edge_nodes(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(label, node) over both ends of the edges, numbered in label order, and their number."""
    ends = pairs.select(F.col("first").alias("label")).union(pairs.select(F.col("second").alias("label")))
    labels = ends.distinct()
    size = labels.count()
    placed = with_positions(labels, ["label"], name="node", total=size)
    return placed.withColumn("node", F.col("node") - 1), size


def flow_edges(df: DataFrame, source: str, target: str, value: str | None = None) -> DataFrame:
    """Weighted links between numbered nodes."""
    pairs = agg_pairs(df, source, target, value)
    nodes, size = edge_nodes(pairs)

    def side(end: str) -> DataFrame:
        keyed = nodes.select(F.col("label").alias(end), F.col("node").alias(f"{end}_node"))
        return F.broadcast(keyed) if size <= BROADCAST_LIMIT else keyed

    linked = pairs.join(side("first"), "first").join(side("second"), "second")
    return linked.select(
        F.col("first_node").alias("source"),
        F.col("second_node").alias("target"),
        F.col("first").alias("source_label"),
        F.col("second").alias("target_label"),
        "value",
    )


def network_nodes(df: DataFrame, first: str, second: str) -> DataFrame:
    """Nodes placed on a circle."""
    nodes, size = edge_nodes(agg_pairs(df, first, second))
    angle = F.lit(2 * math.pi / max(1, size)) * F.col("node")
    return nodes.select("node", "label", F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def network_edges(df: DataFrame, first: str, second: str) -> DataFrame:
    """Link counts between numbered nodes."""
    return flow_edges(df, first, second)


def geo_values(df: DataFrame, location: str, value: str) -> DataFrame:
    """Locations with values, and whether every location is a two-letter state code."""
    require(df, location, value)
    place = as_text(df, location)
    states = df.agg(F.bool_and(F.coalesce(place.rlike("^[A-Z]{2}$"), F.lit(False)))).first()[0]
    mode = "country names" if states is False else "USA-states"
    return df.select(
        F.coalesce(place, F.lit("")).alias("location"),
        amount(df, value).alias("z"),
        F.lit(mode).alias("location_mode"),
    )


def grouped_box(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, range, mean and size of a value per group."""
    require(df, group, value)
    if not is_numeric(type_of(df, value)):
        raise AnalysisError("A box needs a numeric value column")
    slim = df.select(label(df, group).alias("label"), as_double(df, value).alias("v"))
    slim = slim.filter(F.col("v").isNotNull())
    quartiles = grouped_quantiles(slim, ["label"], "v", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    rest = slim.groupBy("label").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    return quartiles.join(rest, "label")


def grouped_histogram(df: DataFrame, group: str, value: str, bins: int = 30) -> DataFrame:
    """Counts per group over shared equal-width bins of the finite values."""
    require(df, group, value)
    every_value = as_double(df, value)
    v = F.when(F.abs(every_value) < F.lit(float("inf")), every_value)
    seen = df.agg(F.min(v).alias("low"), F.max(v).alias("high")).first()
    if seen["low"] is None:
        raise AnalysisError(f"Column {value!r} has no finite value")
    width = (seen["high"] - seen["low"]) / bins
    place = F.lit(0) if width == 0 else F.least(F.floor((v - F.lit(seen["low"])) / F.lit(width)), F.lit(bins - 1))
    slim = df.filter(v.isNotNull()).select(label(df, group).alias("label"), place.cast("int").alias("bin"))
    return slim.groupBy("label", "bin").count()
