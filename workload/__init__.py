"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from workload import (
    chart_queries,
    cleaning_queries,
    feature_queries,
    profile_queries,
    source_queries,
    sql_queries,
    statistics_queries,
)

MODULES = [
    profile_queries,
    cleaning_queries,
    feature_queries,
    statistics_queries,
    chart_queries,
    sql_queries,
    source_queries,
]

QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
