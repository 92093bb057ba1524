"""Constraints as queries that return the violating rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(rule, violations): how many keys occur more than once."""
    return rows.groupBy(*keys).count().filter("count > 1").agg(F.count("*").cast("long").alias("violations")).select(F.lit(label).alias("rule"), "violations")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, label: str) -> DataFrame:
    missing = child.select(F.col(child_key).alias("k")).distinct().join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return missing.agg(F.count("*").cast("long").alias("violations")).select(F.lit(label).alias("rule"), "violations")


def missing_from_grid(grid: DataFrame, found: DataFrame, keys: list[str], label: str) -> DataFrame:
    return grid.join(found.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").cast("long").alias("violations")).select(F.lit(label).alias("rule"), "violations")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows of a that b lacks and the other way round, counted with repeats."""
    left = a.exceptAll(b).agg(F.count("*").cast("long").alias("n")).select(F.lit("left").alias("side"), "n")
    return left.unionByName(b.exceptAll(a).agg(F.count("*").cast("long").alias("n")).select(F.lit("right").alias("side"), "n"))


def assert_empty(violations: DataFrame, label: str) -> None:
    first = violations.head(1)
    if first:
        raise ValueError(f"{label}: {first[0]}")
