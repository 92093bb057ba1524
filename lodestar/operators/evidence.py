"""From raw evidence to three-valued signals, and how observed outcomes agree with what the evidence allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def probe_verdict(status: Column, check: Column, passing: str = "L7OK") -> Column:
    """UP with the passing check is true, DOWN is false, anything else null; a leading "* " marks a check in progress."""
    plain = F.regexp_replace(F.upper(F.trim(status)), r"^\* ", "")
    outcome = F.regexp_replace(F.upper(F.trim(check)), r"^\* ", "")
    return F.when((plain == "UP") & (outcome == passing), True).when(plain == "DOWN", False)


def compatibility(conjunction: Column, outcome: Column) -> Column:
    """Whether an observed outcome lies within the bounds that a three-valued conjunction leaves; unknown outcomes do."""
    return F.when(outcome & conjunction.eqNullSafe(False), "success_excluded").when(~outcome & conjunction.eqNullSafe(True), "failure_excluded").otherwise("compatible")


def span_graph_violations(spans: DataFrame) -> DataFrame:
    """(rule, violations) of (trace_id, span_id, parent_id): traces without exactly one root, and parents that are missing.

    A parent_id of 0 marks a root. Counts only: one aggregation and one anti-join.
    """
    roots = spans.groupBy("trace_id").agg(F.count_if(F.col("parent_id") == 0).alias("roots")).filter("roots <> 1")
    parents = spans.select("trace_id", F.col("span_id").alias("parent_id")).distinct()
    lost = spans.filter("parent_id <> 0").join(parents, ["trace_id", "parent_id"], "left_anti")
    count = lambda df, rule: df.agg(F.count("*").cast("long").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    return count(roots, "not one root").unionByName(count(lost, "missing parent"))


def quantile_higher(values: Column, probability: float) -> Column:
    """The smallest of a bounded group's values with at least ``probability`` of the ranks at or below it."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, (F.ceil((F.size(ordered) - 1) * F.lit(probability)) + 1).cast("int"))
