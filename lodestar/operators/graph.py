"""Span trees and service graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.lineage import settle


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def topology_edges(spans: DataFrame) -> DataFrame:
    """Cross-service edges from each span to its parent, with supporting spans and traces."""
    parents = spans.select(F.col("trace_id").alias("pt"), F.col("span_id").alias("ps"), F.col("service").alias("source"))
    pairs = spans.join(parents, (spans["trace_id"] == F.col("pt")) & (spans["parent_id"] == F.col("ps"))).filter("source <> service")
    return pairs.groupBy("source", F.col("service").alias("target")).agg(F.count("*").cast("long").alias("spans"), F.countDistinct("trace_id").cast("long").alias("traces"))


def trace_features(spans: DataFrame) -> DataFrame:
    """Span count and the sorted set of services per trace."""
    services = F.array_sort(F.collect_set("service"))
    return spans.groupBy("trace_id").agg(F.count("*").cast("long").alias("span_count"), F.array_join(services, ";").alias("services"), F.size(services).cast("long").alias("n_services"))


def nearest_selected_ancestor(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, ancestor): parents contracted to the nearest selected span, null at the top.

    Every unselected span's pointer passes over the unselected spans above it and doubles its reach each round,
    so the depth costs its logarithm. Raises on a cycle of unselected parents. Building the query runs the rounds.
    """
    ups = settle(spans.filter(~F.col("selected")).select(F.col("trace_id").alias("ut"), F.col("span_id").alias("us"), F.col("parent_id").alias("up")))
    for _ in range(64):
        above = ups.select(F.col("ut").alias("at"), F.col("us").alias("as"), F.col("up").alias("above"))
        step = ups.join(above, (F.col("ut") == F.col("at")) & (F.col("up") == F.col("as")), "left")
        moved = step.withColumn("moves", F.col("as").isNotNull())
        ups = settle(moved.select("ut", "us", F.when(F.col("moves"), F.col("above")).otherwise(F.col("up")).alias("up"), "moves"))
        if not ups.filter("moves").head(1):
            break
        ups = ups.drop("moves")
    else:
        raise ValueError("a cycle of unselected parents")
    ids = spans.filter("selected").select(F.col("trace_id").alias("it"), F.col("span_id").alias("id"))
    at = spans.filter("selected").select("trace_id", "span_id", "parent_id")
    at = at.join(ups.select("ut", "us", "up"), (F.col("trace_id") == F.col("ut")) & (F.col("parent_id") == F.col("us")), "left")
    at = at.select("trace_id", "span_id", F.when(F.col("us").isNotNull(), F.col("up")).otherwise(F.col("parent_id")).alias("ancestor"))
    known = at.join(ids, (F.col("trace_id") == F.col("it")) & (F.col("ancestor") == F.col("id")), "left")
    return known.select("trace_id", "span_id", F.col("id").alias("ancestor"))


def closure(edges: DataFrame) -> DataFrame:
    """(a, b): all pairs with a path, by repeated squaring until nothing is added; building the query runs the rounds."""
    reach = settle(edges.select("a", "b").distinct())
    before = -1
    while (after := reach.count()) != before:
        before = after
        x, y = reach.alias("x"), reach.alias("y")
        longer = x.join(y, F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        reach = settle(reach.unionByName(longer).distinct())
    return reach


def strong_components(reach: DataFrame) -> DataFrame:
    """(node, component): smallest mutually reachable node; only nodes on a cycle are listed."""
    mutual = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    return mutual.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
