"""Missing-information experiments: stable random masks, staggered masks and nested budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.expr import kleene_and, stable_uniform


def stable_sample(rows: DataFrame, seed, key: Column, share: float) -> DataFrame:
    return rows.filter(stable_uniform("|", seed, key) < share)


def staggered(rows: DataFrame, tick: str, signals: list[str]) -> DataFrame:
    """Signal i is seen at ticks of its own parity only."""
    return rows.select(*[c for c in rows.columns if c not in signals], *[F.when((F.col(tick) + i) % 2 == 0, F.col(s)).alias(s) for i, s in enumerate(signals)])


def hash_ranks(cells: DataFrame, keys: list[str], order: Column, ties: list[str]) -> DataFrame:
    """``cells`` with ``rank`` from 1 and ``total`` within their key, in the order of a hexadecimal hash, then of ``ties``.

    Cells are ranked within the first digits of their hash, and what lies before these comes from counts of at most
    65,536 prefixes a key; so no task sorts all cells of a key.
    """
    hashed = cells.withColumn("_hash", order).withColumn("_prefix", F.substring("_hash", 1, 4))
    counts = hashed.groupBy(*keys, "_prefix").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    before = counts.select(*keys, "_prefix", F.coalesce(F.sum("_c").over(w.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("total"))
    own = F.row_number().over(Window.partitionBy(*keys, "_prefix").orderBy("_hash", *ties))
    same = F.col("a._prefix") == F.col("b._prefix")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    ranked = hashed.withColumn("_own", own).alias("a").join(before.alias("b"), same)
    return ranked.select(*[F.col(f"a.{c}") for c in cells.columns], (F.col("_before") + F.col("_own")).alias("rank"), "total")


def mask_experiment(rows: DataFrame, keys: list[str], signals: list[str], levels: list[float], seed: str) -> DataFrame:
    """Width of the conjunctive bounds when a nested share of the cells is hidden, in stable hash order within each key."""
    cells = rows.select("id", *keys, F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in signals])).alias("c")).select("id", *keys, "c.*")
    order = F.sha2(F.concat_ws("\0", F.lit(seed), F.col("id").cast("string"), "signal"), 256)
    ranked = hash_ranks(cells, keys, order, ["id", "signal"])
    at = ranked.select("*", F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level"))
    hidden = at.withColumn("value", F.when(F.col("rank") > F.floor(F.col("level") * F.col("total")), F.col("value")))
    wide = hidden.groupBy(*keys, "level", "id").agg(*[F.max(F.when(F.col("signal") == s, F.col("value"))).alias(s) for s in signals])
    every = kleene_and(*[F.col(s) for s in signals])
    return wide.groupBy(*keys, "level").agg(F.count("*").cast("long").alias("n"), F.count_if(every).cast("long").alias("lower_count"), F.count_if(F.coalesce(every, F.lit(True))).cast("long").alias("upper_count"))
