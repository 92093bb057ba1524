"""Window operators over ordered ticks of an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(ticks: DataFrame, key: str, stale: int) -> DataFrame:
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t"))
    return ticks.withColumn("gap", gap).groupBy(key).agg(F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > stale).cast("long").alias("stale_gaps"))


def transitions(ticks: DataFrame, key: str) -> DataFrame:
    """Ticks whose state differs from the one before, with the direction of the change (null counts as a state)."""
    w = Window.partitionBy(key).orderBy("t")
    rows = ticks.select(key, "t", "state", F.lag("state").over(w).alias("before"), F.row_number().over(w).alias("k")).filter("k > 1").filter(~F.col("state").eqNullSafe(F.col("before")))
    direction = F.when(F.col("before") & ~F.col("state"), "degradation").when(~F.col("before") & F.col("state"), "recovery").otherwise("other")
    return rows.select(key, "t", direction.alias("direction"))


def episodes(ticks: DataFrame, key: str) -> DataFrame:
    """Runs of one state: episode number, start, interval-censored age bounds at each tick."""
    w = Window.partitionBy(key).orderBy("t")
    changed = (F.row_number().over(w) > 1) & ~F.col("state").eqNullSafe(F.lag("state").over(w))
    rows = ticks.select(key, "t", "state", changed.cast("int").alias("changed"), F.lag("t").over(w).alias("prior"))
    rows = rows.withColumn("episode", F.sum("changed").over(w))
    inside = Window.partitionBy(key, "episode").orderBy("t")
    start, before = F.first("t").over(inside), F.first("prior").over(inside)
    return rows.select(key, "t", F.col("episode").cast("long").alias("episode"), before.isNull().alias("left_censored"), (F.col("t") - start).alias("age_lower"), (F.col("t") - before).alias("age_upper"))


def block_means(rows: DataFrame, key: str, size: int, value: str) -> DataFrame:
    """Mean per block of ``size`` from the group's own first time, then mean and deviation of the block means."""
    origin = F.min("t").over(Window.partitionBy(key))
    block = F.floor((F.col("t") - origin) / size)
    means = rows.select(key, block.alias("block"), value).groupBy(key, "block").agg(F.avg(value).alias("m"))
    return means.groupBy(key).agg(F.count("*").cast("long").alias("blocks"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("deviation"))


def interval_union(rows: DataFrame, key: str) -> DataFrame:
    """Length covered by the union of [start, stop) intervals, and their plain sum."""
    reach = F.max("stop").over(Window.partitionBy(key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce(reach, F.col("start"))), F.lit(0))
    return rows.withColumn("fresh", fresh).groupBy(key).agg(F.sum("fresh").cast("long").alias("covered"), F.sum(F.col("stop") - F.col("start")).cast("long").alias("total"))


def active_causes(rows: DataFrame, key: str) -> DataFrame:
    """Largest number of intervals that are active at once per entity; ends come before starts at one instant."""
    marks = rows.select(key, F.col("start").alias("t"), F.lit(1).alias("d")).unionByName(rows.select(key, F.col("stop").alias("t"), F.lit(-1).alias("d")))
    running = F.sum("d").over(Window.partitionBy(key).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("active", running).groupBy(key).agg(F.max("active").cast("long").alias("most_active"))


def binned(rows: DataFrame, size: int, value: str, block: int = 4096) -> DataFrame:
    """One row per bin from the first to the last, with the mean or zero and the last known mean carried on.

    Bins are dealt in blocks of time: each is filled by itself, and what it begins with is the last known mean of the
    blocks before, one row a block.
    """
    means = rows.groupBy(F.floor(F.col("t") / size).alias("bin")).agg(F.avg(value).alias("m"))
    ends = means.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).filter("a IS NOT NULL")
    blocks = ends.select("a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))).alias("block"))
    grid = blocks.repartition("block").select("block", F.explode(F.sequence(F.greatest("a", F.col("block") * block), F.least("b", (F.col("block") + 1) * block - 1))).alias("bin"))
    known = means.withColumn("block", F.floor(F.col("bin") / block))
    last = blocks.select("block").join(known.groupBy("block").agg(F.max_by("m", F.when(F.col("m").isNotNull(), F.col("bin"))).alias("last")), "block", "left")
    before = last.select("block", F.last("last", True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    w = Window.partitionBy("block").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(known, ["block", "bin"], "left").join(before, "block", "left")
    return filled.select("bin", F.coalesce("m", F.lit(0.0)).alias("zero_filled"), F.coalesce(F.last("m", True).over(w), F.col("before")).alias("carried"))


def autocorrelation(rows: DataFrame, key: str, value: str, lag: int = 1) -> DataFrame:
    """Correlation of each value with the one ``lag`` places before, per entity."""
    before = F.lag(value, lag).over(Window.partitionBy(key).orderBy("t"))
    pairs = rows.select(key, F.col(value).alias("x"), before.alias("y")).filter("y IS NOT NULL")
    return pairs.groupBy(key).agg(F.count("*").cast("long").alias("pairs"), F.corr("x", "y").alias("r"))


def holm(rows: DataFrame, family: list[str], p: str, order: str) -> DataFrame:
    """Step-down adjusted p-values within a family; null p-values stay null and do not count."""
    known = rows.filter(F.col(p).isNotNull())
    w = Window.partitionBy(*family).orderBy(p, order)
    m = F.count("*").over(Window.partitionBy(*family))
    step = known.withColumn("step", (m - F.row_number().over(w) + 1) * F.col(p))
    adjusted = step.withColumn("adjusted", F.least(F.lit(1.0), F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("step")
    return adjusted.unionByName(rows.filter(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))
