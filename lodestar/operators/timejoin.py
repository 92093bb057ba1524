"""Joins in time. As-of joins are a union and a window per entity: one shuffle, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(left: DataFrame, right: DataFrame, key: str, right_value: str) -> DataFrame:
    probes = right.select(key, "t", F.lit(0).alias("side"), F.struct(F.col("t").alias("at"), F.col(right_value).alias("v")).alias("probe"), F.lit(None).cast("long").alias("id"))
    asks = left.select(key, "t", F.lit(1).alias("side"), F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"), "id")
    return probes.unionByName(asks)


def asof_backward(left: DataFrame, right: DataFrame, key: str, value: str, max_age: int | None = None) -> DataFrame:
    """(id, key, t, probe_t, value): the latest probe at or before each ask; a null verdict is not skipped."""
    w = Window.partitionBy(key).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = _both(left, right, key, value).withColumn("probe", F.last("probe", True).over(w)).filter("side = 1")
    fresh = F.lit(True) if max_age is None else F.col("t") - F.col("probe.at") <= max_age
    return found.select("id", key, "t", F.when(fresh, F.col("probe.at")).alias("probe_t"), F.when(fresh, F.col("probe.v")).alias(value))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(id, key, t, probe_t, value): the probe nearest to each ask, the earlier one on a tie."""
    rows = _both(left, right, key, value)
    back = Window.partitionBy(key).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select("*", F.last("probe", True).over(back).alias("b"), F.last("probe", True).over(ahead).alias("f")).filter("side = 1")
    later = F.col("b").isNull() | (F.col("f.at") - F.col("t") < F.col("t") - F.col("b.at"))
    chosen = F.when(later & F.col("f").isNotNull(), F.col("f")).otherwise(F.col("b"))
    return found.select("id", key, "t", chosen["at"].alias("probe_t"), chosen["v"].alias(value))


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Number of half-open intervals [valid_from, valid_to) of the same entity around each point; null is open.

    Intervals become marks of +1 and -1 that are summed in order of time, so the rows are points and marks, however
    many intervals lie around a point. An interval that ends at or before its start holds no point.
    """
    whole = intervals.filter("valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)")
    blank = F.lit(None).cast(points.schema["id"].dataType)
    marks = whole.select(*keys, F.explode(F.array_compact(F.array(F.struct(F.col("valid_from").alias("t"), F.lit(1).alias("d")), F.when(F.col("valid_to").isNotNull(), F.struct(F.col("valid_to").alias("t"), F.lit(-1).alias("d")))))).alias("m"))
    rows = marks.select(*keys, "m.t", "m.d", F.lit(0).alias("side"), blank.alias("id")).unionByName(points.select(*keys, "t", F.lit(0).alias("d"), F.lit(1).alias("side"), "id"))
    w = Window.partitionBy(*keys).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    # A null entity or time equals none.
    known = F.col("t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    return rows.withColumn("n", F.sum("d").over(w)).filter("side = 1").select("id", F.when(known, F.col("n")).otherwise(0).cast("long").alias("n_active"))


def interval_homogeneous(asks: DataFrame, ticks: DataFrame, key: str, guard: int, max_gap: int) -> DataFrame:
    """Whether all ticks within ``guard`` of an ask are known, close together and in one state, with a reason.

    One window over asks and ticks of an entity, by ranges of time: no ask is paired with its ticks. A gap counts if both
    its ticks are within the guard, so that of the first one there does not.
    """
    wide = F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t")) > max_gap
    marked = ticks.select(key, "t", F.lit(0).alias("side"), "state", F.coalesce(wide, F.lit(False)).cast("int").alias("wide"), F.lit(None).cast(asks.schema["id"].dataType).alias("id"))
    rows = marked.unionByName(asks.select(key, "t", F.lit(1).alias("side"), F.lit(None).cast("boolean").alias("state"), F.lit(None).cast("int").alias("wide"), "id"))
    w = Window.partitionBy(key).orderBy("t").rangeBetween(-guard, guard)
    tick = F.col("side") == 0
    facts = rows.select(
        "id", "side", F.count_if(tick).over(w).alias("n_ticks"), F.count_if(tick & F.col("state").isNull()).over(w).alias("unknown"), (F.min("state").over(w) != F.max("state").over(w)).alias("mixed"),
        (F.sum("wide").over(w) - F.first("wide", True).over(w)).alias("gaps")).filter("side = 1")
    reason = F.when(F.col("n_ticks") == 0, "uncovered").when(F.col("unknown") > 0, "unknown").when(F.col("gaps") > 0, "gap").when(F.col("mixed"), "changed").otherwise("stable")
    return facts.select("id", "n_ticks", reason.alias("reason"))


def first_match_after(asks: DataFrame, events: DataFrame, key: str, matches: Column) -> DataFrame:
    """Offset from each ask to the first later event of the entity that matches, else null: a forward as-of."""
    rows = events.filter(matches).select(key, "t", F.lit(0).alias("side"), F.lit(None).cast("long").alias("id")).unionByName(asks.select(key, "t", F.lit(1).alias("side"), "id"))
    w = Window.partitionBy(key).orderBy(F.desc("t"), "side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("next", F.last(F.when(F.col("side") == 0, F.col("t")), True).over(w)).filter("side = 1").select("id", (F.col("next") - F.col("t")).alias("offset"))
