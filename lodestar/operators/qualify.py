"""Whether the evidence of a cell may be used: wide health ticks with their faults, and the counters of the boundary.

A cell is one run of an application; cells are told apart by a key column. Each counter counts one kind of fault, and
a cell is usable if none has any. All counters are aggregates and joins by request or trace id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICAS = ("a", "b")
ROLES = ("proxy", *(f"replica_{r}" for r in REPLICAS))


def health_ticks(rows: DataFrame, cell: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(wide ticks, faults): one row a (cell, period, observed_at) with each role's fields, and (cell, period, malformed, ticks).

    ``rows`` has (cell, period, observed_at, role, replica, error, seq, fields). The first sound row of a role, by seq, is
    the tick's; a row of no role, with an error, or behind the first is malformed, and so is each role without a row.
    """
    role = F.when(F.col("role") == "replica", F.concat(F.lit("replica_"), F.coalesce("replica", F.lit("")))).when(F.col("role") == "proxy", "proxy")
    sound = role.isin(*ROLES) & (F.coalesce("error", F.lit("")) == "")
    tick = [cell, "period", "observed_at"]
    known = rows.withColumn("_role", F.when(sound, role)).groupBy(*tick).agg(
        F.count("*").alias("_rows"), *[F.min_by(F.struct(*fields), F.when(F.col("_role") == r, F.col("seq"))).alias(r) for r in ROLES], *[F.count_if(F.col("_role") == r).alias(f"_{r}") for r in ROLES])
    held = [F.col(f"_{r}") > 0 for r in ROLES]
    used = sum((h.cast("long") for h in held), F.lit(0).cast("long"))
    wide = known.select(*tick, *[h.alias(f"{r}_observed") for r, h in zip(ROLES, held)], *[F.when(h, F.col(f"{r}.{f}")).alias(f"{r}_{f}") for r, h in zip(ROLES, held) for f in fields])
    # Rows that are not used, and roles without a row.
    faults = known.groupBy(cell, "period").agg(F.sum(F.col("_rows") - used + F.lit(len(ROLES)) - used).alias("malformed"), F.count("*").alias("ticks"))
    return wide, faults


@dataclass(frozen=True)
class Boundary:
    """Periods of a cell's evidence and what it has to reach; ``denied`` are words that no column for the learner may hold."""

    learner: str
    auxiliary: tuple[str, ...] = ()
    test: str = "test"
    least_linked: float = 0.0
    least_assignments: int = 0
    denied: tuple[str, ...] = ()


def denied_columns(frames: list[DataFrame], denied: tuple[str, ...]) -> list[str]:
    """Columns and nested fields whose name holds a denied word."""

    def names(kind) -> list[str]:
        if hasattr(kind, "fields"):
            return [n for f in kind.fields for n in (f.name, *names(f.dataType))]
        return [n for part in ("elementType", "keyType", "valueType") if hasattr(kind, part) for n in names(getattr(kind, part))]

    return sorted({n for df in frames for n in names(df.schema) if any(word.lower() in n.lower() for word in denied)})


def boundary_quality(cells: DataFrame, requests: DataFrame, joins: DataFrame, traces: DataFrame, scans: DataFrame, edges: DataFrame, health: DataFrame, cell: str, boundary: Boundary, learner_frames: list[DataFrame]) -> DataFrame:
    """(cell, counters..., usable) of every cell.

    ``cells`` has (cell, source_ok, labels_off, usable_source, files_missing, privileged_copied, expected_learner,
    expected_auxiliary, expected_test), the declarations of the source; ``requests`` (cell, period, request_id, trace_id,
    success); ``joins`` (cell, period, request_id, trace_present); ``traces`` (cell, trace_id, span_count, replicas);
    ``scans`` (cell, invalid_records, duplicate_spans, unknown_replicas); ``edges`` (cell, ...); ``health`` the faults of
    ``health_ticks``. What a cell lacks counts as nothing of it.
    """
    learned = (boundary.learner, *boundary.auxiliary)
    of = lambda *periods: F.col("period").isin(*periods)
    mine = requests.filter(of(*learned))
    linked = mine.join(joins.filter(of(*learned)).groupBy(cell, "request_id").agg(F.max("trace_present").alias("present")), [cell, "request_id"], "left").join(traces.withColumnRenamed("replicas", "_replicas"), [cell, "trace_id"], "left")
    present = F.coalesce("present", F.lit(False))
    good, calibration = F.col("success"), of(boundary.learner)
    facts = linked.groupBy(cell).agg(
        F.count_if(calibration).alias("_learner"), F.count_if(of(*boundary.auxiliary) if boundary.auxiliary else F.lit(False)).alias("_auxiliary"), (F.count("*") - F.count_distinct("request_id")).alias("duplicate_request_ids"),
        F.count_if(present & (F.coalesce("span_count", F.lit(0)) == 0)).alias("linked_traces_without_spans"), F.count_if(calibration & good).alias("_successes"), F.count_if(calibration & good & present).alias("_linked"),
        *[F.count_if(calibration & F.array_contains("_replicas", r)).alias(f"_at_{r}") for r in REPLICAS])
    ids = mine.select(cell, "request_id").distinct()
    tested = requests.filter(of(boundary.test))
    overlap = ids.join(tested.select(cell, "request_id").distinct(), [cell, "request_id"], "left_semi").groupBy(cell).agg(F.count("*").alias("learner_test_overlap"))
    tests = tested.groupBy(cell).agg(F.count("*").alias("_test"))
    joined = joins.filter(of(*learned)).select(cell, "request_id").distinct()
    both = ids.withColumn("_x", F.lit(True)).join(joined.withColumn("_y", F.lit(True)), [cell, "request_id"], "full").groupBy(cell).agg(F.count_if(F.col("_x").isNull() | F.col("_y").isNull()).alias("trace_join_mismatches"))
    wiring = edges.groupBy(cell).agg(F.count("*").alias("_edges"))
    ticks = health.groupBy(cell).agg(F.sum(F.when(calibration, F.col("malformed"))).alias("malformed_health"), F.sum(F.when(of(boundary.test), F.col("malformed"))).alias("malformed_test_health"), F.sum(F.when(of(boundary.test), F.col("ticks"))).alias("_test_ticks"))
    rows = cells
    for part in (facts, overlap, tests, both, wiring, ticks, scans):
        rows = rows.join(part, cell, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(True)).cast("long")
    share = F.coalesce(F.try_divide(zero("_linked"), zero("_successes")), F.lit(0.0))
    counters: dict[str, Column] = {
        "source_mismatches": flag(~F.col("source_ok")), "source_label_mismatches": zero("labels_off"), "source_unusable": flag(~F.col("usable_source")), "missing_source_files": zero("files_missing"),
        "learner_count_mismatches": flag(zero("_learner") != F.col("expected_learner")), "auxiliary_count_mismatches": flag(zero("_auxiliary") != F.col("expected_auxiliary")), "test_count_mismatches": flag(zero("_test") != F.col("expected_test")),
        "duplicate_request_ids": zero("duplicate_request_ids"), "learner_test_overlap": zero("learner_test_overlap"), "trace_join_mismatches": zero("trace_join_mismatches"), "linked_traces_without_spans": zero("linked_traces_without_spans"),
        "invalid_trace_records": zero("invalid_records"), "duplicate_trace_spans": zero("duplicate_spans"), "unknown_target_instances": zero("unknown_replicas"), "link_share_below_minimum": flag(share < boundary.least_linked),
        "missing_topology_edges": flag(zero("_edges") == 0), "replicas_below_minimum": sum((flag(zero(f"_at_{r}") < boundary.least_assignments) for r in REPLICAS), F.lit(0)),
        "malformed_health": zero("malformed_health"), "missing_test_health": flag(zero("_test_ticks") == 0), "malformed_test_health": zero("malformed_test_health"),
        "denied_learner_fields": F.lit(len(denied_columns(learner_frames, boundary.denied))), "privileged_files_copied": zero("privileged_copied")}
    clean = F.lit(True)
    for c in counters.values():
        clean = clean & (c == 0)
    return rows.select(cell, *[c.cast("long").alias(n) for n, c in counters.items()], clean.alias("usable"))
