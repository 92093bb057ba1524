"""The tables of an evidence bundle as checked CSV: requests, deployments, health, call attempts and injections.

A table is read as text with its columns checked, typed, and each row keeps the first rule it breaks in ``problem``;
keys that repeat are found by a count per key, so a faulty row costs its own row and not the load. ``sound`` raises on
any problem, as a bundle that is taken over whole has to be free of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of the tables and the words that they may hold.
COLUMNS = {
    "requests": ("request_id", "trace_id", "started_at", "completed_at", "period", "operation_class", "branch_class", "outcome", "success", "timed_out"),
    "deployments": ("instance_id", "service", "version", "valid_from", "valid_to", "domain_id", "routing_policy"),
    "health": ("timestamp", "instance_id", "signal", "state", "source"),
    "mesh": ("timestamp", "request_id", "source_instance", "target_service", "logical_call_id", "attempt", "outcome"),
    "injections": ("incident_id", "intent_at", "applied_at", "verified_start", "verified_end", "scope", "mechanism", "confirmed"),
}
SIGNALS, STATES = ("liveness", "readiness", "restart"), ("up", "down", "unknown")
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


@dataclass(frozen=True)
class Period:
    """A half-open period of time with its seeds, in ISO 8601."""

    start: str
    end: str
    seeds: tuple[int, int, int]


@dataclass(frozen=True)
class OperationRule:
    outcomes: tuple[str, ...]
    branches: tuple[str, ...] = ()


def check_periods(spark: SparkSession, periods: dict[str, Period]) -> None:
    """Two periods, calibration and test, neither empty, apart from each other and not of the same seeds."""
    if set(periods) != {"calibration", "test"}:
        raise ValueError("periods are calibration and test")
    rows = spark.createDataFrame([(k, p.start, p.end) for k, p in periods.items()], "k string, a string, b string").select("k", instant(F.col("a")).alias("a"), instant(F.col("b")).alias("b")).collect()
    ends = {r["k"]: (r["a"], r["b"]) for r in rows}
    if any(a is None or b is None or b <= a for a, b in ends.values()):
        raise ValueError("a period is empty or has no time zone")
    (a, b), (c, d) = ends["calibration"], ends["test"]
    if not (b <= c or d <= a):
        raise ValueError("periods overlap")
    if periods["calibration"].seeds == periods["test"].seeds:
        raise ValueError("both periods have the same seeds")


def instant(text: Column) -> Column:
    """A time with its offset from UTC; null if it is no ISO 8601 or has none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp"))


def boolean(text: Column) -> Column:
    plain = F.lower(F.trim(text))
    return F.when(plain.isin(*TRUE), True).when(plain.isin(*FALSE), False)


def _read(spark: SparkSession, path, table: str) -> DataFrame:
    """All columns as text, null as empty; a missing one raises, others are kept."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    missing = [c for c in COLUMNS[table] if c not in rows.columns]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return rows.fillna("", list(COLUMNS[table]))


def _problem(rules: list[tuple[str, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(out)
    return out


def _repeats(*keys: str) -> Column:
    return F.count("*").over(Window.partitionBy(*keys)) > 1


def load_requests(spark: SparkSession, path, periods: dict[str, Period], operations: dict[str, OperationRule], id_lengths: tuple[int, ...] = (16, 32)) -> DataFrame:
    """The request census: typed times and outcomes, lower-case trace ids (null if there is none), ``problem``."""
    check_periods(spark, periods)
    rows = _read(spark, path, "requests")
    typed = rows.withColumns({"trace_id": F.nullif(F.lower("trace_id"), F.lit("")), "started_at": instant(F.col("started_at")), "completed_at": instant(F.col("completed_at")), "success": boolean(F.col("success")), "timed_out": boolean(F.col("timed_out"))})
    at = lambda end: F.create_map(*[x for k, p in periods.items() for x in (F.lit(k), instant(F.lit(getattr(p, end))))])[F.col("period")]
    listed = lambda field: F.create_map(*[x for k, o in operations.items() for x in (F.lit(k), F.array(*map(F.lit, getattr(o, field))).cast("array<string>"))])[F.col("operation_class")]
    lengths = "|".join(f"[0-9a-f]{{{n}}}" for n in id_lengths)
    start, end = F.col("started_at"), F.col("completed_at")
    marked = typed.withColumns({"_again": _repeats("request_id"), "_shared": F.col("trace_id").isNotNull() & _repeats("trace_id")})
    return marked.withColumn("problem", _problem([
        ("repeated_request", F.col("_again")), ("repeated_trace", F.col("_shared")), ("unknown_period", ~F.col("period").isin(*periods)), ("unknown_operation", ~F.col("operation_class").isin(*operations)),
        ("no_time", start.isNull() | end.isNull()), ("outside_period", (end < start) | (start < at("start")) | (start >= at("end")) | (end > at("end"))), ("no_boolean", F.col("success").isNull() | F.col("timed_out").isNull()),
        ("successful_timeout", F.col("success") & F.col("timed_out")), ("outcome_not_accepted", F.col("success") & ~F.array_contains(listed("outcomes"), F.col("outcome"))),
        ("undeclared_branch", (F.col("branch_class") != "") & ~F.array_contains(listed("branches"), F.col("branch_class"))), ("no_trace_id", ~F.col("trace_id").rlike(f"^({lengths})$"))])).drop("_again", "_shared")


def load_deployments(spark: SparkSession, path) -> DataFrame:
    """Instances with the half-open time that they are valid for; null is open."""
    rows = _read(spark, path, "deployments")
    blank = F.lit(False)
    for c in ("instance_id", "service", "version", "domain_id", "routing_policy"):
        blank = blank | (F.col(c) == "")
    start, end = instant(F.col("valid_from")), instant(F.col("valid_to"))
    return rows.withColumn("problem", _problem([("no_time", start.isNull() | ((F.col("valid_to") != "") & end.isNull())), ("reversed", end <= start), ("no_identity", blank)])).withColumns({"valid_from": start, "valid_to": end})


def load_health(spark: SparkSession, path) -> DataFrame:
    rows, at = _read(spark, path, "health"), instant(F.col("timestamp"))
    return rows.withColumn("problem", _problem([("no_time", at.isNull()), ("unknown_signal", ~F.col("signal").isin(*SIGNALS)), ("unknown_state", ~F.col("state").isin(*STATES))])).withColumn("timestamp", at)


def load_mesh(spark: SparkSession, path) -> DataFrame:
    """Call attempts, numbered from 1 within a request's call."""
    rows, at = _read(spark, path, "mesh"), instant(F.col("timestamp"))
    attempt = F.when(F.trim("attempt").rlike("^[+-]?[0-9]+$"), F.trim("attempt").try_cast("long"))
    marked = rows.withColumns({"timestamp": at, "attempt": attempt}).withColumn("_again", _repeats("request_id", "logical_call_id", "attempt"))
    return marked.withColumn("problem", _problem([("no_time", F.col("timestamp").isNull()), ("no_attempt", F.col("attempt").isNull() | (F.col("attempt") <= 0)), ("repeated_attempt", F.col("_again"))])).drop("_again")


def load_injections(spark: SparkSession, path) -> DataFrame:
    """Injected incidents with their four times."""
    rows = _read(spark, path, "injections")
    times = {c: instant(F.col(c)) for c in ("intent_at", "applied_at", "verified_start", "verified_end")}
    typed = rows.withColumns(times | {"confirmed": boolean(F.col("confirmed"))}).withColumn("_again", _repeats("incident_id"))
    lacks = F.lit(False)
    for c in times:
        lacks = lacks | F.col(c).isNull()
    return typed.withColumn("problem", _problem([("repeated_incident", F.col("_again")), ("no_time", lacks), ("reversed", F.col("verified_end") <= F.col("verified_start")), ("no_boolean", F.col("confirmed").isNull())])).drop("_again")


def problems(rows: DataFrame, label: str) -> DataFrame:
    """(table, problem, n) of the rows that break a rule."""
    return rows.filter("problem IS NOT NULL").groupBy(F.lit(label).alias("table"), "problem").agg(F.count("*").alias("n"))


def sound(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` without ``problem``; raises if there is one."""
    found = rows.filter("problem IS NOT NULL").select("problem").head(1)
    if found:
        raise ValueError(f"{label}: {found[0]['problem']}")
    return rows.drop("problem")
