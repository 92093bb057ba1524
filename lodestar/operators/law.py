"""Joint observation laws over three-valued signals, and sharp bounds on Boolean targets.

Every function groups by the distinct signal vectors first, so that what is enumerated afterwards depends
on the number of different vectors and not on the number of requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.expr import kleene_and

MOST_CONTROLS = 10


def category_law(rows: DataFrame, keys: list[str], signals: list[str], weight: Column | None = None) -> DataFrame:
    """Count of every signal vector per key; nulls group together."""
    count = F.count("*") if weight is None else F.sum(weight)
    return rows.groupBy(*keys, *signals).agg(count.cast("long").alias("cnt"))


def conjunctive_bounds(law: DataFrame, keys: list[str], signals: list[str]) -> DataFrame:
    """Sharp bounds on the count of requests with all signals true: no enumeration is needed."""
    every = kleene_and(*[F.col(s) for s in signals])
    return law.groupBy(*keys).agg(
        F.sum("cnt").cast("long").alias("n"), F.coalesce(F.sum(F.when(every, F.col("cnt"))), F.lit(0)).cast("long").alias("lower_count"),
        F.sum(F.when(F.coalesce(every, F.lit(True)), F.col("cnt")).otherwise(0)).cast("long").alias("upper_count"))


def group_conjunction(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Kleene conjunction over a group: false wins, else null if any is null, else true."""
    v = F.col(value)
    answer = F.when(F.count_if(~v) > 0, False).when(F.count(v) == F.count("*"), True)
    return rows.groupBy(*keys).agg(answer.alias("conjunction"), F.count("*").cast("long").alias("n"))


def fiber(law: DataFrame, controls: list[str]) -> DataFrame:
    """Every completion of the unknown controls of each vector, as columns ``<control>_s``."""
    if len(controls) > MOST_CONTROLS:
        raise ValueError(f"at most {MOST_CONTROLS} controls can be enumerated")
    states = law.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit((1 << len(controls)) - 1))))
    known = [F.col(c).isNotNull() & (F.shiftright("state", i).bitwiseAND(F.lit(1)) == 1) for i, c in enumerate(controls)]
    states = states.filter(~_any(known))
    return states.select("*", *[F.coalesce(F.col(c), F.shiftright("state", i).bitwiseAND(F.lit(1)) == 1).alias(f"{c}_s") for i, c in enumerate(controls)])


def _any(columns: list[Column]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | c
    return found


def sharp_bounds(law: DataFrame, keys: list[str], controls: list[str], targets: dict[str, Callable[..., Column]]) -> DataFrame:
    """Count-weighted minimum and maximum of each target over all completions, summed per key."""
    ids = [*keys, *controls]
    states = fiber(law, controls)
    columns = [F.col(f"{c}_s") for c in controls]
    per = states.groupBy(*ids, "cnt").agg(*[
        f(target(*columns).cast("int")).alias(f"{name}_{end}") for name, target in targets.items() for end, f in (("lower", F.min), ("upper", F.max))])
    return per.groupBy(*keys).agg(F.sum("cnt").cast("long").alias("n"), *[
        F.sum(F.col("cnt") * F.col(f"{name}_{end}")).cast("long").alias(f"{name}_{end}") for name in targets for end in ("lower", "upper")])


def state_table(spark, names: list[str]) -> DataFrame:
    """All 2^n Boolean states, one column per name."""
    return spark.range(1 << len(names)).select("id", *[(F.shiftright("id", i).bitwiseAND(F.lit(1)) == 1).alias(n) for i, n in enumerate(names)])


def dnf_probability(states: DataFrame, probabilities: dict[str, float], clauses: list[list[str]]) -> DataFrame:
    """Exact probability of an OR of ANDs of independent factors."""
    weight = F.lit(1.0)
    for name, p in probabilities.items():
        weight = weight * F.when(F.col(name), p).otherwise(1 - p)
    holds = _any([kleene_and(*[F.col(c) for c in clause]) for clause in clauses])
    return states.agg(F.sum(F.when(holds, weight).otherwise(0.0)).alias("probability"))
