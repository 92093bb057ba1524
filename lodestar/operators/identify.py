"""Identification from joint moments: estimates, rank, log-moment and maximum-likelihood fits.

Moments and patterns are aggregated in Spark; what is solved on the driver has the size of the model.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.expr import kleene_and


def subsets(names: list[str], order: int) -> list[tuple[str, ...]]:
    return [c for k in range(1, order + 1) for c in combinations(names, k)]


def joint_moments(rows: DataFrame, names: list[str], order: int, at_least: int = 1) -> DataFrame:
    """P(all true | all observed) of every subset up to ``order``, in one aggregation over the rows."""
    sets = subsets(names, order)
    seen = lambda s: kleene_and(*[F.col(c).isNotNull() for c in s])
    row = rows.agg(*[x for s in sets for x in (F.count_if(seen(s)).alias("n_" + "_".join(s)), F.count_if(kleene_and(*[F.col(c) for c in s])).alias("s_" + "_".join(s)))])
    listed = F.array(*[F.struct(F.lit(";".join(s)).alias("observables"), F.col("n_" + "_".join(s)).cast("long").alias("observations"), F.col("s_" + "_".join(s)).cast("long").alias("successes")) for s in sets])
    return row.select(F.explode(listed).alias("m")).select("m.*").withColumn("moment", F.when(F.col("observations") >= at_least, F.col("successes") / F.col("observations")))


def log_moment_fit(moments: DataFrame, factors: dict[str, list[str]]) -> DataFrame:
    """Weighted least squares of log moments on the factors of each subset; abstains if rank is short."""
    names = sorted({f for v in factors.values() for f in v})
    rows = [r for r in moments.filter("moment > 0").collect()]
    h = np.array([[float(any(f in factors[o] for o in r["observables"].split(";"))) for f in names] for r in rows]).reshape(len(rows), len(names))
    y, w = np.array([np.log(r["moment"]) for r in rows]), np.sqrt([float(r["observations"]) for r in rows])
    identified = len(rows) > 0 and np.linalg.matrix_rank(h) == len(names)
    x = np.exp(np.linalg.lstsq(h * w[:, None], y * w, rcond=None)[0]) if identified else [None] * len(names)
    return moments.sparkSession.createDataFrame([(n, None if v is None else float(v), "identified" if identified else "unsupported") for n, v in zip(names, x)], "factor string, probability double, status string")


def observed_mle(rows: DataFrame, names: list[str], factors: dict[str, list[str]], rounds: int = 200) -> DataFrame:
    """Maximum likelihood of independent factors from compressed three-valued patterns, by expectation-maximisation."""
    patterns = rows.groupBy(*names).agg(F.count("*").alias("n")).collect()
    latent = sorted({f for v in factors.values() for f in v})
    states = np.array([[s >> i & 1 for i in range(len(latent))] for s in range(1 << len(latent))], bool)
    values = {o: states[:, [latent.index(f) for f in factors[o]]].all(axis=1) for o in names}
    fits = np.array([np.all([np.ones(len(states), bool) if r[o] is None else values[o] == r[o] for o in names], axis=0) for r in patterns])
    counts, p = np.array([r["n"] for r in patterns], float), np.full(len(latent), 0.5)
    for _ in range(rounds):
        weight = np.prod(np.where(states, p, 1 - p), axis=1)
        joint = fits * weight
        posterior = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        p = np.clip((counts[:, None] * posterior).sum(axis=0) @ states / max(counts.sum(), 1), 1e-9, 1 - 1e-9)
    return rows.sparkSession.createDataFrame([(f, float(x)) for f, x in zip(latent, p)], "factor string, probability double")
