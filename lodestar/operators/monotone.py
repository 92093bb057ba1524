"""Monotone fits over bins of age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def isotonic(values: Column, weights: Column) -> Column:
    """Weighted least-squares non-decreasing fit of an array of values, all weights over zero.

    Pooling of neighbours that fall, in closed form: the fit at a place is the largest, over starts at or before it,
    of the smallest mean of runs from there to an end at or behind it. Arrays are bins of a report, some hundred at most.
    """
    n = F.size(values)
    upto = lambda terms: F.aggregate(terms, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    weight = F.transform(weights, lambda w: w.cast("double"))
    # Sums before each place, once; a run's mean is a difference of two of them.
    sums = F.struct(upto(weight).alias("w"), upto(F.zip_with(values, weight, lambda v, w: v * w)).alias("s"))
    mean = lambda c, j, k: (F.get(c["s"], k + 1) - F.get(c["s"], j)) / (F.get(c["w"], k + 1) - F.get(c["w"], j))
    # lowest[j][i]: smallest mean of runs from j that end at i or later.
    fit = lambda c, i: F.array_max(F.transform(F.sequence(F.lit(0), i), lambda j: F.array_min(F.transform(F.sequence(i, n - 1), lambda k: mean(c, j, k)))))
    return F.when(n > 0, F.get(F.transform(F.array(sums), lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: fit(c, i))), F.lit(0))).otherwise(F.array().cast("array<double>"))


def age_bin(age: Column, edges: list[float]) -> Column:
    """Number of the half-open bin between ``edges``; the last has no upper edge, and a null or lower age has none."""
    found = F.when(age < edges[0], None)
    for i, upper in enumerate(edges[1:]):
        found = found.when(age < upper, i)
    return found.when(age.isNotNull(), len(edges) - 1).cast("int")


def monotone_bins(rows: DataFrame, keys: list[str], age: Column, success: Column, edges: list[float], q: Column) -> DataFrame:
    """(keys, bin, n, successes, fitted): recovery by age, which must not fall, as a share of the steady rate ``q``.

    Shares are smoothed by half a success of one attempt, divided by ``q`` (one value a group), kept within 0 and 1 and
    pooled by the number of attempts. An empty bin takes the fit of the nearest bin that has rows, the lower of two.
    Rows without a bin do not count, and a group without any has null fits.
    """
    bins = len(edges)
    binned = rows.select(*keys, age_bin(age, edges).alias("bin"), success.cast("long").alias("s"), q.alias("q")).groupBy(*keys).agg(
        F.max("q").alias("q"), F.array(*[F.count_if(F.col("bin") == b) for b in range(bins)]).alias("n"), F.array(*[F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("s"))), F.lit(0)) for b in range(bins)]).alias("s"))
    held = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.get("n", b) > 0)
    share = lambda b: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((F.get("s", b) + 0.5) / (F.get("n", b) + 1.0), F.col("q"))))
    rows = binned.withColumn("held", held).withColumn("fit", isotonic(F.transform("held", share), F.transform("held", lambda b: F.get("n", b))))
    nearest = lambda b: F.array_min(F.transform("held", lambda h, i: F.struct(F.abs(h - b).alias("d"), i.alias("i"))))["i"]
    listed = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(b.alias("bin"), F.get("n", b).alias("n"), F.get("s", b).alias("successes"), F.get("fit", nearest(b)).alias("fitted")))
    return rows.select(*keys, F.explode(listed).alias("b")).select(*keys, "b.*")
