"""Forecast scores, complete cells, equal weighting and paired contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959964


def brier(p: Column, s: Column, n: Column) -> Column:
    """Mean squared error of a probability against s successes of n."""
    return (s * (1 - p) * (1 - p) + (n - s) * p * p) / n


def smoothed_mean(s: Column, n: Column, alpha: float, beta: float) -> Column:
    return (s + alpha) / (n + alpha + beta)


def wilson(s: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = s / n, Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return centre - half, centre + half


def complete_cells(scores: DataFrame, cell: list[str], expected: int, value: str) -> DataFrame:
    """Mean per cell of those cells that have all expected operations; the filter comes before the mean."""
    return scores.groupBy(*cell).agg(F.avg(value).alias(f"mean_{value}"), F.count(value).alias("_n")).filter(F.col("_n") == expected).drop("_n")


def equal_weight(rows: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """Unweighted means taken level by level: of rows, then of their means, and so on."""
    for keys in levels:
        rows = rows.groupBy(*keys).agg(F.avg(value).alias(value))
    return rows


def paired_contrast(rows: DataFrame, keys: list[str], method: str, proposed: str, comparator: str, value: str) -> DataFrame:
    """proposed - comparator on every key that both methods have; one shuffle by conditional aggregation."""
    pick = lambda m: F.max(F.when(F.col(method) == m, F.col(value)))
    return rows.groupBy(*keys).agg(pick(proposed).alias("a"), pick(comparator).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").withColumn("difference", F.col("a") - F.col("b"))


def sign_flip(rows: DataFrame, keys: list[str], value: str, most: int = 16) -> DataFrame:
    """(keys, n, p, status): exact two-sided paired randomisation test over all sign patterns of a group.

    A group of over ``most`` differences is not enumerated; it keeps its row, with a null p and status 'unsupported'.
    """
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    fitting = rows.join(sizes.filter(F.col("n") <= most).select(*keys), keys, "left_semi")
    listed = fitting.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("d")).filter(F.size("d") > 0)
    states = listed.withColumn("state", F.explode(F.expr("sequence(0, shiftleft(1, size(d)) - 1)")))
    flipped = F.aggregate(F.transform("d", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), F.lit(0.0), lambda a, e: a + F.when(F.call_function("getbit", F.col("state"), e["i"]) == 1, e["x"]).otherwise(-e["x"]))
    seen = F.aggregate("d", F.lit(0.0), lambda a, x: a + x)
    tested = states.select(*keys, (F.abs(flipped) >= F.abs(seen) - 1e-9).alias("hit")).groupBy(*keys).agg((F.count_if("hit") / F.count("*")).alias("p"))
    return sizes.join(tested, keys, "left").select(*keys, "n", "p", F.when(F.col("p").isNull(), "unsupported").otherwise("supported").alias("status"))
