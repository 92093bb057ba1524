"""Intervals, resampling and small exact tests. Groups are reports of bounded size; numpy runs inside tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, element by element."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    flip = inside > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - inside, inside)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z))
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(z), 1 / safe(1 - (p + q) * z / (p + 1))
    f = d.copy()
    for m in range(1, 500):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        for step in (even, odd):
            d, c = 1 / safe(1 + step * d), safe(1 + step / c)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    value = front * f / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(flip, 1 - value, value)))


def beta_quantile(q, a, b) -> np.ndarray:
    low, high = np.zeros(np.broadcast(q, a, b).shape), np.ones(np.broadcast(q, a, b).shape)
    for _ in range(60):
        mid = (low + high) / 2
        below = incomplete_beta(a, b, mid) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def t_tail(t, df) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(df, confidence: float) -> np.ndarray:
    """The value that Student's t stays within with ``confidence``; degrees without bound give the normal's."""
    df = np.minimum(np.asarray(df, float), 1e9)
    x = beta_quantile(1 - confidence, df / 2, np.full(df.shape, 0.5))
    return np.sqrt(df * (1 - x) / np.maximum(x, 1e-300))


def t_interval(df: Column, confidence: float) -> Column:
    """``t_quantile`` as a column; null where the degrees of freedom are null or not positive."""

    @F.pandas_udf("double")
    def critical(df: pd.Series) -> pd.Series:
        fine = (df > 0).to_numpy()
        return pd.Series(np.where(fine, t_quantile(np.where(fine, df, 1.0), confidence), np.nan)).replace(np.nan, None)

    return critical(df.cast("double"))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value as a column."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        fine = (df > 0).to_numpy() & t.notna().to_numpy()
        return pd.Series(np.where(fine, t_tail(np.where(fine, t, 0.0), np.where(fine, np.minimum(df, 1e9), 1.0)), np.nan)).replace(np.nan, None)

    return tail(t.cast("double"), df.cast("double"))


def clopper_pearson(successes: Column, trials: Column, confidence: float = 0.95, comparisons: int = 1) -> Column:
    """Exact interval as a struct (lower, upper); null without trials."""
    alpha = (1 - confidence) / comparisons

    @F.pandas_udf("lower double, upper double")
    def interval(s: pd.Series, n: pd.Series) -> pd.DataFrame:
        known = s.notna().to_numpy() & (n > 0).to_numpy()
        s, n = np.where(known, s, 0.0).astype(float), np.where(known, n, 1.0).astype(float)
        low = np.where(s == 0, 0.0, beta_quantile(alpha / 2, np.maximum(s, 0.5), n - s + 1))
        high = np.where(s == n, 1.0, beta_quantile(1 - alpha / 2, s + 1, np.maximum(n - s, 0.5)))
        return pd.DataFrame({"lower": np.where(known, low, np.nan), "upper": np.where(known, high, np.nan)}).replace(np.nan, None)

    return interval(successes.cast("long"), trials.cast("long"))


def bootstrap_mean(rows: DataFrame, key: str, value: str, draws: int = 1000, seed: int = 7, block: int = 1) -> DataFrame:
    """(key, n, mean, lower, upper): percentile interval of the mean per key; ``block`` > 1 keeps runs of rows together.

    Poisson bootstrap: in every draw each block of ``block`` rows in the order of t counts a Poisson(1) number of
    times, by a hash of draw, key and block, and a task adds its rows' weighted sums and weights to one array of
    ``draws`` pairs for each key it meets. Only these arrays are shuffled, so a key of any size spreads over all tasks.
    Rows of a null value are left out; a draw without any row is left out of the quantiles. Circular moving blocks are
    in ``resampling``.
    """
    from lodestar.operators.resampling import placed

    unit = placed(rows, key, value).select(key, "v", F.floor(F.col("place") / block).alias("unit")).sortWithinPartitions(key)
    kind = dict(rows.dtypes)[key]
    limits = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def draw(batches):
        held: dict = {}  # rows come sorted by key, so all keys of a batch but the last are over
        for batch in batches:
            names = pd.util.hash_pandas_object(batch[key], index=False).to_numpy() ^ np.uint64(seed)
            units = batch["unit"].to_numpy().astype(np.uint64)
            codes, found = pd.factorize(batch[key], use_na_sentinel=False)
            v, out = batch["v"].to_numpy(), np.zeros((len(found), 2, draws))
            for at in range(0, len(batch), 2048):
                state = (units[at:at + 2048] * np.uint64(0x9E3779B97F4A7C15) ^ names[at:at + 2048])[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                state = (state ^ state >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                state = (state ^ state >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(limits, (state >> np.uint64(11)) * 2.0**-53).astype(float)
                order = np.argsort(codes[at:at + 2048], kind="stable")
                own = codes[at:at + 2048][order]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out[own[first], 0] += np.add.reduceat(w[order] * v[at:at + 2048][order, None], first, axis=0)
                out[own[first], 1] += np.add.reduceat(w[order], first, axis=0)
            sizes, sums = np.bincount(codes, minlength=len(found)), np.bincount(codes, v, len(found))
            for i, name in enumerate(found):
                n, s, pair = held.pop(name, (0, 0.0, 0.0))
                held[name] = (n + int(sizes[i]), s + float(sums[i]), pair + out[i])
            over, held = list(held.items())[:-1], dict(list(held.items())[-1:])
            if over:
                yield listed(over)
        if held:
            yield listed(list(held.items()))

    def listed(items: list) -> pd.DataFrame:
        return pd.DataFrame({key: [k for k, _ in items], "n": [x[0] for _, x in items], "s": [x[1] for _, x in items], "sums": [x[2][0] for _, x in items], "weights": [x[2][1] for _, x in items]})

    def total(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sums, weights = np.sum(np.stack(pdf["sums"].to_list()), axis=0), np.sum(np.stack(pdf["weights"].to_list()), axis=0)
        low, high = np.quantile(sums[weights > 0] / weights[weights > 0], [0.025, 0.975]) if (weights > 0).any() else (None, None)
        n = int(pdf["n"].sum())
        return pd.DataFrame({key: [name[0]], "n": [n], "mean": [pdf["s"].sum() / n], "lower": [low], "upper": [high]})

    partial = unit.mapInPandas(draw, f"{key} {kind}, n long, s double, sums array<double>, weights array<double>")
    return partial.groupBy(key).applyInPandas(total, f"{key} {kind}, n long, mean double, lower double, upper double")


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact p-value of a 2x2 table."""

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for w, x, y, z in zip(a, b, c, d):
            r, k, n = int(w + x), int(w + y), int(w + x + y + z)
            f = [math.lgamma(i + 1) for i in (r, n - r, k, n - k, n)]
            span = range(max(0, r + k - n), min(r, k) + 1)
            logs = [f[0] + f[1] + f[2] + f[3] - f[4] - sum(math.lgamma(v + 1) for v in (i, r - i, k - i, n - r - k + i)) for i in span]
            seen = logs[int(w) - span.start]
            out.append(min(1.0, sum(math.exp(v) for v in logs if v <= seen + 1e-7)))
        return pd.Series(out)

    return p_value(a, b, c, d)


def stratified(rows: DataFrame, stratum: str, value: str, confidence: float = 0.95) -> DataFrame:
    """(strata, mean, standard_error, df, lower, upper, p_value): equal-weight mean over strata, Satterthwaite's degrees of freedom.

    Every stratum with a value has its part in the mean; those of one value have none in the error. Without an error
    the interval is the mean, and the p-value is 1 at a mean of zero, else 0.
    """
    per = rows.groupBy(stratum).agg(F.avg(value).alias("m"), F.coalesce(F.var_samp(value) / F.count(value), F.lit(0.0)).alias("v"), F.count(value).alias("n")).filter("n > 0")
    total = per.agg(F.count("*").alias("k"), F.avg("m").alias("mean"), F.sum("v").alias("sv"), F.sum(F.when(F.col("n") > 1, F.col("v") * F.col("v") / (F.col("n") - 1))).alias("sw"))
    known = total.select(F.col("k").cast("long").alias("strata"), "mean", (F.sqrt("sv") / F.col("k")).alias("standard_error"), F.when(F.col("sw") > 0, F.col("sv") * F.col("sv") / F.col("sw")).alias("df"))
    half = F.when(F.col("standard_error") > 0, t_interval(F.col("df"), confidence) * F.col("standard_error")).otherwise(0.0)
    p = F.when(F.col("standard_error") > 0, t_p_value(F.col("mean") / F.nullif("standard_error", F.lit(0.0)), F.col("df"))).otherwise(F.when(F.col("mean") == 0, 1.0).otherwise(0.0))
    return known.select("*", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"), F.when(F.col("mean").isNotNull(), p).alias("p_value"))
