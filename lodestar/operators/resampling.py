"""Bootstraps by resampling with replacement: whole clusters within strata, and circular moving blocks of a series.

What is resampled is dealt in blocks of some thousand units. In every draw the number of picks that fall to each
block is a multinomial split, made once from the draw's seed; a block then picks its share
among its own units, for all metrics at once. So a draw is an exact resample of the whole stratum, metrics and their
differences come from the same picks, and no task holds more than a block. What is shuffled is one row a block and draw,
summed before it is sent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.lineage import settle
from lodestar.operators.stats import t_interval

BLOCK = 4096


def _shares(seed: int, stratum: int, draw: int, sizes: np.ndarray, picks: int) -> np.ndarray:
    """How many of a draw's picks fall to each block."""
    if not picks:
        return np.zeros(len(sizes), np.int64)
    common = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), (stratum ^ draw * 0x9E3779B97F4A7C15) & (2**64 - 1)]))
    return common.multinomial(picks, sizes / sizes.sum())


def _picker(seed: int, stratum: int, draw: int, which: int) -> np.random.Generator:
    """The generator that block ``which`` picks its share with."""
    return np.random.default_rng([seed, stratum & (2**64 - 1), draw, which])


def _split(strata: DataFrame, key: str, draws: int, seeds: list[int], sizes: Column, picks: list[Column]) -> DataFrame:
    """(key, _block, draw, part0, ...): the shares of every block in every draw, each draw split once and not by each block anew.

    ``strata`` has a row a key with _id; ``sizes`` are its blocks' (_block, _c), and ``picks`` goes with ``seeds``.
    """
    kind = dict(strata.dtypes)[key]
    parts = max(int(strata.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    asked = strata.select(F.col(key).alias("_key"), "_id", sizes["_block"].alias("_blocks"), sizes["_c"].alias("_counts"), *[p.cast("long").alias(f"_picks{i}") for i, p in enumerate(picks)])
    asked = asked.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition(parts, "_key", "draw")

    def split(frames):
        for pdf in frames:
            for r in pdf.to_dict("records"):
                counts = np.asarray(r["_counts"], float)
                shares = {f"part{i}": _shares(seed, int(r["_id"]), int(r["draw"]), counts, int(r[f"_picks{i}"])) for i, seed in enumerate(seeds)}
                yield pd.DataFrame({key: [r["_key"]] * len(counts), "_block": np.asarray(r["_blocks"], np.int64), "draw": int(r["draw"]), **shares})

    return asked.mapInPandas(split, f"`{key}` {kind}, _block long, draw int, " + ", ".join(f"part{i} long" for i in range(len(seeds))))


def cluster_draws(values: DataFrame, stratum: str, cluster: str, metrics: list[str], draws: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(stratum, draw, metrics): the mean of each metric over the clusters that a draw picks, as many as the stratum has.

    ``values`` has one row a cluster; metrics must not be null.
    """
    kind = dict(values.dtypes)[stratum]
    sizes = values.groupBy(stratum).agg(F.count("*").alias("_n"))
    dealt = values.join(sizes, stratum).withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), cluster), F.ceil(F.col("_n") / block)))
    dealt = settle(dealt.select(stratum, cluster, "_block", "_n", *[F.col(m).cast("double").alias(m) for m in metrics]))
    listed = dealt.groupBy(stratum, "_block").agg(F.count("*").alias("_c"), F.first("_n").alias("_n")).groupBy(stratum).agg(F.array_sort(F.collect_list(F.struct("_block", "_c"))).alias("_sizes"), F.first("_n").alias("_n"))
    shares = _split(listed.withColumn("_id", F.xxhash64(stratum)), stratum, draws, [seed], F.col("_sizes"), [F.col("_n")])
    ranks = listed.select(stratum, F.posexplode("_sizes._block").alias("_which", "_block"))
    dealt = dealt.join(ranks, [stratum, "_block"]).withColumn("_id", F.xxhash64(stratum))

    def pick(pdf: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = pdf.sort_values(cluster, ignore_index=True), parts.sort_values("draw")
        which, n, code, held = int(pdf["_which"].iloc[0]), int(pdf["_n"].iloc[0]), int(pdf["_id"].iloc[0]), pdf[metrics].to_numpy()
        out = np.zeros((draws, len(metrics)))
        for d, part in zip(parts["draw"].tolist(), parts["part0"].tolist()):
            out[d] = held[_picker(seed, code, d, which).integers(0, len(held), part)].sum(axis=0) / n
        return pd.DataFrame({stratum: [pdf[stratum].iloc[0]] * draws, "draw": range(draws)} | {m: out[:, i] for i, m in enumerate(metrics)})

    fields = ", ".join(f"`{m}` double" for m in metrics)
    parts = dealt.groupBy(stratum, "_block").cogroup(shares.groupBy(stratum, "_block")).applyInPandas(pick, f"`{stratum}` {kind}, draw int, {fields}")
    return parts.groupBy(stratum, "draw").agg(*[F.sum(m).alias(m) for m in metrics])


def stratified_bootstrap(values: DataFrame, stratum: str, cluster: str, metrics: list[str], draws: int = 1000, seed: int = 7, alpha: float = 0.05, family: int = 1, differences: list[tuple[str, str]] = (), block: int = BLOCK) -> DataFrame:
    """(metric, estimate, lower, upper, deviation, strata, clusters, least_clusters, status): equal-stratum means by percentiles.

    Each limit leaves alpha / family / 2 of the draws outside. ``differences`` adds metrics ``a - b`` from the same draws.
    With a stratum of a single cluster there is only the point; without a row there is nothing to estimate.
    """
    pairs = {f"{a} - {b}": F.col(a) - F.col(b) for a, b in differences}
    names = [*metrics, *pairs]
    values = settle(values.select(stratum, cluster, *metrics).withColumns(pairs))
    per = values.groupBy(stratum).agg(F.count("*").alias("_n"), *[F.avg(m).alias(m) for m in names])
    facts = per.agg(F.count("*").alias("strata"), F.coalesce(F.sum("_n"), F.lit(0)).alias("clusters"), F.coalesce(F.min("_n"), F.lit(0)).alias("least_clusters"), *[F.avg(m).alias(m) for m in names])
    drawn = cluster_draws(values, stratum, cluster, names, draws, seed, block).groupBy("draw").agg(*[F.avg(m).alias(m) for m in names])
    tail = alpha / family / 2
    limits = drawn.agg(*[F.struct(F.percentile(m, F.array(F.lit(tail), F.lit(1 - tail))).alias("limits"), F.stddev_samp(m).alias("deviation")).alias(f"_{i}") for i, m in enumerate(names)])
    row = facts.withColumn("_one", F.lit(1)).join(limits.withColumn("_one", F.lit(1)), "_one")
    enough = F.col("least_clusters") > 1
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("estimate"), F.col(f"_{i}.limits")[0].alias("lower"), F.col(f"_{i}.limits")[1].alias("upper"), F.col(f"_{i}.deviation").alias("deviation")) for i, m in enumerate(names)])
    status = F.when(F.col("strata") == 0, "not_estimable").when(~enough, "point_only").otherwise("estimable")
    out = row.select(F.explode(listed).alias("m"), "strata", "clusters", "least_clusters", status.alias("status"))
    return out.select("m.metric", "m.estimate", *[F.when(enough, F.col(f"m.{c}")).alias(c) for c in ("lower", "upper", "deviation")], "strata", "clusters", "least_clusters", "status")


def common_campaigns(scores: DataFrame, stratum: str, campaign: str, operation: str, method: str, value: str, left: str, right: str, operations: int) -> DataFrame:
    """(stratum, campaign, difference): mean over operations of left - right, of campaigns in which both methods have all operations."""
    pick = lambda m: F.max(F.when(F.col(method) == m, F.col(value)))
    cells = scores.groupBy(stratum, campaign, operation).agg((pick(left) - pick(right)).alias("d"))
    return cells.groupBy(stratum, campaign).agg(F.avg("d").alias("difference"), F.count("d").alias("_n")).filter(F.col("_n") == operations).drop("_n")


# Series


def placed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, place, n, v): rows of a known value in the order of t, numbered from 0 within the key, from a range-partitioned sort."""
    kept = rows.filter(F.col(value).isNotNull()).select(key, "t", F.col(value).cast("double").alias("v"))
    spread = kept.repartitionByRange(key, "t", "v", F.monotonically_increasing_id()).sortWithinPartitions(key, "t", "v").withColumn("_part", F.spark_partition_id())
    spread = settle(spread.withColumn("_id", F.monotonically_increasing_id()))
    parts = spread.groupBy(key, "_part").agg(F.count("*").alias("_c"), F.min("_id").alias("_first"))
    w = Window.partitionBy(key)
    offsets = parts.select(key, "_part", "_first", F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_c").over(w).alias("n"))
    return spread.join(offsets, [key, "_part"]).select(key, (F.col("_id") - F.col("_first") + F.col("_ahead")).alias("place"), "n", "v")


def dealt_in_blocks(rows: DataFrame, key: str, size: Column | int, overlap: Column | int, circular: bool) -> DataFrame:
    """``placed`` rows with (block, own): each in its own block, and in the one before if it is among the ``overlap`` first of its block.

    In a circle the first rows of the key also come behind the last.
    """
    size, overlap = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (size, overlap))
    own, inside = F.floor(F.col("place") / size), F.pmod("place", size)
    last = F.floor((F.col("n") - 1) / size)
    copies = [F.struct(own.alias("block"), F.col("place").alias("place"), F.lit(True).alias("own")), F.when((own > 0) & (inside < overlap), F.struct((own - 1).alias("block"), F.col("place").alias("place"), F.lit(False).alias("own")))]
    if circular:
        behind = F.col("place") + F.col("n")
        copies.append(F.when(F.col("place") < overlap, F.struct(last.alias("block"), behind.alias("place"), F.lit(False).alias("own"))))
        # The last block may be shorter than the overlap, so the block before it reaches over it into the beginning.
        reach = (last > 0) & (behind < last * size + overlap)
        copies.append(F.when(reach, F.struct((last - 1).alias("block"), behind.alias("place"), F.lit(False).alias("own"))))
    return rows.select(key, "n", "v", F.explode(F.array_compact(F.array(*copies))).alias("c")).select(key, "n", "v", "c.*")


def block_lengths(rows: DataFrame, key: str, value: str, threshold: float = 0.1, consecutive: int = 2, max_lag: int = 50, block: int = BLOCK) -> DataFrame:
    """(key, n, block_length): the first lag of a run of ``consecutive`` lags whose autocorrelation is within the threshold.

    Without such a run it is the largest lag that was looked at, a third of the series at most; a series without
    variation, or of less than three values, has 1.
    """
    kind = dict(rows.dtypes)[key]
    series = settle(placed(rows, key, value))
    moments = series.groupBy(key).agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    size = max(block, max_lag)
    dealt = dealt_in_blocks(series, key, size, max_lag, False).join(moments, key).withColumn("v", F.col("v") - F.col("mean"))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        v, c = pdf["v"].to_numpy(), int(pdf["own"].sum())
        sums = [float(np.dot(v[:min(c, len(v) - lag)], v[lag:lag + min(c, len(v) - lag)])) if lag < len(v) else 0.0 for lag in range(max_lag + 1)]
        return pd.DataFrame({key: [pdf[key].iloc[0]] * (max_lag + 1), "lag": range(max_lag + 1), "s": sums})

    sums = dealt.groupBy(key, "block").applyInPandas(products, f"`{key}` {kind}, lag int, s double").groupBy(key, "lag").agg(F.sum("s").alias("s"))
    lists = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "s"))), lambda x: x["s"]).alias("s"))
    facts = series.groupBy(key).agg(F.count("*").alias("n")).join(moments, key).join(lists, key)
    most = F.least(F.lit(max_lag), F.greatest(F.lit(1), F.floor(F.col("n") / 3)))
    near = lambda lag: F.abs(F.try_divide(F.get("s", lag), F.get("s", F.lit(0)))) <= threshold
    runs = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.lit(max_lag - consecutive + 1))), lambda i: (i + consecutive - 1 <= most) & F.forall(F.sequence(i, i + consecutive - 1), near))
    length = F.when((F.col("n") < 3) | (F.col("variance") <= 1e-15), 1).otherwise(F.coalesce(F.get(runs, F.lit(0)), most))
    return facts.select(key, "n", length.cast("long").alias("block_length"))


def moving_block_bootstrap(rows: DataFrame, key: str, value: str, lengths: DataFrame, draws: int = 1000, seed: int = 7, alpha: float = 0.05, block: int = BLOCK) -> DataFrame:
    """(key, n, block_length, mean, lower, upper): percentile interval of the mean over circular moving blocks.

    ``lengths`` has (key, block_length), no longer than ``block``. A draw takes as many blocks as cover the series, from
    any start and round the end, and cuts the last one to size.
    """
    kind = dict(rows.dtypes)[key]
    series = settle(placed(rows, key, value).join(lengths.select(key, F.least(F.col("block_length"), F.lit(block)).alias("length")), key))
    held = series.withColumn("length", F.least("length", "n"))
    dealt = dealt_in_blocks(held, key, block, block, True)
    dealt = dealt.join(held.groupBy(key).agg(F.max("length").alias("length")), key).withColumn("_id", F.xxhash64(key))

    # Sizes of a key's blocks follow from its length; the last one may be shorter.
    blocks = F.floor((F.col("n") - 1) / block)
    sizes = F.transform(F.sequence(F.lit(0).cast("long"), blocks), lambda i: F.struct(i.alias("_block"), F.least(F.lit(block).cast("long"), F.col("n") - i * block).alias("_c")))
    strata = held.groupBy(key).agg(F.max("n").alias("n"), F.max("length").alias("length")).withColumn("_id", F.xxhash64(key)).withColumn("_sizes", sizes)
    shares = _split(strata, key, draws, [seed, seed + 1], F.col("_sizes"), [F.ceil(F.col("n") / F.col("length")) - 1, F.lit(1)]).withColumnRenamed("_block", "block")

    def pick(pdf: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = pdf.sort_values("place"), parts.sort_values("draw")
        n, length, own, which, code = int(pdf["n"].iloc[0]), int(pdf["length"].iloc[0]), int(pdf["own"].sum()), int(pdf["block"].iloc[0]), int(pdf["_id"].iloc[0])
        v = pdf["v"].to_numpy()
        total = np.concatenate([[0.0], np.cumsum(v)])
        k = -(-n // length)
        rest = n - (k - 1) * length
        whole, last = total[length:length + own] - total[:own], total[rest:rest + own] - total[:own]
        out = np.zeros(draws)
        for d, part, end in zip(parts["draw"].tolist(), parts["part0"].tolist(), parts["part1"].tolist()):
            if part:
                out[d] = whole[_picker(seed, code, d, which).integers(0, own, part)].sum()
            if end:
                out[d] += last[_picker(seed + 1, code, d, which).integers(0, own, end)].sum()
        return pd.DataFrame({key: [pdf[key].iloc[0]] * draws, "draw": range(draws), "s": out / n})

    drawn = dealt.groupBy(key, "block").cogroup(shares.groupBy(key, "block")).applyInPandas(pick, f"`{key}` {kind}, draw int, s double").groupBy(key, "draw").agg(F.sum("s").alias("s"))
    limits = drawn.groupBy(key).agg(F.percentile("s", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("limits"))
    facts = held.groupBy(key).agg(F.max("n").alias("n"), F.max("length").alias("block_length"), F.avg("v").alias("mean"))
    return facts.join(limits, key).select(key, "n", "block_length", "mean", F.col("limits")[0].alias("lower"), F.col("limits")[1].alias("upper"))


def block_interval(rows: DataFrame, key: str, size: int, value: str, confidence: float = 0.95) -> DataFrame:
    """(key, blocks, mean, lower, upper): t interval of a share over means of blocks of time, within 0 and 1; a single block is its own interval."""
    origin = rows.groupBy(key).agg(F.min("t").alias("_from"))
    means = rows.join(origin, key).groupBy(key, F.floor((F.col("t") - F.col("_from")) / size).alias("block")).agg(F.avg(value).alias("m"))
    facts = means.groupBy(key).agg(F.count("*").alias("blocks"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("_sd"))
    half = t_interval(F.col("blocks") - 1, confidence) * F.col("_sd") / F.sqrt("blocks")
    half = F.when(F.col("blocks") > 1, half).otherwise(0.0)
    return facts.select(key, "blocks", "mean", F.greatest(F.lit(0.0), F.col("mean") - half).alias("lower"), F.least(F.lit(1.0), F.col("mean") + half).alias("upper"))
