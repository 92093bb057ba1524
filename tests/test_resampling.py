"""Bootstraps and intervals against known laws, and their parts against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import resampling, stats


@pytest.fixture(scope="module")
def campaigns(spark):
    rng = np.random.default_rng(4)
    rows = [(s, c, float(x), float(x + e)) for s, n in (("p", 900), ("q", 400)) for c, (x, e) in enumerate(zip(rng.normal(3, 2, n), rng.normal(0.5, 0.2, n)))]
    return spark.createDataFrame(rows, "stratum string, campaign long, left double, right double").repartition(4), rows


@pytest.mark.parametrize("block", [4096, 37])
def test_strata_are_resampled_whole_and_jointly(spark, campaigns, block):
    """Width by the normal law; the difference of two metrics is far narrower than they are, as picks are shared."""
    frame, rows = campaigns
    got = {r["metric"]: r for r in resampling.stratified_bootstrap(frame, "stratum", "campaign", ["left", "right"], draws=600, differences=[("right", "left")], block=block).collect()}
    values = {s: np.array([(x, y, y - x) for g, _, x, y in rows if g == s]) for s in "pq"}
    for i, name in enumerate(("left", "right", "right - left")):
        se = np.sqrt(sum(v[:, i].var() / len(v) for v in values.values())) / 2
        assert got[name]["estimate"] == pytest.approx(np.mean([v[:, i].mean() for v in values.values()]))
        assert got[name]["deviation"] == pytest.approx(se, rel=0.1) and got[name]["upper"] - got[name]["lower"] == pytest.approx(2 * 1.96 * se, rel=0.15)
        assert (got[name]["strata"], got[name]["clusters"], got[name]["least_clusters"], got[name]["status"]) == (2, 1300, 400, "estimable")


def test_a_family_widens_the_limits(spark, campaigns):
    frame, _ = campaigns
    width = lambda family: (lambda r: r["upper"] - r["lower"])(resampling.stratified_bootstrap(frame, "stratum", "campaign", ["left"], draws=1500, family=family).first())
    assert width(3) / width(1) == pytest.approx(2.394 / 1.96, rel=0.06)


def test_draws_repeat_and_count_every_pick(spark):
    """Each draw picks as many clusters as there are, whatever the blocks; a second run is the same."""
    frame = spark.createDataFrame([("a", c, 1.0, float(c)) for c in range(100)], "stratum string, campaign long, one double, v double")
    for block in (4096, 9):
        draws = resampling.cluster_draws(frame, "stratum", "campaign", ["one", "v"], 50, 3, block)
        first = {r["draw"]: (r["one"], r["v"]) for r in draws.collect()}
        assert len(first) == 50 and all(one == pytest.approx(1.0) for one, _ in first.values()) and len({v for _, v in first.values()}) > 40
        again = {r["draw"]: (r["one"], r["v"]) for r in resampling.cluster_draws(frame.repartition(3), "stratum", "campaign", ["one", "v"], 50, 3, block).collect()}
        assert again == {d: pytest.approx(v) for d, v in first.items()}


def test_too_little_support(spark):
    kind = "stratum string, campaign long, v double"
    one = resampling.stratified_bootstrap(spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0), ("b", 2, 5.0)], kind), "stratum", "campaign", ["v"], draws=20).first()
    assert (one["status"], one["estimate"], one["lower"], one["upper"]) == ("point_only", 3.0, None, None)
    none = resampling.stratified_bootstrap(spark.createDataFrame([], kind), "stratum", "campaign", ["v"], draws=20).first()
    assert (none["status"], none["estimate"], none["strata"]) == ("not_estimable", None, 0)


def test_only_whole_common_campaigns_count(spark):
    rows = [("s", 1, "x", "g", 1.0), ("s", 1, "x", "c", 3.0), ("s", 1, "y", "g", 2.0), ("s", 1, "y", "c", 2.0), ("s", 2, "x", "g", 1.0), ("s", 2, "x", "c", 1.0), ("s", 2, "y", "g", 1.0), ("s", 3, "x", "g", None), ("s", 3, "x", "c", 1.0), ("s", 3, "y", "g", 1.0), ("s", 3, "y", "c", 1.0)]
    frame = spark.createDataFrame(rows, "stratum string, campaign long, operation string, method string, error double")
    assert [tuple(r) for r in resampling.common_campaigns(frame, "stratum", "campaign", "operation", "method", "error", "g", "c", 2).collect()] == [("s", 1, -1.0)]


def ar1(n, phi, seed):
    rng, x = np.random.default_rng(seed), 0.0
    out = []
    for e in rng.normal(size=n):
        x = phi * x + e
        out.append(x)
    return np.array(out)


def plain_length(v, threshold, consecutive, max_lag):
    if len(v) < 3 or v.var() <= 1e-15:
        return 1
    c, most, below = v - v.mean(), min(max_lag, max(1, len(v) // 3)), 0
    for lag in range(1, most + 1):
        below = below + 1 if abs(np.dot(c[:-lag], c[lag:]) / np.dot(c, c)) <= threshold else 0
        if below >= consecutive:
            return lag - consecutive + 1
    return most


@pytest.mark.parametrize("block", [4096, 40])
def test_block_lengths(spark, block):
    series = {"slow": ar1(3000, 0.9, 1), "quick": ar1(500, 0.2, 2), "flat": np.full(50, 2.0), "two": np.array([1.0, 2.0]), "short": ar1(20, 0.95, 3)}
    frame = spark.createDataFrame([(k, t, float(x)) for k, v in series.items() for t, x in enumerate(v)] + [("gone", 1, None)], "k string, t long, v double").repartition(5)
    got = {r["k"]: r["block_length"] for r in resampling.block_lengths(frame, "k", "v", block=block, max_lag=40).collect()}
    assert got == {k: plain_length(v, 0.1, 2, 40) for k, v in series.items()}


@pytest.mark.parametrize("block", [4096, 100])
def test_moving_blocks_of_a_series(spark, block):
    """Over an AR(1) series the interval has the width of the long-run variance of its blocks, not that of single values."""
    v, length = ar1(4000, 0.8, 7), 40
    frame = spark.createDataFrame([("a", t, float(x)) for t, x in enumerate(v)] + [("b", t, 2.0) for t in range(7)], "k string, t long, v double").repartition(5)
    lengths = spark.createDataFrame([("a", length), ("b", 3)], "k string, block_length long")
    got = {r["k"]: r for r in resampling.moving_block_bootstrap(frame, "k", "v", lengths, draws=800, block=block).collect()}
    turned = np.concatenate([v, v[:length]])
    sums = np.array([turned[i:i + length].sum() for i in range(len(v))])
    sd = np.sqrt(len(v) / length * sums.var()) / len(v)
    a = got["a"]
    assert (a["n"], a["block_length"], a["mean"]) == (4000, length, pytest.approx(v.mean())) and a["upper"] - a["lower"] == pytest.approx(2 * 1.96 * sd, rel=0.12)
    assert (a["lower"] + a["upper"]) / 2 == pytest.approx(v.mean(), abs=0.25 * sd)
    assert got["b"]["lower"] == pytest.approx(2.0) and got["b"]["upper"] == pytest.approx(2.0)


@pytest.mark.parametrize("n,size,overlap", [(1, 4, 4), (3, 4, 4), (4, 4, 4), (5, 4, 4), (9, 4, 3), (12, 5, 5)])
def test_blocks_of_a_circle_hold_what_their_starts_need(spark, n, size, overlap):
    frame = spark.createDataFrame([("k", i, n, float(i)) for i in range(n)], "k string, place long, n long, v double")
    blocks = {}
    for r in resampling.dealt_in_blocks(frame, "k", size, overlap, True).collect():
        blocks.setdefault(r["block"], []).append((r["place"], r["v"], r["own"]))
    assert sorted(blocks) == list(range(-(-n // size)))
    for b, held in blocks.items():
        held.sort()
        own = [p for p, _, o in held if o]
        assert own == list(range(b * size, min(n, (b + 1) * size)))
        reach = min(own[-1] + overlap, own[0] + max(len(own), 1) + overlap, n + n - 1)
        places = [p for p, _, _ in held]
        assert places[:reach - own[0]] == list(range(own[0], reach)) and all(v == p % n for p, v, _ in held)


def test_block_interval(spark):
    rows = [("a", t, float(t // 10 % 2)) for t in range(5, 65)] + [("b", 3, 1.0), ("b", 4, 0.0)]
    got = {r["k"]: r for r in resampling.block_interval(spark.createDataFrame(rows, "k string, t long, v double"), "k", 10, "v").collect()}
    means = np.array([np.mean([v for k, t, v in rows if k == "a" and (t - 5) // 10 == b]) for b in range(6)])
    half = 2.570581835636314 * means.std(ddof=1) / np.sqrt(6)
    assert (got["a"]["blocks"], got["a"]["lower"], got["a"]["upper"]) == (6, pytest.approx(max(0, means.mean() - half)), pytest.approx(min(1, means.mean() + half)))
    assert (got["b"]["blocks"], got["b"]["lower"], got["b"]["upper"]) == (1, 0.5, 0.5)


def test_stratified_inference(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 0.5), ("b", 1.5), ("c", 9.0), ("d", None)]
    r = stats.stratified(spark.createDataFrame(rows, "s string, v double"), "s", "v").first()
    variances = [np.var([1, 2, 4], ddof=1) / 3 / 9, np.var([0.5, 1.5], ddof=1) / 2 / 9]
    df = sum(variances) ** 2 / (variances[0] ** 2 / 2 + variances[1] ** 2)
    assert (r["strata"], r["mean"], r["standard_error"], r["df"]) == (3, pytest.approx((7 / 3 + 1 + 9) / 3), pytest.approx(np.sqrt(sum(variances))), pytest.approx(df))
    assert r["p_value"] == pytest.approx(float(stats.t_tail(r["mean"] / r["standard_error"], df))) and r["upper"] - r["mean"] == pytest.approx(float(stats.t_quantile(np.array([df]), 0.95)[0]) * r["standard_error"])
    flat = stats.stratified(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "s string, v double"), "s", "v").first()
    assert (flat["standard_error"], flat["lower"], flat["upper"], flat["p_value"]) == (0.0, 1.0, 1.0, 0.0)


def test_quantiles_of_t(spark):
    assert stats.t_quantile(np.array([1.0, 5.0, 30.0, 1e12]), 0.95) == pytest.approx([12.7062047364, 2.5705818356, 2.0422724563, 1.9599639845], rel=1e-6)
    got = spark.createDataFrame([(5.0,), (0.0,), (None,)], "df double").select(stats.t_interval(F.col("df"), 0.95).alias("x")).collect()
    assert [r["x"] for r in got] == [pytest.approx(2.5705818356, rel=1e-6), None, None]


def test_draws_are_split_once(spark):
    """Every block gets its share of each draw from one split of it: there is a row a draw to split, and its shares add up."""
    sizes = F.array(*[F.struct(F.lit(i).cast("long").alias("_block"), F.lit(c).cast("long").alias("_c")) for i, c in enumerate((16, 16, 5))])
    strata = spark.createDataFrame([("k", 5), ("l", 6)], "k string, _id long").withColumn("_sizes", sizes)
    got = resampling._split(strata, "k", 20, [7, 8], F.col("_sizes"), [F.lit(100), F.lit(1)])
    rows = got.collect()
    assert len(rows) == 2 * 20 * 3
    for key, code in (("k", 5), ("l", 6)):
        for d in range(20):
            mine = sorted((r for r in rows if r["k"] == key and r["draw"] == d), key=lambda r: r["_block"])
            assert [r["part0"] for r in mine] == resampling._shares(7, code, d, np.array([16.0, 16.0, 5.0]), 100).tolist()
            assert sum(r["part0"] for r in mine) == 100 and sum(r["part1"] for r in mine) == 1
