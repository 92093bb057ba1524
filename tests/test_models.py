"""Monotone bins, polynomial terms and certificates, and the stream of transitions."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import monotone, polynomial, sequence
from lodestar.streaming import health


def pooled(values, weights):
    """Pool adjacent violators with a stack."""
    blocks = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [v for v, _, n in blocks for _ in range(n)]


def test_isotonic_fits(spark):
    r = random.Random(2)
    cases = [([], []), ([3.0], [2]), ([2.0, 1.0], [1, 3]), ([1.0, 1.0, 1.0], [1, 1, 1]), ([3.0, 2.0, 1.0, 4.0], [1, 1, 1, 5])]
    cases += [([float(r.randint(0, 5)) for _ in range(n)], [r.randint(1, 9) for _ in range(n)]) for n in (5, 9, 20) for _ in range(6)]
    frame = spark.createDataFrame([(i, v, w) for i, (v, w) in enumerate(cases)], "i int, v array<double>, w array<long>")
    got = {x["i"]: x["f"] for x in frame.select("i", monotone.isotonic(F.col("v"), F.col("w")).alias("f")).collect()}
    for i, (v, w) in enumerate(cases):
        assert got[i] == pytest.approx(pooled(v, w))


def test_monotone_bins(spark):
    edges, q = [0.0, 1.0, 2.0, 4.0, 8.0, 16.0], 0.8
    r = np.random.default_rng(1)
    rows = [("a", float(age), bool(r.random() < 0.5)) for age in r.uniform(-1, 7.9, 200)] + [("a", None, True), ("b", -3.0, True), ("c", 9.0, True), ("c", 1.0, False), ("c", 16.0, False)]
    frame = spark.createDataFrame(rows, "k string, age double, ok boolean")
    got = {}
    for x in monotone.monotone_bins(frame, ["k"], F.col("age"), F.col("ok"), edges, F.lit(q)).collect():
        got.setdefault(x["k"], {})[x["bin"]] = (x["n"], x["successes"], x["fitted"])
    for key in "abc":
        n, s = [0] * 6, [0] * 6
        for k, age, ok in rows:
            if k == key and age is not None and age >= 0:
                b = max(i for i, e in enumerate(edges) if age >= e)
                n[b], s[b] = n[b] + 1, s[b] + ok
        held = [b for b in range(6) if n[b]]
        fit = pooled([min(max((s[b] + 0.5) / (n[b] + 1) / q, 0), 1) for b in held], [n[b] for b in held])
        want = [fit[held.index(min(held, key=lambda h: (abs(h - b), h)))] if held else None for b in range(6)]
        assert [got[key][b][:2] for b in range(6)] == list(zip(n, s))
        assert [got[key][b][2] for b in range(6)] == (pytest.approx(want) if held else want)


def test_terms_of_every_table_of_three(spark):
    """Each polynomial takes the values of its table at all corners."""
    rows = [(t, m, bool(t >> m & 1)) for t in range(256) for m in range(8)]
    terms = {}
    for x in polynomial.moebius_terms(spark.createDataFrame(rows, "t int, mask int, holds boolean"), ["t"], 3).collect():
        assert x["coefficient"]
        terms.setdefault(x["t"], {})[x["mask"]] = x["coefficient"]
    for t in range(256):
        for m in range(8):
            assert sum(c for k, c in terms.get(t, {}).items() if k & m == k) == (t >> m & 1)


def test_certificates():
    r = random.Random(3)
    for _ in range(60):
        n, k = r.randint(1, 4), r.randint(0, 4)
        moments = [tuple(r.randint(0, 2) for _ in range(n)) for _ in range(k)]
        terms = {tuple(r.randint(0, 2) for _ in range(n)): r.choice([-1, 1, 2]) for _ in range(3)}
        rank = np.linalg.matrix_rank(np.array(moments or [[0] * n], float))
        for p in polynomial.certify(moments, terms, n):
            inside = np.linalg.matrix_rank(np.array([*moments, p["term"]], float)) == rank
            assert p["determined"] == inside
            if inside:
                assert [sum(c * m[j] for c, m in zip(p["combination"], moments)) for j in range(n)] == list(p["term"])
            else:
                assert all(sum(x * y for x, y in zip(m, p["direction"])) == 0 for m in moments) and sum(x * y for x, y in zip(p["term"], p["direction"])) != 0
    assert polynomial.certify([(2,)], {(1,): 3}, 1)[0]["combination"] == [Fraction(1, 2)]
    with pytest.raises(ValueError):
        polynomial.certify([(1, -1)], {}, 2)


def test_certified_targets(spark):
    """With x and xy observed, xy is determined and y alone too; z is not."""
    holds = {"and": lambda x, y, z: x and y, "or": lambda x, y, z: x or y, "z": lambda x, y, z: z, "never": lambda x, y, z: False}
    rows = [(k, sum(b << j for j, b in enumerate(s)), bool(f(*s))) for k, f in holds.items() for s in itertools.product((0, 1), repeat=3)]
    got = {}
    for r in polynomial.certified_targets(spark.createDataFrame(rows, "k string, mask int, holds boolean"), "k", 3, [(1, 0, 0), (1, 1, 0)]).collect():
        got.setdefault(r["k"], {})[r["term"]] = (r["coefficient"], r["determined"], r["target_determined"], r["proof"])
    assert got == {"and": {"110": (1, True, True, "0;1")}, "or": {"100": (1, True, True, "1;0"), "010": (1, True, True, "-1;1"), "110": (-1, True, True, "0;1")}, "z": {"001": (1, False, False, "0;0;1")}}


def test_stream_of_transitions_equals_batch(spark, tmp_path):
    """Files in disorder within the delay; one tick comes too late and is dropped; the last wait for the watermark."""
    r = random.Random(8)
    ticks = [(u, 1000 + 60 * i + u, r.choice([True, False, None])) for u in range(5) for i in range(40)]
    by_time = sorted(ticks, key=lambda x: x[1])
    files = [by_time[i:i + 25] for i in range(0, len(by_time), 25)]
    for f in range(len(files) - 1):  # neighbours exchange a few ticks
        files[f][-3:], files[f + 1][:3] = files[f + 1][:3], files[f][-3:]
    kind = "u int, s long, state boolean"
    whole = spark.createDataFrame(ticks, kind).select("u", F.timestamp_seconds("s").alias("ts"), "state")
    late, end = (0, 1001, True), [(99, 10**6, True)]
    for i, f in enumerate([*files, [late], end]):
        spark.createDataFrame(f, kind).select("u", F.timestamp_seconds("s").alias("ts"), "state").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:02d}"))
        # Sources take the oldest files first.
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = health.transitions(stream, "u", "ts", "state", "10 minutes").writeStream.outputMode("append").format("memory").queryName("changes").start()
    run.processAllAvailable()
    run.stop()
    got = {(x["u"], x["t"], x["direction"]) for x in spark.table("changes").collect()}
    batch = sequence.transitions(whole.select("u", F.unix_micros("ts").alias("t"), "state"), "u")
    assert got == {(x["u"], x["t"], x["direction"]) for x in batch.collect()} and spark.table("changes").count() == len(got)


MODEL = dict(signals={"a": (("x", "z"),), "b": (("y", "z"),), "c": (("z",),), "d": (("x",), ("y",))})


def episodes(n, seed, up=1.0, down=1.0):
    """Signals of factors x, y, z with random masks; a and b are lost together more often when z is down."""
    rng = np.random.default_rng(seed)
    x, y, z = rng.random((3, n)) < np.array([[0.7], [0.8], [0.9]])
    kept = rng.random(n) < np.where(z, up, down)
    hidden = rng.random((2, n)) < 0.2
    out = lambda v, m: [None if h else bool(b) for b, h in zip(v, m)]
    return list(zip(out(x & z, ~kept), out(y & z, ~kept), out(z, hidden[0]), out(x | y, hidden[1])))


def test_gradient_against_differences():
    from lodestar.operators import likelihood as lk

    for retention in (None, ("z", ("a", "b"), 0.9, 0.4)):
        model = lk.FactorModel(**MODEL, retention=retention)
        patterns = sorted(set(episodes(400, 5, 0.8, 0.4)), key=str)
        objective = lk.Likelihood(model, patterns, np.arange(1, len(patterns) + 1))
        for at in np.random.default_rng(1).normal(size=(5, 3)):
            steps = [(objective(at + e)[0] - objective(at - e)[0]) / 2e-6 for e in 1e-6 * np.eye(3)]
            assert objective(at)[1] == pytest.approx(steps, rel=1e-4, abs=1e-3)


def test_factors_are_recovered(spark):
    from lodestar.operators import likelihood as lk

    kind = "k string, a boolean, b boolean, c boolean, d boolean"
    rows = [("lost", *r) for r in episodes(20_000, 6, 0.9, 0.3)] + [("all", *r) for r in episodes(20_000, 7)] + [("none", None, None, None, None)] + [("odd", True, None, False, None)]
    frame = spark.createDataFrame(rows, kind)
    truth = {"x": 0.7, "y": 0.8, "z": 0.9}
    fit = lambda model: {(r["k"], r["factor"]): r for r in lk.fit_factors(frame, "k", model).collect()}
    plain, aware = fit(lk.FactorModel(**MODEL)), fit(lk.FactorModel(**MODEL, retention=("z", ("a", "b"), 0.9, 0.3)))
    for f, p in truth.items():
        assert plain["all", f]["probability"] == pytest.approx(p, abs=0.015) and aware["lost", f]["probability"] == pytest.approx(p, abs=0.015)
        assert (plain["all", f]["status"], plain["none", f]["status"], plain["odd", f]["status"]) == ("converged", "no_observations", "impossible_pattern")
    # Lost traces tell of z only to the fit that knows how they are lost, where z itself is not observed.
    masked = frame.filter("k = 'lost'").withColumn("c", F.lit(None).cast("boolean"))
    z = lambda model: next(r["probability"] for r in lk.fit_factors(masked, "k", model).collect() if r["factor"] == "z")
    assert abs(z(lk.FactorModel(**MODEL, retention=("z", ("a", "b"), 0.9, 0.3))) - 0.9) < 0.02 < abs(z(lk.FactorModel(**MODEL)) - 0.9)


def test_fits_say_how_they_ended(spark):
    from lodestar.operators import likelihood as lk

    frame = spark.createDataFrame([("k", *r) for r in episodes(3000, 9)], "k string, a boolean, b boolean, c boolean, d boolean")
    bounded = {r["factor"]: r for r in lk.fit_factors(frame, "k", lk.FactorModel(**MODEL, bounds={"x": (0.75, 0.99)})).collect()}
    assert bounded["x"]["probability"] == pytest.approx(0.75) and bounded["x"]["status"] == "converged_boundary"
    alike = lk.FactorModel({"a": (("x", "y"),)})  # only the product is determined
    got = lk.fit_factors(frame, "k", alike).collect()
    assert {r["status"] for r in got} == {"converged_nonunique"} and np.prod([r["probability"] for r in got]) == pytest.approx(0.63, abs=0.03)
    with pytest.raises(ValueError):
        lk.FactorModel({"a": (("x",),)}, bounds={"x": (0.9, 0.1)})
