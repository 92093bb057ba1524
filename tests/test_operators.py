"""Exhaustive small-domain oracles, metamorphic properties and the time logic's edges."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.expr import bool_lenient, bool_strict
from lodestar.operators import graph, identify, law, scoring, sequence, stats, timejoin, validate
from lodestar.sources import traces
from lodestar.streaming import health

VALUES = (None, False, True)


def execution(a, b, c, d):
    return (a | b) & c & d


def test_sharp_bounds_match_all_completions(spark):
    vectors = list(itertools.product(VALUES, repeat=4))
    rows = spark.createDataFrame([(i, *v, 1 + i % 3) for i, v in enumerate(vectors)], "id int, a boolean, b boolean, c boolean, d boolean, cnt long")
    got = {r["id"]: r for r in law.sharp_bounds(rows, ["id"], list("abcd"), {"e": execution}).collect()}
    for i, v in enumerate(vectors):
        options = [execution(*s) for s in itertools.product((False, True), repeat=4) if all(x is None or x == y for x, y in zip(v, s))]
        n = 1 + i % 3
        assert (got[i]["e_lower"], got[i]["e_upper"]) == (n * min(options), n * max(options))


def test_conjunctive_bounds_match_enumeration(spark):
    vectors = list(itertools.product(VALUES, repeat=3))
    rows = spark.createDataFrame([(1, *v, 1) for v in vectors], "k int, a boolean, b boolean, c boolean, cnt long")
    closed = law.conjunctive_bounds(rows, ["k"], list("abc")).first()
    listed = law.sharp_bounds(rows, ["k"], list("abc"), {"r": lambda a, b, c: a & b & c}).first()
    assert (closed["lower_count"], closed["upper_count"]) == (listed["r_lower"], listed["r_upper"])


def test_group_conjunction(spark):
    rows = spark.createDataFrame([(1, True), (1, None), (2, False), (2, None), (3, True), (3, True)], "k int, v boolean")
    assert {r["k"]: r["conjunction"] for r in law.group_conjunction(rows, ["k"], "v").collect()} == {1: None, 2: False, 3: True}


def test_asof_ties_and_masked_probes(spark):
    asks = spark.createDataFrame([(1, "u", 10), (2, "u", 15), (3, "u", 5), (4, "v", 1)], "id long, k string, t long")
    probes = spark.createDataFrame([("u", 10, None), ("u", 20, True), ("u", 8, True)], "k string, t long, state boolean")
    back = {r["id"]: (r["probe_t"], r["state"]) for r in timejoin.asof_backward(asks, probes, "k", "state").collect()}
    assert back == {1: (10, None), 2: (10, None), 3: (None, None), 4: (None, None)}
    near = {r["id"]: r["probe_t"] for r in timejoin.asof_nearest(asks, probes, "k", "state").collect()}
    assert near == {1: 10, 2: 10, 3: 8, 4: None}


def test_interval_union(spark):
    rows = spark.createDataFrame([(1, 0, 1500), (1, 200, 1700), (2, 0, 10), (2, 20, 30)], "k int, start long, stop long")
    assert {r["k"]: (r["covered"], r["total"]) for r in sequence.interval_union(rows, "k").collect()} == {1: (1700, 3000), 2: (20, 20)}


def test_episodes(spark):
    states = [None, True, True, False, None, None]
    rows = spark.createDataFrame([("u", i, s) for i, s in enumerate(states)], "k string, t long, state boolean")
    got = [(r["episode"], r["left_censored"], r["age_lower"], r["age_upper"]) for r in sequence.episodes(rows, "k").orderBy("t").collect()]
    assert got == [(0, True, 0, None), (1, False, 0, 1), (1, False, 1, 2), (2, False, 0, 1), (3, False, 0, 1), (3, False, 1, 2)]


def test_strong_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7)], "a int, b int")
    assert {r["node"]: r["component"] for r in graph.strong_components(graph.closure(edges)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_statistics():
    assert stats.beta_quantile(0.025, 5, 6) == pytest.approx(0.18708603, abs=1e-7)
    assert stats.t_tail(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)


def test_fits_recover_factors(spark):
    rng = np.random.default_rng(3)
    x, y, z = (rng.random((3, 4000)) < np.array([[0.7], [0.8], [0.9]]))
    data = [(bool(a), None if m < 0.2 else bool(b), bool(c)) for a, b, c, m in zip(x & z, y & z, z, rng.random(4000))]
    rows = spark.createDataFrame(data, "a boolean, b boolean, c boolean")
    factors = {"a": ["x", "z"], "b": ["y", "z"], "c": ["z"]}
    for fit in (identify.log_moment_fit(identify.joint_moments(rows, list("abc"), 2), factors), identify.observed_mle(rows, list("abc"), factors)):
        assert {r["factor"]: r["probability"] for r in fit.collect()} == pytest.approx({"x": 0.7, "y": 0.8, "z": 0.9}, abs=0.04)
    short = identify.log_moment_fit(identify.joint_moments(rows.select("a"), ["a"], 1), {"a": ["x", "z"]})
    assert {r["status"] for r in short.collect()} == {"unsupported"}


def test_decoders(spark):
    rows = spark.createDataFrame([(" True ",), ("0",), ("junk",)], "v string")
    assert [r[0] for r in rows.select(bool_lenient("v")).collect()] == [True, False, False]
    with pytest.raises(Exception, match="not a Boolean"):
        rows.select(bool_strict("v")).collect()


def test_validation(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert validate.duplicates(a, ["k"], "d").first()["violations"] == 1
    assert validate.orphans(a, b, "k", "k", "o").first()["violations"] == 1
    assert {r["side"]: r["n"] for r in validate.multiset_difference(a, b).collect()} == {"left": 2, "right": 1}
    with pytest.raises(ValueError):
        validate.assert_empty(a, "rows")


def test_jaeger(spark, tmp_path):
    document = {"data": [{"traceID": "t", "processes": {"p": {"serviceName": "shop", "tags": [{"key": "host", "value": "a"}, {"key": "x", "value": "1"}]}}, "spans": [
        {"traceID": "t", "spanID": "1", "processID": "p", "operationName": "root", "startTime": 5, "duration": 7, "references": [], "tags": [{"key": "x", "value": "2"}]},
        {"traceID": "t", "spanID": "2", "processID": "p", "operationName": "child", "startTime": 6, "duration": 1, "references": [{"refType": "CHILD_OF", "traceID": "t", "spanID": "1"}], "tags": [{"key": "error", "value": "true"}]}]}]}
    (tmp_path / "j.json").write_text(json.dumps(document))
    rows = {r["span_id"]: r for r in traces.read_jaeger(spark, str(tmp_path / "j.json")).collect()}
    assert rows["1"]["parent_span_id"] is None and rows["1"]["end_ns"] == 12_000 and rows["1"]["attributes"] == {"host": "a", "x": "2"}
    assert rows["2"]["parent_span_id"] == "1" and rows["2"]["status"] == "ERROR" and rows["2"]["service"] == "shop"


def test_otlp_lines(spark, tmp_path):
    text = lambda v: {"stringValue": v}
    span = {"traceId": "t", "spanId": "1", "parentSpanId": "", "name": "op", "kind": "2", "startTimeUnixNano": "10", "endTimeUnixNano": "30", "status": {"code": "1"}, "attributes": [{"key": "k", "value": text("span")}]}
    document = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": text("shop")}, {"key": "k", "value": text("resource")}]}, "scopeSpans": [{"spans": [span]}]}]}
    (tmp_path / "o.jsonl").write_text(json.dumps(document) + "\n{broken\n")
    spans, counters = traces.otlp_lines(spark, str(tmp_path / "o.jsonl"))
    row = spans.first()
    assert (row["service"], row["parent_span_id"], row["start_ns"], row["attributes"]["k"]) == ("shop", None, 10, "span")
    assert tuple(counters.first()) == (2, 1)


def test_checked_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\nx,1\n")
    assert traces.read_checked_csv(spark, str(tmp_path / "a.csv"), "id string, n int").collect()[0]["n"] == 1
    with pytest.raises(Exception):
        traces.read_checked_csv(spark, str(tmp_path / "a.csv"), "id string, other int").collect()


def test_streaming_equals_batch(spark, tmp_path):
    ticks = spark.range(100).select((F.timestamp_seconds(F.col("id") * 30)).alias("ts"), F.col("id").cast("double").alias("v"))
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {r["start"]: (r["n"], r["mean"]) for r in health.windowed_means(ticks, "ts", "v", "5 minutes", "1 minute").collect()}
    stream = health.windowed_means(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")), "ts", "v", "5 minutes", "1 minute")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("means").start()
    run.processAllAvailable()
    run.stop()
    assert {r["start"]: (r["n"], r["mean"]) for r in spark.table("means").collect()} == batch


def test_contraction_passes_any_number_of_unselected_parents(spark):
    chain = [(1, i, i - 1 or None, i in (1, 12)) for i in range(1, 41)] + [(2, 5, 4, True)]
    got = {(r["trace_id"], r["span_id"]): r["ancestor"] for r in graph.nearest_selected_ancestor(spark.createDataFrame(chain, "trace_id int, span_id int, parent_id int, selected boolean")).collect()}
    assert got == {(1, 1): None, (1, 12): 1, (2, 5): None}
    with pytest.raises(ValueError):
        graph.nearest_selected_ancestor(spark.createDataFrame([(1, 1, 2, False), (1, 2, 1, False), (1, 3, 1, True)], "trace_id int, span_id int, parent_id int, selected boolean")).collect()


def test_closure_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    assert graph.closure(edges).count() == 40 * 41 // 2


def test_sign_flip_keeps_large_groups(spark):
    rows = spark.createDataFrame([("big", float(i)) for i in range(17)] + [("small", 1.0), ("small", 2.0)], "g string, x double")
    got = {r["g"]: (r["n"], r["p"], r["status"]) for r in scoring.sign_flip(rows, ["g"], "x").collect()}
    assert got == {"big": (17, None, "unsupported"), "small": (2, 0.5, "supported")}


def test_bootstrap_intervals(spark):
    """Mean and width follow the normal approximation; blocks of equal values widen it; a hot key is one row like any other."""
    rng = np.random.default_rng(0)
    x, runs = rng.normal(5, 2, 4000), np.repeat(rng.normal(5, 2, 500), 8)
    rows = [("hot", i, float(v)) for i, v in enumerate(x)] + [("runs", i, float(v)) for i, v in enumerate(runs)] + [("one", 0, 3.0), ("none", 0, None)]
    frame = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    got = {r["k"]: r for r in stats.bootstrap_mean(frame, "k", "v").collect()}
    assert set(got) == {"hot", "runs", "one"} and got["one"]["lower"] == got["one"]["upper"] == 3.0 and got["hot"]["n"] == 4000
    assert got["hot"]["mean"] == pytest.approx(x.mean()) and got["hot"]["upper"] - got["hot"]["lower"] == pytest.approx(2 * 1.96 * x.std() / 4000**0.5, rel=0.12)
    wide = {r["k"]: r for r in stats.bootstrap_mean(frame, "k", "v", block=8).collect()}
    assert wide["runs"]["upper"] - wide["runs"]["lower"] == pytest.approx(2 * 1.96 * runs.std() / 500**0.5, rel=0.15)


def test_values_of_exact_intervals(spark):
    """Known values: the rule of three's exact form, and a table of Fisher's tea test."""
    row = spark.createDataFrame([(0, 10, 3, 1, 1, 3)], "s long, n long, a long, b long, c long, d long").select(stats.clopper_pearson(F.col("s"), F.col("n")).alias("i"), stats.fisher(*[F.col(x) for x in "abcd"]).alias("p")).first()
    assert row["i"]["lower"] == 0 and row["i"]["upper"] == pytest.approx(1 - 0.025 ** 0.1, abs=1e-9) and row["p"] == pytest.approx(34 / 70, abs=1e-9)


def test_protocol_status_and_names(spark):
    from lodestar.operators import requests

    cases = [({"http.status_code": "204"}, False, True), ({"http.status_code": "204"}, True, False), ({"http.status_code": "302"}, False, False), ({"rpc.grpc.status_code": "0"}, None, True),
             ({"rpc.grpc.status_code": "0", "http.status_code": "500"}, False, False), ({"http.status_code": "x"}, False, None), ({}, False, None), ({"http.status_code": "9" * 30}, False, False)]
    frame = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(cases)], "i int, attributes map<string,string>, error boolean")
    got = {r["i"]: r["s"] for r in frame.select("i", requests.protocol_status(F.col("attributes"), F.col("error")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    row = spark.createDataFrame([({"k": "a", "host.name": "h2", "db.system": "pg", "server.address": "x", "server.port": "1", "db.name": "d"}, "GET")], "m map<string,string>, n string")
    r = row.select(requests.replica_identity(F.col("m"), "k", {"a": "h1", "b": "h2"}).alias("r"), requests.database_endpoint(F.col("m")).alias("e"), requests.ignored_call(F.lit("a.Health"), F.lit(None), ["Health"]).alias("g")).first()
    assert (r["r"]["replica"], r["r"]["reason"], r["e"], r["g"]) == (None, "conflicting_native_identity", "pg://x:1/d", True)
