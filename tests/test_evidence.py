"""Rules of the evidence by hand: each case is one request whose spans break or keep one rule."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import binding, requests

SPANS = "trace_id string, span_id string, parent_id string, service string, name string, kind string, start_ns long, end_ns long, attributes map<string,string>, resource map<string,string>, error boolean"
REQUESTS = "trace_id string, operation string, boundary string, start_ns long, end_ns long"
OK, BAD = {"http.response.status_code": "200"}, {"http.response.status_code": "500"}
GATE, SHOP = ("gate", "shop"), ("gate", "stock")


def contract(**more):
    operation = dict(entry="gate", deadline_ns=100, required={GATE: 1}, target_calls=1, ignored={GATE: ("Health",)}, retried=(GATE,)) | more
    return binding.Contract(target="shop", replicas={"a": "host-a", "b": "host-b"}, routes=("shop", "stock"), operations={"visit": binding.Operation(**operation)}, peers=(("shop", "pg", "db", "5432", "shop"), ("stock", "pg", "db", "5432", "stock")),
                            unlabelled_entries=("read_server",))


def span(i, parent, service, attributes=OK, kind="2", name="GET", start=10, end=20, host=None, error=False, **resource):
    return (str(i), None if parent is None else str(parent), service, name, kind, start, end, attributes, resource | ({"host.name": host} if host else {}), error)


def client(i, parent, service, target, code, name="POST", start=10, end=20):
    return span(i, parent, service, {"server.address": target} | ({"http.status_code": str(code)} if code else {}), "3", name, start, end)


#: name of the case: spans of one request
CASES = {
    "plain": [span(1, "x", "gate"), span(2, 1, "shop", host="host-a")],
    "no spans": [],
    "unexplained": [span(1, "x", "gate"), span(2, 9, "shop")],
    "wrong entry": [span(1, "x", "shop")],
    "repeated": [span(1, "x", "gate"), span(1, "x", "gate")],
    "cycle": [span(1, "x", "gate"), span(2, 3, "shop"), span(3, 2, "shop")],
    "no time": [span(1, "x", "gate", start=5, end=5)],
    "two roots": [span(1, "x", "gate"), span(2, "x", "gate")],
    "optional failure": [span(1, "x", "gate"), span(2, 1, "shop", host="host-b"), span(3, 1, "shop", BAD, name="a/Health"), client(4, 3, "shop", "stock", 500)],
    "client failure": [span(1, "x", "gate"), span(2, 1, "shop", host="host-b"), client(3, 1, "gate", "shop", 500)],
    "call failure": [span(1, "x", "gate", {}), span(2, 1, "shop", BAD, host="host-a")],
    "silent": [span(1, "x", "gate", {}), span(2, 1, "shop", {}, host="host-a")],
    "undeclared label": [span(1, "x", "gate"), span(2, 1, "shop", host="host-a", **{"study.replica": "c"})],
    "conflicting": [span(1, "x", "gate"), span(2, 1, "shop", host="host-a", **{"study.replica": "b"})],
    "unlabelled entry": [span(1, "x", "gate"), span(2, 1, "shop", kind="", name="read_server", host="host-a")],
    "other kind": [span(1, "x", "gate"), span(2, 1, "shop", kind="1", host="host-a")],
    "own service": [span(1, "x", "gate"), span(2, 1, "shop", host="host-a"), span(3, 2, "shop", host="host-b")],
    "late": [span(1, "x", "gate"), span(2, 1, "shop", host="host-a", start=150, end=160)],
    "database": [span(1, "x", "gate"), span(2, 1, "shop", host="host-a"), span(3, 2, "shop", {"db.system": "pg"}, "3")],
    "nameless database": [span(1, "x", "gate"), span(2, 1, "shop", host="host-a"), span(3, 2, "shop", {"db.system": "my"}, "3")],
}


def evaluated(spark, cases, spec, window=(0, 90)):
    spans = spark.createDataFrame([(name, *s) for name, rows in cases.items() for s in rows], SPANS)
    asked = spark.createDataFrame([(name, "visit", "x", *window) for name in cases], REQUESTS)
    linked = binding.linked_spans(asked, spans, spec)
    facts = binding.request_facts(asked, linked, spec)
    found = binding.calls(linked, spec)
    required = binding.required_pairs(found, spec)
    done = binding.logical_completions(facts, linked, found, binding.client_failures(linked), spec, required)
    by = lambda df, *c: {r["trace_id"]: (tuple(r[x] for x in c) if len(c) > 1 else r[c[0]]) for r in df.collect()}
    return dict(refusal=by(facts, "refusal"), root=by(facts, "root_status"), demand=by(facts, "demand_a", "demand_b"), timely=by(facts, "timely"), done=by(done.filter("target = 'shop'"), "value", "reason"),
                admitted=by(binding.admissions(facts, linked, spec), "admitted_a", "admitted_b"), required=required)


@pytest.fixture(scope="module")
def seen(spark):
    return evaluated(spark, CASES, contract())


def test_refusals(seen):
    refused = {k: v for k, v in seen["refusal"].items() if v}
    assert refused == {"unexplained": "unexplained_parent", "wrong entry": "unexpected_entry", "repeated": "repeated_span", "cycle": "cyclic_parents", "no time": "untimed_span", "nameless database": "ambiguous_database"}
    for name in refused:
        assert seen["root"][name] is None and seen["demand"][name] == (None, None) and seen["done"][name] == (None, "refused") and seen["admitted"][name] == (None, None)


def test_roots(seen):
    assert seen["root"]["plain"] is True and seen["root"]["two roots"] is None and seen["root"]["no spans"] is None and seen["root"]["silent"] is None


def test_completions(seen):
    want = {"plain": (True, "explicit_protocol_success"), "no spans": (None, "group_not_fully_observed"), "optional failure": (True, "explicit_protocol_success"), "client failure": (False, "explicit_client_failure"),
            "call failure": (False, "explicit_call_failure"), "silent": (None, "no_certificate"), "database": (True, "explicit_protocol_success")}
    assert {k: seen["done"][k] for k in want} == want


def test_demand_and_admission(seen):
    want = {"plain": ((True, False), (True, None)), "undeclared label": ((None, None), (None, None)), "conflicting": ((None, None), (None, None)), "unlabelled entry": ((True, False), (True, None)), "other kind": ((None, None), (None, None)),
            "own service": ((True, False), (True, None)), "late": ((True, False), (None, None)), "no spans": ((None, None), (None, None)), "optional failure": ((False, True), (None, True))}
    assert {k: (seen["demand"][k], seen["admitted"][k]) for k in want} == want


def test_databases_are_required_where_they_are_called(seen):
    assert seen["required"]["visit"] == {GATE: 1, ("shop", "pg://db:5432/shop"): 1}


def test_propagation_and_deadline(spark):
    cases = {"silent": [span(1, "x", "gate"), span(2, 1, "shop", {}), span(3, 1, "shop", {})], "few": [span(1, "x", "gate"), span(2, 1, "shop", {})]}
    got = evaluated(spark, cases, contract(propagates=True, required={GATE: 2}, deadline_ns=89))
    # The parent's own code certifies a call, so a silent receiver of a good caller is a success.
    assert got["done"] == {"silent": (True, "explicit_protocol_success"), "few": (None, "group_not_fully_observed")} and set(got["timely"].values()) == {False}
    cases = {"root only": [span(1, "x", "gate"), span(2, 1, "gate", {}), span(3, 2, "shop", {})]}
    assert evaluated(spark, cases, contract(propagates=True))["done"] == {"root only": (True, "propagated_root_success")}
    assert evaluated(spark, cases, contract())["done"] == {"root only": (None, "no_certificate")}


def retry(*, first=503, final=201, extra=(), receiver=5, parent2=1, start2=30, names=("POST", "POST"), receivers=None):
    rows = [span(1, "x", "gate", {}), client(2, 1, "gate", "shop", first, names[0], 10, 20), client(4, parent2, "gate", "shop", final, names[1], start2, start2 + 20)]
    rows += [span(receiver, 4, "shop", {"http.status_code": "201"}, start=start2 + 1, end=start2 + 9, host="host-a")] if receivers is None else receivers
    return [*rows, *extra]


RETRIES = {
    "once": (retry(), (True, "retried_once")),
    "nested receiver": (retry(receivers=[span(6, 4, "gate", {}), span(5, 6, "shop", {"http.status_code": "201"})]), (True, "retried_once")),
    "no 503": (retry(first=500), (False, "explicit_client_failure")),
    "not a post": (retry(names=("GET", "POST")), (False, "explicit_client_failure")),
    "third attempt": (retry(extra=[client(7, 1, "gate", "shop", 201, start=60, end=70)]), (None, "retry_not_fully_observed")),
    "one attempt": (retry()[:2], (None, "retry_not_fully_observed")),
    "final 200": (retry(final=200), (None, "retry_not_fully_observed")),
    "other parent": (retry(parent2=2), (None, "retry_order_not_verified")),
    "overlap": (retry(start2=15), (None, "retry_order_not_verified")),
    "second by get": (retry(names=("POST", "GET")), (None, "retry_order_not_verified")),
    "first was received": (retry(extra=[span(8, 2, "shop", {"http.status_code": "201"})]), (None, "earlier_receiver_effect")),
    "two receivers": (retry(extra=[span(8, 4, "shop", {"http.status_code": "201"})]), (None, "final_receiver_not_unique")),
    "no receiver": (retry(receivers=[]), (None, "final_receiver_not_unique")),
    "silent receiver": (retry(receivers=[span(5, 4, "shop", {})]), (None, "final_receiver_not_unique")),
    "too few calls": (retry(), (None, "final_completion_not_verified")),
}


def test_retries(spark):
    cases = {k: v[0] for k, v in RETRIES.items() if k != "too few calls"}
    got = evaluated(spark, cases, contract(target_calls=0))["done"]
    assert got == {k: v[1] for k, v in RETRIES.items() if k in cases}
    assert evaluated(spark, {"too few calls": RETRIES["too few calls"][0]}, contract(required={GATE: 2}))["done"] == {"too few calls": (None, "final_completion_not_verified")}
    assert evaluated(spark, {"once": RETRIES["once"][0]}, contract(retried=()))["done"] == {"once": (False, "explicit_client_failure")}


def test_shared_host_names_name_no_replica(spark):
    row = spark.createDataFrame([({"hostname": "h"}, {"host.name": "h2", "k": "b"}, {"k": "b", "hostname": "elsewhere"})], "x map<string,string>, y map<string,string>, z map<string,string>")
    got = row.select(*[requests.replica_identity(F.col(c), "k", {"a": "h", "b": "h2", "c": "h"}).alias(c) for c in "xyz"]).first()
    assert (got["x"]["reason"], got["y"]["replica"], got["z"]["replica"]) == ("nonunique_declared_name", "b", "b")


def test_cycles_raise_unless_marked(spark):
    spans = spark.createDataFrame([("t", 1, None, True), ("t", 2, 3, False), ("t", 3, 2, False), ("t", 4, 3, False), ("t", 5, 1, False)], "trace_id string, span_id int, parent_id int, f boolean")
    with pytest.raises(ValueError, match="cycle"):
        requests.ancestor_any(spans, "f")
    marked = {r["span_id"]: (r["f"], r["c"]) for r in requests.ancestor_any(spans, "f", "c").collect()}
    assert marked == {1: (True, False), 2: (False, True), 3: (False, True), 4: (False, True), 5: (True, False)}


def test_linked_spans_are_written_once_and_like_those_of_large_traces(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for t in range(60):
        n = rng.randint(1, 9)
        for i in range(n):
            span, parent = rng.choice([i, i, i, rng.randrange(n)]), rng.choice([None, *range(n), 99]) if i else None
            rows.append((f"t{t}", f"{span}", None if parent is None else f"{parent}", f"s{rng.randint(0, 3)}", rng.choice(["Get", "svc/Health"]), rng.choice(["2", "3"]), 10, 20, {"http.response.status_code": rng.choice(["200", "503"])}, {}, False))
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, service string, name string, kind string, start_ns long, end_ns long, attributes map<string,string>, resource map<string,string>, error boolean").repartition(3)
    asked = spark.createDataFrame([(f"t{t}", "op", None, 0, 50) for t in range(60)], "trace_id string, operation string, boundary string, start_ns long, end_ns long")
    contract = binding.Contract(target="s2", replicas={}, routes=("s1", "s2"), operations={"op": binding.Operation("s0", 100, {("s0", "s1"): 1}, ignored={("s0", "s1"): ("Health",), ("s1", "s2"): ("Health",)})})
    writes, columns = [], ["trace_id", "span_id", "parent_id", "service", "name", "status", "parent_service", "parent_status", "repeated", "root", "across", "unexplained", "destination", "optional", "cyclic"]
    kept = binding.settle
    monkeypatch.setattr(binding, "settle", lambda df: writes.append(1) or kept(df))
    found = {}
    for most in (64, 4, 0):
        writes.clear()
        monkeypatch.setattr(binding, "SMALL", most)
        found[most] = sorted(map(repr, binding.linked_spans(asked, spans, contract).select(columns).collect()))
        if most == 64:
            assert len(writes) == 1
    assert len(found[0]) == len(rows) and found[64] == found[4] == found[0]
    assert sum("cyclic=True" in r for r in found[64]) > 5 and sum("optional=True" in r for r in found[64]) > 5 and sum("repeated=True" in r for r in found[64]) > 5
