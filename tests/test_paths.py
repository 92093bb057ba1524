"""Products along parents, caller contexts, server forests and components of cycles, against plain versions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import paths

SPANS = "trace_id string, span_id int, parent_id int, service string, operation string, error boolean"


def forest(seed, traces, size):
    r, rows = random.Random(seed), []
    for t in range(traces):
        for i in range(1, r.randint(1, size) + 1):
            parent = None if i == 1 or r.random() < 0.1 else r.randint(max(1, i - 3), i - 1)
            rows.append((f"t{t}", i, parent, f"s{i % 3}", f"op{i % 3}{'é' if i % 5 == 0 else ''}", r.random() < 0.3))
    r.shuffle(rows)
    return rows


def plain_path(index, t, i):
    out = []
    while i is not None:
        out.append(index[t, i][4])
        i = index[t, i][2]
    return out[::-1]


def test_contexts_against_plain(spark):
    rows = forest(1, 30, 25)
    index = {(r[0], r[1]): r for r in rows}
    contexts = paths.caller_contexts(spark.createDataFrame(rows, SPANS).repartition(4))
    got = {(r["trace_id"], r["span_id"]): r for r in contexts.collect()}
    assert set(got) == set(index)
    for (t, i), r in got.items():
        assert r["path"] == plain_path(index, t, i)
        assert r["context"] == "operation_" + hashlib.sha256(json.dumps(["full-caller-context-1", *r["path"]], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:24]
    named = {}
    for (t, i), r in got.items():
        named.setdefault(r["context"], []).append((r["error"], any(e[5] for e in rows if (e[0], e[2]) == (t, i))))
    for r in paths.context_operations(contexts).collect():
        pairs = named[r["context"]]
        quiet = [e for e, c in pairs if not c]
        assert (r["invocations"], r["inclusive_errors"], r["child_error_parent_success"], r["no_child_error_invocations"], r["local_errors"]) == (len(pairs), sum(e for e, _ in pairs), sum(c and not e for e, c in pairs), len(quiet), sum(quiet))
        assert r["local_probability"] == (sum(quiet) / len(quiet) if quiet else None) and r["propagates"] == (r["child_error_parent_success"] == 0)
    edges = {}
    for (t, i), r in got.items():
        parent = index[t, i][2]
        key = (got[t, parent]["context"] if parent else None, r["context"])
        edges[key] = edges.get(key, 0) + 1
    assert {(r["caller"], r["callee"]): r["calls"] for r in paths.context_edges(contexts).collect()} == edges


def test_a_deep_chain(spark):
    n = 1000
    contexts = paths.caller_contexts(spark.createDataFrame([("t", i, i - 1 or None, "s", f"o{i}", False) for i in range(1, n + 1)], SPANS))
    deepest = contexts.filter(f"span_id = {n}").first()
    assert deepest["path"] == [f"o{i}" for i in range(1, n + 1)] and deepest["root"] == 1


@pytest.mark.parametrize("rows,what", [([("t", 1, 2, "s", "o", False), ("t", 2, 1, "s", "o", False)], "cycle"), ([("t", 1, 9, "s", "o", False)], "missing"), ([("t", 1, None, "s", "o", False)] * 2, "twice"), ([("t", 1, 1, "s", "o", False)], "cycle")])
def test_broken_traces_raise(spark, rows, what):
    with pytest.raises(ValueError, match=what):
        paths.caller_contexts(spark.createDataFrame(rows, SPANS))


def test_a_context_of_two_services_raises(spark):
    rows = [("t", 1, None, "s", "o", False), ("u", 1, None, "x", "o", False)]
    with pytest.raises(Exception, match="two services"):
        paths.context_operations(paths.caller_contexts(spark.createDataFrame(rows, SPANS))).collect()


def test_forest_against_plain(spark):
    r, rows = random.Random(5), []
    for t in range(40):
        for i in range(1, r.randint(1, 20) + 1):
            parent = None if i == 1 else 99 if r.random() < 0.1 else r.randint(max(1, i - 4), i - 1)
            rows.append((f"t{t}", i, parent, r.random() < 0.5))
    index = {(t, i): (p, s) for t, i, p, s in rows}
    want = {}
    for (t, i), (p, server) in index.items():
        if server:
            passed = 0
            while (t, p) in index and not index[t, p][1]:
                p, passed = index[t, p][0], passed + 1
            want[t, i] = [p if (t, p) in index else None, passed, p if p is not None and (t, p) not in index else None]
    for t, i in want:
        root = i
        while want[t, root][0] is not None:
            root = want[t, root][0]
        want[t, i].append(root)
    frame = spark.createDataFrame(rows, "trace_id string, span_id int, parent_id int, server boolean").repartition(3)
    found = paths.server_forest(frame)
    got = {(r["trace_id"], r["span_id"]): [r["ancestor"], r["contracted"], r["missing_parent"], r["root"]] for r in found.collect()}
    assert got == want
    trees = {(r["trace_id"], r["root"]): r["tree_id"] for r in found.collect()}
    assert len(set(trees.values())) == len(trees) and all(len(x) == 32 for x in trees.values())
    once = paths.unrepeated(frame.union(frame.limit(3)), ["parent_id", "server"])
    audit = {r["trace_id"]: r for r in paths.forest_audit(once, found).collect()}
    assert sum(a["repeats"] for a in audit.values()) == 3
    for t, a in audit.items():
        own = [k for k in want if k[0] == t]
        assert (a["servers"], a["trees"], a["missing_parent_roots"]) == (len(own), sum(want[k][0] is None for k in own), sum(want[k][2] is not None for k in own))
        assert a["whole_tree"] == (a["trees"] == 1 and a["missing_parent_roots"] == 0)


def test_forest_refuses_cycles_and_conflicts(spark):
    kind = "trace_id string, span_id int, parent_id int, server boolean"
    for servers in ((True, True, True), (False, False, True), (True, False, False)):
        with pytest.raises(ValueError, match="cycle"):
            paths.server_forest(spark.createDataFrame([("t", i, (i + 1) % 3, s) for i, s in enumerate(servers)], kind))
    with pytest.raises(Exception, match="different content"):
        paths.unrepeated(spark.createDataFrame([("t", 1, None, True), ("t", 1, None, False)], kind), ["parent_id", "server"]).collect()


def plain_components(edges):
    """Tarjan's algorithm with its own stack."""
    out, index, low, on, stack, found = {}, {}, {}, set(), [], {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    for start in out:
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        group.append(w)
                        if w == v:
                            break
                    if len(group) > 1 or (v, v) in edges:
                        found |= {w: min(group) for w in group}
            elif w not in index:
                index[w] = low[w] = len(index)
                stack.append(w)
                on.add(w)
                work.append((w, iter(out[w])))
            elif w in on:
                low[v] = min(low[v], index[w])
    return found


GRAPHS = {
    "small": {(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (8, 8)},
    "looped chain": {(1, 2), (2, 3), (3, 1), (1, 4), (4, 1), (1, 9)},
    "figure of eight": {(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 0), (5, 0), (4, 6)},
    "path": {(i, i + 1) for i in range(50)},
    "none": set(),
}


def random_graph(seed, nodes, count):
    r = random.Random(seed)
    return {(r.randrange(nodes), r.randrange(nodes)) for _ in range(count)}


def test_components_of_many_graphs(spark):
    """All of them side by side in one table."""
    graphs = [*(GRAPHS[k] for k in sorted(GRAPHS)), random_graph(1, 60, 90), random_graph(2, 200, 230), random_graph(3, 150, 160)]
    edges = {(1000 * i + a, 1000 * i + b) for i, g in enumerate(graphs) for a, b in g}
    got = paths.cycle_components(spark.createDataFrame(list(edges), "a int, b int")).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == plain_components(edges)


def test_a_table_without_edges_has_no_component(spark):
    assert paths.cycle_components(spark.createDataFrame([(None, 1)], "a int, b int")).count() == 0


def test_a_long_cycle(spark):
    n = 100_000
    frame = spark.range(n).selectExpr("id AS a", f"(id + 1) % {n} AS b").union(spark.createDataFrame([(5, n + 1), (n + 2, 7)], "a long, b long"))
    found = paths.cycle_components(frame)
    assert found.count() == n and [r["component"] for r in found.select("component").distinct().collect()] == [0]


def test_small_groups_climb_in_one_write_and_like_large_ones(spark, monkeypatch):
    writes, kept = [], paths.settle
    monkeypatch.setattr(paths, "settle", lambda df: writes.append(1) or kept(df))
    rows = [("a", i, i - 1 or None, f"v{i}") for i in range(1, 9)] + [("b", 1, 9, "x"), ("b", 2, 1, "y"), ("c", 1, 2, "x"), ("c", 2, 1, "y"), ("c", 3, 2, "z"), (None, 1, None, "x"), (None, 2, 1, "y")]
    nodes = spark.createDataFrame(rows, "k string, n int, up int, v string").repartition(3)
    found = {}
    for most in (64, 2, 0):
        writes.clear()
        monkeypatch.setattr(paths, "SMALL", most)
        got = paths.climb(nodes, ["k"], "n", "up", "v", lambda top, own: F.concat(top, own), "cyclic")
        found[most] = {(r["k"], r["n"]): (None if r["cyclic"] else r["up"], None if r["cyclic"] else r["v"], r["cyclic"]) for r in got.collect()}
        if most == 64:
            assert len(writes) == 1
    assert found[64] == found[2] == found[0] and found[64]["a", 8] == (None, "v1v2v3v4v5v6v7v8", False) and found[64]["b", 2] == (9, "xy", False) and found[64]["c", 3][2]
