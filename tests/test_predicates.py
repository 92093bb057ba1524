"""Graph predicates in all states and over all completions, against a plain traversal."""

import itertools

import pytest
from pyspark.sql import functions as F

from lodestar.operators import law, predicates

GRAPH = predicates.ServiceGraph(
    entry="gate", required=("shop", "stock"), replicas={"gate": (("g",),), "shop": (("a",), ("b", "c")), "stock": ((),), "mail": (("m",),)},
    edges=(predicates.Edge("gate", "shop", ("x",)), predicates.Edge("shop", "stock"), predicates.Edge("gate", "mail", (), False), predicates.Edge("stock", "gate")))
DEMANDS = (predicates.Demand("shop", ("da", "db")),)


def reach(graph, state):
    live = {s for s, replicas in graph.replicas.items() if any(all(state[g] for g in gates) for gates in replicas)}
    if graph.entry not in live:
        return False
    seen, open_ = {graph.entry}, [graph.entry]
    while open_:
        at = open_.pop()
        for e in graph.edges:
            if e.synchronous and e.source == at and e.target in live and e.target not in seen and all(state[f] for f in e.factors):
                seen.add(e.target)
                open_.append(e.target)
    return set(graph.required) <= seen


def plain(graph, demands, state, done, soon):
    base = reach(graph, state)
    selected = base and all(any(state[s] for s in d.signals) and all(not state[s] or all(state[g] for g in gates) for s, gates in zip(d.signals, graph.replicas[d.service])) for d in demands)
    out = {"reachability": base, "selected": selected, "without_deadline": selected and done, "execution": selected and done and soon, "without_selection": base and done and soon, "without_completion": selected and soon}
    return out | {f"{n}_minus_execution": int(v) - int(out["execution"]) for n, v in out.items() if n != "execution"}


def test_reachability_in_every_state(spark):
    names = GRAPH.gates()
    assert names == ["a", "b", "c", "g", "m", "x"]
    rows = law.state_table(spark, names).withColumn("holds", predicates.reachability(GRAPH, {n: F.col(n) for n in names})).collect()
    assert len(rows) == 64 and all(r["holds"] == reach(GRAPH, r.asDict()) for r in rows)


def test_a_long_line_of_services(spark):
    names = [f"s{i:02d}" for i in range(40)]
    graph = predicates.ServiceGraph(names[0], (names[-1],), {n: (("up",),) if n == names[20] else ((),) for n in names}, tuple(predicates.Edge(a, b) for a, b in zip(names, names[1:])))
    rows = spark.createDataFrame([(True,), (False,)], "up boolean").withColumn("holds", predicates.reachability(graph, {"up": F.col("up")})).collect()
    assert [r["holds"] for r in rows] == [True, False]


def test_bounds_against_enumeration(spark):
    """Every predicate and gap of some three-valued vectors, against all completions of all signals, edge completions too."""
    values, signals = (None, True, False), ["a", "b", "c", "g", "x", "da", "db", "soon", "e1", "e2"]
    rows = [tuple(values[(k * (i + 3) + k * k // (i + 1)) % 3] for i in range(len(signals))) for k in range(40)]
    frame = spark.createDataFrame([("k", *r, True) for r in rows], "k string, " + ", ".join(f"{s} boolean" for s in signals) + ", m boolean")
    got = predicates.predicate_bounds(frame, ["k"], GRAPH, DEMANDS, ["e1", "e2"], "soon").first()
    total = {}
    for r in rows:
        found = []
        for bits in itertools.product(*[(True, False) if v is None else (v,) for v in r]):
            s = dict(zip(signals, bits)) | {"m": True}
            found.append(plain(GRAPH, DEMANDS, s, s["e1"] and s["e2"], s["soon"]))
        for n in found[0]:
            low, high = total.get(n, (0, 0))
            total[n] = (low + min(int(f[n]) for f in found), high + max(int(f[n]) for f in found))
    assert got["n"] == len(rows)
    assert {n: (got[f"{n}_lower"], got[f"{n}_upper"]) for n in total} == total


def test_independent_primitives(spark):
    rates = {"a": (7, 10), "b": (4, 10), "c": None, "g": (9, 10), "m": None, "x": (5, 10)}
    rows = [("one", n, *(v or (0, 0))) for n, v in rates.items()] + [("two", n, 1, 2) for n in rates]
    got = {r["k"]: r for r in predicates.independent_probability(spark.createDataFrame(rows, "k string, primitive string, successes long, observed long"), ["k"], GRAPH).collect()}

    def probability(p):
        total = 0.0
        for bits in itertools.product((True, False), repeat=6):
            s = dict(zip(rates, bits))
            if reach(GRAPH, s):
                w = 1.0
                for n, b in s.items():
                    w *= p[n] if b else 1 - p[n]
                total += w
        return total

    ends = [probability({n: v[0] / v[1] if v else end for n, v in rates.items()}) for end in (0.0, 1.0)]
    one, two = got["one"], got["two"]
    assert (one["status"], one["prediction"], one["missing"], one["essential"]) == ("insufficient_observations", None, ["c"], ["a", "b", "c", "g", "x"])
    assert [one["lower"], one["upper"]] == pytest.approx(ends)
    assert two["status"] == "estimated" and two["prediction"] == pytest.approx(probability(dict.fromkeys(rates, 0.5))) == pytest.approx(two["upper"])


def test_graphs_are_checked():
    with pytest.raises(ValueError):
        predicates.ServiceGraph("x", ("x",), {"y": ((),)}, ())
    with pytest.raises(ValueError):
        predicates.ServiceGraph("x", ("x",), {"x": ((),)}, (predicates.Edge("x", "z"),))
    with pytest.raises(ValueError):
        predicates.ServiceGraph("x", (), {"x": ((),)}, ())
    with pytest.raises(ValueError):
        predicates.state_predicates(GRAPH, (predicates.Demand("shop", ("da",)),), "e", "t")
