"""A service graph evaluated in states of its primitives: reachability, the six predicates of a request, probabilities.

A graph is a declaration: services with replicas, synchronous and asynchronous edges, each behind gates that are
Boolean columns. Reachability is one expression whose size is that of the graph: the set of reached services is a
number with a bit a service, and a fold takes as many steps as there are services. So a predicate can be evaluated on
any table that has the gates as columns, as on all completions of three-valued vectors or on all states.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.expr import kleene_and
from lodestar.operators import law

MOST_SERVICES, MOST_PRIMITIVES = 62, 16


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    factors: tuple[str, ...] = ()
    synchronous: bool = True


@dataclass(frozen=True)
class ServiceGraph:
    """``replicas`` gives each service its replicas, each a list of gates; a replica without gates is always up."""

    entry: str
    required: tuple[str, ...]
    replicas: dict[str, tuple[tuple[str, ...], ...]]
    edges: tuple[Edge, ...]

    def __post_init__(self):
        names = set(self.replicas)
        if not names or len(names) > MOST_SERVICES:
            raise ValueError(f"1 to {MOST_SERVICES} services")
        if self.entry not in names or not self.required or not set(self.required) <= names or any(not r for r in self.replicas.values()):
            raise ValueError("an entry and required services among the services, each with a replica")
        if any({e.source, e.target} - names for e in self.edges):
            raise ValueError("an edge to an unknown service")

    def gates(self) -> list[str]:
        found = {g for replicas in self.replicas.values() for gates in replicas for g in gates} | {f for e in self.edges if e.synchronous for f in e.factors}
        return sorted(found)


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def reachability(graph: ServiceGraph, state: dict[str, Column]) -> Column:
    """Whether all required services are reached from the entry over live services and open synchronous edges."""
    bit = {s: 1 << i for i, s in enumerate(sorted(graph.replicas))}
    live = {s: _any([kleene_and(*[state[g] for g in gates]) for gates in replicas]) for s, replicas in graph.replicas.items()}
    edges = [e for e in graph.edges if e.synchronous]
    # The fold carries which edges are open, so that each is worked out once.
    open_ = F.array(*[live[e.target] & kleene_and(*[state[f] for f in e.factors]) for e in edges]) if edges else F.array().cast("array<boolean>")
    start = F.struct(F.when(live[graph.entry], F.lit(bit[graph.entry])).otherwise(F.lit(0)).cast("long").alias("m"), open_.alias("open"))

    def step(acc: Column, _: Column) -> Column:
        found = acc["m"]
        for i, e in enumerate(edges):
            found = found.bitwiseOR(F.when((acc["m"].bitwiseAND(F.lit(bit[e.source]).cast("long")) != 0) & F.get(acc["open"], F.lit(i)), F.lit(bit[e.target]).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.struct(found.alias("m"), acc["open"].alias("open"))

    want = F.lit(sum(bit[s] for s in set(graph.required))).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(graph.replicas) - 1))), start, step, lambda acc: acc["m"].bitwiseAND(want) == want)


@dataclass(frozen=True)
class Demand:
    """``signals`` says for each replica of the service whether the request needed it."""

    service: str
    signals: tuple[str, ...]


def state_predicates(graph: ServiceGraph, demands: tuple[Demand, ...], completed: str, timely: str) -> tuple[list[str], dict]:
    """(signals, predicates): functions of complete states for ``law.sharp_bounds``, and the gaps of each to execution.

    Selected means that every demanded replica was open and one was demanded; execution adds completion and deadline.
    """
    for d in demands:
        if len(d.signals) != len(graph.replicas[d.service]):
            raise ValueError("a demand signal for each replica")
    signals = list(dict.fromkeys([*graph.gates(), *[s for d in demands for s in d.signals], completed, timely]))

    def all_of(*columns: Column) -> dict[str, Column]:
        state = dict(zip(signals, columns))
        base = reachability(graph, state)
        chosen = [_any([state[s] for s in d.signals]) & kleene_and(*[~state[s] | kleene_and(*[state[g] for g in gates]) for s, gates in zip(d.signals, graph.replicas[d.service])]) for d in demands]
        selected, done, soon = kleene_and(base, *chosen), state[completed], state[timely]
        return {"reachability": base, "selected": selected, "without_deadline": selected & done, "execution": selected & done & soon, "without_selection": base & done & soon, "without_completion": selected & soon}

    names = ["reachability", "selected", "without_deadline", "execution", "without_selection", "without_completion"]
    found = {n: (lambda *c, n=n: all_of(*c)[n]) for n in names}
    gaps = {f"{n}_minus_execution": (lambda *c, n=n: all_of(*c)[n].cast("int") - all_of(*c)["execution"].cast("int")) for n in names if n != "execution"}
    return signals, found | gaps


def predicate_bounds(rows: DataFrame, keys: list[str], graph: ServiceGraph, demands: tuple[Demand, ...], completions: list[str], timely: str) -> DataFrame:
    """Sharp bounds on the number of requests with each predicate, and on the gaps, over what was not observed.

    With all else fixed a predicate depends on the completions through their conjunction alone, so that is one signal.
    """
    signals, targets = state_predicates(graph, demands, "_completed", timely)
    joint = law.category_law(rows.withColumn("_completed", kleene_and(*[F.col(c) for c in completions])), keys, signals)
    return law.sharp_bounds(joint, keys, signals, targets)


def independent_probability(estimates: DataFrame, keys: list[str], graph: ServiceGraph) -> DataFrame:
    """(keys, status, prediction, lower, upper, essential, missing): probability that all required services are reached.

    ``estimates`` has (keys, primitive, successes, observed) with independent primitives; one that was never observed
    is set to 0 for the lower and to 1 for the upper end, which are the ends as reachability only grows. A primitive is
    essential if it decides in some state; without an estimate of an essential one there is no prediction.
    """
    names = graph.gates()
    if not names or len(names) > MOST_PRIMITIVES:
        raise ValueError(f"1 to {MOST_PRIMITIVES} primitives")
    rates = estimates.groupBy(*keys).agg(*[F.max(F.when((F.col("primitive") == n) & (F.col("observed") > 0), F.col("successes") / F.nullif("observed", F.lit(0)))).alias(n) for n in names])
    states = law.state_table(estimates.sparkSession, names).withColumn("holds", reachability(graph, {n: F.col(n) for n in names}))
    # The states depend on the graph alone, 2^16 at most: which hold, and which primitives decide, are worked out once.
    flips = [(F.sum(F.when(F.col("holds"), F.when(F.col(n), 1).otherwise(-1)).otherwise(0)) != 0).alias(n) for n in names]
    decides = states.agg(*flips).first().asDict()
    essential = [n for n in names if decides[n]]
    holding = {r["id"] for r in states.filter("holds").select("id").collect()}
    total = lambda missing: _summed(F.array(*[F.coalesce(F.col(n), F.lit(missing)) for n in names]), [float(s in holding) for s in range(1 << len(names))])
    absent = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in essential])) if essential else F.array().cast("array<string>")
    rows = rates.withColumn("missing", absent).withColumn("lower", total(0.0)).withColumn("upper", total(1.0))
    status = F.when(F.size("missing") > 0, "insufficient_observations").otherwise("estimated")
    return rows.select(*keys, status.alias("status"), F.when(F.size("missing") == 0, F.col("lower")).alias("prediction"), "lower", "upper", F.array(*map(F.lit, essential)).cast("array<string>").alias("essential"), "missing")


def _summed(p: Column, table: list[float]) -> Column:
    """Sum of the table over all states, each weighted by its primitives' probabilities: one primitive a step halves the table."""

    def halve(acc: Column, i: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(acc), 1) - 1), lambda k: F.get(acc, 2 * k) * (1.0 - F.get(p, i)) + F.get(acc, 2 * k + 1) * F.get(p, i))

    return F.get(F.aggregate(F.sequence(F.lit(0), F.lit(len(table).bit_length() - 2)), F.array(*map(F.lit, table)), halve), F.lit(0))


def demand_bounds(rows: DataFrame, keys: list[str], graph: ServiceGraph, demands: tuple[Demand, ...], timely: str) -> DataFrame:
    """Sharp bounds on reachability, on the selected replicas and on these within the deadline, and on the gaps between them."""
    signals, found = state_predicates(graph, demands, "_whole", timely)
    signals = [s for s in signals if s != "_whole"]
    at = {"reachability": "reachability", "selected_replicas": "selected", "selected_replicas_and_deadline": "without_completion"}
    # Completion has no part in these, so it is taken as given.
    given = lambda name: lambda *c: found[name](*c[:-1], F.lit(True), c[-1])
    targets = {n: given(p) for n, p in at.items()}
    gap = lambda a, b: lambda *c: targets[a](*c).cast("int") - targets[b](*c).cast("int")
    gaps = {"reachability_minus_execution": gap("reachability", "selected_replicas_and_deadline"), "reachability_minus_selected": gap("reachability", "selected_replicas"), "selected_minus_execution": gap("selected_replicas", "selected_replicas_and_deadline")}
    return law.sharp_bounds(law.category_law(rows, keys, signals), keys, signals, targets | gaps)
