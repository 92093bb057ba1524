"""The evidence of requests under a declared contract: who was called, what completed, which replica admitted it.

A contract names, per operation, the entry service, the pairs that have to complete, the calls that may be ignored
for a pair and the deadline; and, for the application, the target service, its replicas and its databases. It has the
size of a declaration, so it goes into expressions; requests and spans are joined and grouped by trace.

A request whose spans contradict the contract is refused with the first reason that applies, and then certifies
nothing. What was not observed stays null: no rule takes the absence of an error for success, nor a receiver that
was not seen for one that cannot receive.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.lineage import settle
from lodestar.operators.requests import ancestor_any, client_destination, database_endpoint, is_client, protocol_status, replica_identity

Pair = tuple[str, str]

#: Distinct required pairs of an operation, databases included; a contract is a declaration, not data.
MOST_PAIRS = 10_000
#: Spans of the largest trace whose parents are looked up in a list of its ids; a span looks at the list once for each span above it.
SMALL = 64
#: The codes of a declared retry, the first attempt's and the second's.
RETRY_FIRST, RETRY_FINAL, RETRY_METHOD = 503, 201, "POST"
SERVER_KINDS = ("2", "server", "span_kind_server")


@dataclass(frozen=True)
class Operation:
    """What one operation requires; ``required`` gives each pair its least number of calls."""

    entry: str
    deadline_ns: int
    required: dict[Pair, int]
    roots: int = 1
    target_calls: int = 0
    ignored: dict[Pair, tuple[str, ...]] = field(default_factory=dict)
    propagates: bool = False
    retried: tuple[Pair, ...] = ()


@dataclass(frozen=True)
class Contract:
    """``replicas`` gives each replica its declared host name, ``peers`` are (owner, system, address, port, database)."""

    target: str
    replicas: dict[str, str]
    routes: tuple[str, ...]
    operations: dict[str, Operation]
    label: str = "study.replica"
    peers: tuple[tuple[str, str, str, str, str], ...] = ()
    unlabelled_entries: tuple[str, ...] = ()


def _lookup(table: dict[str, object], kind: str, key: Column) -> Column:
    """The entry of ``key`` in a small table of literals, else null."""
    if not table:
        return F.lit(None).cast(kind)
    value = lambda v: F.array(*map(F.lit, v)).cast(kind) if isinstance(v, (tuple, list)) else F.lit(v).cast(kind)
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), value(v))])[key]


def _named(*parts: Column | str) -> Column:
    return F.concat_ws("\x1f", *parts)


def _ignored(contract: Contract, source: Column, target: Column) -> Column:
    """Whether the span is one of the calls that its operation ignores between the two."""
    table = {"\x1f".join((o, *pair)): names for o, spec in contract.operations.items() for pair, names in spec.ignored.items()}
    suffixes = F.coalesce(_lookup(table, "array<string>", _named("operation", source, target)), F.array().cast("array<string>"))
    names = F.array(F.col("name"), F.coalesce(F.col("attributes")["rpc.method"], F.lit("")))
    hit = F.exists(suffixes, lambda x: F.exists(names, lambda n: (n == x) | F.endswith(n, F.concat(F.lit("/"), x)) | F.endswith(n, F.concat(F.lit("."), x))))
    return F.coalesce(hit, F.lit(False))


def _database(contract: Contract) -> tuple[Column, Column]:
    """(node, whether it is a database call that names no single peer) of a client span."""
    a = F.col("attributes")
    seen = [F.coalesce(*[a[k] for k in keys]) for keys in (("db.system.name", "db.system"), ("server.address", "net.peer.name"), ("server.port", "net.peer.port"), ("db.namespace", "db.name"))]
    calls = is_client(F.col("kind")) & F.coalesce(seen[0] != "", F.lit(False))
    whole = database_endpoint(a)
    nodes = []
    for owner, *declared in contract.peers:
        fits = reduce(lambda x, y: x & y, [F.coalesce(s == d, F.lit(True)) for s, d in zip(seen, declared)])
        nodes.append(F.when((F.col("service") == owner) & fits, F.lit("{}://{}:{}/{}".format(*declared))))
    found = F.array_distinct(F.array_compact(F.array(*nodes))) if nodes else F.array().cast("array<string>")
    node = F.coalesce(whole, F.when(F.size(found) == 1, F.get(found, F.lit(0))))
    return F.when(calls, node), calls & node.isNull()


def linked_spans(requests: DataFrame, spans: DataFrame, contract: Contract) -> DataFrame:
    """Spans of the requests with their parent's service and status, and what the contract says of each.

    ``requests`` has (trace_id, operation, boundary, start_ns, end_ns), where ``boundary`` is the caller's own span or
    null; ``spans`` (trace_id, span_id, parent_id, service, name, kind, start_ns, end_ns, attributes, resource, error).

    Spans are dealt out by trace once: within a task, windows gather the ids of each trace of up to SMALL spans, and
    every span looks its parent and the ways above it up in them. Larger traces are linked by joins.
    """
    asked = requests.filter(F.col("operation").isin(*contract.operations)).select("trace_id", "operation", "boundary")
    own = spans.withColumn("status", protocol_status(F.col("attributes"), F.col("error"))).join(asked, "trace_id").filter("span_id IS NOT NULL").repartition("trace_id")
    same, trace = Window.partitionBy("trace_id", "span_id"), Window.partitionBy("trace_id")
    own = own.withColumns({"_p": F.min(F.struct("service", "status")).over(same), "repeated": F.count("*").over(same) > 1}).withColumn("_size", F.count("*").over(trace))
    small = F.col("_size") <= SMALL
    own = own.withColumn("_ids", F.collect_list(F.when(small, F.struct("span_id", "_p"))).over(trace))
    parent = F.get(F.col("_ids._p"), (F.array_position(F.col("_ids.span_id"), F.col("parent_id")) - 1).cast("int"))
    rows = _judged(own.withColumn("_up", parent).withColumns({"parent_service": F.col("_up.service"), "parent_status": F.col("_up.status")}), contract)
    rows = rows.withColumn("_tree", F.collect_list(F.when(small & ~F.col("repeated"), F.struct("span_id", "parent_id", "_optional"))).over(trace))

    def higher(at, _):
        i = (F.array_position(F.col("_tree.span_id"), at["up"]) - 1).cast("int")
        return F.struct(F.get(F.col("_tree.parent_id"), i).alias("up"), (at["optional"] | F.coalesce(F.get(F.col("_tree._optional"), i), F.lit(False))).alias("optional"))

    way = F.aggregate(F.sequence(F.lit(1), F.size("_tree")), F.struct(F.col("parent_id").alias("up"), F.col("_optional").alias("optional")), higher)
    rows = rows.withColumn("_way", F.when(small & ~F.col("repeated"), way))
    rows = rows.withColumns({"optional": F.coalesce("_way.optional", F.lit(False)), "cyclic": F.coalesce(F.col("_way.up").isNotNull(), F.lit(False)) & F.col("_way").isNotNull(), "_large": ~small})
    rows = settle(rows.drop("_p", "_size", "_ids", "_up", "_optional", "_tree", "_way"))
    if not rows.filter("_large").head(1):
        return rows.drop("_large")
    large = _linked_by_joins(rows.filter("_large").drop("_large", "repeated", "parent_service", "parent_status", *_JUDGED, "optional", "cyclic"), contract)
    return rows.filter("NOT _large").drop("_large").unionByName(large)


_JUDGED = ["root", "across", "unexplained", "database", "nameless", "destination"]


def _judged(rows: DataFrame, contract: Contract) -> DataFrame:
    """``rows`` with what the contract says of each span that knows its parent's service."""
    root = F.col("parent_id").eqNullSafe(F.col("boundary"))
    across = F.col("parent_service").isNotNull() & (F.col("parent_service") != F.col("service"))
    node, nameless = _database(contract)
    return rows.select(
        "*", root.alias("root"), across.alias("across"), (~root & F.col("parent_service").isNull()).alias("unexplained"), (across & _ignored(contract, F.col("parent_service"), F.col("service"))).alias("_optional"),
        node.alias("database"), nameless.alias("nameless"), client_destination(F.col("kind"), F.col("attributes"), list(contract.routes)).alias("destination"))


def _linked_by_joins(own: DataFrame, contract: Contract) -> DataFrame:
    """Spans of large traces with their parents by joins and the ways above them by pointer doubling."""
    up = own.groupBy(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s")).agg(F.min(F.struct("service", "status")).alias("_p"), F.count("*").alias("_n"))
    rows = own.join(up.select("_t", "_s", F.col("_p.service").alias("parent_service"), F.col("_p.status").alias("parent_status")), (F.col("trace_id") == F.col("_t")) & (F.col("parent_id") == F.col("_s")), "left").drop("_t", "_s")
    repeats = up.select("_t", "_s", "_n")
    rows = rows.join(repeats, (F.col("trace_id") == F.col("_t")) & (F.col("span_id") == F.col("_s"))).drop("_t", "_s").withColumn("repeated", F.col("_n") > 1).drop("_n")
    rows = settle(_judged(rows, contract))
    once = rows.filter("NOT repeated").select("trace_id", "span_id", "parent_id", F.col("_optional").alias("optional"))
    return settle(rows.drop("_optional").join(ancestor_any(once, "optional", "cyclic"), ["trace_id", "span_id"], "left").fillna(False, ["optional", "cyclic"]))


def _receives(contract: Contract) -> tuple[Column, Column]:
    """(whether a span is a call into the target, whether that call is an entry by its kind or its declared name)."""
    into = F.col("across") & (F.col("service") == contract.target) & ~F.col("optional")
    unlabelled = (F.coalesce("kind", F.lit("")) == "") & F.col("name").isin(*contract.unlabelled_entries) if contract.unlabelled_entries else F.lit(False)
    return into, F.lower("kind").isin(*SERVER_KINDS) | unlabelled


def request_facts(requests: DataFrame, linked: DataFrame, contract: Contract) -> DataFrame:
    """Per request: spans, roots, their status, timeliness, demand of each replica, and why the request is refused.

    A demand is true if an entry names the replica, and false only if all declared calls were seen and each names one.
    """
    operation = lambda field_, kind: _lookup({o: getattr(s, field_) for o, s in contract.operations.items()}, kind, F.col("operation"))
    into, entry = _receives(contract)
    named = replica_identity(F.col("resource"), contract.label, contract.replicas)["replica"]
    rows = linked.select("*", (into & entry).alias("_entry"), (into & ~F.coalesce(entry, F.lit(False))).alias("_other")).withColumn("_replica", F.when(F.col("_entry"), named))
    counts = rows.groupBy("trace_id").agg(
        F.count("*").alias("native_spans"), F.count_if("root").alias("native_roots"), F.count_if(F.col("root") & ~F.col("status")).alias("_failed"), F.count_if(F.col("root") & F.col("status")).alias("_good"),
        F.count_if("repeated").alias("_repeated"), F.count_if("cyclic").alias("_cyclic"), F.count_if("unexplained").alias("_unexplained"), F.count_if(F.col("root") & (F.col("service") != operation("entry", "string"))).alias("_elsewhere"),
        F.count_if((F.col("end_ns") <= F.col("start_ns")) | (F.col("start_ns") < 0)).alias("_untimed"), F.count_if("nameless").alias("_nameless"),
        F.count_if("_entry").alias("_entries"), F.count("_replica").alias("_placed"), F.count_if("_other").alias("_others"), *[F.count_if(F.col("_replica") == r).alias(f"_at_{r}") for r in contract.replicas])
    asked = requests.filter(F.col("operation").isin(*contract.operations))
    facts = asked.join(counts, "trace_id", "left").fillna(0, subset=[c for c in counts.columns if c != "trace_id"])
    refusal = F.when(F.col("_repeated") > 0, "repeated_span").when(F.col("_unexplained") > 0, "unexplained_parent").when(F.col("_cyclic") > 0, "cyclic_parents").when(F.col("_elsewhere") > 0, "unexpected_entry").when(F.col("_untimed") > 0, "untimed_span").when(
        F.col("_nameless") > 0, "ambiguous_database").when(F.col("end_ns") < F.col("start_ns"), "negative_duration")
    stands = refusal.isNull()
    whole = (F.col("_good") == F.col("native_roots")) & (F.col("native_roots") == operation("roots", "long")) & (F.col("native_roots") > 0)
    status = F.when(~stands, F.lit(None).cast("boolean")).when(F.col("_failed") > 0, False).when(whole, True)
    complete = (F.col("_entries") == operation("target_calls", "long")) & (F.col("_placed") == F.col("_entries")) & (F.col("_others") == 0)
    demands = [F.when(stands, F.when(F.col(f"_at_{r}") > 0, True).when(complete, False)).alias(f"demand_{r}") for r in contract.replicas]
    return facts.select("trace_id", "operation", "start_ns", "end_ns", "native_spans", "native_roots", refusal.alias("refusal"), status.alias("root_status"),
                        F.when(stands, F.col("end_ns") - F.col("start_ns") <= operation("deadline_ns", "long")).alias("timely"), *demands)


def calls(linked: DataFrame, contract: Contract) -> DataFrame:
    """Calls between services and into databases: (trace_id, operation, source, target, span_id, status, own_status, counts).

    A call counts if it is not optional and not one that its own pair ignores. Its status is false if the span or its
    parent fails, true if one of them succeeds; a database call has no parent to ask.
    """
    both = F.when(~F.col("status") | ~F.col("parent_status"), False).when(F.col("status") | F.col("parent_status"), True)
    ids = ["trace_id", "operation"]
    services = linked.filter("across").select(*ids, F.col("parent_service").alias("source"), F.col("service").alias("target"), "span_id", "parent_id", both.alias("status"), F.col("status").alias("own_status"), (~F.col("optional")).alias("counts"))
    stored = linked.filter("database IS NOT NULL")
    databases = stored.select(*ids, F.col("service").alias("source"), F.col("database").alias("target"), "span_id", "parent_id", "status", F.col("status").alias("own_status"), (~F.col("optional") & ~_ignored(contract, F.col("service"), F.col("database"))).alias("counts"))
    return services.unionByName(databases)


def client_failures(linked: DataFrame) -> DataFrame:
    """(trace_id, source, target) of failed client spans towards a declared name; optional ones do not count."""
    return linked.filter("destination IS NOT NULL AND status = false AND NOT optional").select("trace_id", F.col("service").alias("source"), F.col("destination").alias("target")).distinct()


def required_pairs(found: DataFrame, contract: Contract) -> dict[str, dict[Pair, int]]:
    """Pairs that each operation has to complete: the declared ones, and the databases that its services call."""
    out = {o: dict(s.required) for o, s in contract.operations.items()}
    for r in found.filter(F.col("counts") & F.contains("target", F.lit("://"))).select("operation", "source", "target").distinct().limit(MOST_PAIRS + 1).collect():
        spec = contract.operations[r["operation"]]
        if r["source"] in {spec.entry, *(s for pair in spec.required for s in pair)}:
            out[r["operation"]].setdefault((r["source"], r["target"]), 1)
    if sum(map(len, out.values())) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} required pairs: no contract of an application")
    return out


def completions(facts: DataFrame, found: DataFrame, failures: DataFrame, contract: Contract, required: dict[str, dict[Pair, int]]) -> DataFrame:
    """(trace_id, operation, source, target, value, reason) of every required pair of each request, by ordered rules."""
    listed = {o: [F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(n).alias("minimum"), F.lit(contract.operations[o].propagates).alias("propagates")) for (s, t), n in sorted(pairs.items())] for o, pairs in required.items() if pairs}
    if not listed:
        return facts.select("trace_id", "operation", *[F.lit(None).cast("string").alias(c) for c in ("source", "target")], F.lit(None).cast("boolean").alias("value"), F.lit("").alias("reason")).limit(0)
    pairs = None
    for o, items in listed.items():
        pairs = F.when(F.col("operation") == o, F.array(*items)) if pairs is None else pairs.when(F.col("operation") == o, F.array(*items))
    wanted = facts.select("trace_id", "operation", "root_status", "refusal", F.explode(pairs).alias("p")).select("trace_id", "operation", "root_status", "refusal", "p.*")
    seen = found.filter("counts").groupBy("trace_id", "source", "target").agg(F.count("*").alias("n"), F.count_if(~F.col("status")).alias("failed"), F.count_if("status").alias("good"))
    failed = failures.select("trace_id", "source", "target", F.lit(True).alias("client_failed"))
    rows = wanted.join(seen, ["trace_id", "source", "target"], "left").join(failed, ["trace_id", "source", "target"], "left")
    rules = [("refused", F.col("refusal").isNotNull(), None), ("explicit_client_failure", F.col("client_failed"), False), ("explicit_call_failure", F.col("failed") > 0, False),
             ("group_not_fully_observed", F.coalesce("n", F.lit(0)) < F.col("minimum"), None), ("explicit_protocol_success", (F.col("n") > 0) & (F.col("good") == F.col("n")), True),
             ("propagated_root_success", F.col("root_status") & F.col("propagates"), True)]
    value, reason = F.when(F.lit(False), F.lit(None).cast("boolean")), F.when(F.lit(False), F.lit(""))
    for name, holds, result in rules:
        value, reason = value.when(holds, F.lit(result).cast("boolean")), reason.when(holds, F.lit(name))
    return rows.select("trace_id", "operation", "source", "target", value.alias("value"), reason.otherwise("no_certificate").alias("reason"))


def logical_completions(facts: DataFrame, linked: DataFrame, found: DataFrame, failures: DataFrame, contract: Contract, required: dict[str, dict[Pair, int]]) -> DataFrame:
    """``completions`` that know of one declared retry: a POST that got 503, then one that got 201.

    The first failure is forgiven only if there are just these two attempts of one parent, in order and without
    overlap, no receiver was reached by the first, and one receiver under the second succeeded. A retry that was
    not seen whole leaves the pair unknown. Other failures keep their meaning.
    """
    plain = completions(facts, found, failures, contract, required)
    retried = [(o, *pair) for o, s in contract.operations.items() for pair in s.retried]
    if not retried:
        return plain
    scope = reduce(lambda a, b: a | b, [(F.col("operation") == o) & (F.col("source") == s) & (F.col("target") == t) for o, s, t in retried])
    plain = settle(plain)
    open_ = plain.filter(scope & (F.col("reason") == "explicit_client_failure")).select("trace_id", "source", "target")
    code = F.coalesce(F.col("attributes")["http.response.status_code"], F.col("attributes")["http.status_code"])
    code = F.when(code.rlike("^[0-9]+$"), code.try_cast("int"))
    attempts = linked.filter("destination IS NOT NULL").select("trace_id", F.col("service").alias("source"), F.col("destination").alias("target"), "span_id", "parent_id", "start_ns", "end_ns", "status", code.alias("code"), (F.col("name") == RETRY_METHOD).alias("post"))
    attempts = settle(attempts.join(open_, ["trace_id", "source", "target"], "left_semi"))
    key = ["trace_id", "source", "target"]
    placed = attempts.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("start_ns", "span_id")))
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    facts_of = placed.groupBy(*key).agg(
        F.count("*").alias("attempts"), F.count_if((F.col("code") == RETRY_FIRST) & F.col("post")).alias("retryable"), F.count_if("post").alias("posts"),
        *[at(k, c).alias(f"{c}{k}") for k in (1, 2) for c in ("code", "parent_id", "span_id", "start_ns", "end_ns", "status")])
    # Which receivers stand below the first and the second attempt: the attempts' marks go down the whole trace.
    traces = attempts.select("trace_id").distinct()
    marks = placed.filter("k <= 2").groupBy("trace_id", "span_id").agg(F.max(F.when(F.col("k") == 1, True)).alias("first"), F.max(F.when(F.col("k") == 2, True)).alias("second"))
    tree = settle(linked.filter("NOT repeated").select("trace_id", "span_id", "parent_id").join(traces, "trace_id", "left_semi").join(marks, ["trace_id", "span_id"], "left"))
    below = ancestor_any(tree.drop("second"), "first", "_c").drop("_c").join(ancestor_any(tree.drop("first"), "second", "_c").drop("_c"), ["trace_id", "span_id"])
    receivers = found.filter(F.col("counts") & ~F.contains("target", F.lit("://"))).join(open_, key, "left_semi").join(below, ["trace_id", "span_id"])
    reached = receivers.groupBy(*key).agg(F.count_if("first").alias("early"), F.count_if(F.col("second") & F.col("own_status")).alias("final"), F.count("*").alias("n"), F.count_if(~F.col("status")).alias("failed"), F.count_if("status").alias("good"))
    rows = plain.join(facts_of, key, "left").join(reached, key, "left").join(facts.select("trace_id", "root_status"), "trace_id", "left")
    minimum = _lookup({"\x1f".join((o, s, t)): required[o].get((s, t), 1) for o, s, t in retried}, "long", _named("operation", "source", "target"))
    propagates = _lookup({o: s.propagates for o, s in contract.operations.items()}, "boolean", F.col("operation"))
    certified = (F.col("failed") == 0) & (F.col("n") >= minimum) & ((F.col("good") == F.col("n")) | (F.col("root_status") & propagates))
    ordered = (F.col("posts") == 2) & F.col("parent_id1").eqNullSafe(F.col("parent_id2")) & (F.col("end_ns1") <= F.col("start_ns2")) & F.coalesce("status2", F.lit(False))
    whole = (F.col("attempts") == 2) & F.col("code1").eqNullSafe(F.lit(RETRY_FIRST)) & F.col("code2").eqNullSafe(F.lit(RETRY_FINAL))
    rules = [("retry_not_fully_observed", ~whole),
             ("retry_order_not_verified", ~ordered), ("earlier_receiver_effect", F.coalesce("early", F.lit(0)) > 0), ("final_receiver_not_unique", F.coalesce("final", F.lit(0)) != 1), ("final_completion_not_verified", ~F.coalesce(certified, F.lit(False)))]
    reason = None
    for name, holds in rules:
        reason = F.when(holds, name) if reason is None else reason.when(holds, name)
    reason = reason.otherwise("retried_once")
    asked = F.coalesce("retryable", F.lit(0)) > 0
    return rows.select("trace_id", "operation", "source", "target", F.when(~asked, F.col("value")).when(reason == "retried_once", True).alias("value"), F.when(asked, reason).otherwise(F.col("reason")).alias("reason"))


def admissions(facts: DataFrame, linked: DataFrame, contract: Contract) -> DataFrame:
    """(trace_id, admitted_<replica>...): true where an entry of the replica began inside the request's window, else null.

    Entries are calls into the target from another service that are not optional. Nothing is ever false.
    """
    into, entry = _receives(contract)
    named = replica_identity(F.col("resource"), contract.label, contract.replicas)["replica"]
    receivers = linked.filter(into & entry).select("trace_id", named.alias("replica"), F.col("start_ns").alias("began")).filter("replica IS NOT NULL")
    deadline = _lookup({o: s.deadline_ns for o, s in contract.operations.items()}, "long", F.col("operation"))
    window = facts.select("trace_id", F.col("start_ns").alias("opens"), F.least("end_ns", F.col("start_ns") + deadline).alias("closes"), "refusal")
    inside = F.col("began").between(F.col("opens"), F.col("closes")) & F.col("refusal").isNull()
    return window.join(receivers, "trace_id", "left").groupBy("trace_id").agg(*[F.max(F.when(inside & (F.col("replica") == r), True)).alias(f"admitted_{r}") for r in contract.replicas])


def observed_law(requests: DataFrame, spans: DataFrame, contract: Contract) -> DataFrame:
    """One row a request with all its signals: entry_completed, timely, completed, demand_ and admitted_ of each replica, refusal.

    ``completed`` is the conjunction over the required pairs: false if one is, null if one is unknown or none is required.
    """
    linked = linked_spans(requests, spans, contract)
    facts = settle(request_facts(requests, linked, contract))
    found = settle(calls(linked, contract))
    done = logical_completions(facts, linked, found, client_failures(linked), contract, required_pairs(found, contract))
    every = F.when(F.count_if(~F.col("value")) > 0, False).when(F.count("value") == F.count("*"), True)
    completed = done.groupBy("trace_id").agg(every.alias("completed"))
    names = [f"{kind}_{r}" for kind in ("demand", "admitted") for r in contract.replicas]
    return facts.join(completed, "trace_id", "left").join(admissions(facts, linked, contract), "trace_id", "left").select("trace_id", "operation", "refusal", F.col("root_status").alias("entry_completed"), "timely", "completed", *names)
