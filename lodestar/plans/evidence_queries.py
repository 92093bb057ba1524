"""Queries of the per-request evidence, from spans made of the tables and from trace files written of them.

Line items stand in for native spans: the first of an order is the external entry s0, even ones are clients of s0
or of the service before them, odd ones servers; spans 2 and 4 are attempts of the same parent. The return flag gives
the protocol code. Some spans name a parent that is not there, some call a database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.expr import micros
from lodestar.functions.lineage import settle, shared_path
from lodestar.operators import binding, graph, law, requests
from lodestar.plans.catalogue import _table, query
from lodestar.sources import native

DAY_NS = 86_400_000_000_000
DEADLINE_NS = 60 * DAY_NS
NAMES = [f"s{i}" for i in range(5)]


def _contract() -> binding.Contract:
    one = lambda required, **more: binding.Operation("s0", DEADLINE_NS, required, ignored={("s0", "s1"): ("Health",), ("s0", "s2"): ("Health",)}, **more)
    return binding.Contract(
        target="s2", replicas={"a": "host-a", "b": "host-b"}, routes=tuple(NAMES), peers=(("s0", "pg", "db", "5432", "shop"),),
        operations={"1-URGENT": one({("s0", "s1"): 1}, target_calls=1, retried=(("s0", "s1"),)), "2-HIGH": one({("s0", "s1"): 1, ("s0", "s2"): 1}, target_calls=1, propagates=True),
                    "3-MEDIUM": one({("s0", "s2"): 2}, target_calls=2), "5-LOW": one({("s0", "s3"): 1})})


def _lines(spark, d) -> DataFrame:
    """Line items without repeats, dealt out by their trace."""
    order = ["l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    rows = _table(spark, d, "lineitem").select(_hex("l_orderkey", 32).alias("trace_id"), "l_linenumber", *order)
    return graph.keep_first(rows.repartition("trace_id"), ["trace_id", "l_linenumber"], order)


def _hex(column, width: int):
    return F.lower(F.lpad(F.hex(column), width, "0"))


def _spans(spark, d, more: bool = False) -> DataFrame:
    """Spans as the evidence reads them, ids in hexadecimal as trace files have them; ``more`` keeps what they are made of."""
    n, q, shift, start = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_suppkey") % 4 + 1, micros("l_shipdate") * 1000
    client = (n % 2) == 0
    parent = F.when((n > 1) & (F.col("l_discount") > 0.095) & (F.col("l_tax") > 0.075), 99).when(n == 4, 1).when(n > 1, n - 1)
    code = F.when(F.col("l_returnflag") == "A", F.when(n == 4, "201").otherwise("200")).when(F.col("l_returnflag") == "R", "503")
    database = client & (q > 44)
    listed = {"http.response.status_code": code, "server.address": F.when(database, F.when(q > 49, "elsewhere").otherwise("db")), "peer.service": F.when(client & ~database, F.concat(F.lit("s"), shift)),
              "db.system": F.when(database, "pg"), "server.port": F.when(database & (q < 48), "5432"), "db.name": F.when(database & (q < 48), "shop"), "error": F.when((q > 43) & ~client, "true")}
    resource = {"host.name": F.when(F.col("l_partkey") % 3 < 2, F.when(F.col("l_partkey") % 3 == 0, "host-a").otherwise("host-b")), "study.replica": F.when(F.col("l_tax") < 0.005, "zz")}
    known = lambda table: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*table.values())), lambda _, v: v.isNotNull())
    rows = _lines(spark, d).select(
        "trace_id", _hex(n, 16).alias("span_id"), _hex(parent, 16).alias("parent_id"), F.when((n == 1) | (n == 2) | (n == 4), "s0").otherwise(F.concat(F.lit("s"), shift)).alias("service"),
        F.when(client & n.isin(2, 4), "POST").when(q < 6, "svc/Health").otherwise("svc/Get").alias("name"), F.when(client, "3").otherwise("2").alias("kind"),
        start.alias("start_ns"), (start + q.cast("long") * 1_000_001).alias("end_ns"), known(listed).alias("attributes"), known(resource).alias("resource"),
        *([n.alias("n"), q.alias("q"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount")] if more else []))
    return rows.withColumn("error", F.coalesce(F.col("attributes")["error"] == "true", F.lit(False)))


_LINES = """lines AS (SELECT l_orderkey AS t, l_linenumber AS n, l_quantity AS q, l_suppkey % 4 + 1 AS shift, l_partkey % 3 AS host, l_discount AS discount, l_tax AS tax, l_returnflag AS flag, epoch_us(l_shipdate) * 1000 AS start_ns FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS k FROM lineitem) WHERE k = 1)"""
_TAGGED = f"""{_LINES}, spans AS (SELECT *, n % 2 = 0 AS client, CASE WHEN n > 1 AND discount > 0.095 AND tax > 0.075 THEN 99 WHEN n = 4 THEN 1 WHEN n > 1 THEN n - 1 END AS parent,
    CASE WHEN n IN (1, 2, 4) THEN 's0' ELSE 's' || shift END AS service, CASE WHEN n IN (2, 4) THEN 'POST' WHEN q < 6 THEN 'svc/Health' ELSE 'svc/Get' END AS name, start_ns + q::BIGINT * 1000001 AS end_ns,
    n % 2 = 0 AND q > 44 AS db, CASE WHEN n % 2 = 0 AND q <= 44 THEN 's' || shift END AS destination, CASE flag WHEN 'A' THEN CASE WHEN n = 4 THEN 201 ELSE 200 END WHEN 'R' THEN 503 END AS code,
    CASE WHEN (q > 43 AND n % 2 = 1) OR flag = 'R' THEN false WHEN flag = 'A' THEN true END AS status,
    CASE WHEN tax < 0.005 THEN NULL WHEN host = 0 THEN 'a' WHEN host = 1 THEN 'b' END AS replica FROM lines)"""
_SPANS = f"""{_TAGGED}, asked AS (SELECT o_orderkey AS t, o_orderpriority AS operation, epoch_us(o_orderdate) * 1000 AS opens, epoch_us(o_orderdate) * 1000 + (30 + o_custkey % 60) * {DAY_NS} AS done FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'),
  linked AS (SELECT c.*, operation, p.service AS up_service, p.status AS up_status, p.n AS up, coalesce(p.service <> c.service, false) AS across,
    coalesce(p.service <> c.service AND p.service = 's0' AND c.service IN ('s1', 's2') AND c.name = 'svc/Health', false) AS skips FROM spans c JOIN asked USING (t) LEFT JOIN spans p ON p.t = c.t AND p.n = c.parent),
  down AS (SELECT t, n, skips AS optional FROM linked WHERE up IS NULL UNION ALL SELECT l.t, l.n, d.optional OR l.skips FROM down d JOIN linked l ON l.t = d.t AND l.up = d.n),
  seen AS (SELECT l.*, d.optional FROM linked l JOIN down d USING (t, n)),
  facts AS (SELECT a.*, count(s.n) AS native_spans, count(*) FILTER (WHERE s.n IS NOT NULL AND parent IS NULL) AS native_roots, CASE WHEN count(*) FILTER (WHERE parent IS NOT NULL AND up IS NULL) > 0 THEN 'unexplained_parent'
    WHEN count(*) FILTER (WHERE parent IS NULL AND service <> 's0') > 0 THEN 'unexpected_entry' WHEN count(*) FILTER (WHERE db AND q > 47 AND (q > 49 OR service <> 's0')) > 0 THEN 'ambiguous_database' END AS refusal,
    CASE WHEN count(*) FILTER (WHERE parent IS NULL AND NOT status) > 0 THEN false WHEN count(*) FILTER (WHERE parent IS NULL AND status) = 1 AND count(*) FILTER (WHERE s.n IS NOT NULL AND parent IS NULL) = 1 THEN true END AS root_status0,
    count(*) FILTER (WHERE entry) AS entries, count(*) FILTER (WHERE entry AND replica IS NOT NULL) AS placed, count(*) FILTER (WHERE into_target AND NOT entry) AS others,
    count(*) FILTER (WHERE entry AND replica = 'a') AS at_a, count(*) FILTER (WHERE entry AND replica = 'b') AS at_b FROM asked a LEFT JOIN
    (SELECT *, across AND service = 's2' AND NOT optional AS into_target, across AND service = 's2' AND NOT optional AND NOT client AS entry FROM seen) s ON s.t = a.t GROUP BY ALL),
  signals AS (SELECT t, operation, opens, done, native_spans, native_roots, refusal, CASE WHEN refusal IS NULL THEN root_status0 END AS root_status, CASE WHEN refusal IS NULL THEN done - opens <= {DEADLINE_NS} END AS timely,
    CASE WHEN refusal IS NULL THEN CASE WHEN at_a > 0 THEN true WHEN entries = calls AND placed = entries AND others = 0 THEN false END END AS demand_a,
    CASE WHEN refusal IS NULL THEN CASE WHEN at_b > 0 THEN true WHEN entries = calls AND placed = entries AND others = 0 THEN false END END AS demand_b
    FROM facts JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 1), ('3-MEDIUM', 2), ('5-LOW', 0)) c(operation, calls) USING (operation))"""


def _requests(spark, d) -> DataFrame:
    begun = micros("o_orderdate") * 1000
    return _table(spark, d, "orders").select(
        _hex("o_orderkey", 32).alias("trace_id"), F.col("o_orderpriority").alias("operation"), F.lit(None).cast("string").alias("boundary"), begun.alias("start_ns"), (begun + (F.col("o_custkey") % 60 + 30) * DAY_NS).alias("end_ns"))


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


@query(f"WITH {_TAGGED} SELECT service, client, count(*) FILTER (WHERE status) AS good, count(*) FILTER (WHERE NOT status) AS failed, count(*) FILTER (WHERE status IS NULL) AS unknown FROM spans GROUP BY ALL")
def protocol_status(spark, d):
    rows = _spans(spark, d).withColumn("client", requests.is_client(F.col("kind"))).withColumn("status", requests.protocol_status(F.col("attributes"), F.col("error")))
    return rows.groupBy("service", "client").agg(F.count_if("status").alias("good"), F.count_if(~F.col("status")).alias("failed"), F.count_if(F.col("status").isNull()).alias("unknown"))


@query(f"WITH RECURSIVE {_SPANS} SELECT service, destination, optional, count(*) AS spans FROM seen GROUP BY ALL")
def client_destinations(spark, d):
    rows = binding.linked_spans(_requests(spark, d), _spans(spark, d), _contract())
    return rows.groupBy("service", "destination", "optional").agg(F.count("*").alias("spans"))


@query(f"WITH {_TAGGED} SELECT replica, host, tax < 0.005 AS undeclared, count(*) AS spans FROM spans GROUP BY ALL")
def replica_identities(spark, d):
    rows = _spans(spark, d).withColumn("r", requests.replica_identity(F.col("resource"), "study.replica", {"a": "host-a", "b": "host-b"}))
    host = F.when(F.col("resource")["host.name"] == "host-a", 0).when(F.col("resource")["host.name"] == "host-b", 1).otherwise(2)
    return rows.groupBy(F.col("r.replica").alias("replica"), host.cast("long").alias("host"), (F.coalesce(F.col("r.reason"), F.lit("")) == "undeclared_explicit_replica").alias("undeclared")).agg(F.count("*").alias("spans"))


@query(f"""WITH {_LINES} SELECT CASE WHEN n IN (2, 4) THEN 'POST' WHEN q < 6 THEN 'svc/Health' ELSE 'svc/Get' END || ' /api/' || n AS label, count(*) AS spans FROM lines GROUP BY ALL""")
def qualified_operations(spark, d):
    url = F.create_map(F.lit("url.full"), F.concat(F.lit("http://host:80/api/"), F.conv("span_id", 16, 10)))
    return _spans(spark, d).groupBy(requests.qualified_operation(F.col("name"), url).alias("label")).agg(F.count("*").alias("spans"))


@query(f"WITH RECURSIVE {_SPANS} SELECT operation, refusal, root_status, timely, demand_a, demand_b, sum(native_spans)::BIGINT AS native_spans, sum(native_roots)::BIGINT AS native_roots, count(*) AS n FROM signals GROUP BY ALL")
def request_facts(spark, d):
    """Roots, refusals, timeliness and demand of every request."""
    asked, contract = _requests(spark, d), _contract()
    facts = binding.request_facts(asked, binding.linked_spans(asked, _spans(spark, d), contract), contract)
    return facts.groupBy("operation", "refusal", "root_status", "timely", "demand_a", "demand_b").agg(F.sum("native_spans").alias("native_spans"), F.sum("native_roots").alias("native_roots"), F.count("*").alias("n"))


_CALLS = """calls AS (SELECT t, operation, up_service AS source, service AS target, n, up, CASE WHEN NOT status OR NOT up_status THEN false WHEN status OR up_status THEN true END AS status, status AS own, NOT optional AS counts FROM seen WHERE across
  UNION ALL SELECT t, operation, service, 'pg://db:5432/shop', n, up, status, status, NOT optional FROM seen WHERE db AND q < 48
  UNION ALL SELECT t, operation, service, 'pg://db:5432/shop', n, up, status, status, NOT optional FROM seen WHERE db AND q BETWEEN 48 AND 49 AND service = 's0')"""


@query(f"WITH RECURSIVE {_SPANS}, {_CALLS} SELECT source, target, counts, count(*) AS calls, count(*) FILTER (WHERE status) AS good, count(*) FILTER (WHERE NOT status) AS failed FROM calls GROUP BY ALL")
def cross_service_calls(spark, d):
    """Calls between services and into databases."""
    contract = _contract()
    found = binding.calls(binding.linked_spans(_requests(spark, d), _spans(spark, d), contract), contract)
    return found.groupBy("source", "target", "counts").agg(F.count("*").alias("calls"), F.count_if("status").alias("good"), F.count_if(~F.col("status")).alias("failed"))


_COMPLETIONS = f"""{_SPANS}, {_CALLS}, pairs0(operation, source, target, minimum, propagates) AS (VALUES ('1-URGENT', 's0', 's1', 1, false), ('2-HIGH', 's0', 's1', 1, true), ('2-HIGH', 's0', 's2', 1, true), ('3-MEDIUM', 's0', 's2', 2, false), ('5-LOW', 's0', 's3', 1, false)),
  pairs AS (SELECT * FROM pairs0 UNION ALL SELECT DISTINCT c.operation, c.source, c.target, 1, p.propagates FROM calls c JOIN (SELECT operation, s, any_value(propagates) AS propagates FROM (SELECT operation, source AS s, propagates FROM pairs0 UNION ALL SELECT operation, target, propagates FROM pairs0) GROUP BY ALL) p
    ON p.operation = c.operation AND p.s = c.source WHERE c.counts AND c.target LIKE 'pg:%'),
  grouped AS (SELECT t, source, target, count(*) AS k, count(*) FILTER (WHERE NOT status) AS failed, count(*) FILTER (WHERE status) AS good FROM calls WHERE counts GROUP BY ALL),
  clients AS (SELECT DISTINCT t, service AS source, destination AS target FROM seen WHERE destination IS NOT NULL AND NOT status AND NOT optional),
  ruled AS (SELECT g.t, g.operation, r.source, r.target, r.minimum, r.propagates, g.root_status, s.k, s.good, s.failed, CASE WHEN refusal IS NOT NULL THEN 'refused' WHEN c.t IS NOT NULL THEN 'explicit_client_failure' WHEN s.failed > 0 THEN 'explicit_call_failure' WHEN coalesce(s.k, 0) < minimum THEN 'group_not_fully_observed'
    WHEN s.good = s.k THEN 'explicit_protocol_success' WHEN root_status AND propagates THEN 'propagated_root_success' ELSE 'no_certificate' END AS reason
    FROM signals g JOIN pairs r USING (operation) LEFT JOIN grouped s ON s.t = g.t AND s.source = r.source AND s.target = r.target LEFT JOIN clients c ON c.t = g.t AND c.source = r.source AND c.target = r.target),
  tries AS (SELECT u.t, u.source, u.target, s.n, s.parent, s.start_ns, s.end_ns, s.status, s.code, s.name = 'POST' AS post, row_number() OVER (PARTITION BY u.t, u.source, u.target ORDER BY s.start_ns, s.n) AS k FROM ruled u JOIN seen s ON s.t = u.t AND s.service = u.source AND s.destination = u.target
    WHERE u.operation = '1-URGENT' AND u.source = 's0' AND u.target = 's1' AND u.reason = 'explicit_client_failure'),
  tried AS (SELECT t, source, target, count(*) AS attempts, count(*) FILTER (WHERE code = 503 AND post) AS retryable, count(*) FILTER (WHERE post) AS posts, max(n) FILTER (WHERE k = 1) AS n1, max(n) FILTER (WHERE k = 2) AS n2,
    max(code) FILTER (WHERE k = 1) AS code1, max(code) FILTER (WHERE k = 2) AS code2, max(parent) FILTER (WHERE k = 1) AS p1, max(parent) FILTER (WHERE k = 2) AS p2, max(end_ns) FILTER (WHERE k = 1) AS end1, max(start_ns) FILTER (WHERE k = 2) AS start2, bool_or(status) FILTER (WHERE k = 2) AS status2 FROM tries GROUP BY ALL),
  under AS (SELECT t, n AS top, n FROM seen UNION ALL SELECT l.t, u.top, l.n FROM under u JOIN seen l ON l.t = u.t AND l.up = u.n),
  reached AS (SELECT d.t, d.source, d.target, count(*) FILTER (WHERE e.n IS NOT NULL) AS early, count(*) FILTER (WHERE f.n IS NOT NULL AND c.own) AS final FROM tried d JOIN calls c ON c.t = d.t AND c.source = d.source AND c.target = d.target AND c.counts
    LEFT JOIN under e ON e.t = d.t AND e.top = d.n1 AND e.n = c.n LEFT JOIN under f ON f.t = d.t AND f.top = d.n2 AND f.n = c.n GROUP BY ALL),
  done AS (SELECT u.t, u.operation, u.source, u.target, CASE WHEN coalesce(retryable, 0) = 0 THEN u.reason WHEN NOT (attempts = 2 AND code1 IS NOT DISTINCT FROM 503 AND code2 IS NOT DISTINCT FROM 201) THEN 'retry_not_fully_observed'
    WHEN NOT (posts = 2 AND p1 IS NOT DISTINCT FROM p2 AND end1 <= start2 AND coalesce(status2, false)) THEN 'retry_order_not_verified' WHEN coalesce(early, 0) > 0 THEN 'earlier_receiver_effect' WHEN coalesce(final, 0) <> 1 THEN 'final_receiver_not_unique'
    WHEN NOT coalesce(u.failed = 0 AND u.k >= u.minimum AND (u.good = u.k OR coalesce(u.root_status AND u.propagates, false)), false) THEN 'final_completion_not_verified' ELSE 'retried_once' END AS reason
    FROM ruled u LEFT JOIN tried d ON d.t = u.t AND d.source = u.source AND d.target = u.target LEFT JOIN reached r ON r.t = u.t AND r.source = u.source AND r.target = u.target),
  verdicts AS (SELECT *, CASE WHEN reason IN ('explicit_client_failure', 'explicit_call_failure') THEN false WHEN reason IN ('explicit_protocol_success', 'propagated_root_success', 'retried_once') THEN true END AS value FROM done)"""


@query(f"WITH RECURSIVE {_COMPLETIONS} SELECT operation, source, target, value, reason, count(*) AS n FROM verdicts GROUP BY ALL")
def required_completions(spark, d):
    """Completion of every required pair, a declared retry included."""
    asked, contract = _requests(spark, d), _contract()
    linked = binding.linked_spans(asked, _spans(spark, d), contract)
    found = settle(binding.calls(linked, contract))
    facts = binding.request_facts(asked, linked, contract)
    return _counted(binding.logical_completions(facts, linked, found, binding.client_failures(linked), contract, binding.required_pairs(found, contract)), "operation", "source", "target", "value", "reason")


_ADMITTED = f"""admitted AS (SELECT g.t, max(CASE WHEN replica = 'a' THEN true END) AS admitted_a, max(CASE WHEN replica = 'b' THEN true END) AS admitted_b FROM signals g
  LEFT JOIN seen s ON s.t = g.t AND g.refusal IS NULL AND across AND service = 's2' AND NOT optional AND NOT client AND s.start_ns BETWEEN opens AND least(done, opens + {DEADLINE_NS}) GROUP BY g.t)"""


@query(f"WITH RECURSIVE {_SPANS}, {_ADMITTED} SELECT operation, admitted_a, admitted_b, count(*) AS n FROM signals JOIN admitted USING (t) GROUP BY ALL")
def admission_witnesses(spark, d):
    asked, contract = _requests(spark, d), _contract()
    linked = binding.linked_spans(asked, _spans(spark, d), contract)
    facts = binding.request_facts(asked, linked, contract)
    return _counted(facts.select("trace_id", "operation").join(binding.admissions(facts, linked, contract), "trace_id"), "operation", "admitted_a", "admitted_b")


_BOUNDS = f"""WITH RECURSIVE {_COMPLETIONS}, {_ADMITTED}, c AS (SELECT t, CASE WHEN count(*) FILTER (WHERE NOT value) > 0 THEN false WHEN count(value) = count(*) THEN true END AS completed FROM verdicts GROUP BY t),
  j AS (SELECT operation, count(*) FILTER (WHERE refusal IS NOT NULL) OVER (PARTITION BY operation) AS refused, root_status AND timely AND completed AS r, (admitted_a OR admitted_b) AS reached FROM signals JOIN c USING (t) JOIN admitted USING (t))
  SELECT operation, max(refused) AS refused, count(*) AS n, count(*) FILTER (WHERE r AND reached) AS lower_count, count(*) FILTER (WHERE (r AND reached) IS DISTINCT FROM false) AS upper_count FROM j GROUP BY operation"""


def _bounds(spark, d, spans: DataFrame) -> DataFrame:
    rows = settle(binding.observed_law(_requests(spark, d), spans, _contract()).withColumn("reached", F.col("admitted_a") | F.col("admitted_b")))
    signals = ["entry_completed", "timely", "completed", "reached"]
    refused = rows.groupBy("operation").agg(F.count("refusal").alias("refused"))
    return refused.join(law.conjunctive_bounds(law.category_law(rows, ["operation"], signals), ["operation"], signals), "operation")


@query(_BOUNDS)
def evidence_bounds(spark, d):
    """From spans to bounds: all signals of every request, their joint law, the bounds per operation."""
    return _bounds(spark, d, _spans(spark, d))


# Trace files


def write_traces(spans: DataFrame, form: str, path: str, cut: DataFrame | None = None) -> str:
    """The spans as trace files of one document a line and one document a trace; those of ``cut`` (trace_id, cut) are half a document.

    Spans are dealt out by trace, into as many files as there are tasks.
    """
    spans = spans.repartition("trace_id")
    listed = "array<struct<refType:string,traceID:string,spanID:string>>"
    tag = lambda m, value: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("value")))
    if form == "otlp_jsonl_v1":
        text = lambda v: F.struct(v.alias("stringValue"))
        span = F.struct(F.upper("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_id", F.lit("")).alias("parentSpanId"), "name", F.col("kind").cast("int").alias("kind"),
                        F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"), tag(F.col("attributes"), text).alias("attributes"))
        own = F.map_concat(F.create_map(F.lit("service.name"), F.col("service")), F.col("resource"))
        group = F.struct(F.struct(tag(own, text).alias("attributes")).alias("resource"), F.array(F.struct(F.struct(F.lit("tables").alias("name")).alias("scope"), F.array(span).alias("spans"))).alias("scopeSpans"))
        traces = spans.groupBy("trace_id").agg(F.collect_list(group).alias("resourceSpans")).select("trace_id", F.to_json(F.struct("resourceSpans")).alias("value"))
    else:
        process = F.concat(F.lit("p"), F.col("span_id"))
        reference = F.when(F.col("parent_id").isNotNull(), F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").alias("traceID"), F.col("parent_id").alias("spanID"))))
        tags = F.map_concat(F.col("attributes"), F.create_map(F.lit("span.kind"), F.when(F.col("kind") == "2", "server").otherwise("client")))
        # Jaeger files count in microseconds; the starts of the tables are whole ones, the durations are cut.
        span = F.struct(F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), process.alias("processID"), F.col("name").alias("operationName"), F.expr("start_ns div 1000").alias("startTime"), F.expr("(end_ns - start_ns) div 1000").alias("duration"),
                        F.coalesce(reference, F.array().cast(listed)).alias("references"), tag(tags, lambda v: v).alias("tags"))
        owner = F.struct(process.alias("key"), F.struct(F.col("service").alias("serviceName"), tag(F.col("resource"), lambda v: v).alias("tags")).alias("value"))
        traces = spans.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(owner)).alias("processes"), F.collect_list(span).alias("spans"))
        traces = traces.select("trace_id", F.to_json(F.struct(F.array(F.struct(F.col("trace_id").alias("traceID"), "processes", "spans")).alias("data"))).alias("value"))
    if cut is not None:
        half = F.substring("value", F.lit(1), F.expr("CAST(length(value) div 2 AS INT)"))
        traces = traces.join(cut, "trace_id", "left").withColumn("value", F.when(F.col("cut"), half).otherwise(F.col("value")))
    traces.select("value").write.text(path, compression="gzip")
    return path


def _read_back(spark, d, form: str) -> DataFrame:
    """Spans of all requests as the scan of ``form`` reads them from written files."""
    typed, _ = native.read_native(spark, write_traces(_spans(spark, d), form, shared_path(spark, form)), form, _requests(spark, d))
    start = F.col("start_us") * 1000 + F.col("start_remainder_ns")
    return typed.filter("problem IS NULL").select("trace_id", "span_id", "parent_id", "service", F.col("operation").alias("name"), "kind", start.alias("start_ns"), (start + F.col("duration_us") * 1000 + F.col("duration_remainder_ns")).alias("end_ns"),
                                                  "attributes", F.col("resource_attributes").alias("resource"), (F.col("error_tag") | F.col("error_status")).alias("error"))


@query(_BOUNDS)
def evidence_bounds_otlp(spark, d):
    """The same bounds from written OTLP JSON lines."""
    return _bounds(spark, d, _read_back(spark, d, "otlp_jsonl_v1"))


@query(_BOUNDS)
def evidence_bounds_jaeger(spark, d):
    """The same bounds from written Jaeger documents."""
    return _bounds(spark, d, _read_back(spark, d, "jaeger_jsonl_v1"))
