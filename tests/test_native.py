"""The native scans on files by hand: every rule once, in both formats, with the census and the counters."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lodestar.sources import native

T, U, X = "0a" * 16, "0b" * 16, "0c" * 16


def text(v):
    return {"stringValue": v}


def otlp(trace, sid, parent="", name="op", kind=2, start="1000000001", end="1000005003", attributes=(), status=None, service="shop", resource=(), links=()):
    own = [{"key": "service.name", "value": text(service)}] if service else []
    span = {"traceId": trace, "spanId": sid, "parentSpanId": parent, "name": name, "kind": kind, "startTimeUnixNano": start, "endTimeUnixNano": end, "attributes": list(attributes), "links": list(links)} | ({"status": {"code": status}} if status else {})
    return {"resource": {"attributes": own + list(resource)}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span]}]}


def attribute(key, **value):
    return {"key": key, "value": value}


NESTED = attribute("n", kvlistValue={"values": [attribute("a", intValue="1"), attribute("b", arrayValue={"values": [{"stringValue": "x\"y"}, {"boolValue": True}, {"doubleValue": 1.5}]})]})
OTLP = [
    (otlp(T.upper(), "01", attributes=[attribute("error", boolValue=True), attribute("k", stringValue="first"), attribute("k", stringValue="last"), attribute("i", intValue="7"), NESTED], resource=[attribute("host.name", stringValue="h")]), None),
    (otlp(T, "02", "01", kind="SPAN_KIND_CLIENT", status="STATUS_CODE_ERROR"), None),
    (otlp(U, "01", start=1.5), "noninteger_native_time"),
    (otlp(U, "02", end=True), "noninteger_native_time"),
    (otlp(U, "03", start="1.5"), "invalid_duration_or_timestamp"),
    (otlp(U, "04", start="2000", end="2999"), "invalid_duration_or_timestamp"),
    (otlp(U, "05", start="-5", end="9000"), "invalid_duration_or_timestamp"),
    (otlp(U, "xx"), "missing_or_invalid_identifier"),
    (otlp(U, "07", "no"), "missing_or_invalid_identifier"),
    (otlp(U, "08", service=""), "missing_operation_identity"),
    (otlp(U, "09", name=""), "missing_operation_identity"),
    (otlp(U, "0a", start="0", end="9223372036854775807999"), "invalid_duration_or_timestamp"),
    (otlp(U, "0b", start=1000, end=3000), None),
    (otlp("ff" * 16, "01"), "not asked"),
]


@pytest.fixture
def expected(spark):
    return spark.createDataFrame([(T,), (U.upper(),), (X,), (T,)], "trace_id string")


def test_otlp(spark, tmp_path, expected):
    lines = [json.dumps({"resourceSpans": [g]}) for g, _ in OTLP]
    (tmp_path / "a.jsonl").write_text("\n".join([lines[0], "{broken", "", *lines[1:], '{"resourceSpans": 5}']) + "\n")
    spans, counters = native.read_native(spark, str(tmp_path / "a.jsonl"), "otlp_jsonl_v1", expected)
    rows = {(r["trace_id"], r["span_id"]): r for r in spans.collect()}
    assert {k: r["problem"] for k, r in rows.items()} == {(g["scopeSpans"][0]["spans"][0]["traceId"].lower(), g["scopeSpans"][0]["spans"][0]["spanId"]): p for g, p in OTLP if p != "not asked"}
    first = rows[T, "01"]
    assert (first["server"], first["start_us"], first["start_remainder_ns"], first["duration_us"], first["duration_remainder_ns"]) == (True, 1000000, 1, 5, 2)
    assert (first["error_tag"], first["error_status"], first["parent_id"], first["resource_attributes"]) == (True, False, None, {"service.name": "shop", "host.name": "h"})
    assert first["attributes"]["k"] == "last" and first["attributes"]["i"] == "7" and json.loads(first["attributes"]["adapter.original.scope"]) == {"name": "lib"}
    assert json.loads(first["attributes"]["n"]) == {"a": 1, "b": ["x\"y", True, 1.5]}
    assert (rows[T, "02"]["server"], rows[T, "02"]["error_status"], rows[T, "02"]["parent_id"]) == (False, True, "01")
    assert tuple(counters.first()) == (len(OTLP) + 2, 2)
    census = {r["trace_id"]: (r["spans"], r["invalid"], r["problems"]) for r in native.trace_census(spans, expected).collect()}
    assert census == {T: (2, 0, []), U: (1, 10, ["invalid_duration_or_timestamp", "missing_operation_identity", "missing_or_invalid_identifier", "noninteger_native_time"]), X: (0, 0, [])}


def jaeger(sid, process="p", trace=None, parents=(), name="op", start=5, duration=7, tags=(), **more):
    refs = [{"refType": "CHILD_OF", "spanID": p} | ({"traceID": t} if t else {}) for p, t in parents] + [{"refType": "FOLLOWS_FROM", "spanID": "77"}]
    return {"spanID": sid, "processID": process, "operationName": name, "startTime": start, "duration": duration, "references": refs, "tags": [{"key": k, "value": v} for k, v in tags]} | ({"traceID": trace} if trace else {}) | more


JAEGER = [
    (jaeger("01", trace=T.upper(), tags=[("span.kind", "Server"), ("error", True), ("x", 1), ("x", 2)]), None),
    (jaeger("02", parents=[("01", T)]), None),
    (jaeger("03", trace=U), "conflicting_trace_identity"),
    (jaeger("04", parents=[("01", T), ("02", T)]), "ambiguous_parent"),
    (jaeger("05", parents=[("01", U)]), "cross_trace_parent"),
    (jaeger("06", process="q"), "missing_operation_identity"),
    (jaeger("07", name=""), "missing_operation_identity"),
    (jaeger("zz"), "missing_or_invalid_identifier"),
    (jaeger("09", start=1.25), "noninteger_native_time"),
    (jaeger("0a", start=True), "invalid_duration_or_timestamp"),
    (jaeger("0b", duration=0), "invalid_duration_or_timestamp"),
    (jaeger("0c", duration=-4), "invalid_duration_or_timestamp"),
    (jaeger("0d", start="12"), None),
]


@pytest.mark.parametrize("form", ["jaeger_json_v1", "jaeger_jsonl_v1"])
def test_jaeger(spark, tmp_path, expected, form):
    processes = {"p": {"serviceName": "shop", "tags": [{"key": "host", "value": "h"}]}}
    document = {"data": [{"traceID": T, "processes": processes, "spans": [s for s, _ in JAEGER]}, {"traceID": "ff" * 16, "processes": processes, "spans": [jaeger("01")]}]}
    (tmp_path / "a.json").write_text(json.dumps(document) + "\n")
    spans, counters = native.read_native(spark, str(tmp_path / "a.json"), form, expected)
    rows = {r["span_id"]: r for r in spans.collect()}
    assert {k: r["problem"] for k, r in rows.items()} == {s["spanID"]: p for s, p in JAEGER}
    first = rows["01"]
    assert (first["server"], first["error_tag"], first["error_status"], first["kind"], first["start_us"], first["duration_us"], first["start_remainder_ns"]) == (True, True, False, "server", 5, 7, 0)
    assert first["attributes"]["x"] == "2" and first["resource_attributes"] == {"host": "h"} and first["parent_id"] is None and rows["02"]["parent_id"] == "01" and rows["0d"]["start_us"] == 12
    assert tuple(counters.first()) == (1, 0)


def counted(counters):
    return {r["counter"]: r["n"] for r in counters.collect()}


@pytest.mark.parametrize("tail,want", [("\n", dict(invalid_records=2, truncated_tails=0)), ("", dict(invalid_records=1, truncated_tails=1))])
def test_evidence_of_otlp(spark, tmp_path, expected, tail, want):
    replica = lambda v: [attribute("rep", stringValue=v)]
    groups = [otlp(T, "01", resource=replica("one")), otlp(T, "01", resource=replica("one")), otlp(T, "02", "01", resource=replica("what")), otlp(U, "", service="shop"), otlp("ff" * 16, ""), otlp(U, "05", service="other")]
    lines = [json.dumps({"resourceSpans": [g]}) for g in groups]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines, '{"resourceSpans": [{"resou']) + tail)
    spans, counters = native.trace_evidence(spark, str(tmp_path), "otlp_jsonl_v1", expected, "shop", "rep", {"one": "a"})
    assert {(r["trace_id"], r["span_id"], r["parent_id"], r["service"], r["replica"]) for r in spans.collect()} == {(T, "01", None, "shop", "a"), (T, "02", "01", "shop", None), (U, "05", None, "other", None)}
    assert counted(counters) == want | dict(duplicate_spans=1, unknown_replicas=1)


def test_a_tail_that_names_an_expected_trace_is_invalid(spark, tmp_path, expected):
    (tmp_path / "a.jsonl").write_text(json.dumps({"resourceSpans": []}) + '\n{"traceId": "' + T.upper())
    (tmp_path / "b.jsonl").write_text('{"traceId": "' + "ff" * 16)
    _, counters = native.trace_evidence(spark, str(tmp_path), "otlp_jsonl_v1", expected, "shop", "rep", {"one": "a"})
    assert counted(counters) == dict(invalid_records=1, truncated_tails=1, duplicate_spans=0, unknown_replicas=0)


@pytest.mark.parametrize("text,terminated", [('{"resourceSpans": []}\n{"resou', False), ('{"resourceSpans": []}\n{"resou\n', True), ('{"resourceSpans": []}\n{"resou\r\n', True), ('{"resourceSpans": []}\n{', False), ('{"resourceSpans": []}\n{\n', True), ('{"x": 1}\n{\n{', False),
                                             ('broken', False), ('broken\n', True), ('{"resourceSpans": []}\n"', False), ('{"resourceSpans": []}\n"\n', True), ('broken\n ', False)])
@pytest.mark.parametrize("packed", [False, True])
def test_the_end_of_a_file_is_found_in_any_form(spark, tmp_path, expected, text, terminated, packed):
    """A compressed file's last byte is that of its text, and not that of the file."""
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / f"a.jsonl{'.gz' if packed else ''}").write_bytes(gzip.compress(text.encode()) if packed else text.encode())
    _, counters = native.trace_evidence(spark, str(folder), "otlp_jsonl_v1", expected, "shop", "rep", {"one": "a"})
    found = counted(counters)
    assert found["truncated_tails"] == (not terminated) and found["invalid_records"] == terminated + text.startswith('{"x": 1}\n{\n')


def test_evidence_is_scanned_once(spark, tmp_path, expected):
    """Spans and their counters come from one written scan, not from one scan each."""
    (tmp_path / "a.jsonl").write_text(json.dumps({"resourceSpans": [otlp(T, "01")]}) + "\n")
    spans, _ = native.trace_evidence(spark, str(tmp_path), "otlp_jsonl_v1", expected, "shop", "rep", {"one": "a"})
    assert spans.count() == 1 and not any(f.endswith(".jsonl") for f in spans.inputFiles())


def test_evidence_of_jaeger(spark, tmp_path, expected):
    processes = {"p": {"serviceName": "shop", "tags": [{"key": "rep", "value": "one"}]}, "q": {"serviceName": "shop", "tags": []}}
    document = {"data": [{"traceID": T, "processes": processes, "spans": [jaeger("01"), jaeger("01"), jaeger("02", "q", parents=[("01", T)]), jaeger(""), jaeger("04", "none")]}]}
    (tmp_path / "a.json").write_text(json.dumps(document, indent=1))
    (tmp_path / "b.json").write_text("[broken")
    spans, counters = native.trace_evidence(spark, str(tmp_path), "jaeger_json_v1", expected, "shop", "rep", {"one": "a"})
    assert {(r["span_id"], r["parent_id"], r["replica"]) for r in spans.collect()} == {("01", None, "a"), ("02", "01", None)}
    assert counted(counters) == dict(invalid_records=3, duplicate_spans=1, unknown_replicas=1)


def test_unknown_format(spark, expected):
    with pytest.raises(ValueError, match="unknown trace format"):
        native.read_native(spark, "x", "zipkin", expected)


def test_attribute_values_are_made_once(spark):
    """A use of the list of attributes makes none of them again: the value's expression stands in the plan once."""
    rows = spark.sql("""SELECT parse_json('[{"key":"a","value":1},{"key":"b","value":2},{"value":5},{"key":"a","value":3},{"key":"c"}]')::array<variant> AS items""")
    made = rows.select(native._map(F.col("items"), lambda v: F.concat(F.lit("marker"), native._scalar(v))).alias("m"))
    assert made._jdf.queryExecution().analyzed().toString().count("marker") == 1
    assert made.first()["m"] == {"a": "marker3", "b": "marker2", "c": None}


def planned(rows, text):
    """How often ``text`` stands in the plan of ``rows``."""
    conf, key = rows.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(key)
    conf.set(key, 10_000)
    try:
        return rows._jdf.queryExecution().optimizedPlan().toString().count(text)
    finally:
        conf.set(key, before)


@pytest.mark.parametrize("form", ["otlp_jsonl_v1", "jaeger_jsonl_v1"])
def test_documents_and_times_are_read_once(spark, tmp_path, expected, form):
    """A filter on the problem of a span makes neither its document nor its times again."""
    (tmp_path / "a.jsonl").write_text("{}\n")
    spans, _ = native.read_native(spark, str(tmp_path / "a.jsonl"), form, expected)
    used = spans.filter("problem IS NULL").select("trace_id", (F.col("start_us") * 1000 + F.col("start_remainder_ns")).alias("start_ns"), "attributes", "resource_attributes")
    assert planned(used, "from_json(") == 1 and planned(used, "[+-]?[0-9]+$") == 2


def test_processes_are_read_once_a_trace(spark, tmp_path, expected):
    """The map of a trace's processes is made below the row of each span."""
    (tmp_path / "a.jsonl").write_text("{}\n")
    spans, _ = native.read_native(spark, str(tmp_path / "a.jsonl"), "jaeger_jsonl_v1", expected)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get(processes" in plan.split("Generate explode(spans", 1)[1]


@pytest.mark.parametrize("divisor", [1, 1000])
def test_times_at_the_ends_of_their_range(spark, divisor):
    """Whole numbers beyond 64 bits are split like those within them."""
    most = native.LARGEST_MICROS
    numbers = [-(10**30), -(2**63) - 1, -1001, -1, 0, 1, 999, 1000, 2**63 - 1, 2**63, most * divisor, most * divisor + divisor - 1, (most + 1) * divisor, 10**37]
    pairs = [(a, b) for a in numbers for b in numbers]
    rows = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string").select(*[F.col(c).cast("decimal(38,0)").alias(c) for c in "ab"])
    fine, times = native._split(F.col("a"), F.col("b"), divisor)
    cut = lambda x: (abs(x) // divisor * (1 if x >= 0 else -1), abs(x) % divisor * (1 if x >= 0 else -1))
    for r in rows.select("a", "b", fine.alias("fine"), *[t.alias(f"t{i}") for i, t in enumerate(times)]).collect():
        (au, ar), (bu, br) = cut(int(r["a"])), cut(int(r["b"]))
        assert r["fine"] == (r["a"] >= 0 and bu > 0 and au <= most and bu <= most)
        assert [r[f"t{i}"] for i in range(4)] == [v if -(2**63) <= v < 2**63 else None for v in (au, bu, ar, br)]
