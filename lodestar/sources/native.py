"""Native trace files as typed spans of the traces that are asked for, with a census of what was not usable.

Spans are picked by their trace id before anything of them is read: ids are cut out of the documents, joined with
the expected ones (a semi-join), and only what remains is normalised. A span that breaks a rule keeps its row with
the first rule it breaks in ``problem``, so the traces it belongs to are known to be incomplete. Values keep the type
they have in the file: documents are read with VARIANT leaves, so a time of 1.5 or true is told from a whole number.

JSON lines hold one document a line and are split by Spark within files; a plain Jaeger file is one document.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.lineage import settle

_OTLP = ("resourceSpans ARRAY<STRUCT<resource: STRUCT<attributes: VARIANT>, scopeSpans: ARRAY<STRUCT<scope: VARIANT, spans: ARRAY<VARIANT>>>, "
         "instrumentationLibrarySpans: ARRAY<STRUCT<instrumentationLibrary: VARIANT, spans: ARRAY<VARIANT>>>>>, _bad STRING")
_JAEGER = "data ARRAY<STRUCT<traceID: STRING, processes: VARIANT, spans: ARRAY<VARIANT>>>"

#: Codes and names of the two formats.
OTLP_SERVER = ("2", "SPAN_KIND_SERVER")
OTLP_ERROR = ("2", "STATUS_CODE_ERROR")
SCALARS = ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue")
#: What is taken out of a span in one pass. What has another type than these is null, as it is at a path of its own.
_VALUE = f"STRUCT<{', '.join(f'{k}: STRING' for k in SCALARS)}, arrayValue: VARIANT, kvlistValue: VARIANT>"
_OTLP_ATTRIBUTES = f"ARRAY<STRUCT<key: STRING, value: {_VALUE}>>"
_OTLP_SPAN = ("STRUCT<spanId: STRING, parentSpanId: STRING, name: STRING, kind: STRING, startTimeUnixNano: VARIANT, endTimeUnixNano: VARIANT, "
              f"attributes: {_OTLP_ATTRIBUTES}, status: STRUCT<code: STRING>>")
_TAGS = "ARRAY<STRUCT<key: STRING, value: STRING>>"
_PROCESSES = f"MAP<STRING, STRUCT<serviceName: STRING, tags: {_TAGS}>>"
_JAEGER_SPAN = ("STRUCT<traceID: STRING, spanID: STRING, processID: STRING, operationName: STRING, startTime: VARIANT, duration: VARIANT, "
                f"references: ARRAY<STRUCT<refType: STRING, traceID: STRING, spanID: STRING>>, tags: {_TAGS}>")

LARGEST_MICROS = (2**63 - 1) // 1000
COLUMNS = ["trace_id", "span_id", "parent_id", "service", "operation", "server", "start_us", "duration_us", "start_remainder_ns", "duration_remainder_ns",
           "attributes", "resource_attributes", "error_tag", "error_status", "kind", "problem"]


def _text(v: Column, path: str) -> Column:
    """A scalar as text, null if it is absent."""
    return F.try_variant_get(v, path, "string")


def _identifier(raw: Column) -> tuple[Column, Column]:
    """(id in lower case, whether it is one): hexadecimal digits and not empty."""
    value = F.lower(F.coalesce(raw, F.lit("")))
    return value, value.rlike("^[0-9a-f]+$")


def _number(v: Column) -> tuple[Column, Column]:
    """(a whole number or null, VARIANT type) of what stands in a time's place."""
    text = F.trim(_text(v, "$"))
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("decimal(38,0)")), F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _inexact(kind: Column) -> Column:
    """Whether a number is of a type that must not be rounded."""
    return kind.rlike("^(DOUBLE|FLOAT|DECIMAL)") | (kind == "BOOLEAN")


def _split(start: Column, duration: Column, divisor: int) -> tuple[Column, list[Column]]:
    """(whether the times are in range, microseconds and remainders in nanoseconds), from whole numbers.

    Those that fit are split as long numbers, which is far cheaper than decimals; the others as decimals without a fraction.
    """
    unit, zero = F.lit(divisor).cast("decimal(5,0)"), F.lit(0).cast("long")
    cut = lambda x: [F.call_function("div", x, F.lit(divisor).cast("long")), x % divisor] if divisor > 1 else [x, zero]
    # ``div`` gives a long number in any case, which wraps beyond 64 bits.
    fits = lambda x: F.abs(x) <= F.lit(f"{2**63 * divisor - 1}").cast("decimal(38,0)")
    cut_decimal = lambda x: [F.when(fits(x), F.call_function("div", x, unit)), (x % unit).try_cast("long")] if divisor > 1 else [x.try_cast("long"), zero]
    parts = [[F.when(x.try_cast("long").isNotNull(), short).otherwise(long) for short, long in zip(cut(x.try_cast("long")), cut_decimal(x))] for x in (start, duration)]
    times = [parts[0][0], parts[1][0], parts[0][1], parts[1][1]]
    limit = F.lit(LARGEST_MICROS).cast("long")
    fine = (start >= 0) & (times[1] > 0) & (times[0] <= limit) & (times[1] <= limit)
    return F.coalesce(fine, F.lit(False)), times


def attribute_value(v: Column, depth: int = 2) -> Column:
    """An OTLP attribute value as text: scalars as they are, arrays and key-value lists as JSON, nested to ``depth``.

    Beyond that depth the value stays in its JSON form of the format, so nothing is lost.
    """
    found = F.coalesce(*[_text(v, f"$.{k}") for k in SCALARS])
    if depth == 0:
        return F.coalesce(found, F.to_json(v))
    return F.coalesce(found, _nested(F.try_variant_get(v, "$.arrayValue", "variant"), F.try_variant_get(v, "$.kvlistValue", "variant"), depth))


def _nested(array: Column, pairs: Column, depth: int) -> Column:
    """The JSON form of an array or else of a key-value list, null if both are absent."""
    empty, quoted = F.array().cast("array<variant>"), lambda x: F.coalesce(_json_value(x, depth - 1), F.lit("null"))
    items = F.coalesce(F.try_variant_get(array, "$.values", "array<variant>"), empty)
    listed = F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ","), F.lit("]"))
    items = F.coalesce(F.try_variant_get(pairs, "$.values", "array<variant>"), empty)
    keyed = F.concat(F.lit("{"), F.array_join(F.transform(items, lambda p: F.concat(_quote(_text(p, "$.key")), F.lit(":"), quoted(F.try_variant_get(p, "$.value", "variant")))), ","), F.lit("}"))
    return F.when(array.isNotNull(), listed).when(pairs.isNotNull(), keyed)


def _typed_value(v: Column) -> Column:
    """``attribute_value`` of a value that was taken out as ``_VALUE``."""
    return F.coalesce(*[v[k] for k in SCALARS], _nested(v["arrayValue"], v["kvlistValue"], 2))


def _quote(text: Column) -> Column:
    return F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def _json_value(v: Column, depth: int) -> Column:
    """The JSON form of a nested value: strings quoted, numbers and Booleans bare."""
    bare = F.coalesce(_text(v, "$.boolValue"), _text(v, "$.intValue"), _text(v, "$.doubleValue"))
    strings = F.coalesce(_text(v, "$.stringValue"), _text(v, "$.bytesValue"))
    return F.when(strings.isNotNull(), _quote(strings)).when(bare.isNotNull(), bare).otherwise(attribute_value(v, depth))


def _map(items: Column, value) -> Column:
    """Key to value; the last of repeated keys counts."""
    rows = F.coalesce(items, F.array().cast("array<variant>"))
    return _last(F.transform(rows, lambda a: F.struct(_text(a, "$.key").alias("k"), value(F.try_variant_get(a, "$.value", "variant")).alias("v"))))


def _map_of(items: Column, kind: str, value=lambda v: v) -> Column:
    """``_map`` of items that were taken out as ``kind``, which has a key and a value."""
    return _last(F.transform(F.coalesce(items, F.array().cast(kind)), lambda a: F.struct(a["key"].alias("k"), value(a["value"]).alias("v"))))


def _last(pairs: Column) -> Column:
    def built(m: Column) -> Column:
        last = F.filter(m, lambda p, i: F.array_position(F.reverse(m["k"]), p["k"]) == F.size(m) - i)
        return F.map_from_entries(F.when(F.size(F.array_distinct(m["k"])) == F.size(m), m).otherwise(last))

    # The list is the variable of an outer transform, so that it is made once and not again at each of its uses.
    return F.get(F.transform(F.array(F.filter(pairs, lambda p: p["k"].isNotNull())), built), F.lit(0))


def _scalar(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _first(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds."""
    out = None
    for name, holds in rules:
        out = F.when(F.coalesce(holds, F.lit(False)), name) if out is None else out.when(F.coalesce(holds, F.lit(False)), name)
    return out


def _true(text: Column) -> Column:
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def _asked(spans: DataFrame, expected: DataFrame) -> DataFrame:
    """Spans of the expected traces; ``expected`` has trace_id in any case and may repeat."""
    wanted = expected.select(F.lower("trace_id").alias("_asked")).distinct()
    return spans.join(wanted, F.col("_trace") == F.col("_asked"), "left_semi")


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns as the row of a generator, so that a filter on what uses them does not copy their making."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def otlp_documents(spark: SparkSession, path) -> DataFrame:
    """(value, d, _file, _at) of every line that is not blank; ``d._bad`` is the text of a line that is no document."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    parsed = F.from_json("value", _OTLP, {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.filter(F.length(F.trim("value")) > 0)
    return _once(rows.select("value", "_file", F.struct("_block", "_line").alias("_at")), d=parsed)


def native_otlp(spark: SparkSession, path, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed spans, counters) of OTLP JSON lines, for the expected traces alone.

    Counters: documents and malformed documents, one row.
    """
    documents = otlp_documents(spark, path)
    counters = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("d._bad").isNotNull()).alias("malformed"))
    groups = documents.filter("d._bad IS NULL").select(F.explode("d.resourceSpans").alias("r"))
    # Each group has its scopes under the one name or the other.
    scopes = F.coalesce("r.scopeSpans", F.transform("r.instrumentationLibrarySpans", lambda s: F.struct(s["instrumentationLibrary"].alias("scope"), s["spans"].alias("spans"))))
    spans = groups.select(F.col("r.resource.attributes").alias("base"), F.explode(scopes).alias("s")).select("base", F.col("s.scope").alias("scope"), F.explode("s.spans").alias("x"))
    rows = _asked(spans.withColumn("_trace", F.lower(F.coalesce(_text(F.col("x"), "$.traceId"), F.lit("")))), expected)
    rows = _once(rows, s=F.try_variant_get("x", "$", _OTLP_SPAN), r=F.try_variant_get("base", "$", _OTLP_ATTRIBUTES)).drop("x", "base")
    scope = F.create_map(F.lit("adapter.original.scope"), F.coalesce(F.to_json("scope"), F.lit("{}")))
    own = F.map_filter(_map_of(F.col("s.attributes"), _OTLP_ATTRIBUTES, _typed_value), lambda k, _: k != "adapter.original.scope")
    rows = _once(rows, resource_attributes=_map_of(F.col("r"), _OTLP_ATTRIBUTES, _typed_value), attributes=F.map_concat(own, scope))
    filled = lambda c: F.coalesce(c, F.lit(""))
    start, start_kind = _number(F.col("s.startTimeUnixNano"))
    end, end_kind = _number(F.col("s.endTimeUnixNano"))
    span, good_span = _identifier(F.col("s.spanId"))
    parent, good_parent = _identifier(F.col("s.parentSpanId"))
    rows = _once(rows, service=filled(F.col("resource_attributes")["service.name"]), operation=filled(F.col("s.name")), start=start, end=end, inexact=_inexact(start_kind) | _inexact(end_kind), span_id=span, good_span=good_span,
                 parent_id=F.when(parent != "", parent), good_parent=(parent == "") | good_parent, kind=filled(F.col("s.kind")), error_status=filled(F.col("s.status.code")).isin(*OTLP_ERROR))
    rows = _once(rows, duration=F.col("end") - F.col("start"))
    in_range, times = _split(F.col("start"), F.col("duration"), 1000)
    good_trace = F.col("_trace").rlike("^[0-9a-f]+$")
    problem = _first([
        ("missing_operation_identity", (F.col("service") == "") | (F.col("operation") == "")), ("noninteger_native_time", F.col("inexact")), ("invalid_duration_or_timestamp", F.col("start").isNull() | F.col("end").isNull()),
        ("missing_or_invalid_identifier", ~(good_trace & F.col("good_span") & F.col("good_parent"))), ("invalid_duration_or_timestamp", ~in_range)])
    rows = _once(rows, problem=problem, **dict(zip(COLUMNS[6:10], times)))
    typed = rows.select(
        F.col("_trace").alias("trace_id"), "span_id", "parent_id", "service", "operation", F.col("kind").isin(*OTLP_SERVER).alias("server"), *COLUMNS[6:10],
        "attributes", "resource_attributes", _true(F.col("attributes")["error"]).alias("error_tag"), "error_status", "kind", "problem")
    return typed, counters


def jaeger_documents(spark: SparkSession, path, lines: bool) -> DataFrame:
    """(data, bad) of Jaeger documents: one a file, or one a line."""
    if lines:
        parsed = F.from_json("value", _JAEGER + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
        return _once(spark.read.text(path).filter(F.length(F.trim("value")) > 0), d=parsed).select("d.data", (F.col("d._bad").isNotNull() | F.col("d.data").isNull()).alias("bad"))
    files = spark.read.schema(_JAEGER + ", _bad STRING").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return files.select("data", (F.col("_bad").isNotNull() | F.col("data").isNull()).alias("bad"))


def native_jaeger(spark: SparkSession, path, expected: DataFrame, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(typed spans, counters) of Jaeger documents, for the expected traces alone; counters as of OTLP."""
    files = jaeger_documents(spark, path, lines)
    counters = files.agg(F.count("*").alias("documents"), F.count_if("bad").alias("malformed"))
    traces = files.select(F.explode("data").alias("d")).withColumn("_trace", F.lower(F.coalesce("d.traceID", F.lit(""))))
    # A trace's processes are read once and not again for each of its spans.
    rows = _once(_asked(traces, expected).select("_trace", "d.processes", "d.spans"), named=F.try_variant_get("processes", "$", _PROCESSES))
    rows = _once(rows, owners=F.transform_values("named", lambda _, p: F.struct(p["serviceName"].alias("service"), _map_of(p["tags"], _TAGS).alias("resource"))))
    rows = _once(rows.select("_trace", "owners", F.explode("spans").alias("x")), s=F.try_variant_get("x", "$", _JAEGER_SPAN)).drop("x")
    filled = lambda c: F.coalesce(c, F.lit(""))
    references = F.coalesce(F.col("s.references"), F.array().cast("array<struct<refType:string,traceID:string,spanID:string>>"))
    rows = _once(rows, attributes=_map_of(F.col("s.tags"), _TAGS), parents=F.filter(references, lambda r: r["refType"] == "CHILD_OF"), owner=F.try_element_at("owners", filled(F.col("s.processID"))))
    first = F.get("parents", F.lit(0))
    start, start_kind = _number(F.col("s.startTime"))
    lasted, lasted_kind = _number(F.col("s.duration"))
    own_trace, good_own = _identifier(F.coalesce(F.col("s.traceID"), F.col("_trace")))
    parent_trace, good_parent_trace = _identifier(F.coalesce(first["traceID"], F.col("_trace")))
    span, good_span = _identifier(F.col("s.spanID"))
    parent, good_parent = _identifier(first["spanID"])
    rows = _once(rows, service=filled(F.col("owner.service")), operation=filled(F.col("s.operationName")), start=start, duration=lasted, start_kind=start_kind, lasted_kind=lasted_kind, own_trace=own_trace, good_own=good_own,
                 parent_trace=parent_trace, good_parent_trace=good_parent_trace, span_id=span, good_span=good_span, parent=parent, good_parent=good_parent, has_parent=F.size("parents") > 0, several=F.size("parents") > 1,
                 kind=F.lower(filled(F.col("attributes")["span.kind"])))
    in_range, times = _split(F.col("start"), F.col("duration"), 1)
    has_parent, kinds = F.col("has_parent"), [F.col("start_kind"), F.col("lasted_kind")]
    good_trace = F.col("_trace").rlike("^[0-9a-f]+$")
    problem = _first([
        ("missing_or_invalid_identifier", ~good_trace | ~F.col("good_own")), ("conflicting_trace_identity", F.col("own_trace") != F.col("_trace")), ("ambiguous_parent", F.col("several")),
        ("missing_or_invalid_identifier", has_parent & ~F.col("good_parent_trace")), ("cross_trace_parent", has_parent & (F.col("parent_trace") != F.col("_trace"))),
        ("missing_operation_identity", (F.col("service") == "") | (F.col("operation") == "")), ("missing_or_invalid_identifier", ~F.col("good_span") | (has_parent & ~F.col("good_parent"))),
        ("invalid_duration_or_timestamp", (kinds[0] == "BOOLEAN") | (kinds[1] == "BOOLEAN")), ("noninteger_native_time", _inexact(kinds[0]) | _inexact(kinds[1])),
        ("invalid_duration_or_timestamp", F.col("start").isNull() | F.col("duration").isNull() | ~in_range)])
    rows = _once(rows, problem=problem, **dict(zip(COLUMNS[6:10], times)))
    resource = F.coalesce(F.col("owner.resource"), F.create_map().cast("map<string,string>"))
    typed = rows.select(
        F.col("_trace").alias("trace_id"), "span_id", F.when(has_parent, F.col("parent")).alias("parent_id"), "service", "operation", (F.col("kind") == "server").alias("server"), *COLUMNS[6:10],
        "attributes", resource.alias("resource_attributes"), _true(F.col("attributes")["error"]).alias("error_tag"), F.lit(False).alias("error_status"), "kind", "problem")
    return typed, counters


FORMATS = {"otlp_jsonl_v1": native_otlp, "jaeger_json_v1": native_jaeger, "jaeger_jsonl_v1": partial(native_jaeger, lines=True)}


def read_native(spark: SparkSession, path, form: str, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scan of a format by its name."""
    if form not in FORMATS:
        raise ValueError(f"unknown trace format {form!r}")
    return FORMATS[form](spark, path, expected)


def trace_census(typed: DataFrame, expected: DataFrame) -> DataFrame:
    """(trace_id, spans, invalid, problems) of every expected trace, those without a span in the files too."""
    found = typed.groupBy("trace_id").agg(F.count_if(F.col("problem").isNull()).alias("spans"), F.count("problem").alias("invalid"), F.array_sort(F.collect_set("problem")).alias("problems"))
    asked = expected.select(F.lower("trace_id").alias("trace_id")).distinct()
    return asked.join(found, "trace_id", "left").select("trace_id", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("invalid", F.lit(0)).alias("invalid"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))


def _unterminated(spark: SparkSession, path, tails: DataFrame) -> list[str]:
    """Those files of ``tails`` (_file, value: its last line) whose last byte ends no line.

    Of a plain file that byte alone is read, by Spark's own file systems. A compressed one is read once more in tasks,
    cut at a character that its last line does not end in, so that its last piece is not empty and holds that byte.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out, packed = [], {"{": [], '"': []}
    for name, brace in tails.select("_file", F.endswith("value", F.lit("{"))).collect():
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        if codecs.getCodec(file) is not None:
            packed['"' if brace else "{"].append(name)
            continue
        system = file.getFileSystem(conf)
        size = system.getFileStatus(file).getLen()
        if size:
            stream = system.open(file)
            try:
                stream.seek(size - 1)
                if stream.read() not in (10, 13):
                    out.append(name)
            finally:
                stream.close()
    for sign, names in packed.items():
        if names:
            pieces = spark.read.text(path, lineSep=sign).filter(F.col("_metadata.file_path").isin(names))
            pieces = pieces.select(F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"), F.substring("value", -1, 1).alias("last"))
            ends = pieces.groupBy("_file").agg(F.max_by("last", "_at").alias("last")).filter(~F.col("last").isin("\n", "\r"))
            out += [r["_file"] for r in ends.collect()]
    return out


def _tail_named(tails: DataFrame, expected: DataFrame) -> DataFrame:
    """(_file) of those tails in whose text an expected trace id stands."""
    # Each place is cut out at the length of every id there is, so an id is found by a join, whatever their number.
    lengths = [r["n"] for r in expected.select(F.length("trace_id").alias("n")).distinct().collect() if r["n"]]
    if not lengths:
        return tails.select("_file").limit(0)
    cuts = tails.select("_file", F.lower("value").alias("text"), F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    places = cuts.filter(F.length("text") >= F.col("n")).select("_file", "text", "n", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1)).alias("i"))
    return _asked(places.select("_file", F.substring("text", F.col("i"), F.col("n")).alias("_trace")), expected).select("_file").distinct()


def _otlp_evidence(spark: SparkSession, path, expected: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    documents = otlp_documents(spark, path)
    bad = documents.filter("d._bad IS NOT NULL").select("value", "_file", "_at")
    ends = documents.groupBy("_file").agg(F.max("_at").alias("_at"))
    tails = bad.join(ends, ["_file", "_at"]).select("_file", "value")
    # One name a file whose last line is malformed; of these the last byte is read.
    tails = tails.filter(F.col("_file").isin(_unterminated(spark, path, tails)))
    truncated = tails.join(_tail_named(tails, expected), "_file", "left_anti").agg(F.count("*").alias("n"))
    counters = bad.agg(F.count("*").alias("n")).select(F.lit("invalid_records").alias("counter"), "n").unionByName(truncated.select(F.lit("invalid_records").alias("counter"), (-F.col("n")).alias("n")))
    counters = counters.unionByName(truncated.select(F.lit("truncated_tails").alias("counter"), "n"))
    groups = documents.filter("d._bad IS NULL").select(F.explode("d.resourceSpans").alias("r"))
    spans = groups.select(F.col("r.resource.attributes").alias("base"), F.explode("r.scopeSpans").alias("s")).select("base", F.explode("s.spans").alias("x"))
    rows = _asked(spans.withColumn("_trace", F.lower(F.coalesce(_text(F.col("x"), "$.traceId"), F.lit("")))), expected)
    rows = rows.withColumn("resource", _map(F.try_variant_get("base", "$", "array<variant>"), lambda v: F.coalesce(*[_text(v, f"$.{k}") for k in SCALARS])))
    x = F.col("x")
    return rows.select("_trace", _text(x, "$.spanId").alias("span_id"), _text(x, "$.parentSpanId").alias("parent_id"), F.col("resource")["service.name"].alias("service"), _text(x, "$.name").alias("operation"), F.col("resource")[label].alias("_label")), counters


def _jaeger_evidence(spark: SparkSession, path, expected: DataFrame, label: str, lines: bool) -> tuple[DataFrame, DataFrame]:
    files = jaeger_documents(spark, path, lines)
    traces = files.select(F.explode("data").alias("d")).withColumn("_trace", F.lower(F.coalesce("d.traceID", F.lit(""))))
    rows = _asked(traces, expected).select("_trace", "d.processes", F.explode("d.spans").alias("x"))
    x = F.col("x")
    rows = rows.withColumn("process", F.try_element_at(F.try_variant_get("processes", "$", "map<string,variant>"), F.coalesce(_text(x, "$.processID"), F.lit(""))))
    parents = F.filter(F.coalesce(F.try_variant_get(x, "$.references", "array<variant>"), F.array().cast("array<variant>")), lambda r: _text(r, "$.refType") == "CHILD_OF")
    rows = rows.select("_trace", _text(x, "$.spanID").alias("span_id"), _text(F.get(parents, F.lit(0)), "$.spanID").alias("parent_id"), _text(F.col("process"), "$.serviceName").alias("service"), _text(x, "$.operationName").alias("operation"),
                       _map(F.try_variant_get("process", "$.tags", "array<variant>"), _scalar)[label].alias("_label"))
    return rows, files.agg(F.count_if("bad").alias("n")).select(F.lit("invalid_records").alias("counter"), "n")


def trace_evidence(spark: SparkSession, path, form: str, expected: DataFrame, target: str, label: str, values: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(spans, counters): the lighter scan that evidence of replicas is read by.

    Spans have (trace_id, span_id, parent_id, service, operation, replica), one for each id of an expected trace.
    A span of the target service has the replica that ``values`` gives its resource's ``label``; one that has none
    counts as unknown. Counters are rows (counter, n): invalid records, duplicate spans, unknown replicas and truncated
    tails. A malformed last line without an end is a file that was still being written: it is tolerated unless an
    expected trace id stands in it.
    """
    if form == "otlp_jsonl_v1":
        rows, counters = _otlp_evidence(spark, path, expected, label)
    elif form in ("jaeger_json_v1", "jaeger_jsonl_v1"):
        rows, counters = _jaeger_evidence(spark, path, expected, label, form == "jaeger_jsonl_v1")
    else:
        raise ValueError(f"unknown trace format {form!r}")
    filled = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.create_map().cast("map<string,string>")
    rows = rows.select(F.col("_trace").alias("trace_id"), filled("span_id").alias("span_id"), F.nullif(filled("parent_id"), F.lit("")).alias("parent_id"), F.coalesce("service", F.lit("")).alias("service"),
                       F.coalesce("operation", F.lit("")).alias("operation"), F.when(F.col("service") == target, F.try_element_at(table, F.coalesce("_label", F.lit("")))).alias("replica"))
    usable = (F.col("span_id") != "") & (F.col("service") != "")
    unknown = usable & (F.col("service") == target) & F.col("replica").isNull()
    # The spans and what is counted of them come from one scan, which is written: a row for each id.
    found = settle(rows.groupBy("trace_id", "span_id").agg(
        F.min(F.when(usable, F.struct("parent_id", "service", "operation", "replica"))).alias("s"), F.count_if(usable).alias("n"), F.count_if(~usable).alias("bad"), F.count_if(unknown).alias("unknown")))
    kept = found.filter("n > 0")
    facts = found.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n") - 1)), F.lit(0)).alias("repeats"))
    facts = facts.select(F.explode(F.create_map(F.lit("invalid_records"), "bad", F.lit("unknown_replicas"), "unknown", F.lit("duplicate_spans"), "repeats")).alias("counter", "n"))
    totals = counters.unionByName(facts).groupBy("counter").agg(F.sum("n").alias("n"))
    return kept.select("trace_id", "span_id", "s.*"), totals
