"""Trace documents in OTLP JSON and Jaeger JSON as span rows; tables as checked CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "stringValue STRING, boolValue BOOLEAN, intValue STRING, doubleValue DOUBLE"
_ATTRIBUTES = f"ARRAY<STRUCT<key: STRING, value: STRUCT<{_VALUE.replace(' ', ': ').replace(',:', ',')}>>>"
_SPAN = f"traceId: STRING, spanId: STRING, parentSpanId: STRING, name: STRING, kind: STRING, startTimeUnixNano: STRING, endTimeUnixNano: STRING, status: STRUCT<code: STRING>, attributes: {_ATTRIBUTES}"
OTLP = f"resourceSpans ARRAY<STRUCT<resource: STRUCT<attributes: {_ATTRIBUTES}>, scopeSpans: ARRAY<STRUCT<spans: ARRAY<STRUCT<{_SPAN}>>>>>>"
_TAGS = "ARRAY<STRUCT<key: STRING, value: STRING>>"
JAEGER = (f"data ARRAY<STRUCT<traceID: STRING, processes: MAP<STRING, STRUCT<serviceName: STRING, tags: {_TAGS}>>, spans: ARRAY<STRUCT<traceID: STRING, spanID: STRING, processID: STRING, operationName: STRING, "
          f"startTime: BIGINT, duration: BIGINT, references: ARRAY<STRUCT<refType: STRING, traceID: STRING, spanID: STRING>>, tags: {_TAGS}>>>>")
SPAN_COLUMNS = ["trace_id", "span_id", "parent_span_id", "service", "operation", "start_ns", "end_ns", "status", "kind", "attributes"]


def read_checked_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """CSV with a header; a missing column or a malformed row fails."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def _attribute(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"))


def _attribute_map(items: Column) -> Column:
    """The last of repeated keys wins."""
    rows = F.transform(F.coalesce(items, F.array().cast(_ATTRIBUTES)), lambda a: F.struct(a["key"], _attribute(a["value"])))
    return F.aggregate(rows, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["col2"])))


def _tag_map(items: Column) -> Column:
    rows = F.coalesce(items, F.array().cast(_TAGS))
    return F.aggregate(rows, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))


def _override(base: Column, more: Column) -> Column:
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)


def otlp_spans(documents: DataFrame) -> DataFrame:
    """Span rows of parsed OTLP documents; span attributes override those of the resource."""
    groups = documents.select(F.explode("resourceSpans").alias("r"))
    scopes = groups.select(_attribute_map(F.col("r.resource.attributes")).alias("base"), F.explode("r.scopeSpans").alias("s"))
    spans = scopes.select("base", F.explode("s.spans").alias("x")).select("base", "x.*").withColumn("own", _attribute_map(F.col("attributes")))
    return spans.select(
        F.col("traceId").alias("trace_id"), F.col("spanId").alias("span_id"), F.nullif("parentSpanId", F.lit("")).alias("parent_span_id"), F.col("base")["service.name"].alias("service"), F.col("name").alias("operation"),
        F.col("startTimeUnixNano").cast("long").alias("start_ns"), F.col("endTimeUnixNano").cast("long").alias("end_ns"), F.coalesce("status.code", F.lit("UNSET")).alias("status"), "kind", _override(F.col("base"), F.col("own")).alias("attributes"))


def jaeger_spans(documents: DataFrame) -> DataFrame:
    """Span rows of parsed Jaeger documents; the parent is the first CHILD_OF reference."""
    traces = documents.select(F.explode("data").alias("d"))
    spans = traces.select("d.processes", F.explode("d.spans").alias("x")).select("processes", "x.*").withColumn("process", F.col("processes")[F.col("processID")]).withColumn("own", _tag_map(F.col("tags")))
    parent = F.get(F.filter(F.coalesce("references", F.array().cast("array<struct<refType:string,traceID:string,spanID:string>>")), lambda r: r["refType"] == "CHILD_OF"), F.lit(0))["spanID"]
    return spans.select(
        F.col("traceID").alias("trace_id"), F.col("spanID").alias("span_id"), parent.alias("parent_span_id"), F.col("process.serviceName").alias("service"), F.col("operationName").alias("operation"),
        (F.col("startTime") * 1000).alias("start_ns"), ((F.col("startTime") + F.col("duration")) * 1000).alias("end_ns"), F.when(F.lower(F.col("own")["error"]) == "true", "ERROR").otherwise("UNSET").alias("status"),
        F.col("own")["span.kind"].alias("kind"), _override(_tag_map(F.col("process.tags")), F.col("own")).alias("attributes"))


def read_otlp(spark: SparkSession, path) -> DataFrame:
    return otlp_spans(spark.read.schema(OTLP).option("multiLine", True).json(path))


def read_jaeger(spark: SparkSession, path) -> DataFrame:
    return jaeger_spans(spark.read.schema(JAEGER).option("multiLine", True).json(path))


def otlp_lines(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(spans, counters) of an OTLP JSON-lines file: malformed lines are counted, not fatal."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select("value", F.from_json("value", OTLP + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("d"))
    counters = lines.agg(F.count("*").cast("long").alias("lines"), F.count_if(F.col("d._bad").isNotNull()).cast("long").alias("malformed"))
    return otlp_spans(lines.filter("d._bad IS NULL").select("d.resourceSpans")), counters
