"""WARC archives: writing segmented records and putting them together again.

``write_archive`` writes one record per page with Spark's text writer, whose line separator is the blank
line that ends a WARC record. A response block is an HTTP message in chunked transfer framing; blocks over
SEGMENT_BYTES are cut into a first segment and continuation records. ``read_archive`` parses whole files in
tasks, groups continuation records by the identifier of their origin, orders them by segment number, checks
numbers and total length, and decodes the chunks. A revisit record takes length and digest from the
response it refers to.

Edge cases: null html is an empty payload; records with the same page and payload are read back as often as
they were written; a record that misses a segment is returned with ``complete`` false and no payload; an empty
table gives an empty result; line breaks in a url become spaces. A null page_id comes back as null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import materialize, shared_dir

SEGMENT_BYTES, CHUNK_BYTES = 16 * 1024, 4096
#: With segments of 16 KiB at most, a file has under 40 MB before compression.
RECORDS_PER_FILE = 2000
END = "\r\n\r\n"

_BASE32 = ("array_join(transform(sequence(0, 31), i -> substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ("
           "shiftright(cast(conv(substr(sha, 1 + cast(floor(5 * i / 4) AS INT), 2), 16, 10) AS INT), 3 - (5 * i) % 4) & 31), 1)), '')")
_ID = "concat('<urn:uuid:', substr(k, 1, 8), '-', substr(k, 9, 4), '-', substr(k, 13, 4), '-', substr(k, 17, 4), '-', substr(k, 21, 12), '>')"


def _record_id(page: str, sha: str):
    return F.expr(_ID.replace("k,", f"sha1(concat_ws(':', coalesce(cast({page} AS STRING), 'none'), {sha})),"))


def write_archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Of pages with equal payloads the one with the largest page_id is written in full, others revisit it."""
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ").alias("url"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    narrow = rows.select("page_id", "url", "sha")
    first = narrow.groupBy("sha").agg(F.max("page_id").alias("response_id"))

    framed = rows.join(first.select(F.col("sha").alias("__sha"), "response_id"), (F.col("page_id").eqNullSafe(F.col("response_id"))) & (F.col("sha") == F.col("__sha")), "left_semi")
    chunks = F.expr(f"transform(sequence(0, greatest(octet_length(payload) - 1, 0) div {chunk_bytes}), i -> substring(payload, i * {chunk_bytes} + 1, {chunk_bytes}))")
    body = F.array_join(F.transform(F.filter(chunks, lambda c: F.octet_length(c) > 0), lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit("\r\n"), c.cast("string"), F.lit("\r\n"))), "")
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
    framed = framed.select("page_id", "url", _record_id("page_id", "sha").alias("id"), F.expr(_BASE32).alias("digest"), F.concat(F.lit(head), body, F.lit("0" + END)).cast("binary").alias("block"))
    framed = framed.withColumn("last", F.expr(f"cast((octet_length(block) - 1) div {segment_bytes} AS INT) + 1"))
    parts = framed.select("*", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("n"))
    parts = parts.withColumn("part", F.expr(f"substring(block, (n - 1) * {segment_bytes} + 1, {segment_bytes})"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    several = F.col("last") > 1
    responses = parts.select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("n") == 1, "response").otherwise("continuation"),
        line("WARC-Record-ID", F.when(F.col("n") == 1, F.col("id")).otherwise(F.concat(F.expr("substr(id, 1, length(id) - 1)"), F.lit("-"), F.col("n"), F.lit(">")))),
        line("WARC-Target-URI", F.col("url")), line("X-Page-Id", page),
        F.when(F.col("n") == 1, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))).otherwise(line("WARC-Segment-Origin-ID", F.col("id"))),
        F.when(several, line("WARC-Segment-Number", F.col("n"))).otherwise(""),
        F.when(several & (F.col("n") == F.col("last")), line("WARC-Segment-Total-Length", F.octet_length("block"))).otherwise(""),
        line("Content-Length", F.octet_length("part")), F.lit(END), F.col("part").cast("string")).alias("value"))

    others = narrow.join(first, "sha").filter(~F.col("page_id").eqNullSafe(F.col("response_id")))
    revisits = others.select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: revisit"), line("WARC-Record-ID", _record_id("page_id", "sha")), line("WARC-Target-URI", F.col("url")), line("X-Page-Id", page),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.expr(_BASE32))), line("WARC-Refers-To", _record_id("response_id", "sha")),
        line("Content-Length", F.lit(0)), F.lit(END)).alias("value"))
    responses.unionByName(revisits).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a WARC file, which may be gzipped."""
    if content[:2] == b"\x1f\x8b":
        plain, rest = [], content
        while rest:
            unzip = zlib.decompressobj(31)
            plain.append(unzip.decompress(rest) + unzip.flush())
            rest = unzip.unused_data
        content = b"".join(plain)
    at = 0
    while (start := content.find(b"WARC/", at)) >= 0:
        split = content.find(b"\r\n\r\n", start)
        if split < 0:
            return
        fields = {}
        for x in content[start:split].split(b"\r\n")[1:]:
            name, _, value = x.partition(b":")
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        at = split + 4 + int(fields.get("content-length", "0"))
        yield fields, content[split + 4:at]


def dechunked(body: bytes) -> bytes:
    """The data of a body in chunked transfer framing; extensions and trailers are dropped."""
    data, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(data)
        data.append(body[end + 2:end + 2 + size])
        at = end + 2 + size + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_PARSED = "id string, record_type string, page_id long, refers string, n int, total long, block binary, payload_bytes long, payload_digest string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for f, block in records_of(content):
                kind = f.get("warc-type")
                number, page = f.get("warc-segment-number"), f.get("x-page-id")
                payload = payload_of(block) if kind == "response" and number is None else None
                rows.append((f.get("warc-segment-origin-id") or f.get("warc-record-id"), kind if kind != "continuation" else None, int(page) if page else None, f.get("warc-refers-to"),
                             int(number or 1), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block if number else None,
                             None if payload is None else len(payload), None if payload is None else _digest(payload)))
            for k in range(0, len(rows), 500):
                frame = pd.DataFrame(rows[k:k + 500], columns=names)
                yield frame.astype({"page_id": "Int64", "total": "Int64", "payload_bytes": "Int64"})


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        payloads = [payload_of(bytes(x)) if x is not None else None for x in batch.pop("block")]
        batch["payload_bytes"] = [b if p is None else len(p) for b, p in zip(batch["payload_bytes"].astype("Int64"), payloads)]
        batch["payload_digest"] = [d if p is None else _digest(p) for d, p in zip(batch["payload_digest"], payloads)]
        yield batch.astype({"payload_bytes": "Int64", "page_id": "Int64"})


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(id, record_type, page_id, refers, copies, complete, payload_bytes, payload_digest) per record.

    Segments are grouped by their origin; only records that were cut carry bytes through the shuffle.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInPandas(_parse, _PARSED)
    grouped = parsed.groupBy("id").agg(
        F.max("record_type").alias("record_type"), F.max("page_id").alias("page_id"), F.max("refers").alias("refers"), F.count("*").alias("n_records"), F.max("n").alias("last"),
        F.max("total").alias("total"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"),
        F.array_sort(F.collect_set(F.when(F.col("block").isNotNull(), F.struct("n", "block")))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    sizes = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    cut = F.size("parts") > 0
    complete = F.when(cut, F.coalesce((F.size("parts") == F.col("last")) & (sizes == F.col("total")), F.lit(False))).otherwise(F.col("record_type").isNotNull())
    whole = grouped.select("id", F.coalesce("record_type", F.lit("response")).alias("record_type"), "page_id", "refers", (F.col("n_records") / F.greatest("last", F.lit(1))).cast("long").alias("copies"),
                           complete.alias("complete"), "payload_bytes", "payload_digest", F.when(cut & complete, joined).alias("block"))
    schema = "id string, record_type string, page_id long, refers string, copies long, complete boolean, payload_bytes long, payload_digest string"
    return whole.mapInPandas(_decode, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per written record; revisits get length, digest and page of the response they refer to."""
    responses = records.filter("record_type = 'response'")
    named = responses.select(F.col("id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(named, "refers", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete", "copies"]
    rows = responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisits.withColumnsRenamed({"b": "payload_bytes", "d": "payload_digest"}).select(columns))
    return rows.select(*columns[:-1], F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1)))).alias("copy")).drop("copy")


def op3_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve_revisits(materialize(read_archive(spark, path), "records"))
