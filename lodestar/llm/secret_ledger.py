"""Secret scanning with an incremental blob ledger, in DataFrame functions only.

A `Ledger` is a folder of three tables. ``blobs`` holds every distinct version of a text once, by its SHA-256;
``ledger`` holds the (blob, rule, version) triples that were scanned; ``findings`` holds what they found. Adding
versions stores the unseen blobs; scanning with a set of rules reads the unseen triples alone, so a new rule, or
a new version of one, is run over old blobs without running the others again, and a new blob meets all rules.
The stored findings of the wanted rules are then joined back to every path that carries the blob.

A rule's matches are the leftmost non-overlapping ones. The pieces between matches (split) and the matches
themselves (regexp_extract_all) give every span's offset by a running sum, so no UDF is needed.

Edge cases: a null text counts as empty and has no finding; copies share one scan and repeated rows each get its
findings; a very long text is one row of its blob and its findings are rows; an empty table gives an empty
result; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, materialize, shared_dir, text_of


@dataclass(frozen=True)
class SecretRule:
    """``group`` of a match must have ``shortest`` characters or more; ``version`` changes with the pattern."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 1
    version: int = 1


#: The three base kinds in the order of the contract, then further kinds.
RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")


def _key(rule: SecretRule) -> str:
    return f"{rule.kind}@{rule.version}"


def blob_id(text: Column) -> Column:
    return F.sha2(text, 256)


def _pieces(rule: SecretRule, order: int) -> Column:
    """Array of (k, gap, hit, good) of one rule over ``text``: the gap before each match and the match, as lengths."""
    rx = F.lit(rule.pattern)
    hits = F.regexp_extract_all("text", rx, F.lit(0))
    vals = F.regexp_extract_all("text", rx, F.lit(rule.group))
    zipped = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), hits.alias("hit"), vals.alias("val"))
    rows = F.transform(zipped, lambda x, i: F.struct(
        F.lit(order).alias("rule"), i.alias("k"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"),
        (F.length(x["val"]) >= rule.shortest).alias("good")))
    rows = F.filter(rows, lambda x: x["hit"].isNotNull())
    empty = F.array().cast("array<struct<rule:int,k:int,gap:int,hit:int,good:boolean>>")
    unseen = ~F.array_contains("seen", _key(rule))
    return F.when(unseen & F.col("text").rlike(rule.pattern), rows).otherwise(empty)


def scan_blobs(blobs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """Findings (blob, rule_order, kind, start, end) of unseen pairs, and the ledger rows of these pairs.

    ``blobs`` has distinct (blob, text); ``ledger`` has (blob, rule, version).
    """
    none = F.array().cast("array<string>")
    if ledger is None:
        todo = blobs.select("blob", "text", none.alias("seen"))
        scanned = blobs.select("blob")
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").select("blob", "text", F.coalesce("seen", none).alias("seen"))
        scanned = blobs.select("blob")
    parts = F.concat(*[_pieces(rule, i) for i, rule in enumerate(rules)])
    hits = todo.select("blob", F.explode(parts).alias("x")).select("blob", "x.*")
    running = Window.partitionBy("blob", "rule").orderBy("k")
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(running)).filter("good")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    findings = hits.select("blob", F.col("rule").alias("rule_order"), kinds[F.col("rule")].alias("kind"), (F.col("end") - F.col("hit")).alias("start"), "end")
    pairs = scanned.select("blob", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])).alias("p")).select("blob", "p.rule", "p.version")
    return findings, pairs if ledger is None else pairs.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")


def distinct_blobs(versions: DataFrame) -> DataFrame:
    """(blob, text) once each; the map side drops repeats before the shuffle, so hot copies stay spread."""
    return versions.select(text_of().alias("text")).select(blob_id(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


class Ledger:
    """The stored blobs, scanned triples and findings of one folder, which driver and executors share."""

    SCHEMAS = {"blobs": "blob string, text string", "ledger": "blob string, rule string, version int",
               "findings": "blob string, rule_order int, kind string, version int, start bigint, end bigint"}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, table: str) -> DataFrame:
        """A stored table; an empty one before anything is stored."""
        schema = self.SCHEMAS[table]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, table: str) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{table}")

    def add(self, versions: DataFrame) -> None:
        """Stores the texts of ``versions`` that no stored blob has."""
        blobs, stored = distinct_blobs(versions), self.read("blobs").select("blob")
        self._append(blobs.join(stored, "blob", "left_anti") if stored.head(1) else blobs, "blobs")

    def scan(self, rules=RULES) -> list[SecretRule]:
        """Scans the unseen (blob, rule, version) triples of all stored blobs; returns the rules that had any.

        A rule that has seen every blob is left out, one that has seen none needs no look into the ledger. Findings are
        stored before the triples that vouch for them: a job that is lost between the two leaves its triples unseen, the
        next one scans them again, and what is stored twice by that, or by two writers at once, is read once.
        """
        blobs, ledger = self.read("blobs"), self.read("ledger")
        stored, total = blobs.agg(F.count("*"), F.count_distinct("blob")).first()
        if stored > total:  # two writers stored a blob at once
            blobs = blobs.dropDuplicates(["blob"])
        seen = {(r["rule"], r["version"]): r["n"] for r in ledger.groupBy("rule", "version").agg(F.count_distinct("blob").alias("n")).collect()}  # one row a rule
        unseen = [r for r in rules if seen.get((r.kind, r.version), 0) < total]
        if not unseen:
            return []
        partly = [r for r in unseen if seen.get((r.kind, r.version), 0)]
        known = ledger.filter(F.concat_ws("@", "rule", "version").isin([_key(r) for r in partly])) if partly else None
        findings, pairs = scan_blobs(blobs, known, tuple(unseen))
        versions = F.create_map(*[x for r in unseen for x in (F.lit(r.kind), F.lit(r.version))])
        self._append(findings.select("blob", "rule_order", "kind", versions[F.col("kind")].alias("version"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), "findings")
        self._append(materialize(pairs, "pairs") if partly else pairs, "ledger")
        return unseen

    def findings(self, rules=RULES) -> DataFrame:
        """(blob, start, rule_order, kind, end) of the stored findings of ``rules``, in their order."""
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(_key(r)), F.lit(i))])
        rows = self.read("findings").dropDuplicates(["blob", "kind", "version", "start", "end"]).withColumn("rule_order", order[F.concat_ws("@", "kind", "version")]).filter("rule_order IS NOT NULL")
        return rows.select("blob", "start", "rule_order", "kind", "end")


def find_secrets(docs: DataFrame, rules=RULES, folder: str | None = None) -> DataFrame:
    """doc_id, blob and ``found``: the spans (start, rule_order, kind, end) of each row, by start.

    The ledger of ``folder`` is read and extended; without one a fresh ledger takes the base rules first and the
    others after them. The findings are joined back to the paths by a shuffle of their own on either side, so
    that a blob with very many paths can be split over tasks.
    """
    ledger = Ledger(docs.sparkSession, folder or shared_dir(docs.sparkSession, "secrets"))
    ledger.add(docs)
    ledger.scan([r for r in rules if r.kind in BASE_KINDS])
    ledger.scan(rules)
    per_blob = materialize(ledger.findings(rules).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rule_order", "kind", "end"))).alias("found")), "findings")
    paths = docs.select("doc_id", blob_id(text_of()).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,rule_order:int,kind:string,end:bigint>>")
    return paths.join(per_blob, "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def redact(docs: DataFrame, mark: str = "[REDACTED]", folder: str | None = None) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark`` and ``n_chars`` renewed; columns stay, whatever their names.

    Spans that touch or overlap become one mark. A null text stays null; a text without a finding stays as it is;
    rows with a null or repeated doc_id are treated by their text; an empty table stays empty.
    """
    ledger = Ledger(docs.sparkSession, folder or shared_dir(docs.sparkSession, "secrets"))
    ledger.add(docs)
    ledger.scan(RULES)
    by_start = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = ledger.findings(RULES).withColumn("reach", reach).withColumn("opens", (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int"))
    islands = opened.withColumn("island", F.sum("opens").over(by_start)).groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    mine, marks = fresh(docs, "blob_of_text"), fresh(docs, "marks_of_blob")
    per_blob = materialize(islands.groupBy(F.col("blob").alias(mine)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(marks)), "marks")
    joined = docs.withColumn(mine, blob_id(text_of())).join(per_blob, mine, "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(marks, lambda m: m["end"]))
    ends = F.concat(F.transform(marks, lambda m: m["start"]), F.array(F.length("text").cast("long")))
    cuts = F.arrays_zip(starts.alias("a"), ends.alias("b"), F.array_repeat(F.col("text"), F.size(marks) + 1).alias("t"))
    kept = F.array_join(F.transform(cuts, lambda c: F.substring(c["t"], (c["a"] + 1).cast("int"), (c["b"] - c["a"]).cast("int"))), mark)
    found = F.col(marks).isNotNull()
    joined = joined.withColumn("text", F.when(found, kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(found, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*[f"`{c}`" for c in docs.columns])


def op2_secret_ledger(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
