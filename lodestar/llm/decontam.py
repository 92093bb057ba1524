"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

An item of m distinct five-word shingles is contained at threshold t where ceil(t*m) of them occur in a
document, so among any floor((1-t)*m)+1 of its shingles at least one does. Items are partitioned by size
(powers of two), and a partition's upper bound fixes how many minima of a random hash order an item keeps
as its MinHash sketch. The sketches are the index: every shingle of every whole document is looked up in them
and in nothing else, and the documents that meet a sketch are the candidates of its item. Only candidates are
verified, by the exact containment of all the item's distinct shingles. The candidate step loses nothing at any
document length.

Items of one to four words are one shingle of that width, and documents are then also cut into shingles of
the widths in use, so a short item is found exactly where its words stand in a row.

Documents are told apart by their text (SHA-256), so rows that repeat an id or have none are reported each on
their own. Building the query runs three small jobs: it writes the items' shingles, the candidates and the
candidates' texts.

Words are lower-case runs of letters and digits. Edge cases: null or empty texts and items have no word and
match nothing; texts of under five words can hold short items alone; copies of an item or a document are
reported each on their own; very long texts are exploded row by row and never held as pairs; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, materialize, rolling, text_of

WIDTH, THRESHOLD = 5, 0.8
#: Above this many rows a side is shuffled instead of broadcast (a row has 8 to 80 bytes).
BROADCAST_ROWS = 1_000_000


def _words() -> Column:
    return F.filter(F.split(F.lower(text_of()), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _hashes(words: Column, width: int) -> Column:
    """Array of XXH64 of the windows of ``width`` words."""
    zipped = F.arrays_zip(*[p.alias(f"w{j}") for j, p in enumerate(rolling(words, width))])
    return F.transform(zipped, lambda x: F.xxhash64(*[x[f"w{j}"] for j in range(width)], F.lit(width)))


def shingles_of(words: Column, widths: list[int]) -> Column:
    """Distinct hashes of the windows of WIDTH words and of ``widths``."""
    return F.array_distinct(F.concat(*[_hashes(words, n) for n in [WIDTH, *widths]]))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item, width, h): the distinct shingles of each distinct text; short items are one shingle of their own width."""
    words = items.select(F.sha2(text_of(), 256).alias("item"), _words().alias("words")).filter(F.size("words") > 0).dropDuplicates(["item"])
    width = F.least(F.size("words"), F.lit(WIDTH))
    hashes = F.when(width == WIDTH, _hashes(F.col("words"), WIDTH))
    for n in range(1, WIDTH):
        hashes = hashes.when(width == n, _hashes(F.col("words"), n))
    return words.select("item", width.alias("width"), F.explode(F.array_distinct(hashes)).alias("h"))


def item_sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, h): for each item its smallest hashes, as many as its size partition asks for."""
    sizes = shingles.groupBy("item").agg(F.count("*").alias("m"))
    bound = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("m"))))
    keep = sizes.select("item", (F.floor(F.lit(1 - threshold) * bound + 1e-9) + 1).alias("k"))
    order = Window.partitionBy("item").orderBy(F.xxhash64("h", F.lit("minhash")), "h")
    ranked = shingles.withColumn("rank", F.row_number().over(order))
    return ranked.join(keep, "item").filter("rank <= k").select("item", "h")


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a hint to broadcast it, if it is of at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contained_texts(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_sha) of the rows that are candidates, and (text_sha, item, n_item_shingles, n_shared) at or above ``threshold``."""
    shingles = materialize(item_shingles(items), "items")
    short = [r["width"] for r in shingles.filter(F.col("width") < WIDTH).select("width").distinct().orderBy("width").collect()]  # four at most
    index = _small(item_sketches(shingles, threshold))
    key = F.xxhash64(text_of())
    looked_up = docs.select(key.alias("key"), _words().alias("words")).select("key", F.explode(shingles_of(F.col("words"), short)).alias("h"))
    candidates = materialize(looked_up.join(index, "h").select("key", "item").distinct(), "candidates")
    rows = docs.select("doc_id", text_of().alias("text"), key.alias("key")).join(_small(candidates.select("key").distinct()), "key", "left_semi")
    rows = materialize(rows.withColumn("text_sha", F.sha2("text", 256)), "candidate-texts")
    texts = rows.dropDuplicates(["text_sha"]).select("key", "text_sha", _words().alias("words"))
    held = texts.select("key", "text_sha", F.explode(shingles_of(F.col("words"), short)).alias("h"))
    wanted = candidates.join(shingles.select("item", "h"), "item")
    shared = held.join(wanted, ["key", "h"]).groupBy("text_sha", "item").agg(F.count("*").alias("n_shared"))
    sizes = shingles.groupBy("item").agg(F.count("*").alias("n_item_shingles"))
    found = shared.join(sizes, "item").filter(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_item_shingles") - 1e-9))
    return rows.select("doc_id", "text_sha"), found.select("text_sha", "item", "n_item_shingles", "n_shared")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every pair of rows at or above ``threshold``."""
    rows, found = contained_texts(docs, items, threshold)
    named = items.select("item_id", F.sha2(text_of(), 256).alias("item"))
    return rows.join(found, "text_sha").join(named, "item").select("doc_id", "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text contains an item; columns stay, whatever their names.

    Rows go by their text, so one with a null or repeated doc_id goes too; rows with a null or empty text stay.
    """
    _, found = contained_texts(docs, items, threshold)
    leaked = materialize(found.select("text_sha").distinct(), "leaked")
    mine, other = fresh(docs, "text_sha"), fresh(docs, "leaked")
    rows = docs.withColumn(mine, F.sha2(text_of(), 256))
    other_side = _small(leaked.withColumnRenamed("text_sha", other))
    return rows.join(other_side, rows[mine] == F.col(other), "left_anti").drop(mine)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
