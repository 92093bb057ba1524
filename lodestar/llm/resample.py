"""Importance resampling towards a target: hashed n-gram features, log-ratio gains, Gumbel top-k without replacement.

Features are runs of consecutive words. Two passes read the texts: the first sums the features of every bucket
over the raw texts and over the target's, the second adds up the gains of each text's features. In both, a slice
of texts interns its n-grams in an open-addressed table: XXH64 keys, linear probing, and equal keys are taken for
equal only after their bytes have been compared. A slot holds its n-gram's bucket and count; every occurrence
keeps the number of its slot, through which it reaches the slot's gain. What a task sends on is one count a bucket,
or one row a text. The table of gains has ``buckets`` numbers, so it goes to every task.

The draw ranks by score in a range-partitioned sort; places before a partition come from the partitions' sizes.

Edge cases: a null or empty text has no feature, weight 0 and, having fewer words than ``least_words``, no rank;
long texts are read whole, in parts cut between words; rows of equal score and doc_id are drawn in any order, and
a null doc_id counts as an empty text in the draw's hash and is the smallest; an empty target leaves gains that
depend on the raw counts alone; empty documents give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import materialize
from lodestar.llm.grams import WORD, Words, same_bytes, word_slices, xxhash64

MAX_N, BUCKETS = 1, 10_000
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20

#: Digits, letters and everything beyond ASCII.
KINDS = np.zeros(256, np.int8)
KINDS[48:58] = KINDS[97:123] = KINDS[128:] = WORD


class GramTable:
    """Open-addressed table of the n-grams of a slice: ``slot`` of every occurrence, ``bucket`` and ``count`` of every slot."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int):
        capacity = 1 << max(4, int(2 * len(start) - 1).bit_length())
        mask = np.uint64(capacity - 1)
        key = xxhash64(data, start, length)
        owner = np.full(capacity, -1, np.int64)
        self.slot = np.zeros(len(start), np.int64)
        at, left = (key & mask).astype(np.int64), np.arange(len(start))
        while len(left):
            place = at[left]
            free = owner[place] < 0
            owner[place[free]] = left[free]  # of several that claim a place one stays, and the others meet it below
            holder = owner[place]
            same = (key[holder] == key[left]) & (length[holder] == length[left])
            same[same] = same_bytes(data, start[holder[same]], start[left[same]], length[left[same]])
            self.slot[left[same]] = place[same]
            left = left[~same]
            at[left] = (at[left] + 1) & (capacity - 1)
        self.count = np.bincount(self.slot, minlength=capacity)
        self.bucket = np.zeros(capacity, np.int64)
        used, raw = np.flatnonzero(owner >= 0), data.tobytes()
        spans = zip(start[owner[used]].tolist(), (start + length)[owner[used]].tolist())
        self.bucket[used] = np.fromiter((zlib.crc32(raw[a:b]) for a, b in spans), np.int64, len(used)) % buckets


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes one after another, with one space behind each: (bytes, starts, stops)."""
    length = words.stop - words.start
    start = np.cumsum(length + 1) - (length + 1)
    source = np.arange(int((length + 1).sum())) + np.repeat(words.start - start, length + 1)
    data = words.data[np.minimum(source, len(words.data) - 1)]
    data[start + length] = 32
    return data, start, start + length


def gram_spans(words: Words, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths, rows) of all runs of 1 to ``max_n`` words that begin at a word of the slice's own."""
    data, start, stop = (words.data, words.start, words.stop) if max_n == 1 or not len(words.start) else _joined(words)
    starts, lengths, rows = [], [], []
    for n in range(1, max_n + 1):
        first = np.arange(max(0, min(words.own, len(start) - n + 1)))
        first = first[words.row[first] == words.row[first + n - 1]]
        starts.append(start[first])
        lengths.append(stop[first + n - 1] - start[first])
        rows.append(words.row[first])
    return np.concatenate([data, np.zeros(8, np.uint8)]), np.concatenate(starts), np.concatenate(lengths), np.concatenate(rows)


def feature_counts(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of every bucket over all ``texts`` (column text); a task sends one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for words in word_slices(batch.column(0), KINDS, max_n - 1):
                data, start, length, _ = gram_spans(words, max_n)
                table = GramTable(data, start, length, buckets)
                used = np.flatnonzero(table.count)
                np.add.at(total, table.bucket[used], table.count[used])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the raw texts; counts have ``buckets`` rows at most."""
    s, t = ({r["bucket"]: int(r["n"]) for r in counts.collect()} for counts in (raw, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    ratio = lambda b: float(t.get(b, 0) + 1) * float(all_s + buckets) / (float(s.get(b, 0) + 1) * float(all_t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def importance_weights(docs: DataFrame, gain: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """(doc_id, n_words, n_features, weight): each text's features and the sum of their gains."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for words in word_slices(batch.column(1), KINDS, max_n - 1):
                data, start, length, row = gram_spans(words, max_n)
                table = GramTable(data, start, length, buckets)
                np.add.at(n_words, words.row[:words.own], 1)
                np.add.at(n_features, row, 1)
                np.add.at(weight, row, gain[table.bucket][table.slot])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def draw(weights: DataFrame, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``weights`` with score and rank: of the texts with enough words, ``percent`` of a hundred have a rank, the highest scores first.

    The score adds Gumbel noise, made from a hash of seed and doc_id, to the weight: the highest scores are a sample
    without replacement in proportion to the exponential of the weight.
    """
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    scored = materialize(weights.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    enough = F.col("n_words") >= least_words
    drawn = scored.filter(enough).count() * percent // 100
    # The last key only spreads rows that agree in all that counts.
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.monotonically_increasing_id()]
    spread = scored.filter(enough).repartitionByRange(*order).sortWithinPartitions(F.desc("score"), F.asc_nulls_first("doc_id"))
    spread = materialize(spread.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = spread.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + place + 1
    ranked = spread.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.when(rank <= drawn, rank).cast("long")).drop("_part", "_at", "_before")
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards `benchmark`, its score, and its rank in the draw of a tenth."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    gain = gains(feature_counts(docs), feature_counts(target))
    return draw(importance_weights(docs, gain)).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


#: Every distinct word goes through the bits of CRC-32 once; the table of its bytes comes from the polynomial.
OP11_SQL = r"""WITH RECURSIVE bits(b, k, c) AS (SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) t(i)
    UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
  tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
  dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
  bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
  du AS (SELECT r, unnest(words) AS w FROM dw), vocabulary AS (SELECT w FROM du UNION SELECT w FROM bw),
  hexed AS (SELECT w, hex(encode(w)) AS h FROM vocabulary),
  crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM hexed, tab),
  s AS (SELECT bucket, count(*) AS n FROM du JOIN crc USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bw JOIN crc USING (w) GROUP BY 1),
  sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS all_t),
  gain AS (SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (all_s + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS g
    FROM range(10000) x(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b, sums),
  w AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS weight FROM du JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY r),
  f AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM dw LEFT JOIN w USING (r)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) FILTER (WHERE n >= 20) OVER () AS eligible FROM f)
  SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN n >= 20 AND k <= eligible * 10 // 100 THEN k END AS rank, n::BIGINT AS n_words FROM ranked"""
