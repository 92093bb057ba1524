"""Phrase collocations per language from count streams that are merged in order.

Counting. The phrases that matter occur ``least`` times or more, and so do all phrases within them; thus words are
counted first, then pairs of frequent words, then runs of three whose pairs are frequent, all by hashes, and at
last what is left and its extensions to four by their text. What is frequent reaches the tasks as bitmaps of ``BITS``
bits, whatever the corpus: a bitmap may let a rare phrase pass, which then costs a counted row, but it never loses
one, and the last counts are exact sums of all occurrences.

Estimation. The kept counts of all lengths are one stream, sorted across the cluster by language and words. In this
prefix order a phrase stands behind all its own prefixes, so the last phrase of each shorter length is its prefix,
and its count is taken over in one pass without looking anything up; the same pass gives each phrase the largest
count of a phrase that is one word longer to the right. The stream is then sorted by reversed words, and the same
pass gives the counts of all last parts and of extensions to the left. The empty phrase, at the head of each
language, carries the number of its words. A part of the stream begins with the last phrase of every length before
it, five numbers a part, so parts are processed side by side and may end inside a group of any size.

A longer candidate around a phrase that is counted often enough implies one that is a single word longer, so the
two extension counts decide what is dropped.

Edge cases: a null or empty text has no word; a null lang is ``und`` and joins what is named so; long texts are read
whole, in parts cut between words; repeated rows count as often as they occur; equal scores and counts are
ordered by the phrase; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import materialize
from lodestar.llm.grams import BREAK, SPACE, WORD, Words, word_slices, xxhash64

LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
#: Size of a bitmap of frequent phrases: 8 MB, at any size of the corpus; a task holds three.
BITS = 1 << 26
#: Phrases are first counted by hashes of so many bits; two that share one may pass together, and are told apart at last.
HASH_BITS = 40
SLICE = 4 << 20

KINDS = np.full(256, WORD, np.int8)
KINDS[[9, 32]] = SPACE
KINDS[[10, 11, 12, 13, *b".,;:!?"]] = BREAK

HASHED, COUNTS = "h long, f long", "lang string, phrase string, f long"
ROWS_AT_ONCE = 1 << 16


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _hashes(strings: pa.Array) -> np.ndarray:
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8) if len(strings) and offsets[-1] else np.zeros(1, np.uint8)
    return xxhash64(data, offsets[:-1], np.diff(offsets))


class _Slice:
    """The words of a slice of texts, as numbers in its own vocabulary."""

    def __init__(self, words: Words, langs: pa.DictionaryArray):
        length = words.stop - words.start
        offsets = np.concatenate([[0], np.cumsum(length)])
        inside = np.zeros(len(words.data) + 1, np.int8)
        inside[words.start] += 1
        inside[words.stop] -= 1
        packed = words.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        strings = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])
        coded = strings.dictionary_encode()
        self.vocabulary, self.langs = coded.dictionary.cast(pa.string()), langs.dictionary
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.row]
        self.row, self.broken, self.own = words.row, words.broken, words.own
        self.word_hash, self.lang_hash = _hashes(self.vocabulary), _rotl(_hashes(self.langs), 40)

    def starts(self, k: int, own: bool = True) -> np.ndarray:
        """Words at which k words stand in one piece of one text: the slice's own, or its context too."""
        first = np.arange(max(0, min(self.own if own else len(self.word), len(self.word) - k + 1)))
        return first[(self.row[first] == self.row[first + k - 1]) & (self.broken[first] == self.broken[first + k - 1])]

    def counted(self, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(langs, words as rows of k numbers, counts) of the different phrases that begin at ``first``."""
        code = self.lang[first]
        for i in range(k):
            if len(code) and int(code.max()) * (len(self.vocabulary) + 1) > 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(self.vocabulary) + self.word[first + i]
        _, at, counts = np.unique(code, return_index=True, return_counts=True)
        at = first[at]
        return self.lang[at], np.stack([self.word[at + i] for i in range(k)], axis=1), counts

    def hashes(self, lang: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Hashes of HASH_BITS bits of phrases of up to three words."""
        mixed = self.lang_hash[lang]
        for i in range(words.shape[1]):
            mixed = mixed ^ _rotl(self.word_hash[words[:, i]], 7 + 22 * i)
        return (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def may(self, bits: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
        """Which words begin a phrase of k words whose bit is set."""
        out = np.zeros(len(self.word), bool)
        place = (self.hashes(self.lang[first], np.stack([self.word[first + i] for i in range(k)], axis=1)) >> HASH_BITS - BITS.bit_length() + 1)
        out[first] = bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
        return out

    def rows(self, lang: np.ndarray, words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(words), ROWS_AT_ONCE):
            part = words[at:at + ROWS_AT_ONCE]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), self.vocabulary.take(pa.array(part.ravel())))
            columns = [self.langs.take(pa.array(lang[at:at + ROWS_AT_ONCE])), pc.binary_join(listed, " "), pa.array(counts[at:at + ROWS_AT_ONCE].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for batch in batches:
        langs = pc.fill_null(batch.column(0).cast(pa.string()), "und").dictionary_encode()
        for words in word_slices(batch.column(1), KINDS, LONGEST - 1, SLICE):
            if words.own:
                yield _Slice(words, langs)


def _open(s: _Slice, bits: list, k: int) -> np.ndarray:
    """At which words a phrase of k words begins that may be frequent, by the bitmaps of all lengths up to k."""
    found = s.may(bits[0].value, np.arange(len(s.word)), 1)
    for n in range(2, k + 1):
        first = s.starts(n, own=False)
        found = s.may(bits[n - 1].value, first[found[first] & found[first + 1]], n)
    return found


def _candidates(s: _Slice, bits: list, k: int) -> np.ndarray:
    """Own words at which a phrase of k words begins whose parts may all be frequent."""
    first = s.starts(k)
    if k > 1:
        parts = _open(s, bits, k - 1)
        first = first[parts[first] & parts[first + 1]]
    return first


def frequent_bits(source: DataFrame, k: int, least: int, bits: list) -> np.ndarray:
    """Bitmap of the phrases of k words that occur ``least`` times or more; ``bits`` has the bitmaps of all shorter ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            lang, listed, counts = s.counted(_candidates(s, bits, k), k)
            hashed = s.hashes(lang, listed)
            for at in range(0, len(hashed), ROWS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(hashed[at:at + ROWS_AT_ONCE]), pa.array(counts[at:at + ROWS_AT_ONCE].astype(np.int64))], ["h", "f"])

    total = source.mapInArrow(count, HASHED).groupBy("h").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    place = F.shiftright("h", HASH_BITS - BITS.bit_length() + 1) + 1
    blocks = total.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in blocks.collect():
        held = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["block"] - 1) * len(held)
        out[at:at + len(held)] = held[:len(out) - at]
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, f): every phrase of 1 to 4 words with f occurrences, ``least`` or more, and the empty phrase of each lang with the number of its words."""
    context, source, bits = docs.sparkSession.sparkContext, docs.select("lang", "text"), []
    for k in range(1, LONGEST):
        bits.append(context.broadcast(frequent_bits(source, k, least, bits)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            lang, counts = np.unique(s.lang[:s.own], return_counts=True)
            yield from s.rows(lang, np.zeros((len(lang), 0), np.int64), counts)
            for k in range(1, LONGEST):
                yield from s.rows(*s.counted(np.flatnonzero(_open(s, bits, k)[:s.own]), k))
            yield from s.rows(*s.counted(_candidates(s, bits, LONGEST), LONGEST))

    total = source.mapInArrow(count, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    kept = total.filter((F.col("f") >= least) | (F.col("phrase") == ""))
    # No word has a space in it, so the phrase comes apart as it was joined.
    words_of = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    return materialize(kept.select("lang", words_of.alias("words"), "f"), "phrases")


def merged_in_order(stream: DataFrame, words: Column, name: str) -> DataFrame:
    """``stream`` with ``<name>``: counts of the phrase's first parts in the order of ``words``, by length from 0, and ``<name>_longer``: the largest count of a phrase with one word more behind.

    The stream is sorted by (lang, words) over the cluster; the last counts of each length before every part, and the
    first longer phrases that belong to a phrase of an earlier part, are a few numbers a part.
    """
    ordered = stream.withColumn("_key", words).repartitionByRange("lang", "_key").sortWithinPartitions("lang", "_key")
    ordered = materialize(ordered.drop("_key").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), name)
    depth = F.size("words").alias("depth")
    last = ordered.groupBy("_part", depth).agg(F.min("_at").alias("first"), F.max_by("f", "_at").alias("last"))
    edges = last.collect()
    parts = sorted({r["_part"] for r in edges})
    held = {(r["_part"], r["depth"]): r["last"] for r in edges}
    # Phrases that stand before the first phrase one word shorter of their part continue one of an earlier part.
    heads = ordered.select("_part", depth, "f", "_at").join(F.broadcast(last.select("_part", (F.col("depth") + 1).alias("depth"), "first")), ["_part", "depth"], "left")
    heads = {(r["_part"], r["depth"] - 1): r["f"] for r in heads.filter("depth > 0 AND (first IS NULL OR _at < first)").groupBy("_part", "depth").agg(F.max("f").alias("f")).collect()}
    carried, now, owner, late = {}, {}, {}, {}
    for p in parts:
        carried[p] = [now.get(d, 0) for d in range(LONGEST + 1)]
        for d in range(LONGEST + 1):
            if (p, d) in heads and d in owner:
                late[owner[d], d] = max(late.get((owner[d], d), 0), heads[p, d])
            if (p, d) in held:
                now[d], owner[d] = held[p, d], p

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        part = table["_part"][0].as_py()
        f = table["f"].to_numpy()
        depth = pc.list_value_length(table["words"]).to_numpy()
        place, longer = np.arange(len(f)), np.zeros(len(f), np.int64)
        firsts = np.zeros((len(f), LONGEST), np.int64)
        for d in range(LONGEST):
            last = np.maximum.accumulate(np.where(depth == d, place, -1))
            firsts[:, d] = np.where(last >= 0, f[last], carried[part][d])
            child = np.flatnonzero((depth == d + 1) & (last >= 0))
            np.maximum.at(longer, last[child], f[child])
            own = np.flatnonzero(depth == d)
            if len(own):
                longer[own[-1]] = max(longer[own[-1]], late.get((part, d), 0))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * LONGEST), pa.array(firsts.ravel()))
        return table.drop_columns(["_at", "_part"]).append_column(name, listed).append_column(f"{name}_longer", pa.array(longer))

    kept = ", ".join(f"`{c}` {t}" for c, t in ordered.dtypes if c not in ("_at", "_part"))
    return ordered.groupBy("_part").applyInArrow(merge, f"{kept}, {name} array<bigint>, {name}_longer bigint")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each lang by their weakest cut.

    A phrase goes if a candidate that is longer has ``share`` hundredths of its count or more.
    """
    prefixed = merged_in_order(phrase_counts(docs, least), F.col("words"), "head")
    both = merged_in_order(prefixed, F.reverse("words"), "tail")
    exact = lambda c: c.cast("decimal(19,0)")  # noqa: E731  64-bit counts; products of them fit 38 digits
    candidates = both.filter(F.size("words") >= 2)
    covered = F.lit(100).cast("decimal(3,0)") * exact(F.greatest("head_longer", "tail_longer")) >= F.lit(share).cast("decimal(3,0)") * exact(F.col("f"))
    k = F.size("words")

    def cut(i: int) -> Column:
        l, r = F.get("head", F.lit(i)), F.get("tail", k - i)
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * exact(F.col("f")), exact(l) + exact(r))
        return F.when(k > i, F.struct(score.alias("score"), F.lit(i).alias("k"), l.alias("l"), r.alias("r")))

    best = candidates.filter(~covered).withColumn("cut", F.array_min(F.array_compact(F.array(*[cut(i) for i in range(1, LONGEST)]))))
    scored = best.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", F.get("head", F.lit(0)).alias("n"), "cut.score")
    # The best of every share of a language first, so that no task ranks a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = scored.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = shares.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).filter(F.col("_k") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of two to four words of each language in `documents`."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
  numbered AS (SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
  tokens AS (SELECT lang, p, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM numbered),
  sizes AS (SELECT lang, count(*) AS n FROM tokens GROUP BY lang),
  ahead AS (SELECT lang, w AS a, lead(w, 1) OVER v AS b, lead(w, 2) OVER v AS c, lead(w, 3) OVER v AS d FROM tokens WINDOW v AS (PARTITION BY p ORDER BY i)),
  f AS (SELECT lang, 1 AS k, [a] AS g, count(*) AS f FROM ahead GROUP BY lang, a HAVING count(*) >= 30
    UNION ALL SELECT lang, 2, [a, b], count(*) FROM ahead WHERE b IS NOT NULL GROUP BY lang, a, b HAVING count(*) >= 30
    UNION ALL SELECT lang, 3, [a, b, c], count(*) FROM ahead WHERE c IS NOT NULL GROUP BY lang, a, b, c HAVING count(*) >= 30
    UNION ALL SELECT lang, 4, [a, b, c, d], count(*) FROM ahead WHERE d IS NOT NULL GROUP BY lang, a, b, c, d HAVING count(*) >= 30),
  parts AS (SELECT lang, f, g[i:i + m - 1] AS g FROM f, range(2, 4) s(m), range(1, 4) p(i) WHERE m < k AND i + m - 1 <= k),
  most AS (SELECT lang, g, max(f) AS longer FROM parts GROUP BY ALL),
  cuts AS (SELECT c.lang, c.g, c.f AS a, j, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score FROM f c JOIN range(1, 4) t(j) ON j < c.k
    JOIN f l ON l.lang = c.lang AND l.g = c.g[1:j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j + 1:c.k]),
  weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS best FROM cuts),
  kept AS (SELECT weakest.lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM weakest LEFT JOIN most USING (lang, g) WHERE best = 1 AND (longer IS NULL OR 100 * longer < 80 * a)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
  SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""
