"""Collocations against a plain version; parts of the ordered stream of one row and more; slices of any size."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import collocations as co
from lodestar.llm import grams

STREAM = "lang string, words array<string>, f long"
SCHEMA = "doc_id long, text string, lang string, f string, words string, head string"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", low)]


def plain_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, 5):
                for i in range(len(p) - k + 1):
                    f[lang, tuple(p[i:i + k])] += 1
    return f, n


def plain(rows, least, share, top):
    f, n = plain_counts(rows)
    candidates = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inner = {}
    for (lang, words), v in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner[lang, words[i:i + k]] = max(inner.get((lang, words[i:i + k]), 0), v)
    out = {}
    for (lang, words), a in candidates.items():
        if 100 * inner.get((lang, words), 0) >= share * a and (lang, words) in inner:
            continue
        score, k = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
        out.setdefault(lang, []).append((" ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    return sorted((lang, rank, *r) for lang, found in out.items() for rank, r in enumerate(sorted(found, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top], 1))


def some_rows(seed, n):
    r = random.Random(seed)
    vocabulary = ["The", "of", "a\x01b", "Éa", "éa", "x", "y", "z", "漢字", "w-1", " "]
    glue = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\x0b", "?"]
    text = lambda: "".join(r.choice(vocabulary) + r.choice(glue) for _ in range(r.randint(0, 60)))
    return [(r.choice(["en", "fr", "und", None]), text()) for _ in range(n)] + [("en", "new york city " * 9), ("en", None), (None, ""), ("de", "nur hier"), ("en", "tie one. tie one. tie two. tie two.")]


@pytest.mark.parametrize("least,share,top", [(5, 80, 2000), (3, 50, 7), (2, 100, 2000)])
def test_against_plain(spark, least, share, top):
    rows = some_rows(least, 120)
    docs = spark.createDataFrame([(i, t, lang, "f", "w", "h") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(6)
    got = [tuple(r) for r in co.collocations(docs, least, share, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == plain(rows, least, share, top)


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    """With a bitmap in which every bit is set, only counts decide."""
    rows = some_rows(9, 80)
    docs = spark.createDataFrame([(i, t, lang, "f", "w", "h") for i, (lang, t) in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(co, "frequent_bits", lambda *a: co.np.full(co.BITS // 8, 255, co.np.uint8))
    found = {(r["lang"], tuple(r["words"])): r["f"] for r in co.phrase_counts(docs, 4).collect()}
    f, n = plain_counts(rows)
    assert {k: v for k, v in found.items() if k[1]} == {k: v for k, v in f.items() if v >= 4}
    assert {k[0]: v for k, v in found.items() if not k[1]} == {k: v for k, v in n.items() if v}


@pytest.mark.parametrize("parts", [1, 5, 300])
def test_parts_may_end_anywhere(spark, parts):
    """The merge over one part, and over many parts of about a row: prefixes and longer phrases lie in other parts."""
    f, n = plain_counts(some_rows(4, 60))
    stream = [(lang, [], v) for lang, v in n.items() if v] + [(lang, list(w), v) for (lang, w), v in f.items() if v >= 3]
    frame = spark.createDataFrame(stream, STREAM).repartition(4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        for order, name in ((F.col("words"), "head"), (F.reverse("words"), "tail")):
            for r in co.merged_in_order(frame, order, name).collect():
                w, lang = tuple(r["words"]), r["lang"]
                side = (lambda d: w[:d]) if name == "head" else (lambda d: w[len(w) - d:])
                assert [r[name][d] for d in range(len(w))] == [n[lang] if d == 0 else f[lang, side(d)] for d in range(len(w))]
                longer = [v for (g, x), v in f.items() if g == lang and v >= 3 and len(x) == len(w) + 1 and (x[:-1] if name == "head" else x[1:]) == w]
                assert r[f"{name}_longer"] == max(longer, default=0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", [1, 9, 100, 1 << 20])
def test_slices_change_nothing(size):
    texts = ["one two three four five. six " * 20, "ab " * 200, "x" * 300 + " y", "", "p, q r\ts"]
    found = Counter()
    langs = pa.array(["en"] * len(texts)).dictionary_encode()
    for words in grams.word_slices(pa.array(texts), co.KINDS, co.LONGEST - 1, size):
        if words.own:
            s = co._Slice(words, langs)
            for k in range(1, 5):
                for batch in s.rows(*s.counted(s.starts(k), k)):
                    for r in batch.to_pylist():
                        found["en", tuple(r["phrase"].split(" "))] += r["f"]
    assert found == plain_counts([("en", t) for t in texts])[0]


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 9_000_000_000_000_007
    stream = [("en", [], 4 * big), ("en", ["a"], big), ("en", ["b"], big + 2), ("en", ["a", "b"], big - 1)]
    monkeypatch.setattr(co, "phrase_counts", lambda docs, least: spark.createDataFrame(stream, STREAM))
    row = co.collocations(spark.createDataFrame([], SCHEMA)).collect()[0]
    assert row["score"] == 2_000_000 * (big - 1) // (2 * big + 2)


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
