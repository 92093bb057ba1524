"""Importance resampling against a plain version in Python, and its table of n-grams by itself."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodestar.llm import grams, resample

SCHEMA = "doc_id long, text string, rank string, score string, _at long, n_words long"
TEXTS = ["The cat sat on the mat.", "the CAT; the dog, 12 dogs!", None, "", "...", "Été déjà vu 漢字 漢字", " ".join(f"w{i % 7}" for i in range(25)), "a\x00b\tc" * 9, "mat " * 40]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, max_n):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, max_n, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, max_n))
    t = Counter(bucket(f) for x in target for f in features(x, max_n))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text in rows:
        found = features(text, max_n)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ranked = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for k, r in enumerate(ranked[:len(ranked) * percent // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("max_n", [1, 3])
def test_against_plain(spark, max_n):
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else " ".join(f"x{i * j % 11}" for j in range(i % 50))) for i in range(200)] + [(None, "the null " * 30), (7, "same id " * 30), (7, "same id " * 30)]
    target = ["the cat sat", None, "déjà vu", "w1 w2 w3 w4"]
    docs = spark.createDataFrame([(i, t, "r", "s", 1, 2) for i, t in rows], SCHEMA)
    aimed = spark.createDataFrame([(t,) for t in target], "text string")
    gain = resample.gains(resample.feature_counts(docs, max_n), resample.feature_counts(aimed, max_n))
    got = [tuple(r) for r in resample.draw(resample.importance_weights(docs, gain, max_n)).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=str) == plain(rows, target, max_n)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    gain = resample.gains(resample.feature_counts(none), resample.feature_counts(none))
    assert set(gain.tolist()) == {0}
    assert resample.draw(resample.importance_weights(none, gain)).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_slices_change_nothing(size, max_n):
    texts = [*TEXTS, "long " * 300 + "x" * 500, "é" * 100]
    found = []
    for w in grams.word_slices(pa.array(texts), resample.KINDS, max_n - 1, size):
        data, start, length, row = resample.gram_spans(w, max_n)
        found += [(int(r), data[s:s + n].tobytes().decode()) for s, n, r in zip(start, length, row)]
    assert sorted(found) == sorted((i, f) for i, t in enumerate(texts) for f in features(t, max_n))


def test_hash_is_xxh64():
    raw = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8)
    length = np.array([n for n in range(150) for _ in range(3)])
    start = np.arange(len(length)) * 7
    assert grams.xxhash64(raw, start, length).tolist() == [xxhash.xxh64_intdigest(raw[s:s + n].tobytes(), 42) for s, n in zip(start.tolist(), length.tolist())]


@pytest.mark.parametrize("keys", [lambda n: np.zeros(n, np.uint64), lambda n: np.full(n, 2**64 - 1, np.uint64)])
def test_equal_keys_are_told_apart_by_their_bytes(monkeypatch, keys):
    monkeypatch.setattr(resample, "xxhash64", lambda data, start, length: keys(len(start)))
    text = " ".join([f"word{i % 17}" for i in range(60)] + ["aaaaaaaab", "aaaaaaaac", "aaaaaaaab"])
    w = next(grams.word_slices(pa.array([text]), resample.KINDS))
    data, start, length, _ = resample.gram_spans(w, 1)
    table = resample.GramTable(data, start, length, 10_000)
    seen = {}
    for word, slot in zip(text.split(), table.slot.tolist()):
        assert seen.setdefault(word, slot) == slot
    assert len(set(seen.values())) == len(seen)
    assert {w: int(table.count[s]) for w, s in seen.items()} == Counter(text.split())
    assert {w: int(table.bucket[s]) for w, s in seen.items()} == {w: zlib.crc32(w.encode()) % 10_000 for w in seen}
