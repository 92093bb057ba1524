"""The digest against a plain version of its selection and filters, and what its likeness tells apart."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import rare_digest as rd

SCHEMA = "doc_id long, text string, part string, edge string, n_chars string"


def plain_levels(data: bytes):
    scale = lambda c: round(c * math.log2(c) * (1 << 20)) if c else 0
    most = scale(rd.WIDTH)
    return [(rd.LEVELS - 1) * (most - sum(map(scale, Counter(data[i:i + rd.WIDTH]).values()))) // most for i in range(len(data) - rd.WIDTH + 1)]


def plain_chain(data: bytes, ranks):
    if not data:
        return []
    if len(data) < rd.WIDTH:
        chosen = [data.ljust(rd.WIDTH, b"\xff")]
    else:
        ranked = [int(ranks[x]) for x in plain_levels(data)]
        wins = Counter()
        for first in range(-rd.RUN + 1, len(ranked)):
            run = range(max(0, first), min(len(ranked), first + rd.RUN))
            wins[min(run, key=lambda i: (ranked[i], i))] += 1
        chosen = [data[i:i + rd.WIDTH] for i in range(len(ranked)) if wins[i] >= rd.WINS]
    hashes = list(dict.fromkeys(int(h) for h in rd.feature_hashes(np.frombuffer(b"".join(chosen), np.uint8).reshape(-1, rd.WIDTH))))
    out = []
    for at in range(0, len(hashes), rd.FILTER_FEATURES):
        part = hashes[at:at + rd.FILTER_FEATURES]
        out.append((len(part), sorted({h >> 11 * k & 2047 for h in part for k in range(rd.HASHES)})))
    return out


def opened(chain):
    return [(n, np.flatnonzero(np.unpackbits(bits)).tolist()) for n, bits in chain]


def some_texts(seed, n, most):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghiéß ") for _ in range(r.randint(2, 9))) for _ in range(80)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("segment,group", [(1 << 18, 2 << 20), (50, 300), (7, 1)])
def test_chains_against_plain(monkeypatch, segment, group):
    monkeypatch.setattr(rd, "SEGMENT", segment)
    monkeypatch.setattr(rd, "TEXTS_AT_ONCE", group)
    monkeypatch.setattr(rd, "BLOCK", 97)
    texts = [t.encode() for t in [*some_texts(1, 12, 60), "", "x", "a" * 31, "a" * 32, "a" * 33, "a" * 700, "ab" * 300, "line of text\n" * 40]]
    ranks = rd.rarity_ranks(np.random.default_rng(3).integers(0, 9, rd.LEVELS))
    assert [opened(c) for c in rd.chains(texts, ranks)] == [plain_chain(t, ranks) for t in texts]


def test_long_chain_has_several_filters():
    texts = [" ".join(some_texts(2, 60, 150)).encode()]
    ranks = np.arange(rd.LEVELS)
    chain = rd.chains(texts, ranks)[0]
    assert len(chain) > 2 and opened(chain) == plain_chain(texts[0], ranks)
    assert rd.as_text(rd.from_text(rd.as_text(chain))) == rd.as_text(chain)


def test_likeness_is_symmetric_and_bounded():
    ranks = np.arange(rd.LEVELS)
    chains = rd.chains([t.encode() for t in [*some_texts(4, 10, 300), "", "short"]], ranks)
    for a in chains:
        assert rd.likeness(a, a) == 1.0
        for b in chains:
            assert 0.0 <= rd.likeness(a, b) == rd.likeness(b, a) <= 1.0
    assert rd.likeness([], []) == 1.0 and rd.likeness([], chains[0]) == 0.0


def plain(rows):
    """The same columns in one loop over the sorted rows."""
    from lodestar.llm.grams import xxhash64

    texts = [(i, t or "") for i, t in rows]
    h = lambda t: int(xxhash64(np.frombuffer(t.encode() or b"\0", np.uint8), np.array([0]), np.array([len(t.encode())])).astype(np.int64)[0])
    texts.sort(key=lambda r: (r[0] is not None, r[0] or 0, h(r[1])))
    counts = np.zeros(rd.LEVELS, np.int64)
    for _, t in texts:
        for level in plain_levels(t.encode()):
            counts[level] += 1
    ranks = rd.rarity_ranks(counts)
    out = []
    for k, (i, t) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        cut = len(t) // 4
        new = (t[:len(t) - cut] + following[:cut]).encode()
        own, changed, other = rd.chains([t.encode(), new, following.encode()], ranks)
        out.append((i, len(t), hashlib.sha256(new).hexdigest(), rd.as_text(own), rd.as_text(changed), rd.likeness(own, changed), rd.likeness(own, other)))
    return out


def test_query_against_plain(spark):
    texts = some_texts(5, 90, 120)
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(None, "no id " * 30), (1, None), (1, ""), (6, texts[0]), (6, texts[0]), (400, "日本語のテキスト" * 60)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "p", "e", "n") for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in rd.fingerprints(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_single_row_and_empty_table(spark):
    one = rd.fingerprints(spark.createDataFrame([(5, "a single text " * 20, "", "", "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert rd.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


def test_edits_stay_near_and_neighbours_far(spark):
    rows = rd.op12_rare_digest(spark, "/root/testdata/sf0.001").collect()
    long = [r for r in rows if r["n_chars"] >= 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.5
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.95
    assert np.mean([r["near_next"] for r in long]) < 0.1
