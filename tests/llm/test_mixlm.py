"""The mixing model against exact dictionaries of contexts, and its held-out bits a byte."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixlm

SF = "/root/testdata/sf0.01"
TRAIN = ["the cat sat on the mat 12345", "the cat ran 12399; def f(x): return x[1]", "где находится кот", "кот на столе 漢字 12345", "a\0b c"]
OTHER = ["the cat 12345", "где кот", "漢字 f(x)", "", "a\0b", "x" * 130 + " the cat"]


def _contexts(text):
    data = bytes(5) + text.encode() + mixlm.END
    for i in range(5, len(data)):
        yield [data[i - o:i] for o in range(1, 6)]


def _logit(counts, byte, place):
    same = other = 0
    for b, n in counts.items():
        if b >> (8 - place) == byte >> (8 - place):
            hit = b >> (7 - place) == byte >> (7 - place)
            same, other = same + n * hit, other + n * (not hit)
    return np.rint(mixlm.SCALE * np.clip(np.log((same + mixlm.PRIOR) / (other + mixlm.PRIOR)), -mixlm.CLIP, mixlm.CLIP)) / mixlm.SCALE


def _cost(text, table, weights):
    """Both layers, byte by byte, in the plainest way."""
    total, second, change = 0.0, np.ones((2, 8)), np.zeros((2, 8))
    for i, (byte, found) in enumerate(zip(text.encode() + mixlm.END, _contexts(text))):
        if i % mixlm.STEP == 0:
            second, change = second + mixlm.SECOND_RATE * change, np.zeros((2, 8))
        for place in range(8):
            x = np.array([_logit(table[c], byte, place) for c in found])
            gate = max((o for o in range(1, 6) if x[o - 1] != 0), default=0)
            terms = weights[gate, place] * x
            s = np.rint(mixlm.FINE * np.array([terms[4], terms[:4].sum()])) / mixlm.FINE
            z = second[:, place] @ s
            total += np.log1p(np.exp(-z))
            change[:, place] += s / (1 + np.exp(z))
    return total


def test_scores_are_those_of_exact_contexts(spark, monkeypatch):
    """All eight bits of digits, punctuation, NUL and non-Latin bytes are told by the contexts; the weights here are not learned."""
    monkeypatch.setattr(mixlm, "_learn_weights", lambda *_: mixlm.flat_weights())
    docs = spark.createDataFrame([(i, t, i >= len(TRAIN)) for i, t in enumerate(TRAIN + OTHER)], "doc_id long, text string, other boolean")
    got = {r["doc_id"]: r["score"] for r in mixlm.score_texts(docs.repartition(3), F.col("other")).collect()}
    table = defaultdict(Counter)
    for t in TRAIN:
        for byte, found in zip(t.encode() + mixlm.END, _contexts(t)):
            for c in found:
                table[c][byte] += 1
    for i, t in enumerate(TRAIN + OTHER):
        assert got[i] == pytest.approx(-_cost(t, table, mixlm.flat_weights()) / np.log(10), rel=1e-4)


def _model(texts, kinds, scored):
    """A mixer with learned weights over all of ``texts`` in one block, without Spark."""
    import pyarrow as pa

    block = mixlm.Block()
    for t, k in zip(texts, kinds):
        block.add(t, k)
    rows = [(0, s, mixlm.pack_keys(k), mixlm._pack(n)) for s, k, n in block.cells(3)]
    own = pa.table([pa.array(x, y) for x, y in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "shard", "keys", "counts"])
    answers = pa.concat_tables([mixlm._answer(own.slice(i, 1)) for i in range(own.num_rows)])
    cells = [mixlm.Cells(answers.column(f"{x}keys").to_pylist(), answers.column(f"{x}logits").to_pylist()) for x in ("tuned_", "")]
    weights, seen = mixlm.tune([t for t, k in zip(texts, kinds) if k == mixlm.TUNED], cells[0])
    return mixlm.Mixer(cells[1], np.where(seen[:, :, None] > 0, weights, mixlm.flat_weights()))


def test_next_bytes_sum_to_one():
    """After a context, the chances of all 256 bytes (each with the end mark's own cost taken off) are a distribution."""
    ends = [b"the ca" + bytes([x]) for x in range(256)]
    texts = [t.encode() for t in TRAIN * 4] + [b"the ca"] + ends
    kinds = [mixlm.TUNED if i % 5 == 2 else mixlm.COUNTED for i in range(4 * len(TRAIN))] + [mixlm.OTHER] * (len(ends) + 1)
    m = _model(texts, kinds, ends)
    data = np.array([list(bytes(5) + t) for t in ends], np.uint8)
    z = m.terms[:, m.cells.find(data)[:, -1]].sum(axis=0) / mixlm.FINE
    assert np.exp(-np.log1p(np.exp(-z)).sum(axis=1)).sum() == pytest.approx(1.0, abs=1e-4)


def test_better_than_counts_of_three_bytes(spark):
    """Held-out bits a byte on a table: under 2.2, and 0.2 under smoothed counts after three bytes."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i in docs.doc_id]
    after, seen, bits, size = defaultdict(Counter), defaultdict(Counter), 0.0, 0
    for t, h in zip(docs.text, out):
        data = bytes(3) + (t or "").encode()
        if not h:
            for i in range(3, len(data)):
                for o in range(4):
                    after[data[i - o:i]][data[i]] += 1
    for t, h in zip(docs.text, out):
        data = bytes(3) + (t or "").encode()
        if h:
            for i in range(3, len(data)):
                p = 1 / 256
                for o in range(4):  # each order is interpolated with the shorter one
                    c = after.get(data[i - o:i])
                    if c:
                        p = (c[data[i]] + 2 * p) / (c.total() + 2)
                bits -= np.log2(p)
                size += 1
    got = mixlm.score_texts(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("n_bytes")).first()
    mine = -got[0] / np.log10(2) / got[1]
    print('bits a byte', mine, bits / size)
    assert got[1] == size and mine < 2.2 and mine < bits / size - 0.2


def test_contexts_grow_with_the_corpus():
    """Different contexts of five bytes share no cell, however many there are."""
    text = np.random.default_rng(3).integers(97, 123, 300_000).astype(np.uint8).tobytes()
    keys = mixlm.byte_keys(np.frombuffer(text, np.uint8))
    assert len(np.unique(keys >> np.uint64(8))) == len({text[i:i + 5] for i in range(len(text) - 5)}) > 4 << 16


def test_slices_change_nothing(monkeypatch):
    """A long text that passes through in slices costs what it costs at once."""
    texts = [re.sub("x", "y", "the cat sat on thematwithalongword " * 60).encode(), b"the cat", "где кот ".encode() * 90]
    kinds = [mixlm.COUNTED, mixlm.TUNED, mixlm.COUNTED]
    whole = _model(texts, kinds, texts).costs(texts)
    monkeypatch.setattr(mixlm, "SLICE", 256)
    assert _model(texts, kinds, texts).costs(texts) == pytest.approx(whole, rel=1e-5)
