"""The stage's similarity join: recall against all pairs, hot keys, edges."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lodestar.llm import simhash
from tests.llm.test_operators import components as by_bits


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def classes(texts, similarity=0.8):
    """Smallest index of each text's component under exact similarity of all pairs."""
    sets, parent, holders = [shingles(t) for t in texts], list(range(len(texts))), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for q in s:
            holders.setdefault(q, []).append(i)
    for i, s in enumerate(sets):
        for j in {k for q in s for k in holders[q] if k < i}:
            shared = len(s & sets[j])
            if shared >= similarity * (len(s) + len(sets[j]) - shared) - 1e-9 and (p := root(i)) != (q := root(j)):
                parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(len(texts))]


def test_recall_on_a_table(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    got = simhash.similar_documents(spark.createDataFrame(docs)).toPandas().set_index("doc_id")["class"]
    truth = dict(zip(docs.doc_id, classes(list(docs.text))))
    pairs = [(i, docs.doc_id[c]) for i, c in truth.items() if docs.doc_id[c] != i]
    assert len(pairs) > 30 and sum(got[i] == got[c] for i, c in pairs) >= 0.97 * len(pairs)
    mine = {}
    for i, c in got.items():
        mine.setdefault(c, set()).add(truth[i])
    assert all(len(x) == 1 for x in mine.values())  # nothing is linked that exact similarity does not link


def test_recall_near_the_threshold(spark):
    """Copies with as many words changed as the similarity allows."""
    rng = random.Random(2)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        copy = list(words)
        for at in rng.sample(range(0, 200, 7), 4):  # 20 of 196 shingles: similarity 0.81
            copy[at] = "x" + copy[at]
        texts += [" ".join(words), " ".join(copy)]
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")["class"]
    assert sum(got[i] == got[i + 1] for i in range(0, 300, 2)) >= 0.9 * 150 and len(set(got)) <= 300 - 135


@pytest.mark.parametrize("hot", [8, 4096])
def test_hot_keys_lose_no_link(spark, hot):
    """Keys over the limit are compared block by block with the same components."""
    rng = np.random.default_rng(7)
    fps, at = set(), 12345678901234567
    for _ in range(300):
        fps.add(at)
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            at ^= 1 << int(b)
        if rng.random() < 0.5:
            at = 12345678901234567
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.linked_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), hot).collect()
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        parent[max(root(a), root(b))] = min(root(a), root(b))
    truth = by_bits(dict(zip(signed, fps)))
    assert all((root(a) == root(b)) == (truth[a] == truth[b]) for a in signed for b in signed[:60])


def test_one_of_each_group_stays(spark, edge_docs):
    kept = simhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    # 1, 2 and 3 have no word and are one class; both rows of 5 are one document
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 5, 6, 7, 8]
    assert simhash.drop_near_duplicates(spark.createDataFrame([], edge_docs.schema)).count() == 0
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "h i j k l m"), (3, "n o p q r s"), (2, "h i j k l m")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "a b c d e f g"), (0, "a b c d e f g"), (2, "h i j k l m"), (3, "n o p q r s")]


def joined(spark, run):
    """Rows out of the joins of each kind, in all that ``run`` executes."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    run()
    bus.waitUntilEmpty()
    made, executions = Counter(), store.executionsList()
    for e in (executions.apply(i).executionId() for i in range(executions.size())):
        if e in before:
            continue
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    made[re.sub(r"^\w+(?=Join[ (])|#\d+L?|, \[plan_id.*|, Build\w+", "", node.desc())] += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return made


def test_a_candidate_is_carried_once(spark, monkeypatch):
    """A family of near copies, most pairs of which are not alike: no join makes more rows than there are candidates."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(200):
        copy = list(base)
        for at in rng.sample(range(0, 150, 6), rng.choice([1, 4, 6])):
            copy[at] = f"x{rng.randrange(9000)}"
        texts.append(" ".join(copy))
    count, keep = {}, simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: count.setdefault(name, keep(df, name)) if name == "candidates" else keep(df, name))
    got = {}
    made = joined(spark, lambda: got.update(simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")["class"]))
    candidates = count["candidates"].count()
    assert candidates > 5 * len(texts) and made and max(made.values()) <= candidates, (candidates, made.most_common(3))
    # What exact similarity does not link stays apart.
    truth = classes(texts)
    assert len({truth[i] for i in range(200)}) > 20 and all(truth[i] == truth[j] for i in range(200) for j in range(i) if got[i] == got[j])
