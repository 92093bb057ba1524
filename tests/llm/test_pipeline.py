"""Stages of the pipeline on the small tables, each held against a brute-force version of its decision."""

import re

import pytest

import corpus_pipeline
from lodestar.llm import common
from lodestar.llm.toxicity import LEXICON
from tests.llm.test_operators import check_packing, secrets, shingle_set
from tests.llm.test_simhash_wide import classes

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    toxic = set(spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").toPandas().doc_id)
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialize(stage(spark, docs, SF), name)
        rows = after.toPandas()
        if name == "toxicity":
            gone = set(before.doc_id) - set(rows.doc_id)
            # Some labels of 1 stand on texts without any sign of it; of the texts with an insult all must go.
            shown = {i for i, t in zip(before.doc_id, before.text) if i in toxic and LEXICON & set(re.findall(r"\w+", t.lower()))}
            assert len(shown) > 30 and len(shown & gone) > 0.95 * len(shown) and len(gone) < 0.12 * len(before)
        elif name == "near_duplicates":
            ids = list(before.doc_id)
            least = {}
            for i, c in zip(ids, classes(list(before.text))):
                least[c] = min(i, least.get(c, i))
            kept, wanted = set(rows.doc_id), set(least.values())
            assert wanted <= kept and len(kept - wanted) <= 0.03 * (len(ids) - len(wanted)) + 1
        elif name == "decontamination":
            items = [shingle_set(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
            kept = {i for i, t in zip(before.doc_id, before.text) if (s := shingle_set(t)) is not None and not any(q and len(q & s) >= 0.8 * len(q) for q in items)}
            assert set(rows.doc_id) == kept
        elif name == "secrets":
            assert set(rows.doc_id) == set(before.doc_id) and all(secrets(t)[:3] == (0, 0, 0) for t in rows.text)
        else:
            check_packing(rows, dict(zip(before.doc_id, before.text)))
        if name != "packing":
            assert after.columns == columns
        docs, before = after, rows


CLASHING = "content string, copy string, toxic int, text_sha string, leaked int, blob_of_text string, marks_of_blob string, __blob string, __marks string, blob string, s string, node string, key string, item int"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, name):
    """Null ids and texts, repeated rows, ties, one very long text and columns with the names the stages use."""
    long = "A quiet river runs past many old mills and towns without end. " * 20_000
    rows = [(None, None), (None, "a text of its own with enough words to stand alone"), (1, ""), (2, long), (3, "token=abcdef0123 and more words stand here"), (3, "token=abcdef0123 and more words stand here"), (4, " \n"), (4, "other text under the same id as the blank one")]
    extra = [x.split()[1] for x in CLASHING.split(", ")]
    frame = spark.createDataFrame([(i, t, None, None, None, *["v" if k == "string" else 1 for k in extra]) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(2)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, frame, SF).collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {None, 1, 2, 3, 4} and sum(r["length"] for r in got if r["doc_id"] == 1) == 1
    else:
        kept = [(r["doc_id"], r["text"]) for r in got]
        assert got[0].asDict().keys() == set(frame.columns)
        if name == "near_duplicates":  # texts without a word are one class, of which the smallest id stays
            assert sorted(x[0] or 0 for x in kept) == [0, 1, 2, 3, 3, 4]
        else:
            assert len(kept) == len(rows)
        if name == "secrets":
            assert [t for i, t in kept if i == 3] == ["[REDACTED] and more words stand here"] * 2
    empty = stage(spark, frame.limit(0), SF)
    assert empty.count() == 0 and (name == "packing" or empty.columns == frame.columns)
