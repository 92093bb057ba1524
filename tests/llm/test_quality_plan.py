"""Measured counts may be filtered: the plan holds what they are made of once."""

from lodestar.llm import quality

TEXT = "A line of plain words that says something.\n" * 8


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_copies_nothing(spark):
    docs = spark.createDataFrame([(i, TEXT + f"and number {i}") for i in range(50)] + [(99, None)], "doc_id long, text string")
    plain, kept = (plan(quality.quality_cascade(docs).select("doc_id", "n_repeat_words", "kept")), plan(quality.quality_cascade(docs).filter("kept AND n_repeat_words >= 0").select("doc_id", "n_repeat_words", "kept")))
    for costly in ("split(", "array_sort(", "sort_array(", "aggregate(", "xxhash64("):
        assert plain.count(costly) == kept.count(costly), costly
    assert len(kept) < 2 * len(plain)
    assert quality.quality_cascade(docs).filter("kept").count() + quality.quality_cascade(docs).filter("NOT kept").count() == 51


def test_the_plan_of_a_cascade_is_quick(spark):
    import time

    docs = spark.createDataFrame([(i, TEXT * (i % 5)) for i in range(2000)], "doc_id long, text string").repartition(4)
    quality.plan_cascade(docs.limit(10))
    began = time.perf_counter()
    assert sorted(r.name for r in quality.plan_cascade(docs)) == sorted(r.name for r in quality.RULES)
    assert time.perf_counter() - began < 15
