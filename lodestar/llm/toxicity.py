"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text are rates and counts: hits of two lexicons (a fixed one and one learned from the
labels), hits near a second person, capitals, punctuation, and obfuscated spellings. Trees are boosted on
the labelled rows outside the held-out fold; a fifth of these rows is kept back for the isotonic step, and
neither the learned words nor the trees see it. Equal margins become one weighted row before that step, so its
sort spreads however often a margin occurs.

At most MAX_LABELLED labelled rows, taken by hash, are used for fitting; all documents are scored.

Edge cases: a null or empty text has zero for every feature and gets the score of that point; labels of
missing documents or with a null are ignored; with one class or under MIN_LABELLED rows the base rate is every
score; repeated rows are scored each on their own; a very long text is read in one pass of its task; a null
doc_id is scored and counts as not held out; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fresh

MAX_LABELLED, MIN_LABELLED = 20_000, 20
#: A learned word is in LEAST_DOCS texts of label 1 and in LEAST_SHARE of them, whichever is more.
LEARNED_WORDS, LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 200, 5, 0.01, 8.0
NEAR = 5

#: Insults in common use.
LEXICON = frozenset("idiot idiots moron morons stupid clown scum trash loser losers pathetic worthless disgusting dumb fool fools imbecile jerk creep filth garbage vermin freak ugly hate".split())
#: Second person in the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te ti tus usted ustedes vous votre vos toi ton ta tes".split())
_MARKS = frozenset("@$*!|0123456789")
_ENDS = ".,;:!?\"'()[]"
_WORD = re.compile(r"[^\W\d_]+")
_LEET = str.maketrans("013457@$!|", "oieastasil")
_JUNK = re.compile(r"[\W_]+")

FEATURES = ("n_words", "fixed_rate", "fixed_count", "fixed_kinds", "learned_rate", "learned_count", "learned_kinds", "near_rate", "near_count", "capital_rate", "mark_rate", "exclaim_rate", "masked_rate", "masked_hits")


def features(text: str | None, learned: frozenset[str]) -> tuple[float, ...]:
    """The values of FEATURES, in that order."""
    if not text:
        return (0.0,) * len(FEATURES)
    low = text.lower()
    words = _WORD.findall(low)
    n, size = max(1, len(words)), len(text)
    either = LEXICON | learned
    at = [i for i, w in enumerate(words) if w in either]
    fixed = [w for i in at if (w := words[i]) in LEXICON]
    found = [w for i in at if (w := words[i]) in learned]
    near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR):i + NEAR + 1]) for i in at)
    cores = [c for w in low.split() if not w.isalpha() and not (c := w.strip(_ENDS)).isalpha()]
    masked = [c for c in cores if not _MARKS.isdisjoint(c) and any(map(str.isalpha, c))]
    hits = sum(_JUNK.sub("", x.translate(_LEET)) in either for x in masked)
    capitals = sum(a != b for a, b in zip(text, low)) if len(low) == size and not text.islower() else 0
    exclaims = text.count("!")
    marks = exclaims + sum(text.count(c) for c in "?*#$%&@")
    return (float(len(words)), len(fixed) / n, float(len(fixed)), float(len(set(fixed))), len(found) / n, float(len(found)), float(len(set(found))),
            near / n, float(near), capitals / size, marks / size, exclaims / size, len(masked) / n, float(hits))


def with_features(docs: DataFrame, learned: frozenset[str], keep: list[str]) -> DataFrame:
    """``keep`` columns and one double per feature; a map over rows."""
    kinds = dict(docs.dtypes)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = pd.DataFrame([features(x, learned) for x in batch["text"]], columns=FEATURES, dtype=float)
            yield pd.concat([batch[keep].reset_index(drop=True), values], axis=1)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{f} double" for f in FEATURES)])
    return docs.select(*keep, "text").mapInPandas(measure, schema)


def fold(parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, y) of at most about ``most`` labelled rows outside the held-out fold, chosen by hash."""
    usable = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold(5) != 0).select("doc_id", F.col("toxic").cast("double").alias("y"))
    share = min(1.0, most / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learn_words(sample: DataFrame) -> frozenset[str]:
    """At most LEARNED_WORDS words whose odds under label 1 are LEAST_ODDS times those under label 0."""
    words = sample.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("w"))
    totals = sample.groupBy().agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).first()
    if not totals["t"] or not totals["c"]:
        return frozenset()
    counts = words.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter(F.col("a") >= max(LEAST_DOCS, LEAST_SHARE * totals["t"]))
    odds = ((F.col("a") + 0.5) / totals["t"]) / ((F.col("b") + 0.5) / totals["c"])
    top = counts.select("w", odds.alias("odds"), "a").filter(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("a"), "w").limit(LEARNED_WORDS)
    return frozenset(r["w"] for r in top.collect())


def fit(docs: DataFrame, labels: DataFrame):
    """(assembled -> scored) function and the learned words, or the base rate if there is too little to learn."""
    sample = labelled_sample(docs, labels).persist()
    try:
        rows = sample.count()
        rate = sample.agg(F.avg("y")).first()[0] if rows else None
        if rows < MIN_LABELLED or rate in (0.0, 1.0):
            return None, frozenset(), 0.0 if rate is None else rate
        held = fold(5) == 1
        learned = learn_words(sample.filter(~held))
        # One order of rows whatever their files: the trees' thresholds and sums depend on it.
        table = with_features(sample, learned, ["doc_id", "y"]).repartition(4, "doc_id").sortWithinPartitions("doc_id", "y", *FEATURES)
        dense = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(table).select("doc_id", "y", "x").persist()
        try:
            trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=15, maxDepth=3, seed=7, maxBins=32).fit(dense.filter(~held))
            margins = trees.transform(dense.filter(held)).select("y", vector_to_array("rawPrediction")[1].alias("margin"))
            if not margins.head(1):
                margins = trees.transform(dense).select("y", vector_to_array("rawPrediction")[1].alias("margin"))
            points = margins.groupBy("margin").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("weight"))
            steps = IsotonicRegression(featuresCol="margin", labelCol="y", weightCol="weight", predictionCol="score").fit(points)
        finally:
            dense.unpersist()
        return (trees, steps), learned, rate
    finally:
        sample.unpersist()


def score_toxicity(docs: DataFrame, labels: DataFrame, keep=None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, and ``kept``, an expression of its row, if one is given."""
    model, learned, rate = fit(docs, labels)
    more = [] if keep is None else ["kept"]
    docs = docs.select("doc_id", "text", *([] if keep is None else [keep.alias("kept")]))
    if model is None:
        scored = docs.select("doc_id", *more, F.lit(float(rate)).alias("score"))
    else:
        trees, steps = model
        table = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(with_features(docs, learned, ["doc_id", *more]))
        scored = steps.transform(trees.transform(table).select("doc_id", *more, vector_to_array("rawPrediction")[1].alias("margin")))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select("doc_id", *more, F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted toxic; columns stay, whatever their names.

    Rows go by id and text together, so rows that share an id are judged each by its own text, and a row with a
    null id goes if its text is toxic. A null or empty text gets the score of no features; an empty table stays empty.
    """
    mine, other = fresh(docs, "content"), fresh(docs, "toxic")
    content = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    toxic = score_toxicity(docs, labels, keep=content).filter("predicted = 1").select(F.col("doc_id").alias(other), F.col("kept").alias(f"{other}_content")).distinct()
    rows = docs.withColumn(mine, content)
    return rows.join(toxic, rows["doc_id"].eqNullSafe(toxic[other]) & (rows[mine] == toxic[f"{other}_content"]), "left_anti").drop(mine)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
