"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``measure`` derives per-document counts; ``plan_cascade`` estimates on a sample what each rule costs and how
much it rejects, and orders the rules by rejection per cost; ``apply_cascade`` evaluates them in that order
inside one CASE, which stops at the first rule that rejects. The verdict is the conjunction of the rules, so the
order changes the work and never the result. A rule's cost is the mean of its ``work`` over the sample: the
characters that its expressions read, plus one unit for a comparison of counts. The sample is chosen by a hash of
id and text, so the same table always gives the same order.

Edge cases: a null or empty text has no word, so every count is 0 and ``base_failed`` is true; a very long text is one
row, read whole, in memory of some ten times its size; repeated
rows are measured each on their own; an empty table gives an empty result; other columns are ignored.
Three-word windows are compared by 64-bit XXH64 within one document, so a false match needs a hash
collision between two windows of the same text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE_CHARS, materialize, rolling, text_of, words_of

#: Rows on which costs and rejections are estimated; the sample is drawn over the whole table.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """A rule rejects a document where ``rejects`` is true; it may use ``text`` and the columns of ``measure``.

    ``work`` is an expression of the units of work of one evaluation.
    """

    name: str
    rejects: str
    work: str = "1"


#: Thresholds in the spirit of published web-corpus filters, set wide so that ordinary prose passes.
RULES = (
    Rule("symbols_per_word", "n_symbols > 0.3 * n_words"),
    Rule("duplicate_lines", "n_lines > 3 AND n_dup_lines > 0.5 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 16 * n_words"),
    Rule("repeated_marks", r"regexp_count(text, '[!?]{2,}') > 0.3 * n_words", "1 + length(text)"),
    Rule("words_without_letter", r"regexp_count(text, '[^ \\t-\\r]*\\p{L}[^ \\t-\\r]*') < 0.6 * n_words", "1 + 2 * length(text)"),
    Rule("capitals", r"regexp_count(text, '\\p{Lu}') > 0.6 * regexp_count(text, '\\p{L}')", "1 + 2 * length(text)"),
)


def _repeated_words(windows: Column) -> Column:
    """Sorted (hash, position) pairs of all windows, or an empty array where no hash occurs twice."""
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeated, F.array_sort(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text and the counts of the contract, without a shuffle."""
    rest = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    step = docs.select("doc_id", text_of().alias("text")).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    step = step.withColumn("lines", lines).withColumn("windows", F.zip_with(
        F.zip_with(rolling(F.col("words"), 3)[0], rolling(F.col("words"), 3)[1], lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        rolling(F.col("words"), 3)[2], lambda x, c: F.xxhash64(x["a"], x["b"], c)))
    step = step.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("windows")).alias("s"))
    step = step.withColumn("same", F.zip_with("s", rest(F.col("s")), lambda a, b: a["h"].eqNullSafe(b["h"])))
    flags = F.zip_with("same", F.concat(F.array(F.lit(False)), F.col("same")), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    starts = F.filter(F.zip_with("s", flags, lambda a, f: F.when(f, a["i"])), lambda x: x.isNotNull())
    step = step.withColumn("starts", F.sort_array(starts))
    covered = F.zip_with("starts", rest(F.col("starts")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    repeats = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words")
    # The counts leave as the one row of a generator: a later filter on them stays above it, where each is worked out
    # once, instead of being pushed down with a copy of all that the counts are made of.
    counts = F.struct("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats)
    return step.select("doc_id", "text", F.inline(F.array(counts))).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def plan_cascade(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejection per cost, both estimated on a sample of about ``sample_rows`` rows."""
    total = docs.count()
    if not total:
        return list(rules)
    share = int(min(1.0, sample_rows / total) * 1_000_000)
    sample = materialize(docs.select("doc_id", "text").filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text_of()), F.lit(1_000_000)) < share), "sample")
    stands = ~F.col("base_failed")
    figures = [F.struct(F.count_if(stands & F.coalesce(F.expr(r.rejects), F.lit(False))).alias("rejected"), F.coalesce(F.avg(F.when(stands, F.expr(r.work))), F.lit(1.0)).alias("cost")) for r in rules]
    row = measure(sample).agg(*[f.alias(f"r{i}") for i, f in enumerate(figures)]).first()
    return [rule for _, _, rule in sorted(((-row[i]["rejected"] / row[i]["cost"], r.name, r) for i, r in enumerate(rules)), key=lambda x: x[:2])]


def apply_cascade(measured: DataFrame, ordered: list[Rule]) -> DataFrame:
    """Adds ``kept``: false if ``base_failed``, else false at the first rule of ``ordered`` that rejects."""
    verdict = F.when(F.col("base_failed"), False)
    for rule in ordered:
        verdict = verdict.when(F.coalesce(F.expr(rule.rejects), F.lit(False)), False)
    return measured.withColumn("kept", verdict.otherwise(True))


def quality_cascade(docs: DataFrame, rules=RULES) -> DataFrame:
    return apply_cascade(measure(docs), plan_cascade(docs, rules))


def op7_quality_cascade(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
