"""A cleaning pipeline over `documents`: each stage works on all that the one before kept.

Every stage is written as Parquet to the shared folder and read again, so a lost executor costs one stage's
tasks at most and no stage recomputes another.

Edge cases of every stage: rows with a null or repeated doc_id are judged by their text; null and empty texts
have no word, no secret and no benchmark item, and score as a text without features; very long texts pass whole;
extra columns stay, whatever their names; an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.workers import reachable
from lodestar.llm.common import materialize
from lodestar.llm.decontam import decontaminate
from lodestar.llm.packing import pack_documents
from lodestar.llm.secret_ledger import redact
from lodestar.llm.simhash import drop_near_duplicates
from lodestar.llm.toxicity import drop_toxic


@reachable
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rows whose text is predicted toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@reachable
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 on five words: of texts with a similarity of 0.8 or more, and of what they link, the smallest doc_id stays.

    Texts without a word are one group; rows that repeat id and text are one document and stay together.
    """
    return drop_near_duplicates(docs)


@reachable
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows whose text contains a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@reachable
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: secrets are redacted; every row stays, a null text stays null."""
    return redact(docs)


@reachable
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of packed sequences; a null or empty text is one id."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: No SQL expresses the learned stage or the tokens; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
