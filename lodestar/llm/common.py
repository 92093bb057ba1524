"""Shared helpers: the shared folder of the cluster and a few text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a Java character class and as plain characters.
SPACE_CLASS = "[ \\t-\\r]"
SPACE_CHARS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a session on one machine uses a local folder; on a cluster no folder is known
    that all executors can read, so an error is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints/lodestar"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of anything but space and tab to carriage return; an empty array if there is none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"{SPACE_CLASS}+", -1)).otherwise(F.array().cast("array<string>"))


def rolling(words: Column, width: int) -> list[Column]:
    """``width`` aligned slices of ``words``: the j-th holds the j-th word of each window."""
    n = F.greatest(F.size(words) - (width - 1), F.lit(0))
    return [F.slice(words, F.lit(j + 1), n) for j in range(width)]
