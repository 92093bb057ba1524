"""Tables that are written once, sealed by the digests of their files, and read only if every digest still holds.

Digests are taken by Spark where the files lie, a task a few files; the driver sees a line a file. A seal is the digest
of these lines and of an identity, so a table that was changed, lost a file, gained one or belongs to something else is
refused before a row of it is read.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "sealed-tables-1"


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of all files below a folder but markers of writers; ``file`` is relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = F.lit(folder.rstrip("/").split("://")[-1].removeprefix("file:"))
    name = F.expr("substring_index(path, '/', -1)")
    inside = F.substring("path", F.instr("path", root) + F.length(root) + 1, F.length("path"))
    return files.filter(~name.startswith("_") & ~name.startswith(".")).select(inside.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _manifest(spark: SparkSession, folder: str, identity: dict[str, str]) -> dict:
    files = [r.asDict() for r in file_digests(spark, f"{folder}/tables").orderBy("file").collect()]
    return {"version": VERSION, "identity": dict(sorted(identity.items())), "files": files}


def _seal(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def seal_tables(spark: SparkSession, folder: str, identity: dict[str, str], tables: dict[str, DataFrame]) -> str:
    """Writes the tables below ``folder``, which must be new, with their manifest; returns the seal."""
    for name, rows in sorted(tables.items()):
        if not name.isidentifier():
            raise ValueError(f"{name!r} is no name of a table")
        rows.write.mode("error").parquet(f"{folder}/tables/{name}")
    manifest = _manifest(spark, folder, identity)
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{folder}/manifest")
    return _seal(manifest)


def open_sealed(spark: SparkSession, folder: str, identity: dict[str, str], seal: str) -> dict[str, DataFrame]:
    """The tables of a sealed folder by name; raises if its manifest, its files or its identity are not those of the seal."""
    stored = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    if _seal(stored) != seal:
        raise ValueError("the manifest is not the sealed one")
    if stored["identity"] != dict(sorted(identity.items())):
        raise ValueError("sealed for another identity")
    if _manifest(spark, folder, identity) != stored:
        raise ValueError("files differ from their sealed digests")
    names = sorted({f["file"].split("/")[0] for f in stored["files"]})
    return {n: spark.read.parquet(f"{folder}/tables/{n}") for n in names}
