"""Makes the package importable in Python workers."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query`` with the package's folder on the workers' path.

    That serves sessions on one machine, whatever their working directory; on a cluster the package is
    installed or sent with ``--py-files`` as usual, and the extra path is harmless.
    """

    @wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        environment = spark.sparkContext.environment
        paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
        if ROOT not in paths:
            environment["PYTHONPATH"] = ":".join([*paths, ROOT])
        return query(spark, *args, **kwargs)

    return run
