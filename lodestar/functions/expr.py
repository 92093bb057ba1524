"""Small Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp in the session's zone (pin it to UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def tri(column: str, true: str, false: str) -> Column:
    """Three-valued signal from a code: true, false, or null for anything else."""
    return F.when(F.col(column) == true, True).when(F.col(column) == false, False)


def kleene_and(*columns: Column) -> Column:
    """Row-wise Kleene conjunction; true if there is no column."""
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def kleene_or(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def stable_uniform(separator: str, *parts) -> Column:
    """Uniform in [0, 1) from the top eight bytes of SHA-256 over the joined parts."""
    joined = F.concat_ws(separator, *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def bool_strict(column: str) -> Column:
    """true/false text to Boolean; anything else raises."""
    text = F.lower(F.trim(column))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False).otherwise(F.raise_error(F.concat(F.lit("not a Boolean: "), F.coalesce(F.col(column), F.lit("null")))))


def bool_lenient(column: str) -> Column:
    return F.coalesce(F.lower(F.trim(column)).isin("1", "true", "yes"), F.lit(False))
