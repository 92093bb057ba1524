"""Probabilities of Boolean targets as polynomials of independent primitives, and whether moments determine them."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PRIMITIVES = 20


def moebius_terms(table: DataFrame, keys: list[str], primitives: int) -> DataFrame:
    """(keys, mask, coefficient): the multilinear terms of truth tables (keys, mask, holds), zero ones left out.

    Bit j of a mask is primitive j. In pass j every state without j is taken from the state that has it as well, so
    ``primitives`` passes of one aggregation each make all terms. States that are missing count as false.
    """
    if not 0 <= primitives <= MOST_PRIMITIVES:
        raise ValueError(f"at most {MOST_PRIMITIVES} primitives")
    terms = table.select(*keys, F.col("mask").cast("long").alias("mask"), F.col("holds").cast("long").alias("c")).filter("c <> 0")
    for j in range(primitives):
        bit = F.lit(1 << j).cast("long")
        moved = F.when(F.col("mask").bitwiseAND(bit) == 0, F.array(F.struct("mask", "c"), F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), (-F.col("c")).alias("c")))).otherwise(F.array(F.struct("mask", "c")))
        terms = terms.select(*keys, F.explode(moved).alias("_term")).groupBy(*keys, F.col("_term.mask").alias("mask")).agg(F.sum("_term.c").alias("c")).filter("c <> 0")
    return terms.select(*keys, "mask", F.col("c").alias("coefficient"))


def _eliminated(moments: list[tuple[int, ...]], width: int) -> tuple[list[list[Fraction]], list[list[Fraction]], list[int]]:
    """(reduced rows, how each is made of the moments, pivot columns), in exact fractions."""
    rows = [[*map(Fraction, m), *(Fraction(i == j) for j in range(len(moments)))] for i, m in enumerate(moments)]
    pivots: list[int] = []
    for column in range(width):
        at = next((i for i in range(len(pivots), len(rows)) if rows[i][column]), None)
        if at is None:
            continue
        k = len(pivots)
        rows[k], rows[at] = rows[at], rows[k]
        rows[k] = [x / rows[k][column] for x in rows[k]]
        for i, row in enumerate(rows):
            if i != k and row[column]:
                rows[i] = [x - row[column] * y for x, y in zip(row, rows[k])]
        pivots.append(column)
    return [r[:width] for r in rows], [r[width:] for r in rows], pivots


def certify(moments: Sequence[Sequence[int]], terms: dict[tuple[int, ...], int], primitives: int) -> list[dict]:
    """For each term of a target whether products of powers of the moments give it, with the proof.

    ``moments`` and the terms' keys are exponents of positive parameters. A term is determined if its exponents are a
    rational combination of the moments' (``combination``, one weight a moment); else ``direction`` moves the logarithms
    of the parameters so that every moment stays and the term changes. A target is determined if all its terms are.
    The moments are those of a model, so this is worked out on the driver.
    """
    for row in [*moments, *terms]:
        if len(row) != primitives or any(type(x) is not int or x < 0 for x in row):
            raise ValueError("exponents are whole numbers of 0 or more, one a primitive")
    rows, made, pivots = _eliminated([tuple(m) for m in moments], primitives)
    out = []
    for term, coefficient in sorted(terms.items()):
        if not coefficient:
            continue
        rest, combination = list(map(Fraction, term)), [Fraction(0)] * len(moments)
        for row, how, pivot in zip(rows, made, pivots):
            weight = rest[pivot]
            rest, combination = [x - weight * y for x, y in zip(rest, row)], [x + weight * y for x, y in zip(combination, how)]
        free = next((j for j, x in enumerate(rest) if x), None)
        direction = None
        if free is not None:
            direction = [Fraction(j == free) for j in range(primitives)]
            for row, pivot in zip(rows, pivots):
                direction[pivot] = -row[free]
        out.append({"term": term, "coefficient": coefficient, "determined": free is None, "combination": combination if free is None else None, "direction": direction})
    return out


def certified_targets(table: DataFrame, key: str, primitives: int, moments: Sequence[Sequence[int]]) -> DataFrame:
    """(key, term, coefficient, determined, target_determined, proof) of every target of truth tables (key, mask, holds).

    Which exponents occur is a property of the model, 2^primitives at most; each is certified once and joined back.
    """
    terms = moebius_terms(table, [key], primitives)
    masks = [r["mask"] for r in terms.select("mask").distinct().collect()]
    exponents = {m: tuple(m >> j & 1 for j in range(primitives)) for m in masks}
    proofs = {p["term"]: p for p in certify(moments, dict.fromkeys(exponents.values(), 1), primitives)}
    rows = []
    for m, e in exponents.items():
        p = proofs[e]
        rows.append((m, "".join(map(str, e)), p["determined"], ";".join(map(str, p["combination"] if p["determined"] else p["direction"]))))
    known = table.sparkSession.createDataFrame(rows, "mask long, term string, determined boolean, proof string")
    joined = terms.join(known, "mask")
    whole = joined.groupBy(key).agg(F.bool_and("determined").alias("target_determined"))
    return joined.join(whole, key).select(key, "term", "coefficient", "determined", "target_determined", "proof")
