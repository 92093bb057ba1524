"""Language identification by interpolated Kneser-Ney character models.

One order-4 model per language is learned from counts of character 4-grams; lower orders use continuation
counts, as Kneser-Ney smoothing does. All models share sorted arrays of 64-bit n-gram hashes (binary search)
with one row of log probabilities per n-gram and one column per language. A text gets the language with the
lowest cross-entropy per character. Its score is the posterior at a temperature that is calibrated on held-back
training rows; ``rejected`` marks texts whose cross-entropy is beyond what those rows show.

A model is fitted on at most MAX_DOCS training texts per language, taken by hash; every text is scored whole.

Edge cases: a null text or one without a letter is `und` with score 0; without any labelled text every row
is `und`; ties go to the first language by name; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import text_of

ORDER, DISCOUNT = 4, 0.75
MAX_DOCS = 1500
#: One in so many training texts is kept back for calibration.
CALIBRATE = 8
SLICE = 1 << 19
_TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
#: Odd multiplier and a rotation that mix 16-bit characters into a 64-bit hash.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: Column) -> Column:
    """Lower case; every run of anything but letters becomes one space, also at both ends."""
    return F.concat(F.lit(" "), F.btrim(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))), F.lit(" "))


def fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters that end at each position from order-1 on."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), np.uint64(order))
    for j in range(order):
        h = (h ^ codes[j:j + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray]  # by order - 1: sorted n-gram hashes
    logs: list[np.ndarray]  # (n-grams, languages): log2 of the interpolated probability
    context_keys: list[np.ndarray]  # by order - 1: sorted hashes of contexts (order - 1 characters)
    context_logs: list[np.ndarray]  # log2 of the weight that goes to the lower order
    floor: float  # log2 probability of a character that was never seen
    temperature: float = 4.0
    reject_above: float = 99.0


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def build(counts: pd.DataFrame) -> Models:
    """Models from (lang, gram, n) with grams of ORDER characters."""
    languages = sorted(counts["lang"].unique())
    letters = sorted({c for g in counts["gram"] for c in g})
    floor = -np.log2(len(letters) + 1.0)
    tables = []  # per language and order: {gram: count}, raw at the top and continuation counts below
    for lang in languages:
        own = counts[counts["lang"] == lang]
        grams = dict(zip(own["gram"], own["n"]))
        orders = {ORDER: grams}
        for order in range(ORDER - 1, 0, -1):
            lower: dict[str, int] = {}
            for g in {g for g in orders[order + 1]}:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            orders[order] = lower
        tables.append(orders)
    keys, logs, context_keys, context_logs = [], [], [], []
    lower_probability = [dict() for _ in languages]
    weights_before: list[dict[str, float]] = []
    for order in range(1, ORDER + 1):
        grams = sorted({g for t in tables for g in t[order]})
        contexts = sorted({g[:-1] for g in grams})
        matrix, weight = np.zeros((len(grams), len(languages))), np.zeros((len(contexts), len(languages)))
        weights = []
        for k, t in enumerate(tables):
            total, kinds = {}, {}
            for g, n in t[order].items():
                total[g[:-1]] = total.get(g[:-1], 0) + n
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            back = {c: DISCOUNT * kinds[c] / total[c] for c in total}
            weights.append(back)

            def below(g: str, order=order, k=k) -> float:
                if order == 1:
                    return 2.0 ** floor
                known = lower_probability[k].get(g[1:])
                return known if known is not None else _descend(g[1:], order - 1, k)

            def _descend(g: str, order: int, k: int) -> float:
                scale = weights_before[order - 1][k].get(g[:-1], 1.0)
                if order == 1:
                    return scale * 2.0 ** floor
                known = by_order[order - 1][k].get(g[1:])
                return scale * (known if known is not None else _descend(g[1:], order - 1, k))

            column = np.empty(len(grams))
            for i, g in enumerate(grams):
                c = g[:-1]
                n = t[order].get(g, 0)
                column[i] = (max(n - DISCOUNT, 0.0) / total[c] + back[c] * below(g)) if c in total else below(g)
            matrix[:, k] = np.log2(column)
            weight[:, k] = [np.log2(back.get(c, 1.0)) for c in contexts]
        weights_before.append(weights)
        probabilities = [dict(zip(grams, 2.0 ** matrix[:, k])) for k in range(len(languages))]
        by_order = [*(by_order if order > 1 else []), probabilities]
        lower_probability = probabilities
        for names, values, to_keys, to_logs, width in ((grams, matrix, keys, logs, order), (contexts, weight, context_keys, context_logs, order - 1)):
            h = np.concatenate([_hashes(_codes(x), width) for x in names]) if width else np.zeros(1, np.uint64)
            rank = np.argsort(h)
            to_keys.append(h[rank])
            to_logs.append(values[rank].astype(np.float32))
    return Models(languages, keys, logs, context_keys, context_logs, floor)


def cross_entropy(text: str, m: Models) -> np.ndarray:
    """Bits per character under each language; ``text`` is normalised and has a letter."""
    total, n = np.zeros(len(m.languages)), len(text) - 1
    padded = " " * (ORDER - 1) + text
    for at in range(0, n, SLICE):
        total += _bits(_codes(padded[at + 1:at + SLICE + ORDER]), m)
    return total / max(n, 1)


def _bits(codes: np.ndarray, m: Models) -> np.ndarray:
    """Sum over the positions from ORDER-1 on."""
    places = np.arange(ORDER - 1, len(codes))
    total = np.zeros(len(m.languages))
    for order in range(ORDER, 0, -1):
        h = _hashes(codes, order)[places - order + 1]
        at, known = _look_up(m.keys[order - 1], h)
        counts = np.bincount(at[known], minlength=len(m.keys[order - 1]))
        used = np.flatnonzero(counts)
        total -= counts[used] @ m.logs[order - 1][used]
        places = places[~known]
        if not len(places):
            return total
        if order > 1:
            at, known = _look_up(m.context_keys[order - 1], _hashes(codes, order - 1)[places - order + 1])
            total -= m.context_logs[order - 1][at[known]].sum(axis=0)
    total -= len(places) * (m.floor + m.context_logs[0][0])
    return total


def _posterior(h: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(-(h - h.min()) * temperature)
    return e / e.sum()


def training_rows(docs: DataFrame, most: int = MAX_DOCS) -> DataFrame:
    """(lang, x, kept_back): at most about ``most`` texts a language outside the held-out fold, by hash."""
    usable = docs.filter(F.col("lang").isNotNull() & (fold(4) != 2))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, most / n) * 1_000_000)).otherwise(share)
    place = F.xxhash64("doc_id", F.lit("lang"))
    chosen = usable.filter(F.pmod(place, F.lit(1_000_000)) < share) if sizes else usable
    return chosen.select("lang", normalised(text_of()).alias("x"), (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0).alias("kept_back")).filter(F.col("x").rlike(r"\p{L}"))


def fit(docs: DataFrame, most: int = MAX_DOCS) -> Models | None:
    rows = training_rows(docs, most).persist()
    try:
        padded = rows.filter("NOT kept_back").select("lang", F.explode(_grams(F.concat(F.lit(" " * (ORDER - 2)), F.col("x")))).alias("gram"))
        counts = padded.groupBy("lang", "gram").agg(F.count("*").alias("n")).toPandas()
        if counts.empty:
            return None
        models = build(counts)
        return _calibrate(models, rows.filter("kept_back").select("lang", "x"))
    finally:
        rows.unpersist()


def _grams(text: Column) -> Column:
    """Array of the ORDER-character substrings of ``text``."""
    letters = F.split(text, "")
    n = F.greatest(F.size(letters) - (ORDER - 1), F.lit(0))
    slices = F.arrays_zip(*[F.slice(letters, F.lit(j + 1), n).alias(f"c{j}") for j in range(ORDER)])
    return F.transform(slices, lambda x: F.concat(*[x[f"c{j}"] for j in range(ORDER)]))


def _calibrate(models: Models, rows: DataFrame) -> Models:
    names = models.languages

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "h": [cross_entropy(x, models).tolist() for x in batch["x"]]})

    seen = rows.mapInPandas(measure, "lang string, h array<double>").toPandas()
    seen = seen[seen["lang"].isin(names)]
    if len(seen):
        h, truth = np.array(seen["h"].tolist()), seen["lang"].map(names.index).to_numpy()
        loss = {t: -np.mean([np.log(_posterior(x, t)[y] + 1e-12) for x, y in zip(h, truth)]) for t in _TEMPERATURES}
        models.temperature = min(loss, key=lambda t: (loss[t], t))
        models.reject_above = float(np.quantile(h.min(axis=1), 0.995)) + 0.5
    return models


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document."""
    rows = docs.select("doc_id", (fold(4) == 2).alias("held_out"), text_of().alias("t"))
    rows = rows.select("doc_id", "held_out", F.when(F.col("t").rlike(r"\p{L}"), normalised(F.col("t"))).alias("x"))
    if models is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = dict(docs.dtypes)["doc_id"]

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            out = []
            for x in batch["x"]:
                if x is None:
                    out.append(("und", 0.0, True))
                    continue
                h = cross_entropy(x, m)
                best = int(h.argmin())
                out.append((m.languages[best], float(_posterior(h, m.temperature)[best]), bool(h[best] > m.reject_above)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [o[0] for o in out], "score": [o[1] for o in out], "rejected": [o[2] for o in out]})

    return rows.mapInPandas(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
