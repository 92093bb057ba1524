"""Fingerprints of documents from their improbable features, in chained Bloom filters.

A feature is a window of ``WIDTH`` bytes; its level is the entropy of its bytes in thousandths. How rare a level is
comes from the whole corpus: one pass counts the levels of all windows of all texts, which gives ``LEVELS`` numbers
whatever the corpus, and the rarer a level the better its rank. A feature wins a run of ``RUN`` neighbouring windows
if none in it ranks better (the first of equals); features that win ``WINS`` runs or more are selected. They enter a
chain of Bloom filters of 2,048 bits by five hashes, each filter taking 160 different features. The fingerprint
is the chain as text: features and filter in base64, joined by ``-``; it depends on the text and the table of ranks.

The likeness of two filters is the overlap of their bits over what chance gives, scaled by what could overlap; that
of two fingerprints is the mean over the shorter chain's filters of the best match in the other chain.

Every text is cut into segments with enough bytes of their neighbours on both sides that the selection is the same
as over the whole text; segments of many texts lie side by side in one array. Filters of two long texts are compared
all with all, in blocks: about one comparison for each (6 KB)^2 of text.

Edge cases: a null or empty text has an empty fingerprint, which equals that of another empty text (likeness 1) and
nothing else (0); a text shorter than a window is one feature; rows with equal doc_id follow each other by the
hash of their text, null doc_ids come first, and equal rows in any order; a single row is its own next one; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import shared_dir, text_of
from lodestar.llm.grams import text_buffer

WIDTH, RUN, WINS, LEVELS = 32, 64, 16, 1001
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Part of the possible overlap beyond chance that counts as none.
CUT_OFF = 0.3
SEGMENT, BLOCK, TEXTS_AT_ONCE = 1 << 18, 1 << 15, 2 << 20

_C = np.arange(WIDTH + 1)
#: c log2 c in units of 2^-20, whole numbers, so that sums do not depend on their order.
_PART = np.round(_C * np.log2(np.maximum(_C, 1)) * (1 << 20)).astype(np.int64)
_GAIN = np.append(_PART[1:] - _PART[:-1], 0)
_MOST = int(_PART[WIDTH])
_MARGIN = WIDTH + RUN


def segment_groups(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, int, int]]]:
    """(number of the text, text, first, last feature) of all segments, in order and in groups of some megabytes."""
    group, size = [], 0
    for doc, text in enumerate(texts):
        features = max(0, len(text) - WIDTH + 1)
        for first in range(0, features, SEGMENT):
            group.append((doc, text, first, min(first + SEGMENT, features)))
            size += group[-1][3] - first
            if size >= TEXTS_AT_ONCE:
                yield group
                group, size = [], 0
    if group:
        yield group


class Segments:
    """Segments of texts side by side in one array, with bytes that occur in no text between them."""

    def __init__(self, group: list[tuple[int, bytes, int, int]]):
        self.doc, self.own, self.place, pieces, at = [], [], [], [np.full(_MARGIN, 255, np.uint8)], _MARGIN
        for doc, text, first, last in group:
            start, stop = max(0, first - RUN + 1), min(len(text), last + RUN + WIDTH - 2)
            self.doc.append(doc)
            self.own.append((at + first - start, at + last - start))
            self.place.append((at, at + stop - start))
            pieces += [np.frombuffer(text, np.uint8, stop - start, start), np.full(_MARGIN, 255, np.uint8)]
            at += stop - start + _MARGIN
        self.data = np.concatenate(pieces)
        self.is_feature = np.zeros(len(self.data), bool)
        for start, stop in self.place:
            self.is_feature[start:stop - WIDTH + 1] = True

    def levels(self) -> np.ndarray:
        """Entropy level of the window at every place; only where ``is_feature`` it is one."""
        n = len(self.data)
        ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        for at in range(0, n, BLOCK):
            # Equal bytes among the next and the last WIDTH - 1, block by block, so that a block stays in the cache.
            for lag in range(1, WIDTH):
                end = min(at + BLOCK, n - lag)
                if end > at:
                    same = (self.data[at:end] == self.data[at + lag:end + lag]).view(np.uint8)
                    ahead[at:end] += same
                    behind[at + lag:end + lag] += same
        # A window changes by its new last byte and its old first one. The filler's own windows are never used,
        # and the sums run on from text to text, so each text's are taken from its first byte.
        entered = np.concatenate([[0], np.cumsum(_GAIN[behind])])
        left = np.concatenate([[0], np.cumsum(_GAIN[ahead])])
        held = np.zeros(n, np.int64)
        for start, stop in self.place:
            held[start:stop - WIDTH + 1] = entered[start + WIDTH:stop + 1] - entered[start] - left[start:stop - WIDTH + 1] + left[start]
        return (LEVELS - 1) * (_MOST - held) // _MOST

    def own_features(self) -> np.ndarray:
        mask = np.zeros(len(self.data), bool)
        for start, stop in self.own:
            mask[start:stop] = True
        return mask

    def selected(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, hashes) of the selected features, in order of documents and places."""
        n, far = len(self.data), np.int64(1) << np.int64(62)
        key = np.where(self.is_feature, ranks[np.where(self.is_feature, self.levels(), 0)] << np.int64(40) | np.arange(n), far)
        best, span = key, 1
        while span < RUN:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        winner = best[best < far] & np.int64((1 << 40) - 1)
        chosen = np.flatnonzero((np.bincount(winner, minlength=n) >= WINS) & self.own_features())
        rows = np.lib.stride_tricks.sliding_window_view(self.data, WIDTH)[chosen]
        firsts = np.array([a for a, _ in self.own])
        return np.array(self.doc)[np.searchsorted(firsts, chosen, "right") - 1], feature_hashes(rows)


def feature_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row of WIDTH bytes."""
    with np.errstate(over="ignore"):
        h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
        for lane in np.ascontiguousarray(rows).view(np.uint64).T:
            h = (h ^ lane) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(32)


def _chain(hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(features, filter) of every filter; repeated features count at their first place."""
    _, first = np.unique(hashes, return_index=True)
    kept = hashes[np.sort(first)]
    out = []
    for at in range(0, len(kept), FILTER_FEATURES):
        part, bits = kept[at:at + FILTER_FEATURES], np.zeros(FILTER_BITS, np.uint8)
        for k in range(HASHES):
            bits[(part >> np.uint64(11 * k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
        out.append((len(part), np.packbits(bits)))
    return out


def _by_document(doc: np.ndarray, hashes: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(doc):
        return [], []
    cuts = np.flatnonzero(np.diff(doc)) + 1
    return doc[np.append(0, cuts)].tolist(), np.split(hashes, cuts)


def chains(texts: list[bytes], ranks: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """The chain of filters of every text."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for group in segment_groups(texts):
        doc, hashes = Segments(group).selected(ranks)
        for d, h in zip(*_by_document(doc, hashes)):
            found[d].append(h)
    for i, t in enumerate(texts):
        if 0 < len(t) < WIDTH:
            found[i] = [feature_hashes(np.frombuffer(t.ljust(WIDTH, b"\xff"), np.uint8)[None])]
    return [_chain(np.concatenate(h)) if h else [] for h in found]


def as_text(chain: list[tuple[int, np.ndarray]]) -> str:
    return "-".join(f"{n}.{base64.b64encode(bits.tobytes()).decode()}" for n, bits in chain)


def from_text(fingerprint: str) -> list[tuple[int, np.ndarray]]:
    parts = [p.split(".") for p in fingerprint.split("-")] if fingerprint else []
    return [(int(n), np.frombuffer(base64.b64decode(b), np.uint8)) for n, b in parts]


def likeness(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]]) -> float:
    """From 0 to 1; symmetric."""
    if not a or not b:
        return float(len(a) == len(b))
    if (len(b), sum(n for n, _ in b), as_text(b)) < (len(a), sum(n for n, _ in a), as_text(a)):
        a, b = b, a
    mine, theirs = (np.stack([f for _, f in c]).view(np.uint64) for c in (a, b))
    own, other = (np.bitwise_count(m).sum(axis=1).astype(float) for m in (mine, theirs))
    best = np.zeros(len(mine))
    for at in range(0, len(theirs), 256):
        for i in range(0, len(mine), 16):
            both = np.bitwise_count(mine[i:i + 16, None] & theirs[None, at:at + 256]).sum(axis=2)
            chance = own[i:i + 16, None] * other[None, at:at + 256] / FILTER_BITS
            most = np.minimum(own[i:i + 16, None], other[None, at:at + 256])
            floor = chance + CUT_OFF * (most - chance)
            score = np.where(most > floor, (both - floor) / np.maximum(most - floor, 1e-9), 0.0)
            best[i:i + 16] = np.maximum(best[i:i + 16], score.max(axis=1))
    weights = np.array([n for n, _ in a], float)
    return float(np.clip((best * weights).sum() / weights.sum(), 0.0, 1.0))


def level_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each level; a task sends one row a level."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for texts in _texts(batch.column(0)):
                for group in segment_groups(texts):
                    segments = Segments(group)
                    total += np.bincount(segments.levels()[segments.own_features()], minlength=LEVELS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["level", "n"])

    out = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[r["level"]] = r["n"]
    return out


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column as bytes, some megabytes at a time."""
    data, offsets = text_buffer(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + TEXTS_AT_ONCE, "right")) - 1)
        yield [data[offsets[i]:offsets[i + 1]].tobytes() for i in range(first, last)]
        first = last


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of every level: the rarest first, equal counts by level."""
    ranks = np.empty(len(counts), np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return ranks


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rows: list[tuple[object, str]], following: tuple[object, str], ranks: np.ndarray) -> list[tuple]:
    """Results of texts that follow each other; ``following`` comes after the last."""
    texts = [t for _, t in rows]
    nexts = [*texts[1:], following[1]]
    changed = [edited(t, x).encode() for t, x in zip(texts, nexts)]
    own = chains([t.encode() for t in [*texts, following[1]]], ranks)
    new = chains(changed, ranks)
    return [(i, len(t), hashlib.sha256(c).hexdigest(), as_text(f), as_text(e), likeness(f, e), likeness(f, x))
            for (i, t), c, f, e, x in zip(rows, changed, own, new, own[1:])]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The texts are sorted over the cluster once and stay where they are: each part compares its rows with their
    next ones and hands on its first and its last row alone, which the next part or the one before needs.
    """
    ranks = rarity_ranks(level_counts(docs))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", text_of().alias("text"))
    # The last key only spreads rows that agree in id and text.
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = f"doc_id {kind}, {RESULT}, part int, edge string, text string"

    def table(id_type: pa.DataType, found: list[tuple], part: int, edge: str | None, text: str | None = None) -> pa.RecordBatch:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = [pa.array([r[k] for r in found], kinds[k]) for k in range(len(names))]
        columns += [pa.array([part] * len(found), pa.int32()), pa.array([edge] * len(found), pa.string()), pa.array([text] * len(found), pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*names, "part", "edge", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part = [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for i, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                if part is None:
                    part = at
                    yield table(id_type, [(i, None, None, None, None, None, None)], part, "first", text)
                if size > TEXTS_AT_ONCE:
                    yield table(id_type, _compared(held, (i, text), ranks), part, None)
                    held, size = [], 0
                held.append((i, text))
                size += len(text)
        if held:
            if held[1:]:
                yield table(id_type, _compared(held[:-1], held[-1], ranks), part, None)
            yield table(id_type, [(held[-1][0], None, None, None, None, None, None)], part, "last", held[-1][1])

    path = shared_dir(docs.sparkSession, "fingerprints")
    compared = ordered.mapInArrow(compare, schema)
    compared.write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.schema(compared.schema).parquet(path)
    # One first and one last row a part: the next part's first row follows a part's last one, and the first part's the last.
    parts = sorted(r["part"] for r in found.filter("edge = 'first'").select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    firsts = found.filter("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    lasts = found.filter("edge = 'last'").select("doc_id", "text", "part").join(after, "part").join(firsts, "after").select("doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                yield table(batch.column(0).type, _compared([(i, text)], (None, following), ranks), 0, None)

    closed = lasts.mapInArrow(close, schema)
    names = ["doc_id", *[c.split()[0] for c in RESULT.split(", ")]]
    return found.filter("edge IS NULL").select(*names).unionByName(closed.select(*names))


def op12_rare_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, and how near its edited text's and the next document's are."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
