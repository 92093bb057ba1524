"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Each task tokenises its documents, cuts overlong ones into full windows and packs what remains: pieces in
falling length each go to the tightest open window, found by a segment tree indexed by remaining capacity.
Pieces are pooled up to POOL_PIECES at a time, so memory stays bounded, and no row is shuffled: identifiers
of sequences carry the task's partition. A window that stays open is padded by its reader.

Tokens: byte-level BPE, then id 0 as end of document. The ids are those of the `tokenizers` file; texts of
plain Latin characters take a faster encoder of the same vocabulary with equal results (see the tests).

Edge cases: a null or empty text is the single id 0; ties go by document order; repeated rows are packed each
on their own; a very long text is tokenised in one piece in its task; a null doc_id stays null; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 1024
POOL_PIECES = 1 << 15
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PLAIN = re.compile("[\t\n\r -~\xa0-ɏ‐-‟…€]*")


@functools.lru_cache(4)
def encoder(tokenizer_path: str, ranks_path: str | None):
    """text -> ids; the tokenizers library decides, the rank file only speeds up texts of plain characters."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer_path)
    slow = lambda text: full.encode(text, add_special_tokens=False).ids
    if ranks_path is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: fast.encode_ordinary(text) if "<|" not in text and _PLAIN.fullmatch(text) else slow(text)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree of counts finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, window: int) -> None:
        self.stacks[free].append(window)
        node = free + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, window) with the least free >= need, removed from the tree."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        free = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return free, self.stacks[free].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Pieces (by index) of each window; every length is under ``window``."""
    opened, tree = [], OpenWindows(window)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            opened.append([i])
            free, at = window, len(opened) - 1
        else:
            free, at = found
            opened[at].append(i)
        if free > lengths[i]:
            tree.add(free - lengths[i], at)
    return opened


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """Emits (doc_id, start, length, crc, doc_tokens, sequence_id, offset) rows of one task."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.next, self.window, self.pool = first_sequence, window, []

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        total, full = len(ids), len(ids) - len(ids) % self.window
        for start in range(0, full, self.window):
            yield doc_id, start, self.window, _crc(ids[start:start + self.window]), total, self.next, 0
            self.next += 1
        if full < total:
            self.pool.append((doc_id, full, ids[full:].astype(np.uint16 if ids.max() < 65536 else np.uint32), total))
        if len(self.pool) >= POOL_PIECES:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        pool, self.pool = self.pool, []
        for pieces in best_fit([len(p[2]) for p in pool], self.window):
            offset = 0
            for i in pieces:
                doc_id, start, ids, total = pool[i]
                yield doc_id, start, len(ids), _crc(ids), total, self.next, offset
                offset += len(ids)
            self.next += 1


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece; see the module. Paths default to the public byte-level BPE of 50k ids."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer_path, ranks_path = str(tokenizer_path), ranks_path and str(ranks_path)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([(x, pa.int64()) for x in names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path)
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        rows: list[tuple] = []

        def emit(at_least: int) -> Iterator[pa.RecordBatch]:
            while len(rows) > at_least:
                part = rows[:20_000]
                del rows[:20_000]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), 0], dtype=np.uint32)
                rows.extend(packer.add(doc_id, ids))
            yield from emit(20_000)
        rows.extend(packer.flush())
        yield from emit(0)

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
