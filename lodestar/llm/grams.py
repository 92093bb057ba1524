"""Words of whole texts as spans of bytes, in slices of bounded size; hashes and exact comparison of spans.

An Arrow column of texts is one buffer of bytes with offsets. Everything here is numpy over slices of that
buffer, so a task holds a few arrays of a slice's size, however many or long its texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are read at once; a word that is longer is read whole.
SLICE = 4 << 20
#: Spans of up to this many bytes are hashed in numpy, longer ones one by one.
SHORT = 64

SPACE, WORD, BREAK = 0, 1, 2
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


@dataclass
class Words:
    """Words of a slice: lower-cased bytes, and per word its span, its row and the number of breaks before it."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    row: np.ndarray
    broken: np.ndarray
    own: int  # words from here on are context of the others only


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _long_row(data: np.ndarray, kinds: np.ndarray, start: int, stop: int, size: int, context: int) -> Iterator[tuple[int, int, int]]:
    """(start, own stop, stop) of the parts of a long text: cut between words, with ``context`` words behind."""
    at = start
    while at < stop:
        cut = _next_gap(data, kinds, min(at + size, stop), stop)
        end = cut
        for _ in range(context):
            while end < stop and kinds[data[end]] == SPACE:
                end += 1
            end = _next_gap(data, kinds, end, stop)
        yield at, cut, end
        at = cut


def _next_gap(data: np.ndarray, kinds: np.ndarray, at: int, stop: int) -> int:
    """The first byte at or after ``at`` that is in no word, or ``stop``."""
    step = 256
    while at < stop:
        found = np.flatnonzero(kinds[data[at:min(at + step, stop)]] != WORD)
        if len(found):
            return at + int(found[0])
        at, step = min(at + step, stop), step * 2
    return stop


def word_slices(column: pa.Array, kinds: np.ndarray, context: int = 0, size: int = SLICE) -> Iterator[Words]:
    """The words of every text, slice by slice; ``kinds`` says of each (lower-cased) byte whether it is in a word, a space or a break."""
    data, offsets = text_buffer(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        if offsets[first + 1] - offsets[first] > size:
            for start, own, stop in _long_row(data, kinds[LOWER], int(offsets[first]), int(offsets[first + 1]), size, context):
                found = _words(data[start:stop], np.array([0, stop - start]), first, kinds)
                found.own = int(np.searchsorted(found.start, own - start))
                yield found
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield _words(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], first, kinds)
        first = last


def _words(raw: np.ndarray, offsets: np.ndarray, first: int, kinds: np.ndarray) -> Words:
    data = LOWER[raw]
    kind = kinds[data]
    inside = kind == WORD
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # first bytes of the rows that have any
    begins[edges] = inside[edges]
    ends[edges[1:] - 1] = inside[edges[1:] - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1 + first
    broken = np.searchsorted(np.flatnonzero(kind == BREAK), start)
    return Words(data, start, stop, row, broken, len(start))


def lanes(data: np.ndarray, start: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of each span as one number; bytes behind the span count as zero. ``data`` ends with 8 spare bytes."""
    at = np.minimum(start + 8 * k, len(data) - 8)
    value = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view(np.uint64).ravel()
    rest = np.clip(length - 8 * k, 0, 8).astype(np.uint64)
    keep = np.where(rest == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (rest % np.uint64(8) * np.uint64(8))) - np.uint64(1))
    return value & keep


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of equal ``length`` at ``a`` and ``b`` hold the same bytes."""
    same = lanes(data, a, length, 0) == lanes(data, b, length, 0)
    k, open_ = 1, np.flatnonzero(same & (length > 8))
    while len(open_):
        same[open_] = lanes(data, a[open_], length[open_], k) == lanes(data, b[open_], length[open_], k)
        k, open_ = k + 1, open_[same[open_] & (length[open_] > 8 * (k + 1))]
    return same


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _hash_rows(rows: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of rows of one length."""
    n, length = rows.shape
    seed = np.uint64(seed)
    read = lambda i, w: np.ascontiguousarray(rows[:, i:i + w]).view(f"<u{w}").ravel().astype(np.uint64)
    i = 0
    if length >= 32:
        v = [np.full(n, s, np.uint64) for s in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while length - i >= 32:
            v = [_round(x, read(i + 8 * k, 8)) for k, x in enumerate(v)]
            i += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _round(np.zeros(n, np.uint64), x)) * _P1 + _P4
    else:
        h = np.full(n, seed + _P5, np.uint64)
    h = h + np.uint64(length)
    while length - i >= 8:
        h = _rotl(h ^ _round(np.zeros(n, np.uint64), read(i, 8)), 27) * _P1 + _P4
        i += 8
    if length - i >= 4:
        h = _rotl(h ^ read(i, 4) * _P1, 23) * _P2 + _P3
        i += 4
    while i < length:
        h = _rotl(h ^ rows[:, i].astype(np.uint64) * _P5, 11) * _P1
        i += 1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def xxhash64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every span, those of one length together."""
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        order = np.argsort(length, kind="stable")
        sizes, firsts = np.unique(length[order], return_index=True)
        for size, own in zip(sizes.tolist(), np.split(order, firsts[1:])):
            if size > SHORT:
                out[own] = [xxhash.xxh64_intdigest(data[s:s + size].tobytes(), seed) for s in start[own].tolist()]
            elif size:
                out[own] = _hash_rows(np.lib.stride_tricks.sliding_window_view(data, size)[start[own]], seed)
            else:
                out[own] = xxhash.xxh64_intdigest(b"", seed)
    return out
