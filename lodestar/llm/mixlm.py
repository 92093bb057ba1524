"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Every byte is coded as eight binary decisions. Predictors look a decision up under the last one to LONGEST
bytes. Their counts of (predictor, context, byte) are gathered from
every training document and grow with the corpus: texts are dealt into blocks, the distinct cells of a block
go to shards by a hash of the context, each shard adds the counts of all blocks and answers each block with the logits of
the cells that it touches, and no task or driver holds the whole table.

Two layers mix the logits. The weights of the first are gated by the decision's place and the longest context
that knows it; they are learned online, in text order, on the training texts of a fixed share
(1 in TUNED_PARTS, so the share grows with the corpus), from counts that leave these texts out, and averaged
over the blocks. The second layer mixes two groups of predictors (the longest, all shorter ones); its
weights start at one for every text and are refined online, a STEP of bytes at a time, from the bytes before.
The total of -log2 over all decisions and an end mark (a byte that no UTF-8 text has) is the text's size in bits.

A unigram base score comes with it: token counts over all training documents are joined to the tokens of
each text. The HOT_TOKENS most frequent ones are broadcast; the others are joined by shuffle.

Edge cases: a null or empty text is its end mark alone; without training documents all counts are 0 and
every decision has probability one half; repeated rows are scored each on their own; a very long text is a
block of its own and is read in slices of SLICE bytes; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialize

#: Longest context in bytes; a key is tagged with its context's length.
LONGEST = 5
END = b"\xff"
#: Logits are kept as whole parts of 1/SCALE; a byte is PLACES decisions.
SCALE, FINE, PLACES, PRIOR, CLIP = 8.0, 16.0, 8, 0.1, 8.0
#: Positions at once: of an online step (a power of two), of a slice (all texts together), of the counting of keys.
STEP, SLICE, COUNTED_AT_ONCE, TEXTS_AT_ONCE = 128, 1 << 18, 1 << 19, 64
#: Bytes of texts that are scored together, and for each of which there is one shard of the cells.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 4 << 20
#: One in TUNED_PARTS training texts teaches the first layer's weights; steps of both layers.
TUNED_PARTS, FIRST_RATE, SECOND_RATE, START = 32, 0.08, 0.01, 0.3
HOT_TOKENS, TOKENS_AT_ONCE = 150_000, 250_000
#: The cost of a decision is capped here; four such costs multiply within single precision.
MOST_NATS = 21

_MIX = np.uint64(0x9E3779B97F4A7C15)
_8 = np.uint64(8)


def fold(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts


def byte_keys(data: np.ndarray) -> np.ndarray:
    """Key of the cell under the longest context of each byte after the first LONGEST of the last axis.

    From the top: the byte before, the one before that, and so on, then the byte itself; contexts that end
    alike are neighbours in the order of the keys.
    """
    wide = data.astype(np.uint64)
    n = data.shape[-1] - LONGEST
    key = wide[..., LONGEST:].copy()
    for j in range(1, LONGEST + 1):
        key |= wide[..., LONGEST - j:LONGEST - j + n] << np.uint64(8 * (LONGEST + 1 - j))
    return key


def shorter(keys: np.ndarray, order: int) -> np.ndarray:
    """Tagged keys of the cells of ``order`` that untagged keys of order LONGEST lie in."""
    return keys >> np.uint64(8 * (LONGEST + 1 - order)) << _8 | keys & np.uint64(255) | np.uint64(order << 56)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of the rows of ``values`` that belong to each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(values[order], at, axis=0) if len(at) else values


def _pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, like bytes of all its rows together."""
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.nbytes // max(1, len(values)))
    return len(values).to_bytes(8, "little") + pa.compress(rows.T.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, kind: type, width: int = 1) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize * width
    rows = np.frombuffer(pa.decompress(raw[8:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.frombuffer(rows.T.tobytes(), kind).reshape((n, width) if width > 1 else n)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their steps."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64)


def _nodes(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By place: the first key of each node of the keys' decision trees, the node of each key, and 1 or -1 for its decision."""
    for j in range(PLACES):
        node = keys >> np.uint64(PLACES - j)
        first = np.append(True, node[1:] != node[:-1])[:len(keys)]
        sign = (2 * (keys >> np.uint64(PLACES - 1 - j) & np.uint64(1)).astype(np.int8) - 1).astype(np.int8)
        yield np.flatnonzero(first), np.cumsum(first) - 1, sign


def pack_logits(keys: np.ndarray, logits: np.ndarray) -> bytes:
    """The logits of sorted keys, one for each node that some of them pass."""
    return _pack(np.concatenate([logits[first, j] * sign[first] for j, (first, _, sign) in enumerate(_nodes(keys))]))


def unpack_logits(keys: np.ndarray, raw: bytes) -> np.ndarray:
    out, at, values = np.empty((len(keys), PLACES), np.int8), 0, _unpack(raw, np.int8)
    for j, (first, node, sign) in enumerate(_nodes(keys)):
        out[:, j] = values[at:at + len(first)][node] * sign
        at += len(first)
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a key's context. Few shards share contexts by their last bytes, so that their keys pack well."""
    kept = 2 if shards <= 32 else 3 if shards <= 256 else LONGEST
    tag = keys >> np.uint64(56)
    dropped = np.maximum(tag.astype(np.int64) - kept, 0).astype(np.uint64)
    context = (keys & np.uint64((1 << 56) - 1)) >> _8 + _8 * dropped
    return ((context ^ tag << np.uint64(50)) * _MIX >> np.uint64(33)) % np.uint64(shards)


#: What a text is to the model: counted and tuned on, counted, or neither.
TUNED, COUNTED, OTHER = 2, 1, 0


class Block:
    """The cells of texts that are scored together: keys, and their counts in training and in tuning texts."""

    def __init__(self) -> None:
        self.held: dict[int, list[bytes]] = {TUNED: [], COUNTED: [], OTHER: []}  # each text piece after its lead
        self.waiting = dict.fromkeys(self.held, 0)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, raw: bytes, kind: int) -> None:
        whole = bytes(LONGEST) + raw + END
        self.size += len(raw) + 1
        for at in range(0, len(whole) - LONGEST, SLICE):
            self.held[kind].append(whole[at:at + LONGEST + SLICE])
            self.waiting[kind] += len(self.held[kind][-1])
            if self.waiting[kind] > COUNTED_AT_ONCE:
                self._count(kind)

    def _count(self, kind: int) -> None:
        held = self.held[kind]
        if not held:
            return
        keys = byte_keys(np.frombuffer(b"".join(held), np.uint8))
        real = np.ones(len(keys), bool)
        ends = np.cumsum([len(x) for x in held])[:-1]
        for j in range(LONGEST):  # the lead is no part of a text
            real[ends - LONGEST + j] = False
        found, n = np.unique(keys[real], return_counts=True)
        n = n.astype(np.uint32)
        self.parts.append((found, np.stack([n if kind else 0 * n, n if kind == TUNED else 0 * n], axis=1)))
        if len(self.parts) > 8 and sum(len(p[0]) for p in self.parts[1:]) > len(self.parts[0][0]):
            self._merge()
        self.held[kind], self.waiting[kind] = [], 0

    def _merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [_sum_by(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))]

    def cells(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, tagged keys in order, counts) of the block."""
        for kind in self.held:
            self._count(kind)
        self._merge()
        if self.parts:
            found = [_sum_by(shorter(self.parts[0][0], o), self.parts[0][1]) for o in range(1, LONGEST + 1)]
            self.parts = []
            keys, n = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            to = shard_of(keys, shards)
            order = np.argsort(to, kind="stable")
            keys, n, to = keys[order], n[order].astype(np.uint32), to[order]
            cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
            for i, j in zip(cuts[:-1], cuts[1:]):
                yield int(to[i]), keys[i:j], n[i:j]


def path_logits(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logit, times SCALE, of what each of the eight decisions on the way to each key's byte came out as.

    ``keys`` are sorted and distinct, with all cells of their contexts. A decision that no text met has 0.
    """
    out = np.empty((len(keys), PLACES), np.int8)
    sums = np.concatenate(([0], np.cumsum(n.astype(np.int64))))
    before = None
    for j in range(PLACES + 1):
        node = keys >> np.uint64(PLACES - j)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        ends = np.append(first[1:], len(keys))
        total = np.repeat(sums[ends] - sums[first], ends - first)
        if before is not None:
            out[:, j - 1] = np.rint(SCALE * np.clip(np.log((total + PRIOR) / (before - total + PRIOR)), -CLIP, CLIP))
        before = total
    return out


def _answer(table: pa.Table) -> pa.Table:
    """One shard: the counts of all blocks are added, and each block receives the logits of the cells it touches.

    Cells of tuning texts get a second logit, of the counts without any tuning text.
    """
    parts = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = [_unpack(x, np.uint32, 2) for x in table.column("counts").to_pylist()]
    keys, n = _sum_by(np.concatenate(parts), np.concatenate(counts).astype(np.int64))
    logits = path_logits(keys, n[:, 0])
    # Only contexts with a cell of a tuning text are worked out a second time.
    firsts = np.flatnonzero(np.append(True, keys[1:] >> _8 != keys[:-1] >> _8))
    again = np.repeat(np.add.reduceat(n[:, 1], firsts) > 0, np.diff(np.append(firsts, len(keys))))
    tuned_keys, without = keys[again], path_logits(keys[again], (n[:, 0] - n[:, 1])[again])
    rows = []
    for part, (_, tuned) in zip(parts, (c.T for c in counts)):
        learned = part[tuned > 0]
        rows.append((pack_keys(part), pack_logits(part, logits[np.searchsorted(keys, part)]), pack_keys(learned), pack_logits(learned, without[np.searchsorted(tuned_keys, learned)])))
    packed = [pa.array(x, pa.binary()) for x in zip(*rows)]
    return pa.table([table.column("block").cast(pa.int64()), *packed], names=["block", "keys", "logits", "tuned_keys", "tuned_logits"])


class Cells:
    """The cells of one block with their logits, as both layers need them."""

    def __init__(self, keys: list[bytes], logits: list[bytes]) -> None:
        """``keys`` and ``logits`` are the answers of all shards."""
        found = [unpack_keys(x) for x in keys]
        logits = np.concatenate([unpack_logits(k, x) for k, x in zip(found, logits)])
        keys = np.concatenate(found)
        order = np.argsort(keys)
        keys, logits = keys[order], logits[order]
        cut = np.searchsorted(keys, np.arange(1, LONGEST + 2, dtype=np.uint64) << np.uint64(56))
        by_tag = [(keys[i:j], logits[i:j]) for i, j in zip(cut[:-1], cut[1:])]
        #: Cells under the longest context, in order, and by cell, context and place the logits of all its contexts.
        self.keys = by_tag[LONGEST - 1][0] & np.uint64((1 << 56) - 1)
        self.logits = np.stack([v[np.searchsorted(k, shorter(self.keys, o + 1))] for o, (k, v) in enumerate(by_tag)], axis=1)
        #: By cell and place: the longest context that knows the decision, 0 if none does.
        self.gates = ((self.logits != 0) * np.arange(1, LONGEST + 1, dtype=np.uint8)[None, :, None]).max(axis=1)

        #: A hash table of the cells' places; where cells collide one stays, and the others are found by bisection.
        self.shift = np.uint64(64 - min(22, len(self.keys).bit_length() + 2))
        self.slots = np.zeros(1 << 64 - int(self.shift), np.int32)
        self.slots[(self.keys * _MIX >> self.shift).astype(np.intp)] = np.arange(len(self.keys), dtype=np.int32)

    def find(self, data: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        """Places of the cells of the bytes after the first LONGEST of the last axis, as far as they are ``real``."""
        keys = byte_keys(data)
        flat = keys.reshape(-1)
        at = self.slots.take((flat * _MIX >> self.shift).astype(np.intp))
        missed = np.flatnonzero(self.keys.take(at) != flat)
        distinct, back = np.unique(flat[missed], return_inverse=True)
        at[missed] = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1).astype(np.int32)[back]
        known = self.keys.take(at[missed]) == flat[missed]
        if not known.all() and (real is None or real.reshape(-1)[missed[~known]].any()):
            raise RuntimeError("a text of this block was not counted: the table of texts changed between two reads")
        return at.reshape(keys.shape)


def flat_weights() -> np.ndarray:
    """First-layer weights before learning, by gate, place and length of the context."""
    return np.full((LONGEST + 1, PLACES, LONGEST), START, np.float32)


def tune(texts: list[bytes], cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """First-layer weights learned online over ``texts`` in order, and the decisions seen at each gate and place."""
    weights, seen = flat_weights(), np.zeros((LONGEST + 1, PLACES))
    scale = np.full(weights.shape, 1.0, np.float32)  # sums of squared steps, as in AdaGrad
    place = np.arange(PLACES)
    for text in texts:
        whole = bytes(LONGEST) + text + END
        for at in range(0, len(whole) - LONGEST, 2048):
            cell = cells.find(np.frombuffer(whole[at:at + LONGEST + 2048], np.uint8))
            x = cells.logits[cell].transpose(0, 2, 1) * np.float32(1 / SCALE)
            gate = cells.gates[cell]
            wrong = 1 / (1 + np.exp(np.clip((weights[gate, place] * x).sum(axis=2), -30, 30)))
            index = (gate.astype(np.intp) * PLACES + place).reshape(-1)
            step = np.stack([np.bincount(index, (wrong * x[:, :, k]).reshape(-1), seen.size) for k in range(LONGEST)], axis=1).reshape(weights.shape)
            seen += np.bincount(index, minlength=seen.size).reshape(seen.shape)
            scale += (step * step).astype(np.float32)
            weights += (FIRST_RATE * step / np.sqrt(scale)).astype(np.float32)
    return weights, seen


class Mixer:
    """Both layers over the cells of one block."""

    def __init__(self, cells: Cells, weights: np.ndarray) -> None:
        self.cells = cells
        n = len(cells.keys)
        #: By cell: terms of the longest context and of all shorter ones, as PLACES whole parts of 1/FINE in
        #: the bytes of one number; the last row stands for no byte.
        self.terms = np.zeros((2, n + 1, PLACES), np.int8)
        for at in range(0, n, 1 << 15):
            to = min(n, at + (1 << 15))
            x = cells.logits[at:to].transpose(0, 2, 1) * np.float32(FINE / SCALE)
            x *= weights[cells.gates[at:to], np.arange(PLACES)]
            for k, term in enumerate((x[:, :, -1], x[:, :, :-1].sum(axis=2))):
                self.terms[k, at:to] = np.rint(np.clip(term, -127, 127))
        del cells.logits, cells.gates

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Nats of each text with its end mark, in order; texts of like length go together."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        total = np.zeros(len(texts))
        at = 0
        while at < len(order):
            group = order[at:at + TEXTS_AT_ONCE]
            total[group] = self._group([texts[i] + END for i in group])
            at += len(group)
        return total

    def _group(self, texts: list[bytes]) -> np.ndarray:
        """Texts come longest first; they pass through together, in slices of SLICE bytes at most."""
        lengths = np.array([len(t) for t in texts])
        total, none = np.zeros(len(texts)), len(self.cells.keys)
        second = np.full((2, len(texts), PLACES), -1 / FINE, np.float32)  # negated, as the exponent needs it
        terms = [t.view(np.uint64).reshape(-1) for t in self.terms]
        at = 0
        while alive := int(np.count_nonzero(lengths > at)):
            wide = -(-min(SLICE // alive, int(lengths[0]) - at) // STEP) * STEP
            data = np.zeros((alive, LONGEST + wide), np.uint8)
            for row, text in zip(data, texts):
                piece = text[max(0, at - LONGEST):at + wide]
                skip = 0 if at else LONGEST
                row[skip:skip + len(piece)] = np.frombuffer(piece, np.uint8)
            real = np.arange(at, at + wide) < lengths[:alive, None]
            cell = self.cells.find(data, real)
            cell[~real] = none
            for start in range(0, wide, STEP):
                n = int(np.count_nonzero(lengths > at + start))
                if not n:
                    break
                at_once = cell[:n, start:start + STEP]
                x = [t.take(at_once).view(np.int8).astype(np.float32) for t in terms]
                z = x[0] * np.tile(second[0, :n], STEP)
                z += x[1] * np.tile(second[1, :n], STEP)
                np.minimum(z, MOST_NATS, out=z)
                wrong = np.exp(z, out=z)
                e = wrong + 1
                wrong /= e
                half, quarter = e.shape[1] // 2, e.shape[1] // 4  # one logarithm for four decisions
                e = e[:, :half] * e[:, half:]
                e = e[:, :quarter] * e[:, quarter:]
                total[:n] += np.log(e, out=e).sum(axis=1)
                for k in range(2):
                    x[k] *= wrong
                    second[k, :n] -= np.float32(SECOND_RATE / FINE**2) * _by_place(x[k])
            at += wide
        return total - (-lengths % STEP) * PLACES * np.log(2)


def _by_place(rows: np.ndarray) -> np.ndarray:
    """Sums by place of rows of STEP times PLACES values; halves are added to each other down to PLACES."""
    while rows.shape[1] > PLACES:
        half = rows.shape[1] // 2
        rows = rows[:, :half] + rows[:, half:]
    return rows


def _pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _texts(own: pa.Table) -> Iterator[pa.Table]:
    """The packed tables of texts of one block, in order."""
    for raw in own.column("pack").to_pylist():
        yield pa.ipc.open_stream(raw).read_all()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(block, number of the first row, rows): the rows of one task in pieces of one block each.

    A block is up to BLOCK_BYTES of texts, a piece up to 1,000 of them and 1 MB, or one text. The cut depends on
    the rows and their order alone, so two reads of one table give the same blocks; `Cells.find` checks it.
    """
    block, held, uid = TaskContext.get().partitionId() << 24, 0, TaskContext.get().partitionId() << 33
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            full = held and held + n > BLOCK_BYTES
            if i > start and (full or i - start == 1000 or size + n > 1 << 20):
                yield block, uid + start, batch.slice(start, i - start)
                start = i
                size = 0
            if full:
                block, held = block + 1, 0
            size, held = size + n, held + n
        if sizes:
            yield block, uid + start, batch.slice(start)
        uid += len(sizes)


_GATHERED = "block long, shard long, keys binary, counts binary, token string, n long"


def gather(rows: DataFrame, shards: int) -> DataFrame:
    """The cells of every block, as (block, shard, keys, counts), and words of training texts, as (token, n).

    A task adds up to TOKENS_AT_ONCE words before it sends them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()

        def cells(number: int, block: Block) -> Iterator[pa.RecordBatch]:
            for shard, keys, n in block.cells(shards):
                yield row(pa.array([number]), pa.array([shard]), pa.array([pack_keys(keys)], pa.binary()), pa.array([_pack(n)], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()))

        def tokens() -> Iterator[pa.RecordBatch]:
            n = len(words)
            none = [pa.nulls(n, x) for x in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield row(*none, pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64()))
            words.clear()

        def row(*columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(columns), names=[x.split()[0] for x in _GATHERED.split(", ")])

        number, block = None, Block()
        for at, _, piece in _cut(batches):
            if number is not None and at != number:
                yield from cells(number, block)
                block = Block()
            number = at
            for text, kind in zip(piece.column(1).cast(pa.binary()), piece.column(3).to_pylist()):
                raw = text.as_py() or b""
                block.add(raw, kind)
                if kind != OTHER:
                    words.update(raw.lower().split())
            if len(words) > TOKENS_AT_ONCE:
                yield from tokens()
        if number is not None:
            yield from cells(number, block)
        yield from tokens()

    return rows.mapInArrow(count, _GATHERED)


def packed_texts(rows: DataFrame, tuned: bool) -> DataFrame:
    """(block, pack): the texts of every block, or only those that the weights are tuned on."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, uid, piece in _cut(batches):
            table = pa.table([piece.column(0), pc.fill_null(piece.column(1), ""), piece.column(2), pa.array(range(uid, uid + piece.num_rows), pa.int64())], names=["doc_id", "text", "held_out", "uid"])
            if tuned:
                table = table.filter(pc.equal(piece.column(3), TUNED))
            if table.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_pack_table(table)], pa.binary())], names=["block", "pack"])

    return rows.mapInArrow(pack, "block long, pack binary")


def _learn_weights(tuned: DataFrame, answers: DataFrame) -> np.ndarray:
    """First-layer weights of every block's tuning texts, averaged by the decisions seen."""
    flat = flat_weights()

    def run(own: pa.Table, cells: pa.Table) -> pa.Table:
        texts = [x.as_py() for part in _texts(own) for x in part.column("text").cast(pa.binary())]
        if not texts:
            return pa.table({"w": pa.array([], pa.list_(pa.float64())), "seen": pa.array([], pa.list_(pa.float64()))})
        weights, seen = tune(texts, Cells(cells.column("tuned_keys").to_pylist(), cells.column("tuned_logits").to_pylist()))
        return pa.table({"w": pa.array([(weights * seen[:, :, None]).reshape(-1).tolist()], pa.list_(pa.float64())), "seen": pa.array([seen.reshape(-1).tolist()], pa.list_(pa.float64()))})

    found = tuned.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "w array<double>, seen array<double>")
    places = found.select(F.posexplode(F.concat("w", "seen"))).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    if not places:
        return flat
    sums = np.array([r["v"] for r in sorted(places, key=lambda r: r["pos"])])
    seen = sums[flat.size:].reshape(flat.shape[:2])[:, :, None]
    return np.where(seen > 0, sums[:flat.size].reshape(flat.shape) / np.maximum(seen, 1), flat).astype(np.float32)


def _hot_count(counts: DataFrame, most: int = HOT_TOKENS) -> int:
    """Least count such that at most ``most`` tokens reach it, to an eighth of a power of two."""
    steps = counts.groupBy(F.floor(8 * F.log2("c")).alias("step")).agg(F.count("*").alias("k"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 62
    for r in steps:
        total += r["k"]
        if total > most:
            break
        least = r["c"]
    return least


_SCORED = "held_out boolean, uid long, n_tokens long, n_bytes long, hot_known long, hot_score double, score double, rare array<binary>, times array<long>"


def score_texts(docs: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte per document."""
    spark = docs.sparkSession
    held_out = F.coalesce(fold(10) == 0 if held_out is None else held_out, F.lit(False))
    tuned = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")), F.lit(TUNED_PARTS)) == 0
    rows = docs.select("doc_id", "text", held_out.alias("held_out"), F.when(held_out, OTHER).when(tuned, TUNED).otherwise(COUNTED).alias("kind"))
    size = rows.agg(F.count(F.when(~F.col("held_out"), 1)).alias("texts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    texts, shards = size["texts"], 1 + int(size["bytes"]) // SHARD_BYTES
    # Blocks near BLOCK_BYTES share most cells among their texts; small inputs are still spread over the cores.
    tasks = max(1 + int(size["bytes"]) // BLOCK_BYTES, min(spark.sparkContext.defaultParallelism, 1 + int(size["bytes"]) // (BLOCK_BYTES >> 2)))
    rows = rows.coalesce(tasks)
    gathered = materialize(gather(rows, shards), "gathered")
    counts = materialize(gathered.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("c")), "words")
    cells = gathered.filter("shard IS NOT NULL").select("block", "shard", "keys", "counts")
    answers = materialize(cells.groupBy("shard").applyInArrow(_answer, "block long, keys binary, logits binary, tuned_keys binary, tuned_logits binary"), "answers")
    words = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = words["n"] + texts, words["v"] + (texts > 0)
    log_all = float(np.log10(n + 0.1 * (v + 1)))
    top = counts.filter(F.col("c") >= _hot_count(counts)).toArrow()
    hot = dict(zip((w.encode() for w in top.column("token").to_pylist()), np.log10(top.column("c").to_numpy() + 0.1).tolist()))
    end = float(np.log10(texts + 0.1))
    weights = _learn_weights(packed_texts(rows, True), answers.select("block", "tuned_keys", "tuned_logits"))
    shared = spark.sparkContext.broadcast(hot)
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", *(x.split()[0] for x in _SCORED.split(", "))]

    def scan(own: pa.Table, cells: pa.Table) -> pa.Table:
        known = shared.value
        mixer = Mixer(Cells(cells.column("keys").to_pylist(), cells.column("logits").to_pylist()), weights)
        parts = []
        for table in _texts(own):
            raw = table.column("text").cast(pa.binary()).to_pylist()
            out = []
            for text, nats in zip(raw, mixer.costs(raw)):
                tokens = text.lower().split()
                often = Counter(tokens)
                values = list(map(known.get, often))
                rare = [w for w, v in zip(often, values) if v is None]
                times = [c for c, v in zip(often.values(), values) if v is None]
                total = end - log_all * (len(tokens) + 1) + sum(c * v for c, v in zip(often.values(), values) if v is not None)
                out.append((len(tokens) + 1, len(text), int(texts > 0) + len(tokens) - sum(times), total, -nats / np.log(10), rare, times))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            arrays = [pa.array(list(x), t) for x, t in zip(zip(*out), kinds)]
            parts.append(pa.table([table.column("doc_id"), table.column("held_out"), table.column("uid"), *arrays], names=names))
        return pa.concat_tables(parts)

    found = packed_texts(rows, False).groupBy("block").cogroup(answers.select("block", "keys", "logits").groupBy("block"))
    scored = materialize(found.applyInArrow(scan, f"doc_id {kind}, {_SCORED}"), "scored")
    shared.unpersist()
    rare = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").cast("string").alias("token"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    rest = rare.join(counts.hint("shuffle_hash"), "token", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(c + 0.1)).alias("rest"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    done = scored.drop("rare", "times").join(rest, "uid", "left")
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score", "n_bytes", (-F.col("score") / float(np.log10(2)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op9_mixing_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
