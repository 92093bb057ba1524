"""SimHash near-duplicates by deletion-variant signatures.

Query op10: fingerprints of 64 bits that differ in MAX_BITS = 4 bits at most are linked. Cut into 3 segments, at
least one segment then differs by one bit at most (three segments with two each would need six). Each segment
is indexed once per bit with that bit wildcarded: 64 keys a fingerprint, of 20 or 21 fixed bits. Fingerprints
that share a key are compared on all bits.

Pipeline stage: `similar_documents` links texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more. Fingerprints have 128 bits in eight segments of 16 (128 keys each); pairs of up to WIDE_BITS
differing bits are candidates, and exact similarity decides. At similarity 0.8 a bit differs with probability
0.15, so a segment differs by one bit at most with probability 0.28, and of such pairs 0.93 meet in one segment at
least (0.975 at 0.85, 0.995 at 0.9); pairs are linked through others too. Tests measure the recall.

Copies share a fingerprint, and only distinct fingerprints are indexed. A pair that shares several keys counts at
the first segment that qualifies alone. Within a key a task reduces its links to
a spanning forest, closest pairs first, so a dense group yields as many edges as members, not all its pairs. A
key with over HOT fingerprints is cut into blocks, and each pair of blocks is compared in a group of its own, so
no task holds more than two blocks. Components come from rounds of large-star and small-star.

Edge cases: a null text or one without words has fingerprint 0, linked like any other; a text of fewer words
than a shingle is one shingle; very long texts are hashed in slices of 65,536 shingles; repeated rows keep one
result each; of rows with a null doc_id alone the component_id is null; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, materialize, rolling, text_of, words_of

WIDTH, SEED, MAX_BITS = 4, 42, 4
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_ROUNDS = 40
#: Fingerprints of one key that a task compares at once; larger keys are compared block by block.
HOT = 4096
#: The wide fingerprints of the stage: bits that candidates may differ in, shingle width and similarity.
WIDE_BITS, WIDE_WIDTH, SIMILARITY = 32, 5, 0.8
#: Most differing bits of each band of candidates; the last takes in all.
BANDS = (4, 8, 12, 18, WIDE_BITS)


def _bits(text: str | None, width: int, digest, size: int) -> np.ndarray | None:
    """The bits, lowest first, that are set in over half the ``size``-byte digests of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return None
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    shingles = max(1, n - width + 1)
    ones = np.zeros(8 * size, np.int64)
    for at in range(0, shingles, 65536):
        a, b = starts[at:at + 65536].tolist(), ends[min(width, n) - 1:][at:at + 65536].tolist()
        hashes = np.frombuffer(b"".join([digest(joined[i:j], SEED) for i, j in zip(a, b)]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, size)[:, ::-1], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * ones > shingles


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of one text, as a signed 64-bit value."""
    bits = _bits(text, width, xxhash.xxh64_digest, 8)
    return 0 if bits is None else int(np.packbits(bits, bitorder="little").view("<i8")[0])


def wide_fingerprint(text: str | None, width: int = WIDE_WIDTH) -> tuple[int, int]:
    """The 128-bit SimHash of one text, as two signed 64-bit values."""
    bits = _bits(text, width, xxhash.xxh3_128_digest, 16)
    return (0, 0) if bits is None else tuple(np.packbits(bits, bitorder="little").view("<i8").tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every whole text."""
    kind = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, fp long")


def variant_keys(prints: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard segment variants; a key holds the wildcard's place and the other bits."""
    keys = []
    for low, bits in SEGMENTS:
        for j in range(bits):
            kept = ((1 << bits) - 1) & ~(1 << j)
            value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(kept))
            keys.append((F.lit((low + j) << 22) + value).cast("long"))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _counted_at(x: np.ndarray, segments=tuple((0, low, bits, low) for low, bits in SEGMENTS)) -> np.ndarray:
    """Wildcard place at which pairs with differences ``x`` (n, words) count: the first segment that qualifies.

    ``segments`` has the word, lowest bit, bits and first place of each.
    """
    place = np.full(len(x), -1)
    for word, low, bits, first in reversed(segments):
        part = (x[:, word] >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        count = np.bitwise_count(part)
        place = np.where(count == 0, first, np.where(count == 1, first + np.bitwise_count(part - np.uint64(1)).astype(int), place))
    return place


def _wide_counted_at(x: np.ndarray) -> np.ndarray:
    return _counted_at(x, tuple((s // 4, s % 4 * 16, 16, s * 16) for s in range(8)))


def _forest(pairs: list[tuple[int, int]]) -> list[int]:
    """Places of the pairs that join two trees, in order: a spanning forest of the graph of all pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for i, (x, y) in enumerate(pairs):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(i)
    return kept


def _links(keys: np.ndarray, sides: np.ndarray, prints: np.ndarray, fresh_from: int, most: int, counted) -> np.ndarray:
    """(first, second) rows of a forest, closest pairs first, of the linked pairs of equal keys in sorted rows.

    Rows differ in ``most`` bits at most and ``counted``, if given, tells at which key a difference counts; rows
    of sides 1 and 2 meet those of the other side alone. Of each pair the second is at ``fresh_from`` or later.
    """
    n, found, distances, pending = len(keys), [], [], 0
    names = prints[:, 0] if prints.shape[1] == 1 else prints[:, 0] ^ prints[:, 1] * np.uint64(0x9E3779B97F4A7C15)
    left = np.arange(n)

    def reduced() -> np.ndarray:
        pairs = np.concatenate(found)
        pairs = pairs[np.argsort(np.concatenate(distances), kind="stable")]
        kept = _forest(list(zip(names[pairs[:, 0]].tolist(), names[pairs[:, 1]].tolist())))
        return pairs[kept]

    for step in range(1, n):
        left = left[left + step < n]
        left = left[keys[left] == keys[left + step]]
        if not len(left):
            break
        i = left[left + step >= fresh_from]
        i = i[(sides[i] % 3 == 0) | (sides[i] != sides[i + step])]
        x = prints[i] ^ prints[i + step]
        bits = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        near = bits <= most
        i, x, bits = i[near], x[near], bits[near]
        if counted is not None:
            here = counted(x) == keys[i] >> 22
            i, bits = i[here], bits[here]
        if len(i):
            found.append(np.stack([i, i + step], axis=1))
            distances.append(bits)
            pending += len(i)
        if pending > 200_000:
            kept = reduced()
            bits = np.bitwise_count(prints[kept[:, 0]] ^ prints[kept[:, 1]]).sum(axis=1, dtype=np.int64)
            found, distances, pending = [kept], [bits], 0
    return reduced() if found else np.empty((0, 2), np.int64)


def _compare(words: int, most: int, counted, hot: int):
    """A function for mapInArrow over rows (key, side, words...) sorted by key: (a..., b..., key) edges.

    The last, unfinished key of a batch is carried over to the next one. A key with over ``hot`` rows of side 0
    yields its rows with a null b instead. Rows of sides 1 and 2 are the two blocks of one comparison.
    """
    names = [*(f"a{i}" for i in range(words)), *(f"b{i}" for i in range(words)), "key"]

    def rows(keys: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        left = [pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64()) for x in a.T]
        right = [pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64()) for x in b.T] if b is not None else [pa.nulls(len(a), pa.int64())] * words
        return pa.RecordBatch.from_arrays([*left, *right, pa.array(keys, pa.int64())], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sides, prints, spilled = np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, words), np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh_from = len(keys)
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            sides = np.concatenate([sides, batch.column(1).to_numpy()])
            prints = np.concatenate([prints, np.stack([batch.column(2 + i).to_numpy().view(np.uint64) for i in range(words)], axis=1)])
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            large = np.repeat((sizes > hot) & (sides[starts] == 0) | (keys[starts] == spilled if spilled is not None else False), sizes)
            spilled = int(keys[-1]) if large[-1] else None
            if large.any():
                yield rows(keys[large], prints[large], None)
                fresh_from -= int(np.count_nonzero(large[:fresh_from]))
                keys, sides, prints = keys[~large], sides[~large], prints[~large]
            pairs = _links(keys, sides, prints, fresh_from, most, counted)
            if len(pairs):
                yield rows(keys[pairs[:, 0]], prints[pairs[:, 0]], prints[pairs[:, 1]])
            open_from = int(np.searchsorted(keys, keys[-1])) if len(keys) and spilled is None else len(keys)
            keys, sides, prints = keys[open_from:], sides[open_from:], prints[open_from:]

    return scan, ", ".join(f"{x} long" for x in names)


def linked(keyed: DataFrame, words: int, most: int, counted=None, hot: int | None = None) -> DataFrame:
    """(a0, ..., b0, ...) edges whose components are those of all links among rows (key, p0, ...) of one key."""
    hot = hot or HOT
    spark, columns = keyed.sparkSession, [f"p{i}" for i in range(words)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    scan, schema = _compare(words, most, counted, hot)

    def compared(rows: DataFrame, group: str) -> DataFrame:
        dealt = rows.repartition(parts, group).sortWithinPartitions(group)
        return dealt.select(group, "side", *columns).mapInArrow(scan, schema)

    found = materialize(compared(keyed.select("key", F.lit(0).alias("side"), *columns), "key"), "links")
    edges = found.filter("b0 IS NOT NULL").drop("key")
    left = found.filter("b0 IS NULL").select("key", *[F.col(f"a{i}").alias(f"p{i}") for i in range(words)])
    if not left.head(1):
        return edges
    # Blocks of about hot / 2 rows; every pair of blocks of a key is one group.
    sizes = left.groupBy("key").agg(F.ceil(F.count("*") / (hot // 2)).cast("int").alias("blocks"))
    rows = left.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64(*columns), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    group = ((F.col("key").bitwiseAND(F.lit(-1 << 22))) + F.pmod(F.xxhash64("key", low, high), F.lit(1 << 22))).cast("long")
    return edges.unionByName(materialize(compared(rows.select(group.alias("pair"), side.alias("side"), *columns), "pair").drop("key"), "block-links"))


def linked_fingerprints(prints: DataFrame, hot: int | None = None) -> DataFrame:
    """(a, b) edges whose components are those of all links; ``prints`` has distinct fp."""
    keyed = variant_keys(prints).select("key", F.col("fp").alias("p0"))
    return linked(keyed, 1, MAX_BITS, _counted_at, hot).select(F.col("a0").alias("a"), F.col("b0").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node that is reachable, for every node of an edge (u, v)."""
    spark = edges.sparkSession
    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = materialize(small.filter("u <> v").distinct(), "edges")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if after == before or after[0] == after[2] and not edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").head(1):
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    marked = materialize(fingerprints(docs), "fingerprints")
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    edges = linked_fingerprints(prints.select("fp"))
    named = edges.join(prints.select(F.col("fp").alias("a"), F.col("rep").alias("u")), "a").join(prints.select(F.col("fp").alias("b"), F.col("rep").alias("v")), "b")
    found = components(named.select("u", "v"))
    classes = prints.join(found, prints["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def wide_keys(prints: DataFrame) -> DataFrame:
    """(key, p0, p1): the 128 one-wildcard variants of eight 16-bit segments."""
    keys = []
    for place in range(128):
        kept = 0xFFFF & ~(1 << place % 16)
        segment = F.shiftrightunsigned("p0" if place < 64 else "p1", place % 64 // 16 * 16).bitwiseAND(F.lit(kept))
        keys.append((F.lit(place << 22) + segment).cast("long"))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "p0", "p1")


def shingle_set(text) -> F.Column:
    """Distinct XXH64 of the WIDE_WIDTH-word shingles of a text; fewer words are one shingle."""
    words = words_of(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    zipped = F.arrays_zip(*[p.alias(f"w{j}") for j, p in enumerate(rolling(words, WIDE_WIDTH))])
    long = F.transform(zipped, lambda x: F.xxhash64(*[x[f"w{j}"] for j in range(WIDE_WIDTH)]))
    return F.array_distinct(F.when(F.size(words) >= WIDE_WIDTH, long).otherwise(F.array(F.xxhash64(F.array_join(words, " ")))))


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, content, node, class) per row: ``content`` hashes the text, ``node`` the fingerprint, ``class`` the group.

    Candidates are tested by the exact similarity of their shingle sets, close ones first, band by band of differing
    bits. What joins two texts that are in one class by then needs no test. A candidate is looked up in its own band
    alone, so a text takes as many rows as it has keys at most, whatever the size of its family.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["doc_id", "content", "p0", "p1"])

    content = F.xxhash64(text_of())
    prints = docs.select("doc_id", "text", content.alias("content")).mapInArrow(scan, f"doc_id {kind}, content long, p0 long, p1 long")
    marked = materialize(prints.withColumn("node", F.xxhash64("p0", "p1")), "wide-fingerprints")
    nodes = materialize(marked.groupBy("node", "p0", "p1").agg(F.min("content").alias("content")), "nodes")
    edges = linked(wide_keys(nodes.select("p0", "p1")), 2, WIDE_BITS, _wide_counted_at)
    bits = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    u, v = F.xxhash64("a0", "a1"), F.xxhash64("b0", "b1")
    found = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), bits.cast("int").alias("bits")).distinct()
    candidates = materialize(found, "candidates")
    wanted = candidates.select(F.col("u").alias("node")).unionAll(candidates.select(F.col("v").alias("node"))).distinct().join(nodes, "node").select("node", "content")
    texts = docs.select(content.alias("content"), text_of().alias("text")).join(wanted, "content").dropDuplicates(["node"])
    sets = materialize(texts.select("node", shingle_set(F.col("text")).alias("s")), "shingle-sets")
    classes = materialize(wanted.select("node", F.col("node").alias("class")), "classes")
    for low, high in zip((-1, *BANDS), BANDS):
        band = candidates.filter(F.col("bits").between(low + 1, high))
        if not band.head(1):
            continue
        cu, cv = (classes.select(F.col("node").alias(f"{x}_member"), F.col("class").alias(f"c{x}")) for x in "uv")
        su, sv = (sets.select(F.col("node").alias(f"{x}_node"), F.col("s").alias(f"s{x}")) for x in "uv")
        apart = band.join(cu, F.col("u") == F.col("u_member")).join(cv, (F.col("v") == F.col("v_member")) & (F.col("cu") != F.col("cv")))
        # shared / (a + b - shared) >= similarity, within the join so that only what is alike comes out of it
        alike = (1 + similarity) * F.size(F.array_intersect("su", "sv")) >= similarity * (F.size("su") + F.size("sv")) - 1e-9
        links = apart.join(sv, F.col("v") == F.col("v_node")).join(su, (F.col("u") == F.col("u_node")) & alike).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        merged = components(links).select(F.col("node").alias("class"), F.col("component").alias("into"))
        classes = materialize(classes.join(merged, "class", "left").select("node", F.coalesce("into", "class").alias("class")), "classes")
    return marked.join(classes, "node", "left").select("doc_id", "content", "node", F.coalesce("class", "node").alias("class"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class of `similar_documents`; columns stay, whatever their names.

    The document of the smallest doc_id stays (a null id is larger than any other), of several texts with that id
    the one with the smallest hash. Rows that repeat both id and text are one document and stay together; texts
    without a word, null included, are one class. An empty table gives an empty one.
    """
    found = materialize(similar_documents(docs, similarity), "classes-of-rows")
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("first"))
    more = found.join(first, "class").filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("content") == F.col("first.content"))))
    mine, other = fresh(docs, "content"), fresh(docs, "copy")
    copies = more.select(F.col("doc_id").alias(other), F.col("content").alias(f"{other}_content")).distinct()
    rows = docs.withColumn(mine, F.xxhash64(text_of()))
    return rows.join(copies, rows["doc_id"].eqNullSafe(copies[other]) & (rows[mine] == copies[f"{other}_content"]), "left_anti").drop(mine)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
