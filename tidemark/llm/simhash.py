"""SimHash near-duplicates (operator 7) by a Gray-order hierarchical index.

A text is lower-cased (A-Z), split into words at ASCII white space and cut into 4-word shingles, repeats included.
A fingerprint bit is set when over half of the shingles' XXH64 values have it. Fingerprints link at ``MAX_BITS`` or
fewer differing bits; a component is what links connect.

Plan, for N texts with D different fingerprints:

1. fingerprints in one narrow pass over the text (Arrow), no shuffle;
2. one representative for each fingerprint (``min`` with map-side combine), so copies cost one row from here on;
3. the index: 64 bits in 6 blocks; two fingerprints that differ in 4 bits agree in two blocks at least. For each of the 15
   pairs of blocks the bits are permuted so that the pair leads (the key), and the permuted values are range-partitioned
   and sorted by Gray rank. Consecutive ones form indexes of ``CHUNK`` members: groups of ``FAN_OUT`` under nodes that hold
   the bits all members share, nodes under nodes. Every member is searched from the roots down: differences add up, and a
   whole group is left when they pass ``MAX_BITS`` or touch the key. Values are distinct, so ranges are even however
   crowded a key is; no task holds more than one index;
4. keys that reach beyond one index: members at its two ends meet other indexes' members of the same key. Pairs of such
   groups are pruned by their upper nodes; what is left is searched in tasks of two groups each. No pair is left out;
5. only links that join two parts are emitted (a spanning forest, never all pairs of a group);
6. components by alternating large-star and small-star rounds, each cut into a table of the shared folder.

Defined cases: null or wordless text has fingerprint 0, linked like any other; very long texts are read whole; rows that
repeat a doc_id each get their own row; a null doc_id joins components through its text but is never a component_id,
unless no other is there (then component_id is null). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, drop_cut, forget, pieces, raw_texts, table, unused, whole_row

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: Members of one index, so of one search step in a task.
CHUNK = 4096
#: Children of a node of the index.
FAN_OUT = 8
#: The blocks that linked fingerprints share two of: (first bit, bits).
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Each pair of blocks leads one order of the bits.
ORDERS = tuple((*pair, *(k for k in range(len(BLOCKS)) if k not in pair)) for pair in combinations(range(len(BLOCKS)), 2))
_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    x, hashes, counts = xxhash.xxh64_intdigest, [], []
    for raw in texts:
        words = raw.lower().split()
        n = len(words)
        if not n:
            counts.append(0)
            continue
        joined = b" ".join(words)
        if n <= SHINGLE_WORDS:
            hashes.append(x(joined, SEED))
            counts.append(1)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - SHINGLE_WORDS] + 1)).tolist()
        hashes += [x(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist())]
        counts.append(n - SHINGLE_WORDS + 1)
    n = np.array(counts, np.int64)
    ones = bit_counts(np.array(hashes, np.uint64), n)
    bits = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each bit: byte lanes of 64-bit words add up 255 hashes at a time."""
    out = np.zeros((len(counts), 64), np.int64)
    if not len(hashes):
        return out
    firsts = np.cumsum(counts) - counts
    parts = -(-counts // 255)
    owner = np.repeat(np.arange(len(counts)), parts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = firsts[owner] + 255 * inner
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, at)
        np.add.at(out[:, k::8], owner, lanes.view(np.uint8).reshape(-1, 8))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = fingerprints_of(raw_texts(part.column("text"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray sequence: neighbours differ in few bits."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class Parts:
    """Union-find over positions 0..n-1 that reports which unions joined two parts."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
        new = []
        for a, b in pairs:
            ra, rb = self.find(a), self.find(b)
            if ra != rb:
                self.up[max(ra, rb)] = min(ra, rb)
                new.append((a, b))
        return new

    def labels(self) -> np.ndarray:
        up = np.array(self.up, np.int64)
        while True:
            over = up[up]
            if np.array_equal(over, up):
                self.up = up.tolist()
                return up
            up = over


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits all members of a group share.

    ``levels[0]`` are the roots. A node keeps only the bits that its parent does not have, so a search adds up the
    differences on its way down and leaves a whole group as soon as they pass the limit.
    """

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps  # sorted by Gray rank
        ones, zeros = fps.copy(), ~fps
        stack = [(ones, zeros)]
        while len(stack[-1][0]) > FAN_OUT:
            at = np.arange(0, len(stack[-1][0]), FAN_OUT)
            stack.append((np.bitwise_and.reduceat(stack[-1][0], at), np.bitwise_and.reduceat(stack[-1][1], at)))
        self.levels = []
        above = None
        for ones, zeros in reversed(stack):
            mask = ones | zeros
            own = mask if above is None else mask & ~above[np.arange(len(mask)) // FAN_OUT]
            self.levels.append((own, ones & own))
            above = mask

    def links(self, queries: np.ndarray, limit: int, same=None, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query number, member position) of every pair within ``limit`` bits that agrees in the bits of ``key``.
        ``same(level, query, node)`` may drop groups that are already connected to the query."""
        n = len(self.levels[0][0])
        q, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        off = np.zeros(len(q), np.uint8)
        for depth, (mask, pattern) in enumerate(self.levels):
            if depth:
                node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                q, off = np.repeat(q, FAN_OUT), np.repeat(off, FAN_OUT)
                there = node < len(mask)
                q, node, off = q[there], node[there], off[there]
            far = (queries[q] ^ pattern[node]) & mask[node]
            off = off + np.bitwise_count(far)
            keep = (off <= limit) & (far & np.uint64(key) == 0)
            if same is not None:
                at = np.flatnonzero(keep)
                keep[at] = ~same(len(self.levels) - 1 - depth, q[at], node[at])
            q, node, off = q[keep], node[keep], off[keep]
        return q, node


def spanning_links(fps: np.ndarray, limit: int = MAX_BITS, split: int | None = None, key: int = 0) -> list[tuple[int, int]]:
    """Positions of links that connect whatever links of at most ``limit`` bits (none of them in ``key``) connect. ``fps``
    are in Gray order (two runs in Gray order with ``split``: then only links across the two count)."""
    n = len(fps)
    parts, out = Parts(n), []
    qa, qb, ma, mb = (0, n, 0, n) if split is None else (0, split, split, n)
    index = GrayIndex(fps[ma:mb])
    for at in range(qa, qb, 256):
        queries = np.arange(at, min(at + 256, qb))
        same = None
        if out:  # groups that are wholly in the query's part need no visit
            label = parts.labels()
            low, high = [label[ma:mb]], [label[ma:mb]]
            while len(low[-1]) > FAN_OUT:
                cuts = np.arange(0, len(low[-1]), FAN_OUT)
                low.append(np.minimum.reduceat(low[-1], cuts))
                high.append(np.maximum.reduceat(high[-1], cuts))
            same = lambda k, q, node: (low[k][node] == high[k][node]) & (low[k][node] == label[queries[q]])  # noqa: B023, E731
        q, m = index.links(fps[queries], limit, same, key)
        q, m = queries[q], m + ma
        keep = q != m
        out += parts.join(zip(q[keep].tolist(), m[keep].tolist()))
    return out


def permuted(fps: np.ndarray, order: int) -> np.ndarray:
    """Fingerprints with the blocks of ``ORDERS[order]`` from the highest bit down."""
    out, at = np.zeros_like(fps), 64
    for k in ORDERS[order]:
        first, bits = BLOCKS[k]
        at -= bits
        out |= ((fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)) << np.uint64(at)
    return out


def restored(values: np.ndarray, order: int) -> np.ndarray:
    """The inverse of ``permuted``."""
    out, at = np.zeros_like(values), 64
    for k in ORDERS[order]:
        first, bits = BLOCKS[k]
        at -= bits
        out |= ((values >> np.uint64(at)) & np.uint64((1 << bits) - 1)) << np.uint64(first)
    return out


def key_bits(order: int) -> int:
    """How many leading bits of a permuted value are its key."""
    return sum(BLOCKS[k][1] for k in ORDERS[order][:2])


def key_mask(order: int) -> int:
    return ((1 << key_bits(order)) - 1) << (64 - key_bits(order))


_SIGN = np.uint64(1 << 63)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> (band, rank): its Gray rank in each order of the bits, as a long that sorts alike."""
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for band in range(len(ORDERS)):
            rank = (gray_rank(permuted(fps, band)) ^ _SIGN).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), band, np.int32)), pa.array(rank)], ["band", "rank"])


_LINKS = "kind int, a long, b long, band int, key int, chunk long"


def _search(batches: Iterator[pa.RecordBatch], most: int, part: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows (band, rank) in order -> links as fingerprints (kind 0), and the members (permuted) of the first and the
    last key of every index (kind 1), as those keys may go on in another index."""
    chunk, held_band, held = part << 32, -1, np.zeros(0, np.uint64)

    def emit(kind: int, a: np.ndarray, b: np.ndarray, band: int, key: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(n, band, np.int32)), pa.array(key.astype(np.int32)), pa.array(np.full(n, chunk, np.int64))],
            ["kind", "a", "b", "band", "key", "chunk"],
        )

    def work(band: int, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = rank ^ (rank >> np.uint64(1))  # the Gray code of a rank
        pairs = np.array(spanning_links(values, MAX_BITS, key=key_mask(band)), np.int64).reshape(-1, 2)
        if len(pairs):
            yield emit(0, restored(values[pairs[:, 0]], band), restored(values[pairs[:, 1]], band), band, np.zeros(len(pairs), np.int64))
        keys = values >> np.uint64(64 - key_bits(band))
        ends = (keys == keys[0]) | (keys == keys[-1])
        yield emit(1, values[ends], values[ends], band, keys[ends])

    for batch in batches:
        bands = batch.column("band").to_numpy(zero_copy_only=False)
        ranks = batch.column("rank").to_numpy(zero_copy_only=False).view(np.uint64) ^ _SIGN
        firsts = np.flatnonzero(np.concatenate(([True], bands[1:] != bands[:-1]))) if len(bands) else []
        for a, b in zip(firsts, [*firsts[1:], len(bands)]):
            if bands[a] != held_band:
                if len(held):
                    yield from work(held_band, held)
                    chunk += 1
                held_band, held = int(bands[a]), ranks[:0]
            held = np.concatenate((held, ranks[a:b]))
            while len(held) > most:
                yield from work(held_band, held[:most])
                chunk += 1
                held = held[most:]
    if len(held):
        yield from work(held_band, held)


def _chunk_nodes(members: DataFrame) -> DataFrame:
    """The upper node of each group: shared one bits and shared zero bits."""
    return members.groupBy("band", "key", "chunk").agg(F.bit_and("a").alias("ones"), F.bit_and(F.bitwise_not("a")).alias("zeros"))


def _chunk_links(members: DataFrame) -> DataFrame:
    """Links between groups of one key in different indexes: pairs of groups that their upper nodes don't rule out,
    each searched in its own task group of at most two."""
    nodes = _chunk_nodes(members)
    x, y = nodes.alias("x"), nodes.alias("y")
    far = F.bit_count((F.col("x.ones").bitwiseXOR(F.col("y.ones"))).bitwiseAND(F.col("x.ones").bitwiseOR(F.col("x.zeros"))).bitwiseAND(F.col("y.ones").bitwiseOR(F.col("y.zeros"))))
    pairs = x.join(y, [F.col("x.band") == F.col("y.band"), F.col("x.key") == F.col("y.key"), F.col("x.chunk") < F.col("y.chunk")]).where(far <= MAX_BITS)
    pairs = pairs.select(F.col("x.band").alias("band"), F.col("x.key").alias("key"), F.col("x.chunk").alias("c1"), F.col("y.chunk").alias("c2"))
    sides = pairs.select("*", F.explode(F.array("c1", "c2")).alias("chunk"))

    def search(pdf):
        import pandas as pd

        band = int(pdf["band"].iloc[0])
        one = pdf[pdf["chunk"] == pdf["c1"]]["a"].to_numpy().view(np.uint64)
        two = pdf[pdf["chunk"] == pdf["c2"]]["a"].to_numpy().view(np.uint64)
        one, two = one[np.argsort(gray_rank(one), kind="stable")], two[np.argsort(gray_rank(two), kind="stable")]
        both = np.concatenate((one, two))
        found = np.array(spanning_links(both, MAX_BITS, split=len(one)), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": restored(both[found[:, 0]], band).view(np.int64), "b": restored(both[found[:, 1]], band).view(np.int64)})

    return members.select("band", "key", "chunk", "a").join(sides, ["band", "key", "chunk"]).groupBy("band", "key", "c1", "c2").applyInPandas(search, "a long, b long")


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect what fingerprints within ``MAX_BITS`` connect; ``distinct`` has different values of fp."""
    spread = cut(distinct.select("fp").mapInArrow(_spread, "band int, rank long"), "simhash-ranks")  # ranges are sampled from it
    order = spread.repartitionByRange("band", "rank").sortWithinPartitions("band", "rank")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search(batches, chunk, TaskContext.get().partitionId())

    found = cut(order.mapInArrow(search, _LINKS), "simhash-links")
    drop_cut(spread)
    near = found.where("kind = 0").select("a", "b")
    ends = found.where("kind = 1")
    split = ends.groupBy("band", "key").agg((F.min("chunk") < F.max("chunk")).alias("split")).where("split").select("band", "key")
    return near.unionByName(_chunk_links(cut(ends.join(split, ["band", "key"], "left_semi"), "simhash-ends")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node that can be reached. Alternating
    large-star and small-star; the least neighbour is a combinable aggregate, so a hub is not gathered anywhere."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "cc")
    seen = None
    while True:
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        new = cut(small, "cc")
        state = tuple(new.agg(F.count("*"), F.sum(F.hash("v", "u").cast("long")), F.bit_xor(F.xxhash64("v", "u"))).first())
        drop_cut(now)
        now = new
        if state == seen:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach, itself included)."""
    fps = cut(fingerprints(docs), "simhash-fp")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (a null one only if no other is there),
    of rows that repeat it the one of least fingerprint, then of least hash. Rows are told apart by all their columns
    (128 bits of hashes): of rows that are equal throughout one stays."""
    bounded_batches(docs.sparkSession)
    h1, h2 = unused(docs, "_h1"), unused(docs, "_h2")
    docs = docs.select("*", *(F.xxhash64(F.lit(seed), *whole_row(docs)).alias(h) for seed, h in ((1, h1), (2, h2))))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = fingerprints_of(raw_texts(part.column("text"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), part.column(2), part.column(3)], ["doc_id", "fp", "h1", "h2"])

    rows = cut(docs.select("doc_id", F.col("text").cast("string").alias("text"), h1, h2).mapInArrow(run, f"doc_id {kind}, fp long, h1 long, h2 long"), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "h1", "h2"))
    # the first row of each fingerprint, then the first of each component
    distinct = rows.groupBy("fp").agg(first.alias("row"))
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("row", F.coalesce("root", "fp").alias("root"))
    kept = cut(rooted.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.h1").alias(h1), F.col("row.h2").alias(h2)).distinct(), "simhash-kept")
    twice = rows.select(F.col("h1").alias(h1), F.col("h2").alias(h2)).groupBy(h1, h2).agg(F.count("*").alias("n")).where("n > 1").select(h1, h2)
    twice = cut(twice.join(kept, [h1, h2], "left_semi"), "simhash-twice")
    own = [c for c in docs.columns if c not in (h1, h2)]
    chosen = docs.join(kept, [h1, h2], "left_semi")
    if not twice.limit(1).count():
        return chosen.select(*own)
    # equal rows of one document, wherever they lie, are reduced to one behind a second, narrow choice
    once = chosen.join(twice, [h1, h2], "left_anti").select(*own)
    return once.unionByName(docs.join(twice, [h1, h2], "left_semi").dropDuplicates([h1, h2]).select(*own))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
