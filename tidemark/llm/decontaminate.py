"""Benchmark decontamination (operator 8) by Wu-Manber search over words.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of their UTF-8 bytes. A test item
gives its windows of ``WINDOW`` consecutive words (one window if it has fewer, but some). The search symbol is a word:
for each window length a shift table holds, for every block of two words (one for windows of one word), how far the
search may move when the block ends at the current position; a block that ends no window skips up to the window's
length. Where the shift is nought, the hash bucket of the suffix gives the windows to compare directly.

The items stream through the driver one block of at most ``BLOCK_WINDOWS`` windows or ``BLOCK_BYTES`` of text at a time
(an item with more windows is split over blocks), so what the driver holds and what is broadcast is bounded whatever the
benchmark's size. With one block the documents are read once. More blocks are searched one after the other: rows get a
number in a stored table first, each pass stores the hits it finds, and all passes' spans and items are merged by row;
nothing is left out. An executor builds a block's tables once for each worker.

Defined cases: null, empty or wordless texts have no words, so no hit; very long texts are searched whole; items without
words give no window; items that repeat a text or an id are all reported (an id once, ids in order as strings, so ties
don't matter); a null item_id takes part in hits but not in the list. A row is returned for each row of documents.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, kept, pieces, raw_texts, table

WINDOW = 10
#: Windows in one set of search tables, and text bytes it is made from: the bound of what is broadcast.
BLOCK_WINDOWS, BLOCK_BYTES = 200_000, 32 << 20

_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Words of a text: folded case, every other ASCII byte is a separator."""
    return raw.translate(_FOLD).split()


class WuManber:
    """Windows (tuples of words, each with the items that hold it) of one length."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.block = 2 if length > 1 else 1
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}

    def add(self, window: tuple[bytes, ...], item: int) -> None:
        if self.block == 2:
            for j in range(1, self.length):
                key = (window[j - 1], window[j])
                move = self.length - 1 - j
                if move < self.shift.get(key, self.far):
                    self.shift[key] = move
        else:
            self.shift[window[0]] = 0
        self.bucket.setdefault(window[-3:], {}).setdefault(window, []).append(item)

    def find(self, words: list[bytes]) -> list[tuple[int, list[int]]]:
        """(first word, items) of every occurrence, in order."""
        found = []
        length, n, far = self.length, len(words), self.far
        if n < length:
            return found
        shift, bucket = self.shift.get, self.bucket.get
        i = length - 1
        if self.block == 1:
            for i, w in enumerate(words):
                if shift(w) == 0:
                    found.append((i, bucket((w,))[(w,)]))
            return found
        while i < n:
            move = shift((words[i - 1], words[i]), far)
            if move:
                i += move
                continue
            start = i - length + 1
            near = bucket(tuple(words[max(start, i - 2) : i + 1]))
            if near:
                items = near.get(tuple(words[start : i + 1]))
                if items:
                    found.append((start, items))
            i += 1
        return found


def windows_of(words: list[bytes], window: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


def build(items: list[tuple[object, bytes]], window: int = WINDOW) -> list[WuManber]:
    """Search tables of the items (number, text), one for each window length."""
    out: dict[int, WuManber] = {}
    for number, raw in items:
        for w in windows_of(words_of(raw), window):
            out.setdefault(len(w), WuManber(len(w))).add(w, number)
    return list(out.values())


def search(tables: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged spans [start, stop) of hit words, and the items that hit."""
    spans, items = [], set()
    for t in tables:
        for start, own in t.find(words):
            items.update(own)
            spans.append((start, start + t.length))
    return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def listed(items: set, names: dict) -> tuple[int, str]:
    """Count of the items' ids, and sha256 of the ids sorted as strings and joined by commas."""
    ids = sorted({names[i] for i in items if names[i] is not None})
    return len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def item_blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WINDOWS) -> Iterator[list[tuple[int, str | None, bytes]]]:
    """(number, id, words) of items, in blocks of at most ``most`` windows (and about ``BLOCK_BYTES``), streamed through
    the driver one block at a time. An item with more windows than a block has room for goes on in the next one."""
    block, held, size = [], 0, 0
    for number, row in enumerate(benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator()):
        words = words_of((row[1] or "").encode())
        windows = max(1, len(words) - window + 1) if words else 0
        at = 0
        while at < windows:
            take = min(windows - at, most - held)
            raw = b" ".join(words[at : at + take + window - 1])
            block.append((number, row[0], raw))
            at, held, size = at + take, held + take, size + len(raw)
            if held >= most or size >= BLOCK_BYTES:
                yield block
                block, held, size = [], 0, 0
    if block:
        yield block


_OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_TYPES = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _searcher(docs: DataFrame, block: list, window: int):
    """A function that gives (search tables, names of items) of a broadcast block, built once for each worker."""
    sent, key = docs.sparkSession.sparkContext.broadcast(block), f"leaks-{uuid.uuid4().hex}"
    return lambda: kept(key, lambda: (build([(n, raw) for n, _, raw in sent.value], window), {n: name for n, name, _ in sent.value}))


def _one_pass(docs: DataFrame, block: list, window: int, clean_only: bool) -> DataFrame:
    made = _searcher(docs, block, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = made()
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for raw in raw_texts(part.column("text")):
                    words = words_of(raw)
                    spans, items = search(tables, words)
                    hit = sum(b - a for a, b in spans)
                    rows.append((len(words), hit, *listed(items, names), hit > 0))
                cols = list(zip(*rows))
                if clean_only:
                    yield part.filter(pa.array([not x for x in cols[4]]))
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())))], ["doc_id", *_OUT])

    if clean_only:
        return docs.mapInArrow(run, docs.schema)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {_TYPES}")


def _many_passes(docs: DataFrame, blocks: Iterator[list], window: int) -> DataFrame:
    """The same rows from several bounded passes, one after the other: each stores the spans and item ids of the rows it
    hits; they are merged for each row of documents. Rows are numbered in a stored table, so every pass sees the same."""
    numbered = cut(docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", F.col("text").cast("string").alias("text")), "leaks-rows")
    hits = None
    for block in blocks:
        made = _searcher(docs, block, window)

        def run(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            tables, names = made()
            for batch in batches:
                for part in pieces(batch, "text"):
                    at, spans, ids = [], [], []
                    for row, raw in zip(part.column("at").to_pylist(), raw_texts(part.column("text"))):
                        own, items = search(tables, words_of(raw))
                        if own:
                            at.append(row)
                            spans.append([{"a": a, "b": b} for a, b in own])
                            ids.append(sorted({names[i] for i in items if names[i] is not None}))
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(ids, pa.list_(pa.string()))], ["at", "spans", "ids"])

        one = cut(numbered.select("at", "text").mapInArrow(run, "at long, spans array<struct<a:bigint,b:bigint>>, ids array<string>"), "leaks-hits")
        hits = one if hits is None else hits.unionByName(one)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n = [len(words_of(raw)) for raw in raw_texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("at"), part.column("doc_id"), pa.array(n, pa.int64())], ["at", "doc_id", "n_words"])

    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
        lambda s: s["n"],
    )
    found = hits.groupBy("at").agg(merged.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = numbered.mapInArrow(count, f"at long, doc_id {kind}, n_words long").join(found, "at", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, window, most)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _one_pass(docs, first, window, False)
    return _many_passes(docs, chain((first, second), blocks), window)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; each block of items is one filtering pass."""
    bounded_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, window, most)
    block = next(blocks, None)
    while block is not None:
        docs, block = _one_pass(docs, block, window, True), next(blocks, None)
        if block is not None:  # no plan holds more than one block
            docs = cut(docs, "leaks-clean")
    return docs


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The whole query in DuckDB's SQL: windows as lists of words, joined.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, len(x) AS n, x FROM (SELECT item, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WINDOW} THEN [w] ELSE list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: w[i : i + {WINDOW} - 1]) END) AS x FROM b)),
place AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hits AS (SELECT DISTINCT r, i, n, item FROM (SELECT r, i, n, w[i : i + n - 1] AS x FROM place) JOIN win USING (n, x)),
n_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN own USING (r)
"""
