"""Training-order materialisation (operator 6): token sequences in a keyed pseudo-random order, as fixed-stride shards.

Each text is tokenised whole, once (a public byte-level BPE, an end id behind it). The ids of the documents that one task
reads follow each other and are cut into sequences of ``RECORD`` ids; only a task's last one is padded. They are kept as
compressed blocks in the shared folder. Sequences are numbered by the task that wrote them and their place in it. A keyed
Feistel permutation of a power-of-four domain, walked until it falls below the number of sequences, gives each number its
global slot: a bijection that any reader can compute or invert from (key, total) alone.

Slot s lies in shard s div ``SHARD_ROWS`` at byte (s mod ``SHARD_ROWS``) * stride: where a sequence is on disk needs no
table. Shards are ranges of slots: each task gets its range (``repartitionById``), puts one shard's sequences in their
places at a time and writes them from front to back under another name, then moves the file, so a task that runs again
after an executor was lost just writes the same file again. Between tasks, sequences travel in compressed groups of one
block and one shard. Training reads shards from front to back and resumes at any slot by one seek.

The files are written by ``materialise`` itself, once; its result, a row for each document that says where its tokens
are, is a stored table, so counting it writes nothing.

A very long text is encoded in steps of ``STEP`` characters or more, cut where a white space follows another character:
no piece of the pattern reaches across and none looks back, so the ids are those of the whole text.

Defined cases: null or empty text is only the end id; repeated rows are documents of their own; slots have no ties; an
empty table gives no shards. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, drop_cut, pieces, shared_dir, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
RECORD, SHARD_ROWS, KEY, ROUNDS = 256, 65_536, 20_240_229, 6
#: Characters encoded at once, at least.
STEP = 1_000_000
#: Tasks that write shards, at most; each takes a range of whole shards.
MOST_TASKS = 20_000
#: Sequences of one block, and how hard blocks and groups are compressed.
BLOCK, LEVELS = 6144, (6, 3)
#: Ids that the vocabulary leaves free.
END, PAD = 50_256, 50_257


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A character that a white space follows.
_BORDER = re.compile(r"\S(?=\s)")


class Tokens:
    """Token ids of texts by a public vocabulary."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("shards", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, step: int = STEP) -> np.ndarray:
        """Ids of the whole text."""
        parts, at = [], 0
        while len(text) - at > step:
            found = _BORDER.search(text, at + step)
            if not found:
                break
            parts.append(self._ids(text[at : found.end()]))
            at = found.end()
        parts.append(self._ids(text[at:] if at else text))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def _ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode([i for i in ids if i < END])


_LOADED: dict[str, Tokens] = {}


def loaded(path: str) -> Tokens:
    """The vocabulary, kept while a Python worker lives."""
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function for the rounds."""
    x = (x + np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(total: int) -> int:
    return max(1, ((max(total, 1) - 1).bit_length() + 1) // 2)


def slots_of(index: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The slot of each number below ``total``: Feistel rounds, walked along the cycle until below ``total``."""
    half = np.uint64(_half_bits(total))
    mask = np.uint64((1 << int(half)) - 1)
    out, left = index.astype(np.uint64), np.arange(len(index))
    while len(left):
        a, b = out[left] >> half, out[left] & mask
        for k in range(ROUNDS):
            a, b = b, a ^ (_mix(b, key + k * 0x632BE59BD9B4E019) & mask)
        out[left] = a << half | b
        left = left[out[left] >= total]
    return out.astype(np.int64)


def indices_of(slots: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The inverse of ``slots_of``."""
    half = np.uint64(_half_bits(total))
    mask = np.uint64((1 << int(half)) - 1)
    out, left = slots.astype(np.uint64), np.arange(len(slots))
    while len(left):
        a, b = out[left] >> half, out[left] & mask
        for k in reversed(range(ROUNDS)):
            a, b = b ^ (_mix(a, key + k * 0x632BE59BD9B4E019) & mask), a
        out[left] = a << half | b
        left = left[out[left] >= total]
    return out.astype(np.int64)


def sequences(docs: DataFrame, record: int, vocabulary: str, block: int = BLOCK) -> DataFrame:
    """Blocks of sequences: part and at (which task, its how-manieth sequence comes first), n, ids (two bytes each,
    compressed), and the documents that end in the block: doc_id, start (in the task's ids), n_tokens, crc."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codec, part_id = loaded(vocabulary), pa.Codec("zstd", compression_level=LEVELS[0]), TaskContext.get().partitionId()
        held, held_n, at, start = [], 0, 0, 0
        names, starts, lengths, crcs = [], [], [], []

        def emit(ids: np.ndarray, id_type: pa.DataType) -> pa.RecordBatch:
            own = pa.StructArray.from_arrays([pa.array(names, id_type), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "crc"])
            out = pa.RecordBatch.from_arrays(
                [pa.array([part_id], pa.int32()), pa.array([at], pa.int64()), pa.array([len(ids) // record], pa.int32()), pa.array([codec.compress(ids.tobytes(), asbytes=True)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)],
                ["part", "at", "n", "ids", "docs"],
            )
            for x in (names, starts, lengths, crcs):
                x.clear()
            return out

        id_type = None
        for batch in batches:
            for part in pieces(batch, "text"):
                id_type = part.column("doc_id").type
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(model.encode(text or ""), END).astype("<u2")
                    names.append(doc_id)
                    starts.append(start)
                    lengths.append(len(ids))
                    crcs.append(zlib.crc32(ids.tobytes()))
                    held.append(ids)
                    held_n += len(ids)
                    start += len(ids)
                    if held_n >= block * record:
                        whole = np.concatenate(held)
                        for k in range(0, len(whole) - block * record + 1, block * record):
                            yield emit(whole[k : k + block * record], id_type)
                            at += block
                        held = [whole[len(whole) // (block * record) * (block * record) :]]
                        held_n = len(held[0])
        if held_n or names:
            whole = np.concatenate([*held, np.full(-held_n % record, PAD, "<u2")])
            yield emit(whole, id_type)

    docs_type = f"array<struct<doc_id:{kind},start:bigint,n_tokens:bigint,crc:bigint>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"part int, at long, n int, ids binary, docs {docs_type}")


def materialise(docs: DataFrame, path: str, key: int = KEY, record: int = RECORD, shard_rows: int = SHARD_ROWS, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """Write the shards below ``path``; one row for each document: doc_id, seq_index and token (the sequence that its
    first token is in, and where), slot, shard, offset (of that token, in bytes of the shard), n_tokens (with the end id),
    token_crc32. Its further tokens are in the sequences seq_index + 1, ..., whose slots ``slots_of`` tells."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = cut(sequences(docs, record, vocabulary or vocabulary_path(), block), "training-sequences")
    counts = dict(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n")).collect())  # a row for each task
    total, starts = 0, {}
    for part in sorted(counts):
        starts[part] = total
        total += counts[part]
    stride, shards = 2 * record, -(-total // shard_rows)
    each = max(1, -(-shards // MOST_TASKS))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=LEVELS[1])
        for batch in batches:
            for part, at, n, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "n", "ids"))):
                ids = np.frombuffer(codec.decompress(raw, n * stride), "<u2").reshape(n, record)
                slot = slots_of(starts[part] + at + np.arange(n), total, key)
                order = np.argsort(slot, kind="stable")
                shard = slot[order] // shard_rows
                firsts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
                own = [order[a:b] for a, b in zip(firsts, [*firsts[1:], n])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((shard[firsts] // each).astype(np.int32)), pa.array(shard[firsts].astype(np.int32)), pa.array([slot[o].astype("<i8").tobytes() for o in own], pa.binary()), pa.array([codec.compress(ids[o].tobytes(), asbytes=True) for o in own], pa.binary())],
                    ["task", "shard", "slots", "ids"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        now, places, seen = None, None, None

        def close() -> pa.RecordBatch:
            if not seen.all():
                raise RuntimeError(f"shard {now} lacks {int((~seen).sum())} of {len(seen)} sequences")
            temporary = f"{root}/.shard-{now:08d}-{uuid.uuid4().hex}"
            with files.open_output_stream(temporary) as sink:
                sink.write(memoryview(places).cast("B"))
            files.move(temporary, f"{root}/shard-{now:08d}.bin")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(seen)], pa.int64())], ["shard", "sequences"])

        for batch in batches:
            for shard, slots, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "slots", "ids"))):
                if shard != now:
                    if now is not None:
                        yield close()
                    now = shard
                    rows = min(shard_rows, total - shard * shard_rows)
                    places, seen = np.zeros((rows, record), "<u2"), np.zeros(rows, bool)
                at = np.frombuffer(slots, "<i8") - shard * shard_rows
                places[at] = np.frombuffer(pa.decompress(raw, len(at) * stride, "zstd"), "<u2").reshape(-1, record)
                seen[at] = True
        if now is not None:
            yield close()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, start, n_tokens, crc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "start", "n_tokens", "crc"))
            which, back = np.unique(part, return_inverse=True)
            index = np.array([starts[p] for p in which.tolist()], np.int64)[back] + start // record
            slot, token = slots_of(index, total, key), start % record
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(index), pa.array(token.astype(np.int32)), pa.array(slot), pa.array((slot // shard_rows).astype(np.int32)), pa.array(slot % shard_rows * stride + 2 * token), pa.array(n_tokens), pa.array(crc)],
                ["doc_id", "seq_index", "token", "slot", "shard", "offset", "n_tokens", "token_crc32"],
            )

    groups = blocks.select("part", "at", "n", "ids").mapInArrow(group, "task int, shard int, slots binary, ids binary")
    written = groups.repartitionById(max(1, -(-shards // each)), "task").sortWithinPartitions("shard").select("shard", "slots", "ids").mapInArrow(write, "shard int, sequences long")
    found = written.agg(F.count("*"), F.sum("sequences")).first()
    if tuple(found) != (shards, total or None):
        raise RuntimeError(f"{tuple(found)} shards and sequences were written, not {(shards, total)}")
    own = blocks.select("part", F.explode("docs").alias("d")).select("part", "d.*")
    out = cut(own.mapInArrow(place, f"doc_id {kind}, seq_index long, token int, slot long, shard int, offset long, n_tokens long, token_crc32 long"), "training-order")
    drop_cut(blocks)
    write_plan(path, {"sequences": total, "shards": shards, "record": record, "stride": stride, "shard_rows": shard_rows, "key": key, "pad": PAD, "end": END, "dtype": "<u2"})
    return out


def write_plan(path: str, plan: dict) -> None:
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/order.json") as sink:
        sink.write(json.dumps(plan).encode())


def read_records(path: str, slot: int = 0) -> Iterator[np.ndarray]:
    """Sequences (padded) in training order from a slot on: one seek, then sequential reads."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path)
    with files.open_input_stream(f"{root}/order.json") as source:
        plan = json.loads(source.read())
    first = slot % plan["shard_rows"]
    for s in range(slot // plan["shard_rows"], plan["shards"]):
        with files.open_input_file(f"{root}/shard-{s:08d}.bin") as source:
            source.seek(first * plan["stride"])
            while raw := source.read(plan["stride"] * 1024):
                yield from np.frombuffer(raw, plan["dtype"]).reshape(-1, plan["record"])
        first = 0


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}")
