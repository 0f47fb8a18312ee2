"""SentencePiece encoding and decoding (operator 2) by a max-plus parallel scan.

The pieces and scores are those of a public model file; a text's encoding is the segmentation with the greatest sum of
scores (the unigram search of SentencePiece; of equal sums the one whose last piece is longest, and so on backwards, as
that search has it). The scores of the file are whole numbers, so sums are exact and may be combined in any order.
Letters without a piece become the bytes of their UTF-8 form. Normalisation is the model's: identity, a space in front,
spaces as ``▁``; hence ``decode(encode(text)) == text`` for every text without ``▁`` itself, which comes back as a space.

No piece has ``▁`` behind another letter, so the beginning of a run of ``▁`` is a border that every segmentation
respects, and so are both ends of a letter without a piece. Between two borders lies a segment. Short segments (words)
are solved once and kept in a bounded cache.

Giant texts: a text of more than ``CHUNK`` letters is cut into chunks, at a border if there is one in the last quarter
of a chunk, anywhere else if there is none. Chunks become rows of their own. A state at a cut
is the number of letters that the piece over the cut still has behind it (0: the cut is a border between pieces), at
most the longest piece less one. Each chunk gives the max-plus matrix of its best sums from every state at its
beginning to every state at its end. Matrices of one text are combined associatively (a scan over its chunks, from both
sides, picks the state at every cut), and every chunk is then traced back on its own between its two states. A chunk
with a border inside has a matrix of rank one (best sum to the first border, from the last border), which costs no more
than the plain search. A chunk's matrix has at most 16 x 16 numbers, whatever its length. (Where a stretch without borders passes a cut, equal sums are
settled for the longest piece over that cut.)

Defined cases: a null text has null ids, n_tokens 0 and round_trip null; an empty text has no ids and round_trip true;
repeated rows are encoded each; a null doc_id is kept. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, kept, table
from tidemark.llm.common import pieces as cut_batch

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Letters of a chunk. Longer texts are scanned in parallel.
CHUNK = 32_768
#: Words longer than this aren't cached; words in the cache (about 250 bytes each).
LONG, CACHE = 48, 500_000
_NONE = float("-inf")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Ids of words behind one space, worked out when first asked for; bounded."""

    def __init__(self, model: Pieces) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, w: str) -> tuple[int, ...]:
        ids = tuple(self.model.word(MARK + w))
        if len(w) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[w] = ids
        return ids


class Pieces:
    """The vocabulary of a SentencePiece model file: searches for the best segmentation, and decoding."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.id))
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has ▁ behind another letter: beginnings of words aren't borders")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.value = {i: bytes([b]) for b, i in enumerate(self.byte)} | {i: self.text[i].replace(MARK, " ").encode() for i in plain}
        # pieces as a tree of dicts, the score of a piece under "": a search that grows to the right stops where no piece goes on so
        self.root: dict = {}
        for p, x in self.score.items():
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = x
        self.letters = {c for p in self.id for c in p}
        # a letter without a piece of its own may only stand inside a longer piece; alone it is written as bytes, at this cost
        self.unknown = min(self.score.values()) - 10.0
        lead = [b < 0x80 or b >= 0xC0 for b in range(256)]
        self.score_of = {self.id[p]: x for p, x in self.score.items()} | {i: self.unknown if lead[b] else 0.0 for b, i in enumerate(self.byte)}
        self.words = _Words(self)

    def normal(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def ids_of_unknown(self, letter: str) -> list[int]:
        return [self.byte[b] for b in letter.encode("utf-8", "surrogatepass")]

    def borders(self, s: str) -> list[int]:
        """Positions (first and last included) that no piece can cross."""
        out, before = [0], MARK
        for k, c in enumerate(s):  # as ``border`` for every position
            if k and (c == MARK != before or c not in self.letters or before not in self.letters):
                out.append(k)
            before = c
        out.append(len(s))
        return out

    def border(self, s: str, k: int) -> bool:
        return s[k] == MARK != s[k - 1] or s[k] not in self.letters or s[k - 1] not in self.letters

    def chunks(self, s: str, chunk: int) -> Iterator[tuple[str, str]]:
        """(chunk, letters behind it) of a giant text."""
        at, n = 0, len(s)
        while at < n:
            end = min(n, at + chunk)
            for k in range(end, end - chunk // 4, -1) if end < n else ():
                if self.border(s, k):
                    end = k
                    break
            yield s[at:end], s[end : end + self.longest - 1]
            at = end

    def best(self, s: str, start: int = 0) -> tuple[list[float], list[int]]:
        """For every position from ``start``: the greatest sum of scores up to it, and where its last piece begins."""
        n, root = len(s), self.root
        total, back = [_NONE] * (n + 1), [-1] * (n + 1)
        total[start] = 0.0
        for i in range(start, n):
            base = total[i]
            if base == _NONE:
                continue
            node, j = root.get(s[i]), i + 1
            if node is None or "" not in node:
                x = base + self.unknown
                if x > total[j]:
                    total[j], back[j] = x, i
            while node is not None:
                x = node.get("")
                if x is not None:
                    x += base
                    if x > total[j]:
                        total[j], back[j] = x, i
                if j == n:
                    break
                node = node.get(s[j])
                j += 1
        return total, back

    def trace(self, s: str, back: list[int], end: int, start: int = 0) -> list[int]:
        ids, parts = self.id, []
        while end > start:
            i = back[end]
            k = ids.get(s[i:end])
            parts.append([k] if k is not None else self.ids_of_unknown(s[i:end]))
            end = i
        return [k for p in reversed(parts) for k in p]

    def segment(self, s: str) -> list[int]:
        """Ids of a text between two borders."""
        k = self.id.get(s) if len(s) == 1 else None
        return [k] if k is not None else self.trace(s, self.best(s)[1], len(s))

    def encode_normal(self, s: str) -> list[int]:
        """Ids of normalised text that begins and ends at borders. Words (``▁`` and what follows) are the usual segments."""
        rest = s.split(MARK)
        out: list[int] = self.word(rest[0]) if rest[0] else []
        if "" not in rest[1:]:
            return out + list(chain.from_iterable(map(self.words.__getitem__, rest[1:])))
        k, n = 1, len(rest)
        while k < n:
            marks = 1
            while k + marks < n and not rest[k + marks - 1]:
                marks += 1
            out += self.word(MARK * marks + rest[k + marks - 1]) if marks > 1 or not rest[k] else self.words[rest[k]]
            k += marks
        return out

    def word(self, w: str) -> list[int]:
        """Ids of one word, which may have borders inside (letters without a piece)."""
        if self.letters.issuperset(w) and MARK not in w.lstrip(MARK):
            return self.segment(w)
        at = self.borders(w)
        return [k for a, b in zip(at, at[1:]) if b > a for k in self.segment(w[a:b])]

    def encode(self, text: str) -> list[int]:
        return self.encode_normal(self.normal(text))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes, less the space in front. Broken bytes become U+FFFD."""
        raw = b"".join(map(self.value.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    # -- the parallel scan ------------------------------------------------------------------------------------------

    def matrix(self, s: str, over: str, entry: int) -> np.ndarray:
        """Best sums of chunk ``s`` from each state at its beginning to each state at its end.

        State k at the beginning: the first k letters belong to a piece that began before. State k at the end: the last
        piece takes k letters of ``over``, the text behind the chunk. ``entry``: states at the beginning that can occur.
        """
        states = self.longest
        out = np.full((states, states), _NONE)
        both = s + over[: states - 1]
        first, last = self._inner(both, len(s))
        if first is None:
            for k in range(min(entry, len(s)) + 1):
                out[k] = self._ends(both, k, len(s))
            for k in range(len(s) + 1, entry + 1):  # one piece over the whole chunk
                out[k, k - len(s)] = 0.0
            return out
        middle = sum(map(self.score_of.__getitem__, self.encode_normal(both[first:last])))
        tail = self._ends(both[last:], 0, len(s) - last)
        for k in range(min(entry, first) + 1):
            out[k] = self.best(both[:first], k)[0][first] + middle + tail
        return out

    def _inner(self, both: str, n: int) -> tuple[int | None, int | None]:
        """The first and the last border in a chunk of ``n`` letters (its end included, its beginning not)."""
        most = min(n, len(both) - 1)
        first = next((k for k in range(1, most + 1) if self.border(both, k)), None)
        return first, None if first is None else next(k for k in range(most, 0, -1) if self.border(both, k))

    def _ends(self, both: str, start: int, end: int) -> np.ndarray:
        """Best sums from ``start`` to each state at ``end``: pieces that begin before ``end`` and may pass it."""
        row = np.full(self.longest, _NONE)
        total = self.best(both[:end], start)[0]
        row[0] = total[end]
        for i in range(max(start, end - self.longest + 1), end):
            if total[i] == _NONE:
                continue
            for j in range(end + 1, min(len(both), i + self.longest) + 1):
                x = self.score.get(both[i:j])
                if x is not None and total[i] + x > row[j - end]:
                    row[j - end] = total[i] + x
        return row

    def chunk_ids(self, s: str, over: str, enter: int, leave: int) -> list[int]:
        """Ids of the pieces that begin in a chunk, between the states that the scan picked."""
        if enter >= len(s) and (enter > len(s) or leave == 0):
            return []
        both = s + over[: self.longest - 1]
        first, last = self._inner(both, len(s))
        out: list[int] = []
        at = enter
        if first is not None:
            out += self.segment(both[enter:first])
            out += self.encode_normal(both[first:last])
            at = last
        if leave == 0:
            return out + self.segment(both[at : len(s)])
        # the last piece passes the cut: the best beginning for it, then what lies before
        both = both[at : len(s) + leave]
        end = len(s) - at
        total, back = self.best(both[:end])
        _, i = max((total[i] + self.score[both[i:]], -i) for i in range(end) if total[i] != _NONE and both[i:] in self.score)
        return out + self.trace(both[:end], back, -i) + [self.id[both[-i:]]]


def loaded(path: str) -> Pieces:
    """The vocabulary with its cache of words, kept while a Python worker lives."""
    return kept(f"pieces-{path}", lambda: Pieces(path))


def scan(matrices: list[np.ndarray]) -> list[int]:
    """The state at every cut of a text from its chunks' matrices: (0, states..., 0).

    ``suffix[k]`` is the associative max-plus product of the matrices from chunk k on, applied to the end; going
    forward, each cut's state is the one that keeps the best sum (of equal ones the longest piece over the cut).
    """
    n = len(matrices)
    end = np.full(matrices[0].shape[0], _NONE)
    end[0] = 0.0
    suffix = [end]
    for m in reversed(matrices):
        suffix.append((m + suffix[-1][None, :]).max(axis=1))
    suffix.reverse()
    states = [0]
    for k in range(n):
        value = matrices[k][states[-1]] + suffix[k + 1]
        states.append(int(np.flatnonzero(value == value.max())[-1]))
    return states


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: best sums over two neighbouring chunks."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


_OUT = "n_tokens long, ids array<int>, round_trip boolean"


def _encode_small(kind: str, small: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for part in cut_batch(batch, "text"):
                flat, lengths, same = [], [], []
                for text in part.column("text").to_pylist():
                    if text is None:
                        lengths.append(None)
                        same.append(None)
                        continue
                    ids = model.encode(text)
                    flat += ids
                    lengths.append(len(ids))
                    same.append(model.decode(ids) == text)
                ends = np.cumsum([0] + [n or 0 for n in lengths]).astype(np.int32)
                gaps = pa.array([n is None for n in lengths])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=gaps)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n or 0 for n in lengths], pa.int64()), ids, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return small.mapInArrow(run, f"doc_id {kind}, {_OUT}")


def _encode_giant(kind: str, giant: DataFrame, path: str, chunk: int) -> DataFrame:
    """Chunks as rows: matrices, one scan for each text, chunks traced back on their own, ids joined in order."""
    spark = giant.sparkSession
    numbered = cut(giant.select(F.monotonically_increasing_id().alias("at"), "doc_id", "text"), "pieces-giant")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for at, text in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist()):
                own = list(model.chunks(model.normal(text), chunk))
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(own), pa.int64()), pa.array(range(len(own)), pa.int32()), pa.array([s for s, _ in own]), pa.array([o for _, o in own])], ["at", "k", "s", "over"])

    chunks = cut(numbered.mapInArrow(split, "at long, k int, s string, over string").repartition("at", "k"), "pieces-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            m = [model.matrix(s, o, model.longest - 1 if k else 0).ravel().tolist() for s, o, k in zip(batch.column("s").to_pylist(), batch.column("over").to_pylist(), batch.column("k").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("k"), pa.array(m, pa.list_(pa.float64()))], ["at", "k", "m"])

    def states(pdf):
        import pandas as pd

        pdf = pdf.sort_values("k")
        side = int(len(pdf["m"].iloc[0]) ** 0.5)
        found = scan([np.asarray(m).reshape(side, side) for m in pdf["m"]])
        return pd.DataFrame({"at": pdf["at"], "k": pdf["k"], "enter": found[:-1], "leave": found[1:]})

    picked = chunks.mapInArrow(matrices, "at long, k int, m array<double>").groupBy("at").applyInPandas(states, "at long, k int, enter int, leave int")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            ids = [model.chunk_ids(s, o, a, b) for s, o, a, b in zip(*(batch.column(c).to_pylist() for c in ("s", "over", "enter", "leave")))]
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("k"), pa.array(ids, pa.list_(pa.int32()))], ["at", "k", "ids"])

    traced = chunks.join(picked, ["at", "k"]).mapInArrow(ids_of, "at long, k int, ids array<int>")
    whole = traced.groupBy("at").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            same = [model.decode(i) == t for i, t in zip(ids, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), batch.column("ids"), pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])

    return numbered.join(whole, "at").select("doc_id", "text", "ids").mapInArrow(check, f"doc_id {kind}, {_OUT}")


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (decoding the ids gives the text) for each row of ``docs``."""
    path = path or vocabulary_path()
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    giant = narrow.where(F.length("text") > chunk)
    small = _encode_small(kind, narrow.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk), path)
    return small.unionByName(_encode_giant(kind, giant, path, chunk))


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give a null text."""
    path = path or vocabulary_path()
    bounded_batches(tokens.sparkSession)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if i is None else model.decode(i) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
