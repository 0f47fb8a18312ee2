"""LM scoring (operator 4) by prediction by partial matching over bytes, beside a unigram base.

The text that is scored is the one the base counts: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+`` joined by one
space, and an end. The model is a trie of byte contexts up to ``ORDER`` symbols, pretrained on every document whose
crc32(doc_id) mod 5 is not 1. A symbol is predicted from its longest context in the trie; escapes are estimated by
method D (half a count of each different symbol seen goes to the escape); after an escape, the symbols of the longer context are excluded
from the shorter one. Below the empty context all symbols that are left are equally likely, so every text has a
probability. Documents begin in a context of end marks, so beginnings are learned too.

With a pretrained trie the symbols of a context are a subset of those of its suffix, so what exclusion takes away
depends on the context alone: each context carries the totals for its suffix without its own symbols, and a whole batch
of texts is scored by table look-ups (numpy), an order at a time, for the positions that escaped.

Counts are of the whole training corpus: ``ORDER + 1``-grams are counted in the map tasks, summed by Spark and folded
to shorter ones. All of them are the model; they stay in tables. What is sent out is a cache of it: at most
``MOST_GRAMS`` grams an order, the most frequent ones, with their contexts' totals over all grams. Where the cache
can't tell (a gram isn't in it, and its context isn't there with all its symbols), the symbol's code leaves with its
text's row and meets the tables in shuffled joins, an order at a time, each different code once. Probabilities are
those of the whole trie at any size of the input.

Base: word counts are summed by Spark. The ``MOST_WORDS`` most frequent words (a proven bound, words of up to 64
bytes) are looked up where the text is; the rest of a text's words meet their counts in a shuffled join, one row for
each word of a text.

Defined cases: a null, empty or blank text has the end as its only token; without training documents counts are 0,
N = 0, V = 0 and the base is log10(0.5 / 0.5) = 0 for each token; repeated rows are counted and scored each; a null
doc_id has remainder 0. Only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, fold, forget, id_bucket, kept, pieces, raw_texts, release, sums, table

ORDER = 5
MOST_GRAMS, MOST_WORDS, WORD_BYTES = 1_000_000, 100_000, 64
#: Text bytes of one step, different codes and words that a task holds before they leave it.
STEP_BYTES, HELD_CODES, HELD_WORDS = 1 << 20, 1_000_000, 200_000
#: Codes that are looked up at a time: what is worked out on their way is of this size, not of a step's.
LOOKED_UP = 1 << 17
FOLDS, HELD_OUT = 5, 1
#: The end of a text, and its beginning's context: a byte that UTF-8 never has.
END = 255
SYMBOLS, BITS = 256, 8
#: No code: it would be ends only, before an end.
_EMPTY = np.uint64(2**64 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Rows of numbers by 64-bit key: open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] == _EMPTY)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.rows[at[won]] = keys[left[won]], left[won]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & self.last

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if there is none."""
        at = self.slots(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.rows[at], np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        at = at[left]
        while len(left):
            at = (at + 1) & self.last
            seen = self.keys[at]
            hit = seen == keys[left]
            out[left[hit]] = self.rows[at[hit]]
            on = ~hit & (seen != _EMPTY)
            left, at = left[on], at[on]
        return out


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)


class Trie:
    """A pretrained model. ``grams[j]``: (sorted codes of j + 1 symbols, counts).

    ``nodes[j]``, for an order whose grams are not all there: (sorted contexts, totals, kinds, the suffix's totals and
    kinds without the context's own symbols), counted over all grams; None for an order that is whole. Both are gone
    through once, an order at a time.
    """

    def __init__(self, grams: Iterable[tuple[np.ndarray, np.ndarray]], nodes: Iterable | None = None) -> None:
        self.gram, self.context, self.log_n, self.full, self.node, self.whole = [], [], [], [], [], []
        before, single = None, 0
        for (codes, n), given in zip(grams, nodes or repeat(None)):
            codes, n = codes.astype(np.uint64, copy=False), n.astype(np.float64)
            single = single if self.gram else len(codes)
            if given is not None:
                self._add_part(codes, n, *given)
                continue
            contexts = codes >> np.uint64(BITS)
            at = _groups(contexts)
            size = np.diff(np.append(at, len(codes)))
            total, kinds = np.add.reduceat(n, at) if len(at) else n, size.astype(np.float64)
            owner = np.repeat(np.arange(len(at)), size)
            found = Table(codes)
            escape = np.log(kinds) - np.log(2 * total)
            out_total = out_kinds = np.zeros(len(at))
            if before is not None and len(at):
                # the suffix context's counts, without the symbols of this context
                width = np.uint64((1 << (BITS * (len(self.gram)))) - 1)
                shorter = before[0].find(codes & width)
                suffix = before[1].find(contexts[at] & (width >> np.uint64(BITS)))
                out_total = before[3][suffix] - np.bincount(owner, before[2][shorter], len(at))
                out_kinds = before[4][suffix] - kinds
            den = 2 * out_total
            with np.errstate(divide="ignore", invalid="ignore"):
                log_den = np.where(den > 0, np.log(den), 0.0)
                log_escape = np.where(out_kinds > 0, np.log(out_kinds) - np.log(den), 0.0)
            nodes = Table(contexts[at])
            self.gram.append(found)
            self.context.append(nodes)
            self.log_n.append(np.log(2 * n - 1).astype(np.float32))
            self.full.append((np.log(2 * n - 1) - np.log(2 * total)[owner]).astype(np.float32))
            self.node.append(np.stack((escape, log_den, log_escape), axis=1) if len(at) else np.zeros((0, 3)))
            self.whole.append(None)
            before = (found, nodes, n, total, kinds)
        self.order = len(self.gram) - 1
        self.floor = -np.log(max(1.0, SYMBOLS - (self.node[0].shape[0] and single)))

    def _add_part(self, codes: np.ndarray, n: np.ndarray, contexts: np.ndarray, total: np.ndarray, kinds: np.ndarray, out_total: np.ndarray, out_kinds: np.ndarray) -> None:
        found, nodes = Table(codes), Table(contexts)
        owner = nodes.find(codes >> np.uint64(BITS))
        den = 2.0 * out_total
        with np.errstate(divide="ignore", invalid="ignore"):
            log_den = np.where(den > 0, np.log(den), 0.0)
            log_escape = np.where(out_kinds > 0, np.log(out_kinds) - np.log(den), 0.0)
        self.gram.append(found)
        self.context.append(nodes)
        self.log_n.append(np.log(2 * n - 1).astype(np.float32))
        self.full.append((np.log(2 * n - 1) - np.log(2.0 * total)[owner]).astype(np.float32))
        self.node.append(np.stack((np.log(kinds) - np.log(2.0 * total), log_den, log_escape), axis=1))
        self.whole.append(np.bincount(owner, minlength=len(contexts)) == kinds)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """ln of the probability of each code's last symbol after the symbols before it (``order`` of them).

        NaN where the grams that are here can't tell.
        """
        out = np.empty(len(codes))
        for at in range(0, len(codes), LOOKED_UP):
            out[at : at + LOOKED_UP] = self._look_up(codes[at : at + LOOKED_UP])
        return out

    def _look_up(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        left, above = np.arange(len(codes)), np.full(len(codes), -1)  # above: row of the longer context escaped from
        for j in range(self.order, -1, -1):
            own = codes[left] & np.uint64((1 << (BITS * (j + 1))) - 1)
            row = self.gram[j].find(own)
            hit = row >= 0
            plain = hit & (above < 0)
            out[left[plain]] += self.full[j][row[plain]]
            after = hit & (above >= 0)
            if after.any():
                out[left[after]] += self.log_n[j][row[after]] - self.node[j + 1][above[after], 1]
            miss = ~hit
            left, above, own = left[miss], above[miss], own[miss]
            if not len(left):
                return out
            node = self.context[j].find(own >> np.uint64(BITS))
            if self.whole[j] is not None:  # only a context with all its symbols shows that a gram is nowhere
                sure = node >= 0
                sure[sure] = self.whole[j][node[sure]]
                out[left[~sure]] = np.nan
                left, above, node = left[sure], above[sure], node[sure]
            escaped = above >= 0
            if escaped.any():
                out[left[escaped]] += self.node[j + 1][above[escaped], 2]
            fresh = ~escaped & (node >= 0)
            out[left[fresh]] += self.node[j][node[fresh], 0]
            above = node
        out[left] += self.floor
        return out


def normal(raw: bytes) -> tuple[list[bytes], bytes]:
    """Words, and the text that is scored."""
    words = raw.lower().split()
    return words, b" ".join(words)


def codes_of(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """A code for every symbol of the texts (each with its end): ``order`` symbols before it and itself."""
    pad = np.full(order, END, np.uint8)
    parts = []
    for t in texts:
        parts += [pad, np.frombuffer(t, np.uint8), pad[:1]]
    seq = np.concatenate(parts)
    lengths = np.array([len(t) + 1 for t in texts])
    codes = np.zeros(len(seq) - order, np.uint64)
    for k in range(order + 1):
        codes <<= np.uint64(BITS)
        codes |= seq[k : len(seq) - order + k]
    ends = np.cumsum(lengths + order) - order  # codes are numbered by their last symbol less ``order``
    keep = np.ones(len(codes), bool)
    for k in range(order):
        keep[(ends[:-1] + k)] = False
    return codes[keep]


def count_codes(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and how often each occurs."""
    if weights is None:
        codes = np.sort(codes)
        at = _groups(codes)
        return codes[at], np.diff(np.append(at, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    at = _groups(codes)
    return codes[at], np.add.reduceat(weights, at) if len(at) else weights


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Words and grams of the training texts: (word, code, n), a task's counts summed before they leave it.

    The worker holds no trie of a query before, and none of the task's memory while the tables are made in the JVM.
    """
    forget()
    yield from _counts(batches, order)
    release()


def _counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    def flush(words: Counter, codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "code", "n"])
        for at in range(0, len(codes), 200_000):
            part = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(codes[part]), pa.binary()), pa.array(codes[part].view(np.int64)), pa.array(n[part].astype(np.int64))], ["word", "code", "n"])

    words, runs, held = Counter(), [], 0
    for batch in batches:
        for part in pieces(batch, "text", STEP_BYTES):
            texts = []
            for raw in raw_texts(part.column("text")):
                own, text = normal(raw)
                words.update(own)
                texts.append(text)
            words[None] += len(texts)
            runs.append(count_codes(codes_of(texts, order)))
            held += len(runs[-1][0])
            if held > HELD_CODES:
                runs = [count_codes(*(np.concatenate(x) for x in zip(*runs)))]
                held = len(runs[0][0])
                if held > HELD_CODES // 2:
                    yield from flush(Counter(), *runs[0])
                    runs, held = [], 0
            if len(words) > HELD_WORDS:
                ends = words.pop(None)
                yield from flush(words, np.zeros(0, np.uint64), np.zeros(0, np.int64))
                words = Counter({None: ends})
    codes, n = count_codes(*(np.concatenate(x) for x in zip(*runs))) if runs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    ends = words.pop(None, 0)
    yield from flush(words, codes, n)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([ends], pa.int64())], ["word", "code", "n"])


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` rows of ``counts`` have it or more; from a histogram of logarithms."""
    bins = sorted((tuple(r) for r in counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).select("bin", "rows", "n").collect()), reverse=True)
    held, least = 0, None
    for _, rows, n in bins:
        held += rows
        if held > most:
            break
        least = n
    return least if least is not None else 1 << 62


def _mask(symbols: int):
    return F.lit((1 << (BITS * symbols)) - 1)


def contexts_of(levels: list[DataFrame]) -> list[DataFrame]:
    """For each order: context, total, kinds, and out_total and out_kinds, the suffix's without the context's own symbols."""
    nodes: list[DataFrame] = []
    for j, level in enumerate(levels):
        grams = level.select("code", "n", F.shiftright("code", BITS).alias("context"))
        if j == 0:
            nodes.append(cut(grams.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.lit(0).cast("long").alias("out_total"), F.lit(0).cast("long").alias("out_kinds")), "ppm-contexts"))
            continue
        shorter = levels[j - 1].select(F.col("code").alias("short"), F.col("n").alias("short_n"))
        own = grams.withColumn("short", F.col("code").bitwiseAND(_mask(j))).join(shorter, "short").groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("short_n").alias("own"))
        suffix = nodes[-1].select(F.col("context").alias("suffix"), F.col("total").alias("suffix_total"), F.col("kinds").alias("suffix_kinds"))
        met = own.withColumn("suffix", F.col("context").bitwiseAND(_mask(j - 1))).join(suffix, "suffix")
        nodes.append(cut(met.select("context", "total", "kinds", (F.col("suffix_total") - F.col("own")).alias("out_total"), (F.col("suffix_kinds") - F.col("kinds")).alias("out_kinds")), "ppm-contexts"))
    return nodes


def settle(codes: DataFrame, levels: list[DataFrame], nodes: list[DataFrame], floor: float) -> DataFrame:
    """code, value: ln of the probability of each code's last symbol, by the tables (as ``Trie.log_probabilities``)."""
    state = codes.select("code", F.lit(0.0).alias("value"), F.lit(None).cast("long").alias("out_total"), F.lit(None).cast("long").alias("out_kinds"))
    done = []
    for j in range(len(levels) - 1, -1, -1):
        gram = levels[j].select(F.col("code").alias("own"), "n")
        node = nodes[j].select("context", "total", "kinds", F.col("out_total").alias("next_total"), F.col("out_kinds").alias("next_kinds"))
        met = state.withColumn("own", F.col("code").bitwiseAND(_mask(j + 1))).join(gram, "own", "left").withColumn("context", F.shiftright("own", BITS)).join(node, "context", "left")
        escaped = F.col("out_total").isNotNull()
        den = F.when(F.col("out_total") > 0, F.log(2.0 * F.col("out_total"))).otherwise(0.0)
        hit = F.log(2.0 * F.col("n") - 1) - F.when(escaped, den).otherwise(F.log(2.0 * F.col("total")))
        miss = F.when(escaped, F.when(F.col("out_kinds") > 0, F.log(F.col("out_kinds").cast("double")) - den).otherwise(0.0)).when(F.col("total").isNotNull(), F.log(F.col("kinds").cast("double")) - F.log(2.0 * F.col("total"))).otherwise(0.0)
        met = cut(met.select("code", F.col("n").isNotNull().alias("hit"), (F.col("value") + F.when(F.col("n").isNotNull(), hit).otherwise(miss)).alias("value"), F.col("next_total").alias("out_total"), F.col("next_kinds").alias("out_kinds")), "ppm-settled")
        done.append(met.where("hit").select("code", "value"))
        state = met.where("not hit").drop("hit")
    done.append(state.select("code", F.col("value") + F.lit(floor)))
    return reduce(DataFrame.union, done)


def train(docs: DataFrame, order: int = ORDER) -> tuple[list, list, list, list, DataFrame, int, int, int]:
    """The cached grams and contexts, the tables of all grams and contexts (none if the cache holds all), the table of
    word counts (word, n), N and V (both with the end token), and the count of ends."""
    counted = docs.where(fold("doc_id", FOLDS) != HELD_OUT).select(F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: _count(batches, order), "word binary, code long, n long")
    summed = cut(counted.groupBy("word", "code").agg(F.sum("n").alias("n")), "ppm-counts")
    words = summed.where("word is not null").select("word", "n")
    ends = summed.where("word is null and code is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = summed.where("word is null and code is not null").select("code", "n")
    levels = [level]
    for j in range(order, 0, -1):
        level = cut(level.groupBy(F.col("code").bitwiseAND(_mask(j)).alias("code")).agg(F.sum("n").alias("n")), "ppm-level")
        levels.append(level)
    levels.reverse()
    floors = [1]
    for j in range(1, order + 1):
        floors.append(max(floors[-1], least_count(levels[j], MOST_GRAMS)) if j >= 2 else 1)  # 256 ** 2 grams of order 1 at most
    contexts = contexts_of(levels) if max(floors) > 1 else []
    grams, nodes = [], []
    for j, floor in enumerate(floors):
        code, n = _sorted(levels[j].where(F.col("n") >= floor), "code", "n")
        grams.append((code, n))
        # a context is a gram of the order before: no more than MOST_GRAMS have the floor, and the beginning of texts
        nodes.append(_sorted(contexts[j].where(F.col("total") >= floor), "context", "total", "kinds", "out_total", "out_kinds") if floor > 1 else None)
    return grams, nodes, levels if contexts else [], contexts, words, n_words + ends, kinds + (ends > 0), ends


def _sorted(df: DataFrame, key: str, *columns: str) -> tuple[np.ndarray, ...]:
    """Columns of a small table, by the first (codes)."""
    rows = df.select(key, *columns).toArrow()
    code = rows.column(key).to_numpy().view(np.uint64)
    at = np.argsort(code, kind="stable")
    return code[at], *(rows.column(c).to_numpy()[at] for c in columns)


def _trie(key: str, sent) -> Trie:
    """The trie of a broadcast, built once in a Python worker, which drops the arrays of an order when it is built."""

    def each(orders: list) -> Iterator:
        for j in range(len(orders)):
            one, orders[j] = orders[j], None
            yield one

    def make() -> Trie:
        grams, nodes = map(list, sent.value)
        if getattr(sent, "_path", None):  # a file, from which another build would read them again
            vars(sent).pop("_value", None)
        model = Trie(each(grams), each(nodes))
        release()
        return model

    return kept(key, make)


_ROW = "row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:bigint>>, far array<struct<code:bigint,n:bigint>>"


def _far(codes: np.ndarray, lengths: list[int], at: np.ndarray) -> pa.Array:
    """For each text, the codes at positions ``at`` and how often each is there."""
    owner = np.repeat(np.arange(len(lengths)), lengths)[at]
    order = np.lexsort((codes[at], owner))
    owner, code = owner[order], codes[at][order]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])))) if len(at) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(at)))
    starts = np.concatenate(([0], np.bincount(owner[first], minlength=len(lengths)).cumsum())).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(code[first].view(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"]))


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    grams, nodes, levels, contexts, words, tokens, kinds, ends = train(docs, order)
    short = words.where(F.length("word") <= WORD_BYTES)
    heavy = short.where(F.col("n") >= least_count(short, MOST_WORDS)).toArrow()
    known = dict(zip(heavy.column("word").to_pylist(), np.log10(heavy.column("n").to_numpy() + 0.5).tolist()))
    key, sent, sent_words = f"ppm-{uuid.uuid4().hex}", spark.sparkContext.broadcast((grams, nodes)), spark.sparkContext.broadcast(known)
    end = float(np.log10(ends + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        release()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, get = _trie(key, sent), sent_words.value.get
        for batch in batches:
            for part in pieces(batch, "text", STEP_BYTES):
                flat, texts, counts = [], [], []
                for raw in raw_texts(part.column("text")):
                    own, text = normal(raw)
                    flat += own
                    texts.append(text)
                    counts.append(len(own))
                value = np.fromiter(map(get, flat, repeat(np.nan)), np.float64, len(flat))
                far = np.isnan(value)
                base = sums(np.where(far, 0.0, value), counts) + end
                seen = sums((~far).astype(np.float64), counts).astype(np.int64) + (ends > 0)
                rare: list = [None] * len(texts)
                if far.any():
                    owner = np.repeat(np.arange(len(texts)), counts)
                    for k, i in zip(owner[far].tolist(), np.flatnonzero(far).tolist()):
                        if rare[k] is None:
                            rare[k] = Counter()
                        rare[k][flat[i]] += 1
                codes, lengths = codes_of(texts, model.order), [len(t) + 1 for t in texts]
                value = model.log_probabilities(codes)
                logs = sums(np.nan_to_num(value), lengths) / np.log(10)
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), ids, pa.array([id_bucket(i, FOLDS) == HELD_OUT for i in ids.to_pylist()]), pa.array([n + 1 for n in counts], pa.int64()), pa.array(seen), pa.array(base), pa.array(logs),
                        pa.array([[{"word": w, "n": n} for w, n in r.items()] if r else [] for r in rare], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
                        _far(codes, lengths, np.flatnonzero(np.isnan(value))),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "far"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, _ROW.format(kind=kind)), "ppm-scored")
    rare = scored.select("row", F.inline("rare").alias("word", "m"))
    met = rare.join(words, "word", "left").select("row", "m", F.coalesce("n", F.lit(0)).alias("c"))
    more = met.groupBy("row").agg(F.sum(F.col("m") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("more_known"))
    each = float(np.log10(tokens + 0.5 * (kinds + 1)))
    out = scored.drop("rare", "far").join(more, "row", "left")
    if levels:
        far = cut(scored.select("row", F.inline("far").alias("code", "m")), "ppm-far")
        values = settle(far.select("code").distinct(), levels, contexts, -float(np.log(max(1, SYMBOLS - len(grams[0][0])))))
        out = out.join(far.join(values, "code").groupBy("row").agg((F.sum(F.col("m") * F.col("value")) / float(np.log(10))).alias("more_score")), "row", "left")
    else:
        out = out.withColumn("more_score", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
