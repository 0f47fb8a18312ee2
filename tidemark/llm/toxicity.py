"""Toxicity (operator 9): noisy-channel restoration of disguised words, then a score of the restored text.

A token that looks disguised (digits or symbols among letters, a letter three times in a row, letters spaced out) spans
a lattice of letters: each character may stand for itself, for the letters it imitates, for a repetition of the letter
before, or for nothing (a separator). A character trigram model, learned from the words of the labelled sample, gives
the language's side; Viterbi decoding finds the likeliest word. Its rival is the token as it is: runs of letters as words
of their own with digits and symbols between them (covid19, 3rd, a.b/c); the likelier of both is taken. Other tokens
only lose their case and outer symbols. Tokens of over ``LONG_TOKEN`` characters are no disguised words: what lies
between their symbols is read as separate tokens (as they are, if still longer).

The score is a logistic function of the evidence in a text: each restored word weighs as much as the strongest of its
features (the word, its beginnings of 4 to 6 letters) whose log odds of toxic against other documents are
``STRONG`` or ``SURE``. Documents of one label with the same min-hash value of their shingles share one vote, so that a
group of copies is one witness. Weights and logistic are fitted on different halves, then the weights on both.

Learning takes every labelled row whose crc32(doc_id) mod 3 is not 1, whole texts: all their words count for the
character model, all features that are strong enough weigh, and the logistic is fitted to all witnesses of its half.
Words, features and the sums of the logistic are counted where they are; the driver gets the different letter trigrams
and the features that weigh. Every text is scored whole.

Defined cases: null, empty and wordless texts have no evidence and get the score of a text without any; a doc_id with
several labels counts as toxic if one of them says so; very long texts and tokens are read in linear time; of equally
likely words the one that comes last in order of its last two letters is taken, of equally likely ways the first; without labels of both kinds every score is 0; repeated rows are
scored each. Only doc_id and text are read (doc_id to tell the fold), and toxic to learn.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import TokenTable, bounded_batches, cut, drop_cut, fold, forget, id_bucket, kept, pieces, sums, table

#: Characters of a token that is still read as one word.
LONG_TOKEN = 256
#: (standard errors, log odds) that a feature must have to weigh: much more likely, or less so but beyond doubt.
STRONG, SURE = (3.2, 2.3), (6.0, 1.2)
LEAST_SCORE = 0.7
#: Text bytes of one step of learning.
LEARN_BYTES = 1 << 19
#: Entries of a table that a task of learning fills before it hands them on.
LEARN_ENTRIES = 150_000
#: The vote of a witness, shared by the documents of its group; a whole number, so that sums don't depend on their order.
VOTE = 1 << 32
FOLDS, HELD_OUT = 3, 1
_PREFIXES = (4, 5, 6)

#: Letters that a character may imitate.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "ß": "b", "¡": "i", "vv": "w"}
#: Characters that may stand for nothing between letters.
SEPARATORS = set(".-_*~'`^/\\,:;#%&=\"​­ ")
#: ln of the channel: a letter as itself, a look-alike, a separator or symbol dropped, a repeated character dropped, a digit or symbol kept.
SELF, LOOKS, DROPPED, REPEATED, KEPT = -0.05, -1.5, -1.5, -1.0, -14.0
#: ln of a disguise at all, against a token that is as it is; there, ln of a symbol or a first digit, and of a further digit.
DISGUISED, PLAIN_SYMBOL, PLAIN_DIGIT = -3.0, -3.4, -1.0
_DISGUISED = re.compile(r"(?=.*[^\W\d_].*)(?=.*([0-9@$!|+(€£]|[^\W\d_][^\w]+[^\W\d_]|(?:([^\W\d_])\2\2)|_))", re.S)
_LETTER = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"(.)\1\1", re.S)
_BETWEEN = re.compile(r"[\W_]+")


def trigrams(words: dict[str, int]) -> Counter:
    """Weights of the letter trigrams of counted words, with two starts and an end around each word."""
    out: Counter = Counter()
    for w, n in words.items():
        s = f"\x02\x02{w}\x03"
        n = 1 + math.log(n)  # types count, tokens less: names of few forms shall not drown the rest
        for a, b, c in zip(s, s[1:], s[2:]):
            out[a + b + c] += n
    return out


class CharModel:
    """Trigrams of letters in words, with linear interpolation."""

    def __init__(self, tri: dict[str, float]) -> None:
        self.tri, self.bi, self.uni = Counter(tri), Counter(), Counter()
        for k, n in tri.items():
            self.bi[k[1:]] += n
            self.uni[k[2:]] += n
        self.tri_context, self.bi_context = Counter(), Counter()
        for k, n in self.tri.items():
            self.tri_context[k[:2]] += n
        for k, n in self.bi.items():
            self.bi_context[k[:1]] += n
        self.total = sum(self.uni.values()) + 100.0
        self.kept: dict[str, float] = {}

    def __call__(self, context: str, letter: str) -> float:
        """ln of the letter's probability after a context of two."""
        key = context + letter
        value = self.kept.get(key)
        if value is None:
            t, b = self.tri_context[context], self.bi_context[context[1]]
            p = (self.uni[letter] + 0.1) / self.total
            p = (self.bi[key[1:]] + 5 * p) / (b + 5)
            p = (self.tri[key] + 5 * p) / (t + 5)
            value = self.kept[key] = float(np.log(p))
        return value


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each character of a token may stand for: (letters or nothing, ln of the channel)."""
    out = []
    for k, c in enumerate(token):
        may = []
        if _LETTER.fullmatch(c):
            may.append((c, SELF))
            if k and token[k - 1] == c:
                may.append(("", REPEATED))
        else:
            may.append(("", DROPPED if c in SEPARATORS else DROPPED - 1.5))
            may.append((c, KEPT))
            if k and token[k - 1] == c:
                may.append(("", REPEATED))
        may += [(x, LOOKS) for x in LOOKALIKES.get(c, "")]
        out.append(may)
    return out


def decoded(token: str, model: CharModel) -> tuple[float, str]:
    """The likeliest word behind a token and its ln: Viterbi over the lattice, states are the last two restored letters."""
    best: dict[str, tuple[float, tuple]] = {"\x02\x02": (0.0, ())}
    for may in lattice(token):
        new: dict[str, tuple[float, tuple]] = {}
        for context, (value, path) in best.items():
            for letter, channel in may:
                if letter:
                    v, after, way = value + channel + model(context, letter), context[1] + letter, (path, letter)
                else:
                    v, after, way = value + channel, context, path
                old = new.get(after)
                if old is None or v > old[0]:
                    new[after] = (v, way)
        best = new
    context, (value, path) = max(best.items(), key=lambda x: (x[1][0] + model(x[0], "\x03"), x[0]))
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return value + model(context, "\x03"), "".join(reversed(letters))


def decode(token: str, model: CharModel) -> str:
    """The likeliest word behind a disguised token."""
    return decoded(token, model)[1]


def as_it_is(token: str, model: CharModel) -> float:
    """ln of a token that is no disguise: its runs of letters are words, digits and symbols stand for themselves."""
    value, context, digit = 0.0, "", False
    for c in token:
        if _LETTER.fullmatch(c):
            context = context or "\x02\x02"
            value += model(context, c)
            context, digit = context[1] + c, False
            continue
        if context:
            value, context = value + model(context, "\x03"), ""
        value += PLAIN_DIGIT if digit and c.isdigit() else PLAIN_SYMBOL
        digit = c.isdigit()
    return value + model(context, "\x03") if context else value


def bare(token: str) -> str:
    """A token without its outer symbols."""
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] in "_@$"):
        a += 1
    while b > a and not (token[b - 1].isalnum() or token[b - 1] in "_@$!"):
        b -= 1
    return token[a:b]


def restored(token: str, model: CharModel | None) -> str:
    """A token (lower case) as the word it stands for; empty if it has no letter."""
    if token.isalpha() and not _THRICE.search(token):  # most tokens
        return token
    own = bare(token)
    if model is not None and len(own) <= LONG_TOKEN and _DISGUISED.match(own):
        value, word = decoded(own, model)
        if value + DISGUISED > as_it_is(own, model):
            return word
    return own if _LETTER.search(own) else ""


def tokens_of(text: str | None) -> list[str]:
    """Lower-case tokens; runs of three or more single letters or symbols are one token, tokens of over ``LONG_TOKEN``
    characters are the parts between their symbols."""
    own = text.lower().split() if text else []
    lengths = np.array(list(map(len, own)), np.int64)
    single = lengths == 1
    if b"\1\1\1" in single.tobytes():
        edges = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
        out, last = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= 3:
                out += own[last:a]
                out.append(" ".join(own[a:b]))
                last = b
        own = out + own[last:]
    elif not len(own) or lengths.max() <= LONG_TOKEN:
        return own
    if max(map(len, own)) <= LONG_TOKEN:
        return own
    return [x for t in own for x in ([t] if len(t) <= LONG_TOKEN else filter(None, _BETWEEN.split(t)))]


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "~" for k in _PREFIXES if len(word) > k)] if len(word) > 2 else []


class WordHashes(dict):
    """Hashes of words, worked out once."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def sketch(words: list[str], hashes: WordHashes) -> int:
    """A min-hash value of a text's 5-word shingles (fewer words: of them all): near copies mostly share it."""
    if not words:
        return 0
    h, n = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), min(5, len(words))
    mixed = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return int((mixed ^ (mixed >> np.uint64(32))).min()) & (2**63 - 1)


class Model:
    def __init__(self, chars: CharModel, weights: dict[str, float], beta: np.ndarray) -> None:
        self.chars, self.weights, self.beta, self.key = chars, weights, beta, uuid.uuid4().hex


class Scorer:
    """Scores for batches of texts; a bounded cache holds each token's weight."""

    def __init__(self, chars: CharModel, weights: dict[str, float], beta: np.ndarray | None = None) -> None:
        self.chars, self.weights, self.beta = chars, weights, beta
        self.tokens = TokenTable(self._rows, 1, 200_000)

    def weight(self, token: str) -> float:
        word, get = restored(token, self.chars), self.weights.get
        if len(word) < 3:
            return 0.0
        most = get(word, 0.0)
        for k in _PREFIXES:
            if len(word) > k:
                most = max(most, get(word[:k] + "~", 0.0))
        return most

    def _rows(self, tokens: list[str]) -> np.ndarray:
        return np.array([self.weight(t) for t in tokens]).reshape(-1, 1)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """One row a text: 1, ln(1 + sum of weights), ln(1 + heavy tokens), heavy tokens in a hundred."""
        flat, counts = [], []
        for t in texts:
            own = tokens_of(t)
            flat += own
            counts.append(len(own))
        ids = self.tokens.ids(flat)  # first, as it may replace values
        w = self.tokens.values[ids]
        total, hits, n = sums(w, counts)[:, 0], sums((w > 0).astype(float), counts)[:, 0], np.maximum(np.array(counts), 1)
        return np.stack([np.ones(len(texts)), np.log1p(total), np.log1p(hits), np.minimum(100 * hits / n, 10)], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts) @ self.beta, -30, 30)))


def slopes(beta: np.ndarray, toxic: np.ndarray, evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First and second derivatives (4 and 16 numbers) of the likelihood of rows that count n times."""
    x = np.column_stack([np.ones(len(evidence)), evidence])
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return np.concatenate([x.T @ (n * (toxic - p)), (x.T @ (x * (n * p * (1 - p))[:, None])).ravel()])


def logistic(rows: DataFrame, most: int = LEARN_ENTRIES, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps (the intercept is free) of toxic on 1, a, b, c, in rows that count n
    times. Up to ``most`` rows are fitted in the driver; of more, each step's sums are made where the rows are."""

    def columns(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        toxic, a, b, c, n = (part.column(k).to_numpy().astype(float) for k in ("toxic", "a", "b", "c", "n"))
        return toxic, np.column_stack([a, b, c]), n

    if rows.count() <= most:
        own = columns(rows.orderBy("toxic", "a", "b", "c").toArrow())
        total = lambda beta: slopes(beta, *own)
    else:

        def total(beta: np.ndarray) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                got = sum((slopes(beta, *columns(b)) for b in batches), np.zeros(20))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in got], [f"v{k}" for k in range(20)])

            return np.array(rows.mapInArrow(run, ", ".join(f"v{k} double" for k in range(20))).agg(*(F.sum(f"v{k}") for k in range(20))).first(), float)

    beta, penalty = np.zeros(4), np.diag([1e-6] + [ridge] * 3)
    for _ in range(50):
        got = total(beta)
        step = np.linalg.solve(got[4:].reshape(4, 4) + penalty + 1e-9 * np.eye(4), got[:4] - penalty @ beta)
        beta = beta + step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def weigh(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Log odds of a feature in toxic against other documents, nought if it is neither ``STRONG`` nor ``SURE``."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    z = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    return np.where((z >= STRONG[0]) & (odds >= STRONG[1]) | (z >= SURE[0]) & (odds >= SURE[1]), odds, 0.0)


def weighs(toxic: Column, other: Column, n_toxic: int, n_other: int) -> Column:
    """Whether ``weigh`` gives a feature a weight (or nearly so), as a column."""
    odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((other + 0.5) / (n_other + 1))
    z = odds / F.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)) + 1e-6
    return (z >= STRONG[0]) & (odds + 1e-6 >= STRONG[1]) | (z >= SURE[0]) & (odds + 1e-6 >= SURE[1])


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on all labelled documents outside the held-out fold; None without both kinds."""
    spark = docs.sparkSession
    known = labels.select("doc_id", "toxic").where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic").cast("int") != 0).cast("int").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("text").isNotNull())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text with its sketch, then the words of all with their counts."""
        forget()
        seen, hashes = Counter(), WordHashes()

        def words() -> pa.RecordBatch:
            out: Counter = Counter()
            for t, n in seen.items():
                if t.isalpha():
                    out[t] += n
                else:
                    for w in _LETTER.findall(t):
                        out[w] += n
            seen.clear()
            k = len(out)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.string()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names)

        names = ["text", "toxic", "key", "word", "n"]
        for batch in batches:
            for part in pieces(batch, "text", LEARN_BYTES):
                keys = []
                for t in part.column("text").to_pylist():
                    own = t.lower().split()
                    seen.update(own)
                    keys.append(sketch(own, hashes))
                k = len(keys)
                yield pa.RecordBatch.from_arrays([part.column("text"), part.column("toxic"), pa.array(keys, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names)
                if len(seen) > LEARN_ENTRIES:
                    yield words()
                if len(hashes) > LEARN_ENTRIES:
                    hashes.clear()
        yield words()

    looked = cut(texts.join(known.hint("shuffle_hash"), "doc_id").select("text", "toxic").mapInArrow(look, "text string, toxic int, key long, word string, n long"), "toxicity-labelled")
    own = looked.where("key is not null").select("text", "toxic", "key")
    sizes = own.groupBy("key", "toxic").agg(F.count("*").alias("size"))
    n_of = Counter({(bool(r.toxic), r.half): r.n for r in sizes.groupBy("toxic", (F.col("key") % 2).alias("half")).agg(F.count("*").alias("n")).collect()})
    if len({t for t, _ in n_of}) < 2:
        drop_cut(looked)
        return None
    shared = cut(sizes.where("size > 1"), "toxicity-copies")

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()

        def grams() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.float64())], ["gram", "n"])

        for batch in batches:
            for g, n in trigrams(dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()))).items():
                out[g] += n
            if len(out) > LEARN_ENTRIES:
                yield grams()
                out.clear()
        yield grams()

    words = looked.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(letters, "gram string, n double")
    grams = words.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the letters of the texts
    chars = CharModel(dict(zip(grams.column("gram").to_pylist(), grams.column("n").to_pylist())))
    sent = spark.sparkContext.broadcast(chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Votes for features by side: 0 and 1 are the halves of other documents, 2 and 3 those of toxic ones."""
        forget()
        cached: dict[str, list[str]] = {}
        single, split = [Counter() for _ in range(4)], [Counter() for _ in range(4)]

        def votes() -> Iterator[pa.RecordBatch]:
            for k in range(4):
                for of, each in ((single[k], VOTE), (split[k], 1)):
                    yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.string()), pa.array([k] * len(of), pa.int32()), pa.array(np.fromiter(of.values(), np.int64, len(of)) * each)], ["feature", "side", "n"])
                    of.clear()

        for batch in batches:
            for part in pieces(batch, "text", LEARN_BYTES):
                for text, toxic, key, size in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "key", "size"))):
                    different = set(tokens_of(text))
                    for t in different.difference(cached):
                        cached[t] = features(restored(t, sent.value))
                    different = set(chain.from_iterable(map(cached.__getitem__, different)))
                    side = (2 if toxic else 0) + key % 2
                    if size == 1:
                        single[side].update(different)
                    else:
                        vote, to = max(1, VOTE // size), split[side]
                        for f in different:
                            to[f] += vote
                if len(cached) > LEARN_ENTRIES // 2:
                    cached.clear()
                if sum(map(len, single + split)) > LEARN_ENTRIES:
                    yield from votes()
        yield from votes()

    voted = own.join(shared, ["key", "toxic"], "left").select("text", "toxic", "key", F.coalesce("size", F.lit(1)).alias("size"))
    table_of = voted.mapInArrow(count, "feature string, side int, n long").groupBy("feature").agg(*(F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))) / VOTE, F.lit(0.0)).alias(f"s{k}") for k in range(4)))
    halves, all_of = (n_of[True, 0], n_of[False, 0]), (n_of[True, 0] + n_of[True, 1], n_of[False, 0] + n_of[False, 1])
    strong = table_of.where(weighs(F.col("s2"), F.col("s0"), *halves) | weighs(F.col("s2") + F.col("s3"), F.col("s0") + F.col("s1"), *all_of)).orderBy("feature").toArrow()
    drop_cut(shared)
    names = strong.column("feature").to_pylist()
    s = np.array([strong.column(f"s{k}").to_numpy() for k in range(4)], float).reshape(4, -1)
    half, whole = weigh(s[2], s[0], *halves), weigh(s[2] + s[3], s[0] + s[1], *all_of)
    half_sent = spark.sparkContext.broadcast({f: w for f, w in zip(names, half.tolist()) if w})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, half_sent.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                x = scorer.evidence(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("toxic"), *(pa.array(x[:, c]) for c in range(1, 4))], ["key", "toxic", "a", "b", "c"])

    witnesses = own.where("key % 2 = 1").mapInArrow(measure, "key long, toxic int, a double, b double, c double").groupBy("key", "toxic").agg(*(F.max(c).alias(c) for c in "abc"))
    rows = cut(witnesses.groupBy("toxic", *"abc").agg(F.count("*").alias("n")), "toxicity-evidence")
    beta = logistic(rows) if rows.select("toxic").distinct().count() == 2 else np.array([-3.0, 0.0, 3.0, 0.0])
    drop_cut(rows)
    drop_cut(looked)
    return Model(chars, {f: w for f, w in zip(names, whole.tolist()) if w}, beta)


def _apply(docs: DataFrame, model: Model | None, clean_only: bool) -> DataFrame:
    sent, key = docs.sparkSession.sparkContext.broadcast(model), model and f"toxicity-{model.key}"

    def make() -> Scorer:
        m = sent.value
        return Scorer(m.chars, m.weights, m.beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(key, make) if key else None
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text").to_pylist()
                score = scorer.score(texts) if scorer else np.zeros(len(texts))
                if clean_only:
                    yield part.filter(pa.array(score < LEAST_SCORE))
                else:
                    ids = part.column("doc_id")
                    yield pa.RecordBatch.from_arrays([ids, pa.array([id_bucket(i, FOLDS) == HELD_OUT for i in ids.to_pylist()]), pa.array(score), pa.array((score >= LEAST_SCORE).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    if clean_only:
        return docs.mapInArrow(run, docs.schema)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    return _apply(docs, learn(docs, labels), False)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    bounded_batches(docs.sparkSession)
    return _apply(docs, learn(docs, labels), True)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
