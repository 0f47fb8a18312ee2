"""Language identification (operator 10) by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over
all ways to cut it into pieces, of the products of their probabilities: a forward algorithm over the word's lattice,
for all languages at once. A text's score is the sum over its words; the posterior of the best language is ``score``.

Learning: piece probabilities by expectation-maximisation (forward-backward over the same lattices) on all words of about
``SAMPLE_DOCS`` documents with a language whose crc32(doc_id) mod 3 is not 1. Languages share that number of documents:
those with few are taken whole, the others in equal parts, so every language of the labels is learned. The number of
documents is the only bound; words and their counts stay distributed, and each round sends the driver the expected
counts of the vocabulary's pieces only. A share ``UNSEEN`` of each language is spread over all pieces alike, so that
what no language has speaks for none. Every text is scored whole.

Defined cases: null text or text without a letter is ``und`` with score 0; so is every text if nothing can be learned
from (no labelled rows, empty table); a language whose documents have no letter is not learned; of equally likely
languages the first by name is predicted; very long texts and words are summed step by step; repeated rows are scored
each; only doc_id, text and (to learn) lang are read.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import TokenTable, bounded_batches, cut, drop_cut, fold, forget, id_bucket, kept, pieces, sums, table

SAMPLE_DOCS, ROUNDS, UNSEEN = 4000, 4, 0.01
#: Words of one step of learning, and tasks of one round.
STEP_WORDS, TASKS = 5000, 24
FOLDS, HELD_OUT = 3, 1
VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words longer than this are summed step by step with rescaling.
LONG = 40
#: The pipeline's stage keeps documents whose language is known with at least this posterior.
LEAST_SCORE = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lattice:
    """Arcs of words over the pieces of the vocabulary. Piece 0 stands for a letter that no piece has."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = ["", *(sp.id_to_piece(i) for i in ids)]
        self.size = len(self.pieces)
        if self.size > 65_536:
            raise ValueError("arcs hold pieces in 16 bits")
        # pieces from their last letter to their first, as a tree of dicts with the piece under "": a search that grows to
        # the left stops where no piece goes on so
        self.root: dict = {}
        for k, p in enumerate(self.pieces):
            node = self.root
            for c in reversed(p):
                node = node.setdefault(c, {})
            if k:
                node[""] = k

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of every arc, words in order and ends ascending. Start and piece are packed in one
        number while arcs are collected; how many there are up to each end tells the rest."""
        packed, upto, root = array("q"), array("q"), self.root
        push, mark = packed.append, upto.append
        for w in words:
            for i in range(len(w)):
                node = root.get(w[i])
                if node is None or "" not in node:
                    push(i << 16)
                while node is not None:
                    k = node.get("")
                    if k is not None:
                        push(i << 16 | k)
                    if not i:
                        break
                    i -= 1
                    node = node.get(w[i])
                mark(len(packed))
        out = np.frombuffer(packed, np.int64) if packed else np.zeros(0, np.int64)
        n = np.array([len(w) for w in words], np.int64)
        each = np.diff(np.frombuffer(upto, np.int64) if upto else np.zeros(0, np.int64), prepend=0)
        ends = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        return np.repeat(np.repeat(np.arange(len(words)), n), each), out >> 16, np.repeat(ends, each), out & 65535


def _runs(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))


class Model:
    """Piece probabilities p[piece, language] and the languages' names."""

    def __init__(self, langs: list[str], p: np.ndarray, path: str) -> None:
        self.langs, self.p, self.path, self.key = langs, p, path, uuid.uuid4().hex

    def forward(self, lattice: Lattice, words: list[str], arcs=None) -> np.ndarray:
        """Probabilities alpha[word, position, language] of each word's beginnings, times ``scale`` for each letter."""
        word, start, end, piece = arcs or lattice.arcs(words)
        width = max(map(len, words)) + 1
        alpha = np.zeros((len(words), width, len(self.langs)))
        alpha[:, 0] = 1
        order = np.argsort(end, kind="stable")
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        cuts = np.searchsorted(end, np.arange(1, width + 1))
        for j in range(1, width):
            a, b = cuts[j - 1], cuts[j]
            if a == b:
                continue
            w = word[a:b]
            at = _runs(w)
            alpha[w[at], j] = np.add.reduceat(alpha[w, start[a:b]] * (self.p[piece[a:b]] * SCALE ** (j - start[a:b])[:, None]), at, axis=0)
        return alpha

    def log_probabilities(self, lattice: Lattice, words: list[str]) -> np.ndarray:
        """ln of each word's probability in each language, over all its segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        short.sort(key=lambda k: len(words[k]))
        for at in range(0, len(short), 10_000):  # words of like length together
            own = short[at : at + 10_000]
            part = [words[k] for k in own]
            n = np.array([len(w) for w in part])
            alpha = self.forward(lattice, part)
            out[own] = np.log(alpha[np.arange(len(part)), n]) - (n * np.log(SCALE))[:, None]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.long(lattice, w)
        return out

    def long(self, lattice: Lattice, w: str) -> np.ndarray:
        """The same for a word of any length: a window of beginnings, rescaled at each letter."""
        most = max(map(len, lattice.pieces))
        window, scale = [np.ones(len(self.langs))], np.zeros(len(self.langs))
        for at in range(0, len(w), 4096):
            text = w[max(0, at - most) : at + 4096]
            _, start, end, piece = lattice.arcs([text])
            new = end > at - max(0, at - most)
            start, end, piece = start[new], end[new], piece[new]
            cuts = np.append(_runs(end), len(end)) if len(end) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                back = end[a:b] - start[a:b]
                value = sum(window[-int(k)] * self.p[q] for k, q in zip(back, piece[a:b]))
                scale += np.log(value)
                window = [x / value for x in window[-most:]] + [np.ones(len(self.langs))]
        return scale


#: Keeps the probabilities of long words within floating point: each letter counts this much more, undone in the logarithm.
SCALE = 8.0


def spread(sum_of: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts, a share ``UNSEEN`` over all pieces alike."""
    return (1 - UNSEEN) * sum_of / np.maximum(sum_of.sum(axis=0), 1e-300) + UNSEEN / len(sum_of)


def expected(model: Model, lattice: Lattice, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected counts [piece, language] of the pieces in words with their counts[word, language]."""
    sum_of = np.zeros((lattice.size, len(model.langs)))
    order = sorted((k for k, w in enumerate(words) if len(w) <= LONG), key=lambda k: len(words[k]))
    for at in range(0, len(order), STEP_WORDS):  # words of like length together, few enough for small arrays
        own = [words[k] for k in order[at : at + STEP_WORDS]]
        _expect(model, lattice, own, counts[order[at : at + STEP_WORDS]], lattice.arcs(own), sum_of)
    return sum_of


def _expect(model: Model, lattice: Lattice, words: list[str], counts: np.ndarray, arcs: tuple, sum_of: np.ndarray) -> None:
    """Add the expected counts of pieces in the words to ``sum_of``."""
    word, start, end, piece = arcs
    n = np.array([len(w) for w in words])
    alpha = model.forward(lattice, words, arcs)
    beta = np.zeros_like(alpha)
    beta[np.arange(len(words)), n] = 1
    weight = model.p[piece] * SCALE ** (end - start)[:, None]
    order = np.argsort(start, kind="stable")
    starts = start[order]
    for i in range(int(n.max()) - 1, -1, -1):
        own = order[np.searchsorted(starts, i) : np.searchsorted(starts, i + 1)]
        if len(own):
            at = _runs(word[own])
            beta[word[own][at], i] = np.add.reduceat(beta[word[own], end[own]] * weight[own], at, axis=0)
    total = alpha[np.arange(len(words)), n]
    share = alpha[word, start] * weight * beta[word, end] * (counts / np.maximum(total, 1e-300))[word]
    for k in range(sum_of.shape[1]):
        sum_of[:, k] += np.bincount(piece, share[:, k], lattice.size)


def _words(text: str | None) -> list[str]:
    return [] if not text else [MARK + w for w in _LETTERS.findall(text.lower())]


def quotas(n_of: dict[str, int], sample: int) -> dict[str, float]:
    """The share of each language's documents to take: small languages whole, the others an equal number."""
    left, out = sample, {}
    for k, (lang, n) in enumerate(sorted(n_of.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, max(1, left // (len(n_of) - k)))
        out[lang], left = take / n, left - take
    return out


def learn(docs: DataFrame, path: str | None = None, sample: int = SAMPLE_DOCS) -> Model | None:
    """Fit on a bounded sample of the documents that have a language; None if there are none."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = quotas(dict(tuple(r) for r in labelled.groupBy("lang").agg(F.count("*")).collect()), sample)
    if not share:
        return None
    parts = spark.createDataFrame(list(share.items()), "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000))
    chosen = labelled.join(F.broadcast(parts), "lang").where(drawn < F.col("share") * 1_000_000).select("lang", "text")  # a row for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in pieces(batch, "text"):
                seen: Counter = Counter()
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    seen.update((lang, w) for w in _words(text))
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    rows = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("counts"))
    words = cut(rows.coalesce(TASKS), "langid-words")
    langs = [r.lang for r in words.select(F.explode("counts.lang").alias("lang")).distinct().orderBy("lang").collect()]
    if not langs:
        return None
    of_lang, lattice = {x: k for k, x in enumerate(langs)}, Lattice(path)
    model = Model(langs, np.full((lattice.size, len(langs)), 1 / lattice.size), path)
    lattice_key = f"lattice-{uuid.uuid4().hex}"
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model.p)  # bounded by the vocabulary

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now, own = Model(langs, sent.value, path), kept(lattice_key, lambda: Lattice(path))
            total = np.zeros((own.size, len(langs)))
            for batch in batches:
                counts = np.zeros((batch.num_rows, len(langs)))
                for k, pairs in enumerate(batch.column("counts").to_pylist()):
                    for x in pairs:
                        counts[k, of_lang[x["lang"]]] = x["n"]
                total += expected(now, own, batch.column("word").to_pylist(), counts)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        found = words.mapInArrow(step, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        sum_of = np.zeros((lattice.size, len(langs)))
        sum_of[found.column("piece").to_numpy(), found.column("lang").to_numpy()] = found.column("n").to_numpy()
        model = Model(langs, spread(sum_of), path)
        sent.unpersist()
    drop_cut(words)
    return model


class Scorer:
    """Predictions for batches of texts, with a bounded cache of tokens."""

    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, Lattice(model.path)
        self.tokens = TokenTable(self._rows, len(model.langs) + 1, 300_000)

    def _rows(self, tokens: list[str]) -> np.ndarray:
        owner, words = [], []
        for k, t in enumerate(tokens):
            for w in _words(t):
                owner.append(k)
                words.append(w)
        out = np.zeros((len(tokens), len(self.model.langs) + 1))
        if words:
            different = list(dict.fromkeys(words))
            place = {w: k for k, w in enumerate(different)}
            logs = self.model.log_probabilities(self.lattice, different)
            np.add.at(out, owner, np.concatenate((logs, np.ones((len(different), 1))), axis=1)[[place[w] for w in words]])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        flat, counts = [], []
        for t in texts:
            own = t.split() if t else []
            flat += own
            counts.append(len(own))
        ids = self.tokens.ids(flat)
        total = sums(self.tokens.values[ids], counts)
        logs = total[:, :-1]
        best = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        letters = total[:, -1] > 0
        return [self.model.langs[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, score, 0.0).tolist()


def _apply(docs: DataFrame, model: Model | None, keep_known: bool) -> DataFrame:
    sent, key = docs.sparkSession.sparkContext.broadcast(model), model and f"langid-{model.key}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(key, lambda: Scorer(sent.value)) if key else None
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text").to_pylist()
                lang, score = scorer.predict(texts) if scorer else (["und"] * len(texts), [0.0] * len(texts))
                if keep_known:
                    yield part.filter(pa.array([x != "und" and s >= LEAST_SCORE for x, s in zip(lang, score)]))
                else:
                    ids = part.column("doc_id")
                    yield pa.RecordBatch.from_arrays([ids, pa.array([id_bucket(i, FOLDS) == HELD_OUT for i in ids.to_pylist()]), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    if keep_known:
        return docs.mapInArrow(run, docs.schema)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, path: str | None = None, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    return _apply(docs, learn(docs, path, sample), False)


def keep_known(docs: DataFrame, path: str | None = None, sample: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or has a posterior under ``LEAST_SCORE``."""
    bounded_batches(docs.sparkSession)
    return _apply(docs, learn(docs, path, sample), True)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
