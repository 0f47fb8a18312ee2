"""Main text, LM scores, toxicity and languages: naive versions and held-out accuracy."""

import math
import subprocess
import sys
import zlib
from collections import Counter
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import blocks, langid, ppm, toxicity


@pytest.fixture(scope="module")
def labeller():
    return blocks.train()


def test_pages_of_the_table(spark, sf, labeller):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.page_id: r for r in blocks.extract(pages, labeller).collect()}
    exact = 0
    for p in pages.collect():
        want = "\n\n".join(b.text for b in blocks.blocks_of(p.html) if "article" in b.path)
        exact += rows[p.page_id].text == want
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text) and rows[p.page_id].url == p.url
    assert exact / len(rows) >= 0.95


def test_made_up_pages(labeller):
    made = [blocks.training_page(10**9 + k) for k in range(150)]
    reader = blocks.Reader()
    p = labeller.predict([reader.page(b) for b, _ in made])
    wrong = np.concatenate([(a >= 0.5) != y for a, (_, y) in zip(p, made)])
    assert wrong.mean() < 0.03


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    model = blocks.Labeller(1)
    pages = [rng.standard_normal((n, blocks.INPUTS)).astype(np.float32) * 0.3 for n in (5, 2, 7)]
    labels = [(rng.random(len(p)) < 0.5).astype(np.float32) for p in pages]

    def loss():
        p = np.concatenate(model.predict(pages))
        y = np.concatenate(labels)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = model.gradient(pages, labels)
    for array, g in zip([model.w[0], model.w[1], model.out], grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = array[at]
        array[at] = old + 1e-2
        up = loss()
        array[at] = old - 1e-2
        down = loss()
        array[at] = old
        assert math.isclose((up - down) / 2e-2, g[at], rel_tol=0.05, abs_tol=1e-4)


def test_blocks():
    html = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><p>one&amp;two&nbsp;x<br>y <b>z</b><p>three<ul><li>a<li><a href=x>b</a></ul><!-- <p>gone</p> --><style>p{}</style></div><td>q</body>"
    got = [(b.path[-1], b.text, b.linked) for b in blocks.blocks_of(html)]
    assert got == [("p", "one&two x y z", 0), ("p", "three", 0), ("li", "a", 0), ("li", "b", 1), ("td", "q", 0)]
    assert [b.text for b in blocks.blocks_of("plain text")] == ["plain text"] and blocks.blocks_of("<p></p> ") == []
    assert [b.text for b in blocks.blocks_of('a < b <p title="x>y">c</p> <')] == ["a < b", "c", "<"]


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<html><head><title>T</title><p>Hello there<p>B", ["Hello there", "B"]),
        ("<head><meta charset=x><title>T</title><script>a<b</script>text", ["text"]),
        ("<head><title>T</title></head><body><p>x", ["x"]),
        ("<head><title>T", ["T"]),
        ("<p>A.</p><noscript>x<p>B.</p>", ["A.", "x", "B."]),
        ("<p>A<select><option>1<p>B</p>", ["A", "1", "B"]),
        ("<p>A<select><option>1</select> B</p>", ["A B"]),
        ("<p>A<svg><text>t</text></svg><object>o</object><iframe>i</iframe><template>q</template>B", ["A", "B"]),
        ("<p>A<script>var x = '<p>no</p>';", ["A"]),
        ("<p>a <b>b</i></p> c<a href='x>y'>d</a> <a title=\"open>e</a>", ["a b", "cd e"]),
        ("x <a <b y", ["x <a <b y"]),
    ],
)
def test_broken_pages(html, texts):
    assert [b.text for b in blocks.blocks_of(html)] == texts


def test_adversarial_pages_take_linear_time(labeller):
    import time
    import tracemalloc

    reader = blocks.Reader()
    n = 300_000
    for html in ("<a " * (n // 3), "<b>" * (n // 6) + "</i>" * (n // 8), "<div>x" * (n // 6), "<b>" * (n // 6) + "<p></p>" * (n // 14), "<noscript>" * (n // 10), '<a "' * (n // 4), "<p>word" * (n // 7), "<" * n, "<!--" * (n // 4), "<a title='\"<a title=\"'" * (n // 22)):
        start = time.perf_counter()
        labeller.label(reader, [blocks.blocks_of(html)])
        assert time.perf_counter() - start < 15, html[:20]
    tracemalloc.start()
    found = blocks.blocks_of("<div>x" * 10_000)
    labeller.label(reader, [found])
    assert len(found) == 10_000 and tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()


def test_lstm_step_by_step_and_in_segments(labeller):
    made = [blocks.training_page(7 * 10**8 + k)[0] for k in range(12)]
    reader, sig = blocks.Reader(), lambda z: 1 / (1 + np.exp(-z))
    plain = []
    for own in made:
        x, sides = reader.page(own).astype(float), []
        for w, rows in ((labeller.w[0], x), (labeller.w[1], x[::-1])):
            h, c, out = np.zeros(blocks.HIDDEN), np.zeros(blocks.HIDDEN), []
            for row in rows:
                z = np.concatenate((row, h, [1.0])) @ w
                i, f, o, g = np.split(z, 4)
                c = sig(f) * c + sig(i) * np.tanh(g)
                h = sig(o) * np.tanh(c)
                out.append(h)
            sides.append(np.array(out))
        plain.append(sig(np.concatenate((sides[0], sides[1][::-1]), axis=1) @ labeller.out[:-1] + labeller.out[-1]))
    for got in (labeller.label(reader, made), labeller.label(reader, made, steps=3)):
        assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(got, plain))


def test_odd_pages(spark, labeller):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p"), (3, "v", deep), (3, "v", deep), (4, "w", "<article>" + "<p>Some words here, and more of them follow.</p>" * 3000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    out = blocks.extract(df, labeller).collect()
    assert len(out) == 6 and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert next(r for r in out if r.page_id == 1).text == "" and next(r for r in out if r.page_id == 4).n_kept > 2900
    assert blocks.extract(df.where("page_id = 99"), labeller).count() == 0


# -- LM scores ---------------------------------------------------------------------------------------------------------


def codes(symbols):
    v = 0
    for x in symbols:
        v = v << 8 | x
    return v


def grams(texts, order):
    out = []
    for j in range(order + 1):
        n = Counter()
        for t in texts:
            q = [255] * order + list(t) + [255]
            for i in range(order, len(q)):
                n[tuple(q[i - j : i + 1])] += 1
        out.append(n)
    return out


def naive(tables, context, symbol):
    order, total, out = len(tables) - 1, 0.0, set()
    for j in range(order, -1, -1):
        c = tuple(context[order - j :])
        seen = {g[-1]: n for g, n in tables[j].items() if g[:-1] == c and g[-1] not in out}
        if not seen:
            continue
        n = 2 * sum(seen.values())
        if symbol in seen:
            return total + math.log((2 * seen[symbol] - 1) / n)
        total += math.log(len(seen) / n)
        out |= set(seen)
    return total - math.log(256 - len(out))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 5 for x in b)), min_size=1, max_size=5), st.lists(st.integers(95, 103), min_size=3, max_size=3))
def test_ppm_is_the_naive_one_and_sums_to_one(texts, context):
    tables = grams(texts, 3)
    trie = ppm.Trie([(np.array([codes(g) for g in sorted(t)], np.uint64), np.array([t[g] for g in sorted(t)])) for t in tables])
    lp = trie.log_probabilities(np.array([codes([*context, s]) for s in range(256)], np.uint64))
    assert abs(np.exp(lp).sum() - 1) < 1e-6
    assert all(abs(lp[s] - naive(tables, context, s)) < 1e-6 for s in [*range(94, 105), 255])


def test_codes():
    got = ppm.codes_of([b"ab", b"", b"c"], 2)
    e = 255
    assert [int(x) for x in got] == [codes(x) for x in ([e, e, 97], [e, 97, 98], [97, 98, e], [e, e, e], [e, e, 99], [e, 99, e])]
    keys = np.unique(np.random.default_rng(0).integers(0, 2**60, 5000, dtype=np.uint64))
    t = ppm.Table(keys)
    assert np.array_equal(t.find(keys), np.arange(len(keys))) and (t.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def check_base(rows, texts):
    words = {i: (t or "").encode().lower().split() for i, t in texts}
    held = {i: (0 if i is None else zlib.crc32(str(i).encode()) % 5) == 1 for i, _ in texts}
    c = Counter()
    for i, _ in texts:
        if not held[i]:
            c.update([*words[i], None])
    n, z = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    for r in rows:
        own = [*words[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / z) for w in own), rel_tol=1e-9, abs_tol=1e-9) and r.score < 0


def test_scores_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = ppm.op4(spark, sf).collect()
    check_base(rows, [(r.doc_id, r.text) for r in docs.collect()])
    seen = [r for r in rows if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_rare_words_meet_their_counts(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(ppm, "MOST_WORDS", 5)
    rows = ppm.score(odd_docs).collect()
    assert len(rows) == 11
    check_base(rows, [(r.doc_id, r.text) for r in odd_docs.collect()])


@pytest.mark.parametrize("most", [0, 1000, 5000])
def test_grams_outside_the_cache_are_scored_too(spark, sf, odd_docs, monkeypatch, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 60").union(odd_docs.select("doc_id", "text")).coalesce(4)
    whole = sorted((str(r.doc_id), r.n_tokens, r.score) for r in ppm.score(docs).collect())
    monkeypatch.setattr(ppm, "MOST_GRAMS", most)
    part = sorted((str(r.doc_id), r.n_tokens, r.score) for r in ppm.score(docs).collect())
    assert len(part) == len(whole) > 11
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-6) for a, b in zip(part, whole))


def test_codes_are_looked_up_by_blocks(monkeypatch):
    codes, n = ppm.count_codes(ppm.codes_of([b"abracadabra", b"", b"cad abra"], 2))
    levels = [ppm.count_codes(codes & np.uint64(2**bits - 1), n) for bits in (8, 16)] + [(codes, n)]
    asked = ppm.codes_of([b"abra zebra", b"cab"], 2)
    whole = ppm.Trie(levels).log_probabilities(asked)
    monkeypatch.setattr(ppm, "LOOKED_UP", 3)
    assert np.array_equal(ppm.Trie(iter(levels)).log_probabilities(asked), whole) and len(ppm.Trie(levels).log_probabilities(asked[:0])) == 0


_MEMORY = """
import pickle, re, sys
import numpy as np, pyarrow as pa
from pyspark.core.broadcast import Broadcast
from tidemark.llm import common, ppm

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

some = np.random.default_rng(0)
texts = pa.RecordBatch.from_arrays([pa.array([bytes(row).decode() for row in some.integers(97, 123, (60, 50_000), np.uint8)])], ["text"])
list(ppm._count(iter([texts.slice(0, 1)]), 5))
before = held()
counted = sum(b.num_rows for b in ppm._count((texts.slice(k, 3) for k in range(0, 60, 3)), 5))
after_count = held()
codes = np.unique(some.integers(0, 2**48, 2**20, np.uint64))
context, four = np.unique(codes >> np.uint64(8)), np.ones(4, np.int64)[:, None]
with open(sys.argv[1], "wb") as f:
    pickle.dump(([(codes, np.full(len(codes), 3))], [(context, *(four * np.full(len(context), 9)))]), f)
del codes, context
common.release()
low = held()
sent = Broadcast(path=sys.argv[1])
first = ppm._trie("a", sent)
after_build = held()
again = ppm._trie("b", sent)  # after another key the arrays are read again
assert first is not again and np.array_equal(first.full[0], again.full[0])
own = sum(x.nbytes for t in (again.gram[0], again.context[0]) for x in (t.keys, t.rows)) + sum(x[0].nbytes for x in (again.log_n, again.full, again.node, again.whole))
del first, again
list(ppm._count(iter([texts.slice(0, 1)]), 5))
print(counted, after_count - before, after_build - low - own / 2**20, held() - low)
"""


def test_ppm_workers_give_memory_back(tmp_path):
    got = subprocess.run([sys.executable, "-c", _MEMORY, str(tmp_path / "sent")], cwd=Path(ppm.__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    counted, after_count, beside_trie, after_all = map(float, got.stdout.split())
    assert counted > 2_000_000 and max(after_count, beside_trie, after_all) < 10, got.stdout


def test_scores_without_training(spark, no_docs):
    assert ppm.score(no_docs).count() == 0
    i = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    (r,) = ppm.score(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isclose(r.score, -4 * math.log10(256))


# -- languages ---------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(langid.vocabulary_path())
    rng = np.random.default_rng(0)
    p = rng.random((lattice.size, 2))
    model = langid.Model(["a", "b"], p / p.sum(axis=0), langid.vocabulary_path())
    place = {x: k for k, x in enumerate(lattice.pieces) if k}

    def brute(w):
        total = np.zeros(2)
        for cuts in product([0, 1], repeat=len(w) - 1):
            parts, a = [], 0
            for k, c in enumerate([*cuts, 1]):
                if c:
                    parts.append(w[a : k + 1])
                    a = k + 1
            rows = [place.get(x, 0 if len(x) == 1 else -1) for x in parts]
            if min(rows) >= 0:
                total += np.prod([model.p[k] for k in rows], axis=0)
        return np.log(total)

    words = ["▁the", "▁hello", "▁ab", "▁日本", "▁ꙮx"]
    got = model.log_probabilities(lattice, words)
    assert np.allclose(got, [brute(w) for w in words])
    long = "▁" + "hello" * 30
    whole = model.long(lattice, long)
    assert np.isfinite(whole).all() and np.allclose(model.long(lattice, words[1]), got[1])


def test_languages_of_the_table(spark, sf):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op10(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)


def test_every_labelled_language_is_learned(spark):
    import random

    rng = random.Random(1)
    english = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)) for _ in range(400)]
    rows = [(k, t, "en") for k, t in enumerate(english)]
    greek = next(k for k in range(1000, 1010) if zlib.crc32(str(k).encode()) % 3 != 1)
    rows += [(greek, "η αλεπού πηδάει πάνω από το σκυλί", "el"), (5000, "το σκυλί πηδάει", None), (5001, english[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, sample=100).collect()}
    assert got[5000] == "el" and got[5001] == "en" and list(got.values()).count("el") == 2
    assert langid.quotas({"a": 1000, "b": 3, "c": 10}, 20) == {"b": 1.0, "c": 0.8, "a": 0.009}


def test_languages_of_odd_rows(spark, odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == 11
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {2, 3, 4, 8} <= und and 1 not in und
    kept = langid.keep_known(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() <= 7
    assert langid.identify(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# -- toxicity ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chars():
    return toxicity.CharModel(toxicity.trigrams({w: 50 for w in "idiot stupid moron loser pathetic worthless clown trash the and house street letter total titled covid http www rd mp".split()}))


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("$tup1d", "stupid"), ("m.o.r.o.n", "moron"), ("l0000ser", "loser"), ("tr@sh!!", "trash"), ("s t u p i d", "stupid"), ("idiooot", "idiot"), ("house", "house"), ("l3tt3r", "letter"), ("(the)", "the"), ("***", ""), ("covid19", "covid19"), ("http://www.mp", "http://www.mp"), ("2024", "")])
def test_restored(chars, token, word):
    assert toxicity.restored(token, chars) == word


def test_viterbi_is_the_best_path(chars):
    def total(path):
        context, value = "\x02\x02", 0.0
        for letter, channel in path:
            value += channel
            if letter:
                value += chars(context, letter)
                context = context[1] + letter
        return value + chars(context, "\x03")

    for token in ("1d10t", "l00ser", "a.b", "t1l"):
        paths = list(product(*toxicity.lattice(token)))
        best = max(paths, key=total)
        assert math.isclose(total(best), max(map(total, paths)))
        assert "".join(x for x, _ in best) == toxicity.decode(token, chars)


def test_long_tokens_take_linear_time(chars):
    import time

    scorer = toxicity.Scorer(chars, {"idiot": 3.0})
    start = time.perf_counter()
    for middle in ("." * 10**6, ".-" * 500_000, "o" * 10**6, "0" * 10**6, "x " * 500_000, "a." * 500_000):
        scorer.evidence(["a" + middle + "b"])
    assert time.perf_counter() - start < 6
    assert scorer.evidence(["." * 300 + "idiot" + "/" * 300 + "b"])[0, 1] > 0 and toxicity.bare("(.a!.)") == "a!"


def test_spaced_letters_are_one_token():
    assert toxicity.tokens_of("you i d i o t a b") == ["you", "i d i o t a b"] and toxicity.tokens_of("a b word c d e") == ["a", "b", "word", "c d e"] and toxicity.tokens_of(None) == []


@pytest.fixture(scope="module")
def toxic_docs(spark):
    import random

    rng = random.Random(0)
    syllables = "ba be bi bo du fa ge ki lo mu na po ra se ti vu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    disguised = {"idiot": ["1d10t", "i.d.i.o.t", "idiooot"], "moron": ["m0r0n", "m o r o n"]}
    docs, labels = [], []
    for k in range(900):
        own = [word() for _ in range(rng.randint(20, 120))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w = rng.choice(list(disguised))
                own.insert(rng.randrange(len(own)), rng.choice(disguised[w]) if k % 12 == 0 and k > 600 else w)
        docs.append((k, " ".join(own), "xx", "s", 1))
        labels.append((k, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found(toxic_docs):
    docs, labels = toxic_docs
    rows = toxicity.toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) / len(held) > 0.98
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, toxic_docs):
    docs, labels = toxic_docs
    both = odd_docs.select(*docs.columns).unionByName(docs.where("doc_id > 9"))
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (700, 1, None), (11, 0, 1), (11, 0, 0)], "doc_id long, quality int, toxic int")).selectExpr("*", "'x' AS text", "1 AS score")
    rows = toxicity.toxicity(both, more).collect()
    assert len(rows) == 11 + 890 and all(0 <= r.score <= 1 for r in rows)
    bare = {r.doc_id: r.score for r in rows if r.doc_id in (2, 3, 4)}
    assert len(set(bare.values())) == 1
    none = toxicity.toxicity(odd_docs, labels.where("toxic = 0")).collect()
    assert len(none) == 11 and {r.score for r in none} == {0.0}
    assert toxicity.toxicity(no_docs, labels).count() == 0 and toxicity.toxicity(odd_docs, labels.where("doc_id < 0")).count() == 11


def test_toxicity_is_learned_from_every_labelled_row(spark):
    import random

    rng = random.Random(1)
    syllables = "ba be bi du fa ge ki lo mu na po ra".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 3)))
    insults = ["vex" + "".join(rng.choice(syllables) for _ in range(3)) for _ in range(40)]
    texts = [" ".join([*(word() for _ in range(4)), rng.choice(insults) if k % 8 == 0 else word()]) for k in range(14_400)]
    for k in range(0, 14_400, 48):
        texts[k] = f"a copy of one {insults[0]}"  # one witness
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(14_400)], "doc_id long, toxic int")
    rows = [(texts[k], k % 8 == 0) for k in range(14_400) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert len(rows) > 9500
    witnesses = set(rows)
    n = Counter(toxic for _, toxic in witnesses)
    count = {side: Counter(f for text, toxic in witnesses if toxic == side for f in {f for w in text.split() for f in toxicity.features(w)}) for side in (True, False)}
    names = sorted(count[True])
    w = toxicity.weigh(np.array([count[True][f] for f in names]), np.array([count[False][f] for f in names]), n[True], n[False])
    want = {f: v for f, v in zip(names, w.tolist()) if v}
    model = toxicity.learn(docs, labels)
    assert len(want) >= 40 and model.weights.keys() == want.keys() and all(math.isclose(model.weights[f], v) for f, v in want.items())
    tri = toxicity.trigrams(Counter(w for text, _ in rows for w in text.split()))
    assert model.chars.tri.keys() == tri.keys() and all(math.isclose(model.chars.tri[g], v, rel_tol=1e-9) for g, v in tri.items())


def test_logistic_is_fitted_alike_in_the_driver_and_in_tasks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (300, 3)).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(2 - x.sum(1) / 2))).astype(int)
    rows = spark.createDataFrame([(int(t), *map(float, r), int(n)) for t, r, n in zip(y, x, rng.integers(1, 5, 300))], "toxic int, a double, b double, c double, n long")
    here, there = toxicity.logistic(rows), toxicity.logistic(rows.repartition(3), most=0)
    assert np.allclose(here, there, atol=1e-7) and (here[1:] > 0.2).all()
    each = rows.selectExpr("toxic", "a", "b", "c", "explode(sequence(1, int(n))) AS k").selectExpr("toxic", "a", "b", "c", "1L AS n")
    assert np.allclose(here, toxicity.logistic(each), atol=1e-7)


def test_sketch_tells_copies():
    hashes = toxicity.WordHashes()
    words = [f"w{k}" for k in range(400)]
    assert toxicity.sketch([], hashes) == 0 and toxicity.sketch(words, hashes) == toxicity.sketch(words, toxicity.WordHashes()) >= 0
    assert len({toxicity.sketch(words[k : k + 5], hashes) for k in range(300)}) == 300 and len({toxicity.sketch(words[:k], hashes) for k in range(1, 5)}) == 4
    same = sum(toxicity.sketch(words[k:] + words[:k], hashes) == toxicity.sketch(words[k:] + words[:k][:-1] + ["x"], hashes) for k in range(100))
    assert same >= 90
