"""SentencePiece encoding, sharding, training order and chroma fingerprints."""

import io
import wave
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chroma, hashtree, pieces, trainorder

TEXT = st.text(st.sampled_from("abcdehinorst éß日𝒳 \n.=_/"), max_size=40)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.vocabulary_path())


def total(model, ids):
    return sum(model.score_of[i] for i in ids)


def brute(model, s):
    """Best sum over every segmentation, by plain recursion over positions."""
    best = [0.0] + [float("-inf")] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - model.longest), j):
            x = model.score.get(s[i:j], model.unknown if j == i + 1 else None)
            if x is not None:
                best[j] = max(best[j], best[i] + x)
    return best[-1]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_best_segmentation_and_round_trip(model, text):
    ids = model.encode(text)
    assert model.decode(ids) == text
    assert total(model, ids) == brute(model, model.normal(text))


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from([3, 7, 20, 50]))
def test_scan_over_chunks_is_the_whole(model, text, chunk):
    s = model.normal(text)
    if not s:
        return
    parts = list(model.chunks(s, chunk))
    matrices = [model.matrix(a, o, model.longest - 1 if k else 0) for k, (a, o) in enumerate(parts)]
    states = pieces.scan(matrices)
    ids = [i for (a, o), enter, leave in zip(parts, states, states[1:]) for i in model.chunk_ids(a, o, enter, leave)]
    assert model.decode(ids) == text and total(model, ids) == total(model, model.encode(text))
    product = matrices[0]
    for m in matrices[1:]:
        product = pieces.combine(product, m)
    assert product[0, 0] == total(model, ids)


def test_combination_is_associative(model):
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-50, 0, (16, 16)).astype(float) for _ in range(3))
    assert np.array_equal(pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c)))


def test_no_segmentation_of_the_library_is_better(model):
    """Its BPE segmentation of the same vocabulary is one of those searched, so it can't have a greater sum."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    for w in "the other letters reason station house under always nothing internationalisation".split():
        assert total(model, lib.encode(w)) <= total(model, model.encode(w))
        assert lib.decode(model.encode(w)) == w


@pytest.mark.parametrize("chunk", [pieces.CHUNK, 64])
def test_documents(spark, sf, model, chunk):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = pieces.encode(docs, chunk=chunk).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.ids for r in rows} == {i: model.encode(t) for i, t in texts.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_encoding_odd_rows(spark, odd_docs, no_docs):
    rows = pieces.encode(odd_docs).collect()
    assert len(rows) == 11 and all(r.round_trip for r in rows if r.ids is not None)
    null = next(r for r in rows if r.doc_id == 2)
    assert null.ids is None and null.n_tokens == 0 and null.round_trip is None
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(odd_docs)).collect()}
    assert back == {r.doc_id: r.text for r in odd_docs.collect()}
    assert pieces.encode(no_docs).count() == 0


# -- shards ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [hashtree.BUCKET_ROWS, 3])
def test_shards(spark, sf, bucket):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = hashtree.shard(docs, bucket_rows=bucket).collect()
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert {r.law for r in rows} == {"key"} and all(0 <= r.shard < 24 and r.grown_shard in (r.shard, 24) for r in rows)


def test_descent_against_brute_force(spark):
    import math

    from pyspark.sql import functions as F

    regions = hashtree.tree([1.0, 2.0, 0.5, 1.0, 1.0, 3.0, 1.0, 1.0, 1.0, 0.25, 4.0], base=10)
    assert [[len(x) for x in racks] for racks in regions] == [[4, 4], [2], [1]]
    ids = spark.range(500).select("id", F.col("id").cast("string").alias("k"))
    got = {r.id: r.s for r in hashtree.descend(ids, "k", regions, "s").collect()}
    hashes = ids.select("id", *(F.xxhash64("k", F.lit(0), F.lit(0), F.lit(i)).alias(f"a{i}") for i in range(3)), *(F.xxhash64("k", F.lit(1), F.lit(r), F.lit(i)).alias(f"b{r}_{i}") for r in range(3) for i in range(2)), *(F.xxhash64("k", F.lit(2), F.lit(r), F.lit(c), F.lit(i)).alias(f"c{r}_{c}_{i}") for r in range(3) for c in range(2) for i in range(4)))
    draw = lambda h, w: -math.log((((h & (2**64 - 1)) >> 11) + 0.5) / 2**53) / w
    for row in hashes.collect():
        r = min(range(3), key=lambda i: draw(row[f"a{i}"], sum(w for rack in regions[i] for _, w in rack)))
        c = min(range(len(regions[r])), key=lambda i: draw(row[f"b{r}_{i}"], sum(w for _, w in regions[r][i])))
        leaf = min(range(len(regions[r][c])), key=lambda i: draw(row[f"c{r}_{c}_{i}"], regions[r][c][i][1]))
        assert got[row.id] == regions[r][c][leaf][0]


def test_weights_are_kept_and_moves_confined(spark):
    from pyspark.sql import functions as F

    ids = spark.range(20_000).select("id", F.col("id").cast("string").alias("k"))
    even, n = [1.0] * 16, 20_000
    light, heavy, grown = [1.9, 0.1, *even[2:]], [1.0, 1.0, 1.0, 5.0, *even[4:]], [*even, 1.0]
    out = ids
    for name, w in (("even", even), ("light", light), ("heavy", heavy), ("grown", grown)):
        out = hashtree.descend(out, "k", hashtree.tree(w, 16), name)
    rows = out.collect()
    # weights change inside a rack, its sum doesn't: no row leaves or enters the rack
    assert {r.even // 4 for r in rows if r.even != r.light} == {0} and all(r.light // 4 == r.even // 4 for r in rows)
    # one subtree gains weight: the other rack of the region and the other region only lose rows to it
    for r in rows:
        if r.even // 8 != r.heavy // 8:
            assert r.heavy // 8 == 0
        elif r.even // 4 != r.heavy // 4:
            assert r.heavy // 4 == 0
    assert abs(sum(r.heavy == 3 for r in rows) / n - 5 / 20) < 0.02
    # one more shard takes rows only into itself
    assert {r.grown for r in rows if r.grown != r.even} == {16} and abs(sum(r.grown == 16 for r in rows) / n - 1 / 17) < 0.01
    assert all(abs(sum(r.even == k for r in rows) / n - 1 / 16) < 0.01 for k in range(16))


def test_growth_step_by_step(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'x' AS text")
    a = {r.doc_id: r.grown_shard for r in hashtree.shard(docs).collect()}
    rows = hashtree.shard(docs, 25, base=24).collect()
    assert {r.doc_id: r.shard for r in rows} == a and all(r.grown_shard in (r.shard, 25) for r in rows)


def test_sharding_odd_rows(odd_docs, no_docs):
    rows = hashtree.shard(odd_docs, bucket_rows=1).collect()
    assert len(rows) == 11 and next((r.size, r.text_crc32) for r in rows if r.doc_id == 2) == (8, 0)
    twins = [r for r in rows if r.doc_id == 1]
    assert twins[0].shard == twins[1].shard and twins[0].slot != twins[1].slot
    assert hashtree.shard(no_docs).count() == 0


# -- training order ----------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_feistel_is_a_permutation(n, key):
    s = trainorder.slots_of(np.arange(n), n, key)
    assert np.array_equal(np.sort(s), np.arange(n)) and np.array_equal(trainorder.indices_of(s, n, key), np.arange(n))


@pytest.mark.parametrize("block", [trainorder.BLOCK, 7])
def test_order_on_disk(spark, odd_docs, tmp_path, block):
    model = trainorder.Tokens(trainorder.vocabulary_path())
    at, record, rows_each = f"file://{tmp_path}/order", 32, 100
    out = trainorder.materialise(odd_docs.repartition(3), at, record=record, shard_rows=rows_each, block=block)
    files = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "order").iterdir()}
    rows = out.collect()
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "order").iterdir()} == files  # reading the result writes nothing
    raw = [(tmp_path / "order" / f"shard-{s:08d}.bin").read_bytes() for s in range(len(files) - 1)]
    whole = np.frombuffer(b"".join(raw), "<u2").reshape(-1, record)
    n = len(whole)
    assert [len(x) for x in raw] == [64 * min(rows_each, n - k * rows_each) for k in range(len(raw))]
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((r.doc_id for r in odd_docs.collect()), key=repr)
    taken = np.zeros(n * record, int)
    for r in rows:  # a document's tokens, wherever the permutation put them, are the ids of its whole text
        assert (r.shard, r.offset) == (r.slot // rows_each, r.slot % rows_each * 64 + 2 * r.token)
        assert r.slot == trainorder.slots_of(np.array([r.seq_index]), n)[0]
        flat = r.seq_index * record + r.token + np.arange(r.n_tokens)
        taken[flat] += 1
        ids = whole[trainorder.slots_of(flat // record, n), flat % record]
        assert ids.tolist() == [*model.encode(texts[r.doc_id]).tolist(), trainorder.END] and zlib.crc32(ids.tobytes()) == r.token_crc32
        assert model.decode(ids.tolist()) == texts[r.doc_id]
    assert taken.max() == 1 and (whole[trainorder.slots_of(np.arange(n), n)].ravel()[taken == 0] == trainorder.PAD).all()
    for slot in (0, 1, rows_each, n - 1):
        assert np.array_equal(np.stack(list(trainorder.read_records(at, slot))), whole[slot:])


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abé日 \n\t'st1.\u00a0\u2003"), max_size=80), st.integers(1, 9))
def test_encoding_in_steps_is_the_whole(text, step):
    model = trainorder.loaded(trainorder.vocabulary_path())
    assert model.encode(text, step).tolist() == model.encoding.encode_ordinary(text)


def test_no_sequences(no_docs, tmp_path):
    assert trainorder.materialise(no_docs, f"file://{tmp_path}/o").count() == 0
    assert list(trainorder.read_records(f"file://{tmp_path}/o")) == []


# -- chroma ------------------------------------------------------------------------------------------------------------


def wav(x, rate=4000, channels=1):
    sink = io.BytesIO()
    with wave.open(sink, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return sink.getvalue()


def test_integral_image_is_plain_sums():
    c = np.random.default_rng(0).random((20, 12))
    got = chroma.integers_of(c)
    assert len(got) == 20 - chroma.WINDOW + 1
    for t in (0, 5):
        word = 0
        for kind, p, n, f in chroma.FILTERS:
            w = c[t : t + f, p : p + n]
            h, g = f // 2, n // 2
            one, two = {0: (w[:, :g].sum(), w[:, g:].sum()), 1: (w[:h].sum(), w[h:].sum()), 2: (w[:h, :g].sum() + w[h:, g:].sum(), w[:h, g:].sum() + w[h:, :g].sum()), 3: (w.sum() - w[:, n // 3 : 2 * (n // 3)].sum(), w[:, n // 3 : 2 * (n // 3)].sum()), 4: (w.sum() - w[f // 3 : 2 * (f // 3)].sum(), w[f // 3 : 2 * (f // 3)].sum())}[kind]
            word = word << 2 | int(chroma._GRAY[np.searchsorted(chroma.BORDERS, np.log1p(one) - np.log1p(two))])
        assert int(got[t]) == word


def test_a_tone_has_its_pitch_class():
    t = np.arange(8000) / chroma.RATE
    c = chroma.chroma_of(chroma.samples_of(wav(np.sin(2 * np.pi * 440 * t))))
    assert (c.argmax(axis=1) == 0).all()
    stereo = np.repeat(np.sin(2 * np.pi * 440 * np.arange(16000) / 8000), 2)
    assert (chroma.chroma_of(chroma.samples_of(wav(stereo, 8000, 2))).argmax(axis=1) == 0).all()


@pytest.fixture(scope="module")
def recordings(spark):
    rng = np.random.default_rng(0)
    base = [chroma.render((rng.standard_normal(64) * 0.125).tolist()) for _ in range(40)]
    rows, truth = [(k * 50, w) for k, w in enumerate(base)], set()
    for k, w in enumerate(base):
        x = chroma.samples_of(w)
        cut = int(rng.integers(0, 5)) * chroma.HOP + int(rng.integers(0, 150))
        rows.append((10_001 + k, wav(x[cut:] + 0.05 * rng.standard_normal(len(x) - cut))))
        if k < 10:
            rows.append((20_001 + k, w))
    rows += [(30_001, None), (30_002, b""), (30_003, b"RIFFxx"), (30_004, wav(np.zeros(30_000))), (None, wav(np.zeros(30_000))), (30_004, wav(np.zeros(30_000)))]
    return spark.createDataFrame(rows, "id long, wav binary").selectExpr("*", "'x' AS kind", "1 AS offset")


@pytest.mark.parametrize("hot", [chroma.HOT, 1])
def test_alignment_against_brute_force(recordings, hot):
    prints = {}
    for r in chroma.fingerprints(recordings).collect():
        if r.ints and r.id is not None:
            prints.setdefault(tuple(r.ints), r.id)
            prints[tuple(r.ints)] = min(prints[tuple(r.ints)], r.id)
    arrays = {i: np.array(p, np.int32).view(np.uint32) for p, i in prints.items()}
    want = set()
    for q, a in arrays.items():
        for c, b in arrays.items():
            if q % 50 or q == c:
                continue
            for off in range(-len(a), len(b)):
                lo, hi = max(0, -off), min(len(a), len(b) - off)
                if hi - lo >= chroma.OVERLAP and np.bitwise_count(a[lo:hi] ^ b[lo + off : hi + off]).mean() / 32 <= chroma.BIT_ERROR:
                    want.add((q, c))
    rows = chroma.align(chroma.fingerprints(recordings), hot=hot).collect()
    got = {(r.class_id, r.other_class) for r in rows if r.kind == "match"}
    assert got <= want and len(got) / len(want) >= 0.9 and len(want) >= 40
    members = [r for r in rows if r.kind == "member"]
    assert len(members) == 96 and sum(r.class_id is None for r in members) == 3
    assert {r.id: r.class_id for r in members if r.id and 20_000 < r.id < 20_020} == {20_001 + k: 50 * k for k in range(10)}


@pytest.mark.parametrize("noise", [0.3, 0.4, 0.5, 0.6])
def test_recall_up_to_the_bit_error(spark, monkeypatch, noise):
    rng, prints, want = np.random.default_rng(int(noise * 10)), [], set()
    for k in range(40):
        x = chroma.samples_of(chroma.render((rng.standard_normal(64) * 0.125).tolist()))
        start = int(rng.integers(0, 14)) * chroma.HOP + int(rng.integers(0, 150))
        a, b = (chroma.integers_of(chroma.chroma_of(y)) for y in (x, x[start:] + noise * rng.standard_normal(len(x) - start)))
        prints += [(50 * k, a.view(np.int32).tolist()), (10_001 + k, b.view(np.int32).tolist())]
        for off in range(-len(a), len(b)):
            lo, hi = max(0, -off), min(len(a), len(b) - off)
            if hi - lo >= chroma.OVERLAP and np.bitwise_count(a[lo:hi] ^ b[lo + off : hi + off]).mean() / 32 <= chroma.BIT_ERROR:
                want.add((50 * k, 10_001 + k))
    monkeypatch.setattr(chroma, "BLOCK_WINDOWS", 700)
    rows = chroma.align(spark.createDataFrame(prints, "id long, ints array<int>")).where("kind = 'match' and other_class > 10000 and other_class - 10001 = class_id / 50").collect()
    got = {(r.class_id, r.other_class) for r in rows}
    assert len(rows) == len(got) and got <= want and len(want) >= 5 and len(got) / len(want) >= 0.9


def test_no_recordings(recordings):
    assert chroma.align(chroma.fingerprints(recordings.where("id = 5"))).count() == 0
    assert chroma.render(None) is None and len(chroma.integers_of(chroma.chroma_of(chroma.samples_of(chroma.render([None, float("nan"), 1.0] * 20))))) > 0
