"""SimHash near-dedup and benchmark decontamination against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontaminate, simhash

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], np.uint64)
    parts = simhash.Parts(len(ids))
    for i in range(len(ids)):
        parts.join((i, int(j)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4))
    label = parts.labels()
    return {ids[i]: ids[label[i]] for i in range(len(ids))}


def test_whole_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = simhash.op7(spark, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps and all(len(r.fingerprint) == 16 for r in rows)
    assert {r.doc_id: r.component_id for r in rows} == plain_components(fps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \nC\tdé", max_size=60), max_size=12))
def test_fingerprints(texts):
    got = simhash.fingerprints_of([t.encode() for t in texts])
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]


def test_long_text_counts_beyond_a_byte():
    t = " ".join(str(k % 5) for k in range(3000))
    assert int(simhash.fingerprints_of([t.encode()])[0]) == plain_fingerprint(t)


@pytest.mark.parametrize("chunk", [20, simhash.CHUNK])
def test_dense_groups_with_and_without_chunks(spark, chunk):
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 8, dtype=np.uint64)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (120, 2)).astype(np.uint64), axis=1) for c in centres]
    x = np.unique(np.concatenate([*near, rng.integers(0, 2**63, 200, dtype=np.uint64), np.zeros(1, np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    links = simhash.links(df, chunk)
    assert links.count() < 40 * len(x)  # a forest for each bucket, not all pairs
    root = {r.node: r.root for r in simhash.components(links).collect()}
    want = plain_components({int(v): int(u) for v, u in zip(x.view(np.int64), x)})
    groups = lambda d: sorted(sorted(k for k in d if d[k] == r) for r in set(d.values()))
    assert groups({int(v): root.get(int(v), int(v)) for v in x.view(np.int64)}) == groups(want)


def searched(x, most):
    """Links that ``_search`` gives for fingerprints, all orders in one task, and the edge members it passes on."""
    ranks = list(simhash._spread(iter([pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], ["fp"])])))
    t = pa.Table.from_batches(ranks).sort_by([("band", "ascending"), ("rank", "ascending")])
    return pa.Table.from_batches(list(simhash._search(iter(t.to_batches(max_chunksize=37)), most))).to_pylist()


def test_every_link_of_the_table_comes_through_the_index(sf, monkeypatch):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()
    x = np.unique(simhash.fingerprints_of([(t or "").encode() for t in texts]))
    seen, links = [], simhash.GrayIndex.links
    monkeypatch.setattr(simhash.GrayIndex, "links", lambda self, q, *a, **k: seen.append((len(q), len(self.levels))) or links(self, q, *a, **k))
    rows = searched(x, simhash.CHUNK)
    assert sum(n for n, _ in seen) == len(x) * len(simhash.ORDERS) and max(levels for _, levels in seen) >= 3
    parts = simhash.Parts(len(x))
    at = {int(v): k for k, v in enumerate(x.view(np.int64))}
    parts.join((at[r["a"]], at[r["b"]]) for r in rows if r["kind"] == 0)
    got = {i: i0 for i, i0 in enumerate(parts.labels().tolist())}
    assert got == plain_components({i: int(v) for i, v in enumerate(x)})


def test_orders_are_undone():
    x = np.random.default_rng(3).integers(0, 2**63, 500, dtype=np.uint64)
    for k in range(len(simhash.ORDERS)):
        assert np.array_equal(simhash.restored(simhash.permuted(x, k), k), x)


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 200), st.integers(0, 2**32 - 1))
def test_index_finds_all(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    x = np.unique(base[rng.integers(0, 5, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)))
    x = x[np.argsort(simhash.gray_rank(x))]
    q, m = simhash.GrayIndex(x).links(x, 4)
    want = {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4)}
    assert set(zip(q.tolist(), m.tolist())) == want


def test_odd_documents(odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {by[k][0].fingerprint for k in (2, 3, 4)} == {"0" * 16} and {by[k][0].component_id for k in (2, 3, 4)} == {2}
    assert len(by[1]) == 2 and by[None][0].component_id is None
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(None) == 1 and 3 not in ids and 2 in ids


def test_one_row_of_each_group_stays(spark):
    a, b, c = "one two three four five six", "red green blue black white grey", "un deux trois quatre cinq six"
    for rows, kept in (
        ([(5, a), (5, b), (3, b)], [(3, b), (5, a)]),
        ([(5, a), (5, c)], [(5, a), (5, c)]),
        ([(4, a), (4, a), (9, a)], [(4, a)]),
        ([(None, a), (7, a), (None, b)], [(7, a), (None, b)]),
    ):
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS _h1", "1 AS _kept_id")
        out = simhash.drop_near_duplicates(df)
        assert out.columns == df.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(kept, key=repr)


def test_empty(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def plain_leaks(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").encode().lower())
        if w:
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = WORD.findall((t or "").encode().lower()), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    ids |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        names = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [decontaminate.BLOCK_WINDOWS, 100])
def test_leaks_of_the_tables(spark, sf, most):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(docs, bench, most=most).collect()), key=repr)
    assert got == plain_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d".split()), max_size=14), min_size=1, max_size=5), st.lists(st.sampled_from("a b c d".split()), max_size=60))
def test_wu_manber_is_brute_force(items, words):
    tables = decontaminate.build([(k, " ".join(w).encode()) for k, w in enumerate(items)])
    spans, found = decontaminate.search(tables, [w.encode() for w in words])
    (want,) = plain_leaks([(0, " ".join(words))], [(k, " ".join(w)) for k, w in enumerate(items)])
    assert (sum(b - a for a, b in spans), len(found)) == want[2:4]


def test_leaks_of_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "quick brown fox"), (2, None), (3, ""), (None, "lazy dog"), (1, "le chien"), (10, "Again")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    for most in (decontaminate.BLOCK_WINDOWS, 2):
        got = sorted((tuple(r) for r in decontaminate.decontaminate(odd_docs, bench, most=most).collect()), key=repr)
        assert got == plain_leaks([(r.doc_id, r.text) for r in odd_docs.collect()], items)
        assert decontaminate.keep_clean(odd_docs, bench, most=most).count() == 11 - sum(x[-1] for x in got)
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    none = decontaminate.decontaminate(odd_docs, bench.where("item_id = 77")).collect()
    assert len(none) == 11 and not any(r.contaminated for r in none)


def test_blocks_are_bounded_and_split_items(spark, sf):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(500))), (2, "a b"), (3, None)], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, most=100))
    sizes = [sum(max(1, len(raw.split()) - 9) for _, _, raw in b) for b in blocks]
    assert max(sizes) <= 100 and sum(sizes) == 492
    text = " ".join(f"w{k}" for k in range(90, 130))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "w90 w91")], "doc_id long, text string")
    for most in (100, 7):
        rows = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, bench, most=most).collect())
        assert rows == [(1, 40, 40, 1), (1, 40, 40, 1), (2, 2, 0, 0)]


def test_leaks_as_sql(spark, sf):
    from pathlib import Path

    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(sf) / name}.parquet'")
    want = con.execute(decontaminate.SQL).df()
    got = decontaminate.op8(spark, sf).toPandas()[list(want.columns)]
    order = lambda df: df.sort_values("doc_id").reset_index(drop=True)
    assert order(got).astype(object).equals(order(want).astype(object)) and got.contaminated.any()
