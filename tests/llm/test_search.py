"""Archives, top-k search, components and near-duplicates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from navlytics.llm import minhash, topk, warc
from navlytics.llm.components import components


def test_loser_tree_merges_sorted_runs():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives(spark):
    long = "<html>" + "é" * 200
    rows = [(5, "http://www.A.org/x?Q=1#f", long, 1), (3, "https://a.org/x?q=1", long, 2), (9, None, long, 3), (1, "http://b.org/", "short", 4), (2, "http://b.org/", "short", 5),
            (7, "http://b.org/a b\n", None, 6), (8, "::bad[", "", 7), (None, "http://c.org", long, 8), (4, "http://d.org/\r\n\r\n", "x\r\n\r\ny" * 40, 9), (4, "http://d.org/2", "z" * 99, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_at int").repartition(3)
    got = warc.index(warc.captures(warc.write(pages))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [by[k][0].record_type for k in (3, 5, 9)] == ["response", "revisit", "revisit"] and by[5][0].refers_to == 3 and by[9][0].refers_to == 3
    assert by[5][0].payload_bytes == len(long.encode()) and by[5][0].payload_digest == by[3][0].payload_digest
    assert by[1][0].record_type == by[2][0].record_type == "response" and by[None][0].record_type == "response"
    assert by[7][0].payload_bytes == by[8][0].payload_bytes == 0 and sorted(r.payload_bytes for r in by[4]) == [99, 240]
    order = [(r.url_key, r.captured) for r in sorted(got, key=lambda r: (r.range_no, r.place_in_range))]
    assert order == sorted(order) and warc.url_key("http://www.A.org/x?Q=1#f") == "org,a)/x?q=1"
    assert warc.index(warc.captures(warc.write(pages.limit(0)))).count() == 0


@pytest.mark.parametrize("kind", ["even", "skewed"])
def test_topk(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 12)) * (rng.lognormal(0, 1.5, size=(700, 1)) if kind == "skewed" else 1)
    x[100:140] = x[100]
    rows = [(i, [float(a) for a in v], "clash") for i, v in enumerate(x)]
    rows += [(700, None, "c"), (701, [None] * 12, "c"), (702, [float("nan")] * 12, "c"), (703, [float("inf")] * 12, "c"), (None, [1.0] * 12, "c"), (704, [0.0] * 12, "c"), (750, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.search(df, F.col("vec_id") % 50 == 0, 5, bucket_rows=64, query_rows=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = {i: np.floor(256 * x[i]).astype(int) for i in range(700)} | {704: np.zeros(12, int)}
    for q in (i for i in v if i % 50 == 0):
        want = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:5]
        assert sorted(got[q]) == [(k + 1, c, -s) for k, (s, c) in enumerate(want)]
    assert set(got) == {i for i in v if i % 50 == 0}
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_components_of_random_links(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1150)] + [(5, 5), (None, 3)]
    rng.shuffle(links)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7), "a", "b").collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def brute(texts, words, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + min(words, len(w))]) for k in range(len(w) - min(words, len(w)) + 1)} if w else set()
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    rng = random.Random(words)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n\t", "One", "one", "ONE two", "one two", "É x", "é x"]
    for n in (30, 60, 90, 200):
        for _ in range(5):
            base = [rng.choice(vocab) for _ in range(n)]
            texts.append(" ".join(base))
            chain = list(base)
            for _ in range(9):  # chains that drift away from their beginning
                chain[rng.randrange(n)] = rng.choice(vocab)
                if n > 60:
                    chain[rng.randrange(n)] = rng.choice(vocab)
                texts.append(" ".join(chain))
            texts += [" ".join(base).upper(), "  ".join(base)]
    template = [rng.choice(vocab) for _ in range(80)]
    for _ in range(40):  # much in common, but not enough
        texts.append(" ".join(template[:60] + [rng.choice(vocab) for _ in range(20)]))
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a long, component_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, words, percent).collect()}
    assert got == brute([(i, t) for i, t, _, _ in rows], words, percent)
    assert minhash.near_duplicates(df.limit(0), words, percent).count() == 0


@pytest.mark.parametrize("batch", [40, 10**6])
def test_components(spark, batch):
    """Chains, rings and stars over many tasks or one; loops, repeated links and nulls."""
    pairs = [(i, i + 1) for i in range(100, 170)] + [(300 + i, 300 + (i + 1) % 20) for i in range(20)] + [(500, 500 - i) for i in range(1, 40)]
    df = spark.createDataFrame(pairs + pairs[:9] + [(7, 7), (None, 8), (8, None)], "a long, b long").repartition(6)
    got = {r.node: r.component for r in components(df, "a", "b", batch).collect()}
    want = {i: 100 for i in range(101, 171)} | {i: 300 for i in range(301, 320)} | {i: 461 for i in range(462, 501)}
    assert got == want
    assert components(df.limit(0), "a", "b", batch).count() == 0


@pytest.mark.parametrize("small", [2, 32])
def test_crowded_buckets(spark, small):
    """Many near copies of one text, some linked only over others and many with none, and rows that share an id."""
    rng = random.Random(small)
    vocab = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(260):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 5, 6, 7])):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        if i % 9 == 0:
            t = t[:rng.randrange(95, 120)]
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 3, 85, small=small).collect()}
    assert got == brute(rows, 3, 85)
    twice = df.unionByName(spark.createDataFrame([(0, rows[1][1])], "doc_id long, text string"))
    assert minhash.near_duplicates(twice, 3, 85, small=small).where("doc_id = 0").count() == 2


def test_signatures_estimate_similarity_and_fill_every_place():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [base[:200], base[50:250], base[:1], base[:0], base]
    sig = minhash.signatures(sets, 192)
    assert np.isfinite(sig[:3].view(float)).all() and np.isinf(sig[3].view(float)).all()
    assert abs((sig[0] == sig[1]).mean() - 150 / 250) < 0.12
    # chunks of the elements do not change the result
    assert (minhash.signatures(sets, 192, chunk=37) == sig).all()
