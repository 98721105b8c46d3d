"""Clustering, manifests and repeated passages against plain versions, with the cases that tables bring along."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from navlytics.llm import centroids, exact_index, merkle, suffix_dedup


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


# ---- clustering -------------------------------------------------------------------------------

def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (sha(f"2:{r[0]}"), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [(i, *near(v)) for i, v in kept]
    spread = [sum(d for _, d, o in final if o == j) for j in range(len(c))]
    return sorted((i, o, d, spread[o], sum(spread), sha(",".join(map(str, c[o])))) for i, d, o in final)


def test_clusters_equal_the_plain_version(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-0.5, 0.25, rnd.uniform(-1, 1)]) for _ in range(4)]) for i in range(90)]
    rows += [(7, rows[7][1]), (200, [1.0, None, 0.0, 0.0]), (201, [1.0, float("nan"), 0.0, 0.0]), (202, [float("inf")] * 4), (203, None), (204, [1.0] * 3), (205, [0.0] * 4)]
    rows += [(300 + i, [0.1, 0.2, 0.3, 0.4]) for i in range(60)]  # a hot vector
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    got = centroids.cluster(df, k=6, rounds=3, dims=4)
    assert sorted(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == plain_clusters(exact, 6, 3, 4)
    few = centroids.cluster(df.where("vec_id in (1, 2)"), k=6, rounds=2, dims=4)
    assert {(r.cluster, r.distance) for r in few.collect()} == {(0, 0), (1, 0)}
    assert centroids.cluster(df.limit(0), k=6, dims=4).count() == 0
    with pytest.raises(Exception, match="overflow"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>"), dims=4)


# ---- manifest ---------------------------------------------------------------------------------

def plain_manifest(rows):
    """Rows (id, lang, text); every third id is lower-cased."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, g, t: sha(enc(i) + enc(g) + enc(t))

    def climb(levels, at, fold, proof):
        for lv in levels[:-1]:
            s = at // 8 * 8
            run = lv[s : s + 8]
            proof += "".join(x for k, x in enumerate(run) if s + k != at)
            fold = sha("".join(fold if s + k == at else x for k, x in enumerate(run)))
            at //= 8
        return fold, proof

    def tree(lv):
        out = [lv]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    groups = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g in groups}
    trees = {g: tree([leaf(*r) for r in order[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    root, out = top[-1][0], []
    for n, g in enumerate(groups):
        for at, (i, _, t) in enumerate(order[g]):
            seen = leaf(i, g, t.lower() if t is not None and i is not None and i % 3 == 0 else t)
            fold, proof = climb(top, n, *climb(trees[g], at, seen, ""))
            out.append((i, leaf(i, g, t), trees[g][-1][0], root, sha(proof), fold, fold == root))
    return sorted(out, key=str)


def manifest(df):
    seen = F.when(F.col("doc_id") % 3 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.manifest(df, ["doc_id", "lang", "text"], "lang", "doc_id", {"text": seen}).collect()), key=str)


def test_manifest_equals_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SHARE", 4)  # light and heavy nodes even here
    rows = [(i, "en", f"Text {i}") for i in range(70)] + [(100 + i, "de", f"Text {i}") for i in range(9)] + [(200, "one", "Alone"), (201, None, "No language"), (202, None, None)]
    rows += [(300 + i, f"l{i}", "UP") for i in range(9)] + [(5, "en", "same id"), (5, "en", "same id"), (None, "en", "Null id"), (64, "en", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, text string, level string")
    assert manifest(df) == plain_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    schema = "doc_id long, lang string, text string"
    assert manifest(spark.createDataFrame([(3, None, "ABC")], schema)) == plain_manifest([(3, None, "ABC")])
    assert manifest(spark.createDataFrame([], schema)) == []


# ---- repeated passages ------------------------------------------------------------------------

def plain_removal(rows, depth=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - depth + 1 if i is not None else 0):
            first[b[p : p + depth]] = min(i, first.get(b[p : p + depth], i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1 if i is not None else 0):
            if first[b[p : p + depth]] < i:
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), sha(kept)))
    return sorted(out, key=str)


def removal(df, **limits):
    got = suffix_dedup.remove_repeats(df, **limits)
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got.select("kept", "kept_sha256").collect())
    return sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def documents():
    rnd = random.Random(5)
    text = lambda n, abc="abcdé fgh": "".join(rnd.choice(abc) for _ in range(n))
    shared, line = text(180), text(70)
    rows = [(40 - i, text(rnd.randint(0, 120)) + shared[rnd.randint(0, 60) :] + text(30)) for i in range(12)]
    rows += [(100 + i, text(40) + line + text(40)) for i in range(40)]  # a line that many documents share
    rows += [(200, None), (201, ""), (202, "x" * 300), (203, "x" * 120), (204, "ab" * 90), (3, rows[0][1]), (3, rows[0][1]), (None, shared), (205, text(49)), (206, rows[0][1])]
    rows += [(300, text(50)), (301, "")]
    rows.append((302, rows[-2][1]))
    rows.append((303, text(9000, "ab") + shared))  # a long one
    return rows


def test_removal_equals_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, block string")
    assert removal(df) == plain_removal(rows)
    assert removal(df.limit(0)) == []


def test_removal_with_cut_anchors_small_blocks_and_files(spark):
    """The same with every limit so low that it takes effect."""
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removal(df, hot=3, block=600, batch=16, file_bytes=100) == plain_removal(rows)


def test_transform_orders_all_suffixes(tmp_path):
    import numpy as np

    texts = [b"banana", b"ananas", b"nab", b"banana", b"a"]
    n = np.array([len(x) for x in texts])
    m = np.array([list(x.ljust(6, b"\0")) for x in texts], np.uint8)
    place, border = suffix_dedup.insert_columns(m, n, 3, suffix_dedup.Files(str(tmp_path), 4))
    suffixes = sorted((x[len(x) - r :], i, r) for i, x in enumerate(texts) for r in range(len(x) + 1))
    order = sorted((place[i, r], x, i, r) for x, i, r in suffixes)
    assert [o[0] for o in order] == list(range(len(suffixes))) and [o[1] for o in order] == [s[0] for s in suffixes]
    for (_, x, *_), (at, y, *_) in zip(order, order[1:]):
        assert border[at] == (not (len(x) >= 3 and len(y) >= 3 and x[:3] == y[:3]))


# ---- digest index -----------------------------------------------------------------------------

def test_an_index_keeps_all_rows_when_opened_again(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    first = exact_index.DigestIndex(spark, path, 8)
    first.add(df).collect()
    first.close()
    again = exact_index.DigestIndex(spark, path)
    assert again.buckets == 8 and again.state().count() == 40
    assert again.add(df).where("kept").count() == 0
    with pytest.raises(ValueError, match="8 buckets"):
        exact_index.DigestIndex(spark, path, 4)
