"""The pipeline's stages against brute force on a small corpus with odd rows."""

import random

import corpus_pipeline
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from navlytics.llm import exact_index
from tests.llm.test_search import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, keep_id long"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", F.lit("x").alias("digest"), F.lit(0.5).alias("score"), F.lit(1).cast("long").alias("keep_id"))
    rng = random.Random(4)
    texts = [r.text for r in docs.where("length(text) > 400").orderBy("doc_id").limit(12).collect()]
    rows = [(5000, None, "en", None, None), (5001, "", None, "s", 0), (5002, "12 34", "en", "s", 5), (5003, texts[0], "en", None, 1), (5003, texts[0], "en", None, 1),
            (5004, "  ".join(texts[1].split(" ")), None, "s", 1), (None, texts[2], "en", "s", 1)]
    for k, t in enumerate(texts[3:]):
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((5100 + k, " ".join(words), "en", "s", 1))
    return docs.unionByName(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).repartition(3)


def test_stages(spark, corpus):
    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    docs = corpus
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        after = stage(spark, docs, SF)
        if name == "packing":
            got = {}
            for r in after.collect():
                got.setdefault(r.doc_id, []).append(r)
            assert set(got) == {r.doc_id for r in before}
            for r in before:
                if r.doc_id is not None:
                    assert sum(p.length for p in got[r.doc_id]) == len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1
            return
        assert after.columns == docs.columns
        rows = after.collect()
        if name == "language":
            gone = {r.doc_id for r in before} - {r.doc_id for r in rows}
            assert gone == {5000, 5001, 5002}
        elif name == "exact_dedup":
            first = {}
            for r in before:
                key = " ".join((" " + r.text.replace("\n", " ") + " ").split())
                first.setdefault(key, []).append(r.doc_id)
            want = sorted(min((i for i in ids if i is not None), default=None) for ids in first.values())
            assert sorted(r.doc_id for r in rows) == want
        else:
            comp = brute([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(i for i, (_, c) in comp.items() if i == c)
        docs = after


def test_empty(spark, corpus):
    docs = corpus.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_index_over_batches(spark):
    index = exact_index.DigestIndex(spark, buckets=4)
    first = {r.doc_id: r for r in index.add(spark.createDataFrame([(7, "a  b"), (9, "a b"), (8, None), (None, "z")], "doc_id long, text string")).collect()}
    assert (first[9].keep_id, first[9].group_size, first[9].kept, first[7].kept, first[None].kept) == (7, 2, False, True, True)
    again = {r.doc_id: r for r in index.add(spark.createDataFrame([(1, "a b"), (2, ""), (3, "new"), (4, "new")], "doc_id long, text string")).collect()}
    assert [(again[i].keep_id, again[i].group_size, again[i].kept) for i in (1, 2, 3, 4)] == [(7, 3, False), (8, 2, False), (3, 2, True), (3, 2, False)]
    assert index.state().count() == 4 and index.add(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_few_hashes_of_words_are_remembered():
    """A worker keeps them through the stages that follow, beside the tokenizer of the last one."""
    from navlytics.llm import minhash

    seen = minhash._Words()
    hashes = [seen[b"%d" % i] for i in range(300_000)]
    assert len(seen) <= 100_001
    assert [seen[b"%d" % i] for i in range(300_000)] == hashes
