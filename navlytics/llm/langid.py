"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams. Each language has several centroids, clustered from a
bounded sample of labelled rows. A text gets the language of the centroid with the greatest cosine; one that lies much
further from it than labelled texts of its length ever do is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from navlytics.llm.shared import keep

#: Dimensions of the hashed space and the n-gram sizes.
DIMS, GRAMS = 4096, (1, 2, 3)
#: Labelled rows per language that the model is fitted on: those with the least hash of their id. Bounds the fit at any corpus size.
SAMPLE = 600
#: Centroids per language, rounds of the clustering.
CLUSTERS, ROUNDS = 4, 10
#: A text is rejected at a distance (1 - cosine) beyond the greatest of the sample's texts of its length plus this share of what lacks to 1.
REJECT = 0.5
#: Texts of fewer letters than this are rejected only beyond this distance: they have too few n-grams to lie near anything.
SHORT, SHORT_LIMIT = 64, 0.95
#: Length classes (letters) of the rejection limits.
LENGTHS = (8, 16, 32, 64, 128, 256, 1024)
UNKNOWN = "und"


def counts(text: str, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, int]:
    """(n-gram slots, counts, letters) of a text: lower case, what is no letter counts as one space, words padded by spaces.

    The slots come from a fixed hash of the code points, so they are the same on every executor. A whole text is taken in
    pieces of at most ``step`` code points, cut after a space where there is one, since lower case can depend on the rest of the
    word. A run of spaces across a cut is one space, and n-grams across a cut are counted, so the result does not depend on ``step``.
    """
    total, letters, tail, at = np.zeros(DIMS, np.int64), 0, np.zeros(0, np.uint32), 0
    pad, none = np.array([32], np.uint32), np.zeros(0, np.uint32)
    while at < len(text):
        end = at + step
        if end < len(text):
            end = text.rfind(" ", at, end) + 1 or end
        c = np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = _letter(c)
        letters += int(ok.sum())
        c = np.concatenate([tail if at else pad, np.where(ok, c, np.uint32(32)), pad if end >= len(text) else none])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        new = len(c) - len(tail)  # the tail has no two spaces, so all of it is still there
        h = np.zeros(len(c), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if len(c) < n:
                break
            h = (h[:len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[n - 1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            if n in GRAMS:
                slot = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - DIMS.bit_length() + 1)
                total += np.bincount(slot[max(0, len(slot) - new):].astype(np.int64), minlength=DIMS)
        tail, at = c[-(max(GRAMS) - 1):], end
    slots = np.flatnonzero(total)
    return slots, total[slots], letters


_LETTERS: np.ndarray | None = None


def _letter(c: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS[c]


def _weigh(slots: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = np.sqrt(n) * idf[slots]  # under the root, the direction settles as a text grows
    norm = np.sqrt((w * w).sum())
    return w / norm if norm else w


@dataclass(frozen=True)
class Model:
    """languages[i] is the language of row i of centroids; limits by (language, length class), as the sample shows them."""

    languages: tuple[str, ...]
    centroids: np.ndarray
    idf: np.ndarray
    limits: dict[str, np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine from 0 to 1, rejected). Null and texts without a letter: und, 0, rejected."""
        slots, n, letters = counts(text or "")
        if not letters or not self.languages:
            return UNKNOWN, 0.0, True
        cos = self.centroids[:, slots] @ _weigh(slots, n, self.idf)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        lang = self.languages[best]
        return lang, score, 1 - score > self.limits[lang][np.searchsorted(LENGTHS, letters)]


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; begins with the row nearest the mean and then the rows furthest from all centres."""
    centres = [x[np.argmax(x @ x.mean(axis=0))]]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[np.argmin(near)])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                m = x[own == i].mean(axis=0)
                c[i] = m / max(np.sqrt(m @ m), 1e-12)
    return c


def fit(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` rows per language of those that are ``labelled`` and have a language.

    Only sparse vectors of the sample and the finished centroids leave the executors: at most CLUSTERS * DIMS numbers per language reach
    the driver. Rows with the same id are ordered by text. Languages without a letter in their sample are not learned.
    """
    rows = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    # the sample is the start of the hash order; a bound on the hash from the language's row count leaves few more rows than it to be ranked
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    near = rows.join(sizes, "lang").where(F.col("h").cast("double") <= (F.lit(1.5 * sample + 100) / F.col("size") - 0.5) * 2.0**64).drop("size")
    slim = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", F.xxhash64("text")))).where(F.col("k") <= sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counts(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s.tolist() for s, _, _ in got], pa.list_(pa.int32())), pa.array([n.tolist() for _, n, _ in got], pa.list_(pa.int64())),
                 pa.array([x for _, _, x in got], pa.int64())], ["lang", "slots", "n", "letters"])

    drawn = keep(slim.select("lang", "text").mapInArrow(vectors, "lang string, slots array<int>, n array<long>, letters long").where("letters > 0"), "language-sample")
    total = drawn.count()
    seen = np.zeros(DIMS)
    for r in drawn.select(F.explode("slots").alias("s")).groupBy("s").count().collect():  # DIMS rows at most
        seen[r["s"]] = r["count"]
    idf = np.log((1 + total) / (1 + seen)) + 1

    def learn(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("letters", kind="stable")
        x = np.zeros((len(df), DIMS), np.float32)
        for i, (s, n) in enumerate(zip(df["slots"], df["n"])):
            x[i, s] = _weigh(np.asarray(s), np.asarray(n), idf)
        # the number of texts that a cosine says something about grows with their length, so longer ones shape the centroids
        long = x[df["letters"].to_numpy() >= np.quantile(df["letters"], 0.25)]
        c = _clusters(long, CLUSTERS)
        far = 1 - np.max(x @ c.T, axis=1)
        cls = np.searchsorted(LENGTHS, df["letters"].to_numpy())
        limits = np.full(len(LENGTHS) + 1, np.nan)
        for k in range(len(limits)):
            if (cls == k).sum() >= 5:
                limits[k] = far[cls == k].max()
        # a class with few texts takes the limit of the next longer one, widened step by step as short texts scatter more
        for k in range(len(limits) - 1, -1, -1):
            if np.isnan(limits[k]):
                limits[k] = far.max() if k == len(limits) - 1 else limits[k + 1]
        limits = np.maximum.accumulate(limits[::-1])[::-1]
        return pd.DataFrame({"lang": [df["lang"].iloc[0]], "c": [c.astype("<f4").tobytes()], "limits": [limits.tolist()]})

    made = sorted(drawn.groupBy("lang").applyInPandas(learn, "lang string, c binary, limits array<double>").collect(), key=lambda r: r["lang"])
    parts = [np.frombuffer(r["c"], "<f4").reshape(-1, DIMS) for r in made]
    names = tuple(r["lang"] for r, p in zip(made, parts) for _ in p)
    limits = {r["lang"]: (far := np.minimum(1.0, np.array(r["limits"]))) + REJECT * (1 - far) for r in made}
    for x in limits.values():
        x[:LENGTHS.index(SHORT) + 1] = SHORT_LIMIT
    return Model(names, np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32), idf, limits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row, from the text alone. An empty table gives an empty one; repeated rows and null ids are kept."""
    share = docs.sparkSession.sparkContext.broadcast(model)  # CLUSTERS * DIMS numbers per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for b in batches:
            lang, score, out = zip(*(m.predict(t) for t in b.column(1).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                                             [id_col, "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(
        run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text the model does not reject, with all their columns."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for b in batches:
            yield b.filter(pa.array([not m.predict(t)[2] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
