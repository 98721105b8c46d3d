"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find.

A document is the set of its word shingles. Equal sets are one class first, so copies cost nothing further. Each class
gets a SuperMinHash signature; classes that agree in a band are compared, first by signatures, then on their full sets.

No bucket is turned into all its pairs. First each bucket's least id is compared with its other members. Then a bucket is done when its
members are all in one component. Of the others, those of at most SMALL members compare their members across components. Larger ones count
the shingles of their members: a shingle of at most RARE of them is rare. Two members are linked only if they share a rare shingle, so
that an index of the rare ones finds them, or if what they hold beside rare shingles (their room) is enough for a link. So members whose room is too
small are done without a comparison, the member of most room serves as hub first, then several, and what is then left in different components is
compared if room and sizes allow a link. All of it is exact for members of a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from navlytics.llm.components import components
from navlytics.llm.shared import keep

#: Words of a shingle, links from 100 * intersection >= percent * union on, bands and rows of the signature.
#: At a similarity of 0.85, 32 bands of 6 rows miss a pair with probability 3e-7; at 0.8, 38 bands of 5 miss 3e-7.
BANDING = {85: (32, 6), 80: (38, 5)}
#: Pairs whose signatures agree in fewer places than a similarity this many standard errors below the limit are not verified.
ERRORS = 5.0
#: Members of a bucket up to which all are compared across components; members up to which a shingle is rare; hubs of the third round.
SMALL, RARE, HUBS = 32, 64, 16
#: Sizes of sets within this ratio are one size class.
CLASS = 1.02
#: Rows of a task after a shuffle, by what they carry: ids, signatures, pairs with signatures, texts. Small rounds then need few tasks.
ID_ROWS, SIGNED_ROWS, SIGNED_PAIRS, TEXT_ROWS = 50_000, 8192, 8192, 1024
_SEEN_WORDS = 100_000


class _Words(dict):
    """64-bit hashes of words; starts anew when it has grown large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > _SEEN_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Words()
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``words`` words; fewer words are one shingle; no words, none.

    A-Z become lower case; words are what lies between the characters 0x20 and 0x09 to 0x0D.
    """
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = _mix(out * _M[0] + h[k:len(h) - n + 1 + k])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int, chunk: int = 1 << 15) -> np.ndarray:
    """SuperMinHash signatures (rows of 64-bit hashes of m places) of many sets at once.

    Element i has a random permutation of the m places; at step j it offers the value j + u, u in [0, 1), to its j-th place, and a
    place keeps its least offer. A set is done after step j once no place holds more than j + 1: later offers are larger. Elements of
    all sets take their steps together; those of finished sets leave. Permutations are drawn step by step (Fisher-Yates).
    """
    best = np.full((len(sets), m), np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seeds = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for a in range(0, len(seeds), chunk):
        _offer(best, owner[a:a + chunk], seeds[a:a + chunk], m)
    # a place's value is unique to its element; its bits serve as the hash, places are told apart by their position
    return best.view(np.uint64)


def _offer(best: np.ndarray, own: np.ndarray, seed: np.ndarray, m: int) -> None:
    flat = best.reshape(-1)
    rows = np.arange(len(seed))
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(seed), 1))
    for j in range(m):
        r = _mix(seed + np.uint64((j + 1) * int(_M[0]) & 0xFFFFFFFFFFFFFFFF))
        u = (r >> np.uint64(11)) * 2.0**-53
        k = j + ((r & np.uint64(0x7FFFFFFF)) * np.uint64(m - j) >> np.uint64(31)).astype(np.int64)
        place = perm[rows, k].astype(np.int64)
        perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, own * m + place, u + j)
        if j + 1 < m:
            first, last = own[0], own[-1] + 1
            open_ = best[first:last].max(axis=1) > j + 1
            if not open_.all():
                stay = open_[own - first]
                if not stay.any():
                    return
                own, seed, perm = own[stay], seed[stay], perm[stay]
                rows = np.arange(len(seed))


def _few(df: DataFrame, rows: int, each: int) -> DataFrame:
    """At most as many tasks as ``rows``, a bound of what is dealt to them, asks for; all rows pass, and shuffle partitions stay the upper limit."""
    return df.coalesce(max(1, -(-rows // each)))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _classes(docs: DataFrame, words: int, m: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, digest of the set, its first 8 bytes as a number, signature) per row."""
    schema = "id long, n_shingles long, digest binary, key long, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                sig = signatures(sets, m)
                # 32 bits of each place are enough to compare: a chance agreement has a probability of 2^-32
                low = _mix(sig.reshape(-1)).astype(np.uint32).reshape(len(sets), m)
                digests = [_digest(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                    pa.array([_key(d) if d else None for d in digests], pa.int64()),
                    pa.array([low[i].tobytes() if len(s) else None for i, s in enumerate(sets)], pa.binary())], ["id", "n_shingles", "digest", "key", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band and hash in one number, id) per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, bands, rows)
                h = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (b.num_rows, 1))
                for k in range(rows):
                    h = _mix(h * _M[0] + sig[:, :, k])
                yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), bands))], ["bucket", "id"])

    return classes.select("id", "signature").mapInArrow(run, "bucket long, id long")


def _agree(pairs: DataFrame, classes: DataFrame, places: int, least: float) -> DataFrame:
    """The pairs whose signatures agree in at least ``least`` places."""
    s = classes.select("id", "signature")
    p = pairs.join(s.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    p = p.join(s.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, places) for c in (2, 3))
                ok = (x == y).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    return _few(p.select("a", "b", "sa", "sb"), pairs.count(), SIGNED_PAIRS).mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are linked, by their full sets. Only texts of pairs are kept; a pair's two meet by joins on ids, which AQE may split."""
    named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    n = pairs.count()
    named = keep(_few(named, 2 * n, ID_ROWS), "named")
    texts = keep(_few(texts.join(named, "id", "left_semi").dropDuplicates(["id", "text"]), 2 * n, TEXT_ROWS), "texts")
    p = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = None, None
        for b in batches:
            ok = []
            for a, ta, tb in zip(*(b.column(c).to_pylist() for c in (0, 2, 3))):
                if a != last:
                    last, s = a, shingles(ta, words)
                t = shingles(tb, words)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _few(p.select("a", "b", "ta", "tb"), n, TEXT_ROWS).mapInArrow(run, "a long, b long")


def _shingle_rows(texts: DataFrame, words: int) -> DataFrame:
    """(key of the set, shingle) for every shingle of (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(1).to_pylist():
                s = shingles(text, words)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), _key(_digest(s)))), pa.array(s.view(np.int64))], ["key", "shingle"])

    return texts.select("id", "text").mapInArrow(run, "key long, shingle long")


def _may_link(percent: int, room_a: str, room_b: str, n_a: str, n_b: str):
    """Whether an intersection of the smaller room is enough for sets of these sizes."""
    return (100 + percent) * F.least(room_a, room_b) >= percent * (F.col(n_a) + F.col(n_b))


def _rooms(crowd: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rooms and an index of the members (id, c) of crowded buckets: (id, c, key, n, room), and pairs (a, b) that share a rare shingle.

    The index takes the rarest shingles of a set, so many that sets without one of them in common can't be linked.
    """
    members = crowd.count()
    crowd_texts = keep(_few(texts.join(crowd.select("id"), "id", "left_semi").dropDuplicates(["id", "text"]), members, TEXT_ROWS), "crowd-texts")
    rows = keep(_shingle_rows(crowd_texts, words), "crowd-shingles")
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= RARE)
    n = rows.count()
    rare = keep(_few(rows.join(counts, "shingle").dropDuplicates(["key", "shingle"]), n, ID_ROWS), "rare")
    size = classes.select("id", "key", F.col("n_shingles").alias("n")).join(crowd, "id")
    of_set = rare.groupBy("key").agg(F.count(F.lit(1)).alias("n_rare"))
    room = F.col("n") - F.coalesce("n_rare", F.lit(0))
    rooms = keep(_few(size.join(of_set, "key", "left").select("id", "c", "key", "n", room.alias("room")), members, ID_ROWS), "rooms")
    rank = F.row_number().over(W.partitionBy("id", "key").orderBy("df", "shingle"))
    first = rare.join(rooms, "key").withColumn("rank", rank).where(F.col("rank") <= F.floor(F.col("n") * (100 - percent) / 100) + 1)
    first = keep(_few(first.where("df > 1").select("shingle", "id", "c", "n"), n, ID_ROWS), "rarest")
    a, b = (first.select("shingle", *(F.col(x).alias(x + y) for x in ("id", "c", "n"))) for y in "ab")
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    found = a.join(b, "shingle").where((F.col("ida") < F.col("idb")) & (F.col("ca") != F.col("cb")) & fits)
    return rooms, found.select(F.col("ida").alias("a"), F.col("idb").alias("b"))


def _open(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the links, and (bucket, id, c, n, main) of the buckets with members in several components, the largest being main."""
    comp, rows = components(links, "a", "b"), members.count()
    now = members.join(comp.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    now = keep(_few(now, rows, ID_ROWS), "open")
    size = now.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    many = size.groupBy("bucket").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.max(F.struct("n", "c"))["c"].alias("main")).where("groups > 1")
    return comp, keep(_few(now.join(many.drop("groups"), "bucket").select("bucket", "id", "c", "n", "main"), rows, ID_ROWS), "left")


def _hubs(members: DataFrame, by: list[str]) -> DataFrame:
    """The member of most room, of these the least id, in each group."""
    top = members.groupBy(*by).agg(F.max(F.struct("room", (-F.col("id")).alias("id"), "c", "set")).alias("t"))
    return top.select("bucket", (-F.col("t.id")).alias("id"), "t.c", "t.set", "t.room")


def _size_class(n):
    return F.floor(F.log(n.cast("double")) / float(np.log(CLASS)))


def _cross(a: DataFrame, b: DataFrame, on: list[str], percent: int | None = None) -> DataFrame:
    """Pairs of rows with equal ``on`` and different components; with a limit, those whose rooms allow a link."""
    other = b.select(*on, *(F.col(x).alias(x + "2") for x in b.columns if x not in on))
    p = a.join(other, on).where(F.col("c") != F.col("c2"))
    if a is b:
        p = p.where("id < id2")
    if percent is not None:
        p = p.where(_may_link(percent, "room", "room2", "set", "set2"))
    return p.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    bands: int | None = None, rows: int | None = None, small: int = SMALL) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; component_id is the smallest id reachable over links.

    Null texts and texts without a word have no shingle and no link. Rows with a null id get component_id null and kept true
    and take no part. Rows that share an id are one node,
    linked by whichever of their texts links. Links are missed only with the probability stated at BANDING. An empty table gives an empty one; other columns are not read.
    """
    base_bands, base_rows = BANDING.get(percent, (38, 5))
    bands, rows = bands or base_bands, rows or base_rows
    m, s = bands * rows, percent / 100
    least = m * (s - ERRORS * np.sqrt(s * (1 - s) / m))
    all_rows = keep(_classes(docs, words, m, id_col, text_col), "signatures")
    member = all_rows.where("digest is not null and id is not null")
    n = all_rows.count()
    classes = member.groupBy("digest").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n_shingles", "key", "signature")))
    classes = keep(_few(classes, n, SIGNED_ROWS), "classes")
    # a bucket's only member needs no comparison; of each bucket the rest is kept, with the least id, which leads the first round
    entries = _buckets(classes, bands, rows)
    lead = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).where("n > 1").drop("n")
    open_ = keep(_few(entries.join(lead, "bucket").select("bucket", "id", "a"), n * bands, ID_ROWS), "buckets")
    active = keep(_few(classes.select("id", "signature").join(open_.select("id").distinct(), "id", "left_semi"), n, SIGNED_ROWS), "active")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    led = open_.where("a < id").select("a", F.col("id").alias("b")).distinct()
    pairs = seen = keep(_few(led, open_.count(), ID_ROWS), "pairs")
    open_ = open_.select("bucket", "id")
    links = keep(_verify(keep(_agree(pairs, active, m, least), "candidates"), texts, words, percent), "links")

    def compare(new: DataFrame) -> None:
        nonlocal seen, links
        new = keep(new.distinct().join(seen, ["a", "b"], "left_anti"), "pairs")
        seen = seen.unionByName(new)
        found = keep(_agree(new, active, m, least), "candidates")
        if not found.isEmpty():
            links = links.unionByName(keep(_verify(found, texts, words, percent), "links"))

    comp, left = _open(open_, links)
    if not left.isEmpty():
        few, many = left.where(F.col("n") <= small).select("bucket", "id", "c"), left.where(F.col("n") > small)
        crowd = keep(many.select("id", "c").distinct(), "crowd")
        crowded = not crowd.isEmpty()
        new = _cross(few, few, ["bucket"])
        if crowded:
            rooms, indexed = _rooms(crowd, classes, texts, words, percent)
            rooms = rooms.select("id", F.col("n").alias("set"), "room")
            many = keep(_few(many.select("bucket", "id", "c").join(rooms, "id"), left.count(), ID_ROWS), "many")
            new = new.unionByName(_cross(_hubs(many, ["bucket"]), many, ["bucket"], percent)).unionByName(indexed)
        compare(new)
        comp, left = _open(many.select("bucket", "id").distinct(), links) if crowded else (components(links, "a", "b"), None)
        if crowded and not left.isEmpty():
            many = keep(_few(left.drop("n").join(rooms, "id"), left.count(), ID_ROWS), "many")
            core = _hubs(many.where("c = main").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(HUBS))), ["bucket", "part"])
            compare(_cross(core, many.where("c <> main"), ["bucket"], percent))
            comp, left = _open(many.select("bucket", "id").distinct(), links)
            many = keep(_few(left.drop("n").join(rooms, "id"), left.count(), ID_ROWS), "many")
            # an outsider's partners: not smaller than a link allows, and not larger than its room allows
            high = F.least(F.floor(F.col("room") * (100 + percent) / percent) - F.col("set"), F.floor(F.col("set") * 100 / percent))
            low = F.ceil(F.col("set") * percent / 100)
            at = many.withColumn("class", _size_class(F.col("set"))).drop("main")
            out = many.where((F.col("c") != F.col("main")) & (high >= low)).withColumn("class", F.explode(F.sequence(_size_class(low), _size_class(high)))).drop("main")
            compare(_cross(keep(out, "outsiders"), at, ["bucket", "class"], percent))
            comp = components(links, "a", "b")
    of_class = classes.select("digest", "id").join(comp, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("c"))
    return _name(all_rows, of_class, n, id_col)


def _name(all_rows: DataFrame, of_class: DataFrame, n: int, id_col: str) -> DataFrame:
    """A component per row. Large classes are looked up by broadcast: there are at most 1000 with over a thousandth of the rows."""
    big = all_rows.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1000, n // 1000)).select("digest")
    hot = keep(of_class.join(big, "digest"), "large-classes")
    rows = all_rows.select("id", "n_shingles", "digest")
    light = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(of_class, "digest", "left")
    both = light.unionByName(rows.join(F.broadcast(hot), "digest"))
    c = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return both.select(F.col("id").alias(id_col), "n_shingles", c.alias("component_id"), F.coalesce(F.col("id") == c, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the row with the smallest id. Rows without id stay."""
    gone = near_duplicates(docs, words, percent, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).cast("long").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
