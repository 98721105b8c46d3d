"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from navlytics.llm import bpe, centroids, chat, exact_index, html_text, langid, merkle, minhash, packing, suffix_dedup, token_files, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_index.DigestIndex(spark).add(table(spark, sf_dir, "documents"))


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


@query()
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query(r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
        regexp_replace(text, '(\\|<turn |</turn>|### Assistant:|### User:|### System:|<\|endoftext\|>)', 'x\1', 'g') AS longer FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(length(longer) + length(role) + 16)::BIGINT AS formatted_chars,
        bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
                      WHEN before = 'user' THEN role = 'assistant' ELSE false END) AND arg_max(role, k) = 'assistant' AS valid
      FROM n GROUP BY conv_id)
SELECT * FROM c
""")
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chat(rows.unionByName(extra)))


@query()
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.scan(token_files.write(table(spark, sf_dir, "documents")))



@query()
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text"), model).withColumn("held_out", held_out)


@query("""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f
""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.index(warc.captures(manifest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query()
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def _cluster_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, any_value(x.v) AS v, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT),
  c := c.c)) AS m FROM x, c{r} c GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
f{r} AS (SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
g{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM f{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(g.v, o.v) AS v FROM c{r} o LEFT JOIN g{r} g ON g.c = o.c)""")
    return f"""
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM x) WHERE c < {k}),{','.join(steps)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(l.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} l ON l.c = m.c
"""


@query(_cluster_sql())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _merkle_sql(levels: int = 9) -> str:
    leaf = lambda text: " || ".join(
        f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    steps = []

    def build(name: str, by: str) -> None:
        for i in range(levels):
            steps.append(f"""
{name}{i + 1} AS MATERIALIZED (SELECT {by}, i // 8 AS i, CASE WHEN max(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d,
  (max(n) + 7) // 8 AS n FROM {name}{i} GROUP BY {by}, i // 8)""")

    def climb(name: str, tree: str, by: str, first: str) -> str:
        """Fold and proof of every leaf through one tree, by one join per level."""
        last = first
        for i in range(levels):
            steps.append(f"""
{name}{i + 1} AS MATERIALIZED (SELECT c.doc_id, any_value(c.leaf) AS leaf, any_value(c.g) AS g, any_value(c.i) // 8 AS i,
  CASE WHEN max(t.n) = 1 THEN any_value(c.fold) ELSE sha256(string_agg(CASE WHEN t.i = c.i THEN c.fold ELSE t.d END, '' ORDER BY t.i)) END AS fold,
  any_value(c.proof) || coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i <> c.i), '') AS proof
  FROM {last} c JOIN {tree}{i} t ON t.{by} = c.{'g' if by == 'g' else 'one'} AND t.i // 8 = c.i // 8 GROUP BY c.doc_id)""".replace(
                "any_value(c.g) AS g", "any_value(c.g) AS g, any_value(c.one) AS one"))
            last = f"{name}{i + 1}"
        return last

    build("t", "g")
    build("u", "one")
    up = climb("p", "t", "g", "p0")
    steps.append(f"""
q0 AS MATERIALIZED (SELECT doc_id, leaf, g, 0 AS one, g AS i, fold, proof FROM {up})""")
    end = climb("q", "u", "one", "q0")
    crc = ("list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT), "
           "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1))))")
    tampered = f"CASE WHEN xor({crc}, 4294967295::UBIGINT) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    # roots of single languages are at level `levels` of t; the tree over them starts from these
    body = ",".join(s for s in steps if s.strip().startswith("t")) + f""",
u0 AS MATERIALIZED (SELECT 0 AS one, g AS i, d, count(*) OVER () AS n FROM t{levels}),""" + ",".join(s for s in steps if not s.strip().startswith("t"))
    return f"""
WITH l AS MATERIALIZED (SELECT doc_id, sha256({leaf('text')}) AS leaf, sha256({leaf('(' + tampered + ')')}) AS seen,
  dense_rank() OVER (ORDER BY lang IS NOT NULL, lang) - 1 AS g, lang FROM documents),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
t0 AS MATERIALIZED (SELECT g, i, leaf AS d, n FROM n),
p0 AS MATERIALIZED (SELECT doc_id, leaf, g, 0 AS one, i, seen AS fold, '' AS proof FROM n),{body}
SELECT doc_id, leaf, t.d AS subroot, u.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.d AS verified
FROM {end} e JOIN t{levels} t ON t.g = e.g CROSS JOIN u{levels} u
"""


@query(_merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.lower_ascii(text)).otherwise(text)
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": tampered})


@query()
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
