"""Exact de-duplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is first reduced to one row per digest (map-side
combine), then compared with the index by a sort-merge anti-join that does not shuffle the index, and what is new is
appended. An index row is (digest, keep_id, n); a digest met again in a later batch appends a row that only adds to n.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from navlytics.llm.shared import create, keep, new_folder, read

SPACE = r"[\x20\x09-\x0D]+"
#: The file beside an index's data that holds its number of buckets; Spark does not read names with an underscore.
_BUCKETS = "_buckets"
SCHEMA = "digest binary, keep_id bigint, n bigint"
#: A digest with more rows than this share of a batch, and over HOT_ROWS, is looked up by broadcast: at most 1/HOT_SHARE of them.
HOT_SHARE, HOT_ROWS = 1 / 1000, 1000


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256))


class DigestIndex:
    """``path`` names an existing or new index; without it the index gets a folder of its own below the shared folder.

    The number of buckets is part of the data, so a new index writes it beside them; an existing one is read with its own number, and
    asking for another one raises.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_folder(spark, "digests")
        self.buckets = self._recorded(buckets) if path else None
        if not self.buckets:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            with create(f"{self.path}/{_BUCKETS}") as f:
                f.write(str(self.buckets).encode())
        self.table = f"digests_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def _recorded(self, wanted: int | None) -> int | None:
        try:
            with read(f"{self.path}/{_BUCKETS}") as f:
                found = int(f.read())
        except FileNotFoundError:
            return None
        if wanted and wanted != found:
            raise ValueError(f"the index at {self.path} has {found} buckets, not {wanted}")
        return found

    def close(self) -> None:
        """Drop the catalog's entry; the index stays at its path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def state(self) -> DataFrame:
        """One row per digest; grouping needs no shuffle since the table is bucketed by it."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Index a batch; return (id, keep_id, group_size, kept, text_sha256) for each of its rows.

        keep_id is the smallest id of the first batch that held the text. Null texts equal empty ones. A null id never
        stays beside an id; a text that has only null ids gets keep_id null, and one of its rows stays. Of repeated rows
        with the same id and text one stays. An empty batch gives an empty table. Other columns are not read.
        """
        rows = keep(docs.select(F.col(id_col).alias("__id"), digest(F.col(text_col)).alias("digest"),
                                F.monotonically_increasing_id().alias("__row")), "digest-rows")
        groups = keep(rows.groupBy("digest").agg(
            F.min("__id").alias("keep_id"), F.count(F.lit(1)).alias("n"),
            F.min(F.struct(F.col("__id").isNull(), "__id", "__row"))["__row"].alias("__first")), "digest-groups")
        known = self.state().select("digest", F.col("keep_id").alias("__old"), F.col("n").alias("__before"))
        fresh = groups.join(known.hint("merge"), "digest", "left_anti").select("digest", "keep_id", "n")
        again = groups.join(known.hint("merge"), "digest").select("digest", F.col("__old").alias("keep_id"), "n")
        decided = keep(groups.join(known.hint("merge"), "digest", "left").select(
            "digest", F.when(F.col("__before").isNull(), F.col("keep_id")).otherwise(F.col("__old")).alias("keep_id"),
            (F.col("n") + F.coalesce("__before", F.lit(0))).alias("group_size"), "n",
            F.when(F.col("__before").isNull(), F.col("__first")).alias("__first")), "digest-decided")
        (fresh.unionByName(again).repartition(self.buckets, "digest").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table))
        total = groups.agg(F.sum("n")).first()[0] or 0
        hot = decided.where(F.col("n") > max(HOT_ROWS, int(total * HOT_SHARE)))
        light = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(decided, "digest")
        found = light.unionByName(rows.join(F.broadcast(hot), "digest"))
        return found.select(
            F.col("__id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("__row") == F.col("__first"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows that stay, with all their columns; see DigestIndex.add for ties, nulls and repeated rows."""
    marks = (index or DigestIndex(docs.sparkSession)).add(docs, id_col, text_col).where("kept").select(
        F.col(id_col).alias("__k"), F.unhex("text_sha256").alias("__d"))
    here = docs.withColumn("__t", digest(F.col(text_col)))
    stay = here.join(marks, F.col(id_col).eqNullSafe(F.col("__k")) & (F.col("__t") == F.col("__d")), "left_semi")
    return stay.dropDuplicates([id_col, "__t"]).select(*[F.col(f"`{c}`") for c in docs.columns])
