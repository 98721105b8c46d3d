"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HEAVY_SHARE = 1.0 / 1000


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """Keys holding more than ``share`` of the rows; there can be at most 1/share of them."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c"), F.max("__c")).first()
    if not total[0] or total[1] <= max(1000.0, total[0] * share):
        return []
    return [r[0] for r in counts.where(F.col("__c") > max(1000.0, total[0] * share)).select(key).collect()]


def salted_lookup(big: DataFrame, lookup: DataFrame, key: str, how: str = "inner", heavy: list | None = None,
                  salts: int = 64, also: tuple[str, ...] = ()) -> DataFrame:
    """Equi-join a large frame with a one-row-per-key lookup, spreading heavy keys over salts.

    ``also`` names further join columns, for keys that are hashes.
    Rows of heavy keys get a salt from their own content; only the heavy lookup rows (at most
    1/HEAVY_SHARE of them) are repeated once per salt.
    """
    heavy = heavy_keys(big, key) if heavy is None else heavy
    if not heavy:
        return big.join(lookup, [key, *also], how)
    hot = F.col(key).isin(heavy)
    salt = F.when(hot, F.pmod(F.xxhash64(*big.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    reps = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return (
        big.withColumn("__salt", salt)
        .join(lookup.withColumn("__salt", F.explode(reps)), [key, *also, "__salt"], how)
        .drop("__salt")
    )
