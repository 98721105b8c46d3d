"""Exact percentiles and trimmed statistics without per-group value buffers.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer.  These
operators use the approximate sketch only to bracket the wanted ranks; a second pass counts what
lies below the bracket and ranks just the values inside it, so results stay exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from navlytics.operators.skew import HEAVY_SHARE, salted_lookup
from navlytics.session import written

ACCURACY = 10_000
_SMALL = ACCURACY


def _join(df: DataFrame, stats: DataFrame, by: Sequence[str], hot: Sequence = ()) -> DataFrame:
    if not hot:
        return df.join(stats, list(by))
    key = F.xxhash64(*by)
    return salted_lookup(df.withColumn("__g", key), stats.withColumn("__g", key), "__g", heavy=list(hot), also=tuple(by)).drop("__g")


def _hot(counts: DataFrame, by: Sequence[str], count: str) -> list:
    """Hashes of the groups that hold a large share of the rows."""
    if not by:
        return []
    total = counts.agg(F.sum(count)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(count) > max(1000.0, total * HEAVY_SHARE)).select(F.xxhash64(*by)).collect()]


def _literal(value, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return F.array(*[_literal(v, dtype.elementType) for v in value])
    return F.lit(value).cast(dtype)


def with_group_values(df: DataFrame, stats: DataFrame, by: Sequence[str], hot: Sequence = ()) -> DataFrame:
    """Attach one-row-per-group values, rows of ``hot`` groups spread; the ungrouped single row becomes literals."""
    if by:
        return _join(df, stats, by, hot)
    row = stats.first()
    return df.withColumns({f.name: _literal(row[f.name], f.dataType) for f in stats.schema.fields})


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One row per group with linearly interpolated quantiles, NULL values ignored."""
    return _quantiles(df, by, value, probs)[0]


def _quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> tuple[DataFrame, list]:
    """The quantiles and the hot groups."""
    by = list(by)
    names = list(probs)
    eps = 3.0 / ACCURACY
    ask = sorted({min(1.0, max(0.0, p + d)) for p in probs.values() for d in (-eps, eps)})
    v = F.col(value).cast("double")
    src = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*by, v.alias("__v"))
    sketch = src.groupBy(*by).agg(
        F.count("__v").alias("__cnt"), F.percentile_approx("__v", ask, ACCURACY).alias("__pts")
    )
    sketch = written(sketch, "sketch")
    hot = _hot(sketch, by, "__cnt")
    small = F.col("__cnt") <= _SMALL
    idx = list(enumerate(probs.values()))
    limits: list[Column] = []
    for i, p in idx:
        lo = F.when(small | F.lit(p - eps <= 0), F.lit(float("-inf"))).otherwise(F.col("__pts")[ask.index(max(0.0, p - eps))])
        hi = F.when(small | F.lit(p + eps >= 1), F.lit(float("inf"))).otherwise(F.col("__pts")[ask.index(min(1.0, p + eps))])
        limits += [lo.alias(f"__lo{i}"), hi.alias(f"__hi{i}")]
    stats = sketch.select(*by, "__cnt", *limits)
    rows = with_group_values(src, stats, by, hot)
    inside = [(F.col("__v") >= F.col(f"__lo{i}")) & (F.col("__v") <= F.col(f"__hi{i}")) for i, _ in idx]

    # one map-side combined pass counts what lies below each bracket ...
    below = rows.groupBy(*by).agg(
        F.first("__cnt").alias("__cnt"),
        *[F.count_if(F.col("__v") < F.col(f"__lo{i}")).alias(f"__below{i}") for i, _ in idx],
    )
    # ... and only values inside a bracket are shuffled and ranked, copies merged first
    band = (
        rows.where(reduce(or_, inside))
        .select(*by, "__v", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for (i, _), c in zip(idx, inside)]))).alias("__i"))
        .groupBy(*by, "__i", "__v").agg(F.count(F.lit(1)).alias("__c"))
    )
    w = W.partitionBy(*by, "__i").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    ranked = with_group_values(band.withColumn("__cum", F.sum("__c").over(w)), below, by)
    lower = reduce(lambda acc, i: F.when(F.col("__i") == i, F.col(f"__below{i}")).otherwise(acc), range(len(idx)), F.lit(0))
    pos = reduce(lambda acc, ip: F.when(F.col("__i") == ip[0], F.lit(float(ip[1])) * (F.col("__cnt") - 1)).otherwise(acc), idx, F.lit(0.0))
    k = F.floor(pos)
    at = F.col("__cum") + lower
    picked = ranked.groupBy(*by, "__i").agg(
        F.min(F.when(at > k, F.col("__v"))).alias("__a"),
        F.min(F.when(at > F.least(k + 1, F.col("__cnt") - 1), F.col("__v"))).alias("__b"),
        F.max(lower > k).alias("__missed"),
        F.max(pos - k).alias("__f"),
    )
    value_at = F.when(
        F.col("__missed") | F.col("__a").isNull() | F.col("__b").isNull(),
        F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
    ).otherwise(F.col("__a") + F.col("__f") * (F.col("__b") - F.col("__a")))
    flat = picked.select(*by, "__i", value_at.alias("__q"))
    return flat.groupBy(*by).agg(*[F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(nm) for i, nm in enumerate(names)]), hot


def trimmed(df: DataFrame, by: Sequence[str], value: str, discard_pct: float) -> DataFrame:
    """Rows strictly between the discard_pct and 100-discard_pct percentiles of their group."""
    p = discard_pct / 100.0
    lim, hot = _quantiles(df, by, value, {"__lo": p, "__hi": 1.0 - p})
    kept = with_group_values(df, lim, by, hot).where((F.col(value) > F.col("__lo")) & (F.col(value) < F.col("__hi")))
    return kept.drop("__lo", "__hi")


def robust_mean(df: DataFrame, by: Sequence[str], value: str, discard_pct: float = 0.2) -> DataFrame:
    """Trimmed mean and the number of values it used."""
    return trimmed(df, by, value, discard_pct).groupBy(*by).agg(
        F.avg(value).alias("robust_mean"), F.count(value).alias("robust_n")
    )


def robust_std(df: DataFrame, by: Sequence[str], value: str, discard_pct: float = 0.2,
               mean: float | None = None) -> DataFrame:
    """Root of the trimmed mean of squared deviations; Bessel-corrected unless a mean is given."""
    if mean is None:
        m = robust_mean(df, by, value, discard_pct)
        src = with_group_values(df.select(*by, value), m, by)
        corr = F.col("__n") / (F.col("__n") - 1)
    else:
        src = df.select(*by, value, F.lit(mean).alias("robust_mean"), F.lit(1).alias("robust_n"))
        corr = F.lit(1.0)
    sq = src.withColumn("__sq", (F.col(value) - F.col("robust_mean")) ** 2)
    t = trimmed(sq, by, "__sq", discard_pct)
    return t.groupBy(*by).agg(F.avg("__sq").alias("__m"), F.max("robust_n").alias("__n")).select(
        *by, F.sqrt(F.col("__m") * corr).alias("robust_std")
    )
