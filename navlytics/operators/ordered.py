"""Ordered (window-like) computations whose tasks never hold a whole key.

A plain ``Window.partitionBy(session).orderBy(ts)`` puts one session into one task.  Here the
order axis is cut at literal split points into slices of about equal row count, so that a
(key, slice) group holds at most ~1/n of all rows, whichever key is hot.  Window functions run
inside slices; what must cross a slice border (last row, running total, last non-null value) is
carried by a summary with one row per (key, slice), at most n rows per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from navlytics.session import parallelism, written

SLICE = "__slice"
_TIE_STRIDE = 1_000_000


def _count_le(points: Sequence[float], x: Column) -> Column:
    """Number of sorted literal points <= x, by a two-level scan of about 2*sqrt(n) compares."""
    pts = list(points)
    if not pts:
        return F.lit(0)
    if len(pts) <= 32:
        return F.size(F.filter(F.lit(pts), lambda p: p <= x))
    step = int(len(pts) ** 0.5) + 1
    blocks = [pts[i : i + step] for i in range(0, len(pts), step)]
    full = F.size(F.filter(F.lit([b[-1] for b in blocks[:-1]]), lambda p: p <= x))
    inner = F.element_at(F.array(*[F.lit(b) for b in blocks]), full + 1)
    return full * step + F.size(F.filter(inner, lambda p: p <= x))


def slice_column(df: DataFrame, order: str, tie: str | None = None, n: int | None = None) -> Column:
    """A BIGINT slice number, monotone in (order, tie).  ``order`` and ``tie`` are numeric.

    One aggregate job sketches the split points.  They become literals, so the slicing is the
    same in every branch and every retry of the plan.  Values heavy enough to repeat among the
    split points are cut once more along ``tie``.
    """
    n = n or parallelism(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    pts = df.agg(F.percentile_approx(order, probs, max(1000, 10 * n)).alias("p")).first()[0] or []
    uniq = sorted(set(pts))
    # a heavy value gets its own odd slot, so that rows just above it still sort after its pieces
    heavy = [v for v in uniq if pts.count(v) > 1] if tie else []
    slot = _count_le(uniq, F.col(order)).cast("bigint") * 2
    col = (slot - F.when(F.col(order).isin(heavy), 1).otherwise(0) if heavy else slot) * _TIE_STRIDE
    if not heavy:
        return col
    subs = (
        df.where(F.col(order).isin(heavy))
        .groupBy(order)
        .agg(F.percentile_approx(tie, probs, max(1000, 10 * n)).alias("p"))
        .collect()
    )
    extra = F.lit(0)
    for row in subs:
        extra = F.when(F.col(order) == row[0], _count_le(sorted(set(row[1] or [])), F.col(tie))).otherwise(extra)
    return col + extra


class Ordered:
    """Rows of ``df`` in (order, tie) order inside ``keys``."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: str, tie: str, n: int | None = None):
        self.keys = list(keys)
        self.order = order
        self.tie = tie
        # a frame that still carries its slices (see keep_slice) is not sketched again
        self.df = df if SLICE in df.columns else df.withColumn(SLICE, slice_column(df, order, tie, n))

    def prefix(
        self,
        lag: Mapping[str, Column] | None = None,
        lead: Mapping[str, Column] | None = None,
        total: Mapping[str, Column] | None = None,
        last: Mapping[str, Column] | None = None,
        high: Mapping[str, Column] | None = None,
        rank: str | None = None,
        keep_slice: bool = False,
    ) -> DataFrame:
        """Append columns: previous/next row's value, running sum, last non-null value so far,
        running maximum, and 1-based rank.  All running forms include the current row.
        ``keep_slice`` leaves the slice column for another pass over the same keys and order.
        """
        lag, lead, total, last, high = (dict(m or {}) for m in (lag, lead, total, last, high))
        pos = F.struct(self.order, self.tie)
        parts = [*self.keys, SLICE]
        w = W.partitionBy(*parts).orderBy(self.order, self.tie)
        upto = w.rowsBetween(W.unboundedPreceding, 0)

        aggs: list[Column] = []
        if lag:
            aggs.append(F.max_by(F.struct(*[c.alias(k) for k, c in lag.items()]), pos).alias("__tail"))
        if lead:
            aggs.append(F.min_by(F.struct(*[c.alias(k) for k, c in lead.items()]), pos).alias("__head"))
        aggs += [F.sum(c).alias(f"__t_{k}") for k, c in total.items()]
        aggs += [F.max_by(c, F.when(c.isNotNull(), pos)).alias(f"__l_{k}") for k, c in last.items()]
        aggs += [F.max(c).alias(f"__h_{k}") for k, c in high.items()]
        if rank:
            aggs.append(F.count(F.lit(1)).alias("__n"))

        across = W.partitionBy(*self.keys).orderBy(SLICE) if self.keys else W.orderBy(SLICE)
        before = across.rowsBetween(W.unboundedPreceding, -1)
        carry: list[Column] = []
        if lag:
            carry.append(F.lag("__tail").over(across).alias("__tail"))
        if lead:
            carry.append(F.lead("__head").over(across).alias("__head"))
        carry += [F.sum(f"__t_{k}").over(before).alias(f"__t_{k}") for k in total]
        carry += [F.last(f"__l_{k}", ignorenulls=True).over(before).alias(f"__l_{k}") for k in last]
        carry += [F.max(f"__h_{k}").over(before).alias(f"__h_{k}") for k in high]
        if rank:
            carry.append(F.sum("__n").over(before).alias("__n"))
        summary = self.df.groupBy(*parts).agg(*aggs).select(*parts, *carry)

        local: dict[str, Column] = {}
        if lag:
            local["__first"] = F.row_number().over(w) == 1
            local |= {f"__lag_{k}": F.lag(c).over(w) for k, c in lag.items()}
        if lead:
            local["__final"] = F.lead(F.lit(1)).over(w).isNull()
            local |= {f"__lead_{k}": F.lead(c).over(w) for k, c in lead.items()}
        local |= {f"__tot_{k}": F.sum(c).over(upto) for k, c in total.items()}
        local |= {f"__lst_{k}": F.last(c, ignorenulls=True).over(upto) for k, c in last.items()}
        local |= {f"__hgh_{k}": F.max(c).over(upto) for k, c in high.items()}
        if rank:
            local["__rn"] = F.row_number().over(w)

        joined = self.df.withColumns(local).join(summary, parts, "left")
        out: dict[str, Column] = {}
        for k in lag:
            out[k] = F.when(F.col("__first"), F.col(f"__tail.{k}")).otherwise(F.col(f"__lag_{k}"))
        for k in lead:
            out[k] = F.when(F.col("__final"), F.col(f"__head.{k}")).otherwise(F.col(f"__lead_{k}"))
        for k in total:
            a, b = F.col(f"__t_{k}"), F.col(f"__tot_{k}")
            out[k] = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        for k in last:
            out[k] = F.coalesce(F.col(f"__lst_{k}"), F.col(f"__l_{k}"))
        for k in high:
            out[k] = F.greatest(F.col(f"__hgh_{k}"), F.col(f"__h_{k}"))
        if rank:
            out[rank] = F.coalesce(F.col("__n"), F.lit(0)) + F.col("__rn")
        keep = [c for c in self.df.columns if (keep_slice or c != SLICE) and c not in out]
        return joined.select(*keep, *[c.alias(k) for k, c in out.items()])


def _composed(df: DataFrame, parts: list[str], order: list[str], rows: int) -> DataFrame:
    """Columns __a, __b of each row after those of all rows before it in its part: doubling steps over one sort.

    A row's map y -> a y + b is composed with that of the row 1, 2, 4, ... before it, so neither division nor a loop over rows is needed
    and maps with a = 0 are no special case.
    """
    w = W.partitionBy(*parts).orderBy(*order)
    step = 1
    while step < rows:
        before = F.lag(F.struct("__a", "__b"), step).over(w)
        df = df.withColumn("__p", before)
        df = df.withColumns({"__b": F.col("__a") * F.coalesce("__p.__b", F.lit(0.0)) + F.col("__b"),
                             "__a": F.col("__a") * F.coalesce("__p.__a", F.lit(1.0))}).drop("__p")
        step *= 2
    return df


def affine_scan(df: DataFrame, keys: Sequence[str], order: str, tie: str, a: Column, b: Column, out: str, n: int | None = None) -> DataFrame:
    """Append ``out``: y = a y' + b with y' the value of the row before, 0 before the first row of a key.

    Maps are composed inside slices; one map per (key, slice) is composed across slices and carried in. A row whose ``a`` or ``b`` is NULL
    leaves the value as it is.
    """
    known = a.isNotNull() & b.isNotNull()
    o = Ordered(df, keys, order, tie, n).df.withColumns({
        "__a": F.when(known, a.cast("double")).otherwise(1.0), "__b": F.when(known, b.cast("double")).otherwise(0.0)})
    parts = [*keys, SLICE]
    o = written(o, "scan")  # the number of steps is counted on the rows that are then worked on
    most = o.groupBy(*parts).count().agg(F.max("count")).first()[0] or 0
    o = _composed(o, parts, [order, tie], most)
    ends = o.groupBy(*parts).agg(F.max_by(F.struct("__a", "__b"), F.struct(order, tie)).alias("__e")).select(*parts, "__e.*")
    slices = ends.select(SLICE).distinct().count()
    across = W.partitionBy(*keys).orderBy(SLICE) if keys else W.partitionBy(F.lit(0)).orderBy(SLICE)
    ends = _composed(ends, list(keys) or [F.lit(0)], [SLICE], slices).select(*parts, F.lag("__b").over(across).alias("__c"))
    j = o.join(ends, parts)
    keep = [c for c in df.columns if c != SLICE and c != out]
    return j.select(*keep, (F.col("__a") * F.coalesce("__c", F.lit(0.0)) + F.col("__b")).alias(out))


def dense_ids(df: DataFrame, key: str, out: str = "dense_id", tie: str | None = None) -> DataFrame:
    """0-based consecutive numbers in key order, without a global sort in one task."""
    ranked = Ordered(df, [], key, tie or key).prefix(rank="__rank")
    return ranked.withColumn(out, F.col("__rank") - 1).drop("__rank")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    tie: str,
    payload: Sequence[str],
    keep_slice: bool = False,
) -> DataFrame:
    """Each left row with the payload of the last right row at or before its time.

    Both sides are stacked and the right payload is carried forward, so the cost is one shuffle
    of left + right whatever the key distribution.  ``tie`` is a numeric unique id of left rows;
    at equal time, right rows come first.
    """
    cols = left.columns
    a = left.select(
        *keys,
        F.col(left_time).alias("__t"),
        F.col(tie).cast("double").alias("__tie"),
        F.struct(*cols).alias("__row"),
        F.lit(None).cast(right.select(F.struct(*payload).alias("s")).schema["s"].dataType).alias("__pay"),
    )
    b = right.select(
        *keys,
        F.col(right_time).alias("__t"),
        F.lit(float("-inf")).alias("__tie"),
        F.lit(None).cast(a.schema["__row"].dataType).alias("__row"),
        F.struct(*payload).alias("__pay"),
    )
    both = a.unionByName(b)
    filled = Ordered(both, keys, "__t", "__tie").prefix(last={"__hit": F.col("__pay")}, keep_slice=keep_slice)
    out = [F.col(f"__hit.{p}").alias(p) for p in payload] + ([F.col(SLICE)] if keep_slice else [])
    return filled.where("__row is not null").select("__row.*", *out)
