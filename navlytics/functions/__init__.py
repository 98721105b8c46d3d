"""Column functions.  Everything here is a Spark expression; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def num(x) -> Column:
    """A DOUBLE column from a Column, column name or number."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def record(**parts) -> Column:
    """A struct that remembers its parts, so that ``.x`` of a value being composed is the part itself
    and not an extraction that drags the other parts along."""
    cols = {k: num(v) for k, v in parts.items()}
    out = F.struct(*[c.alias(k) for k, c in cols.items()])
    out.__dict__.update(cols)
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Long quaternion chains double their expression size at every use; binding keeps them linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def clip(x, lo, hi) -> Column:
    return F.greatest(F.least(num(x), num(hi)), num(lo))


def computed(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with further columns that are worked out once a row.

    A generator of one row gives them, since projections of long expressions are merged and repeated by whatever reads them, filters
    included, until the compiled code is too long to run fast.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))
