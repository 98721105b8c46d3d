"""Distance-based filters on 2-D points in linear work, however many points share one spot.

Points are put in square cells whose diagonal is not longer than the distance limit, so any two
points of a cell are too close to each other.  One representative per cell is then enough on one
side of every comparison.  Points meet the representatives by tiles of 8 x 8 cells: a point goes to
its own tile only, and a representative to the up to four tiles that its neighbour cells lie in, so a
tile holds at most 144 of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from navlytics.operators.skew import heavy_keys
from navlytics.session import written

#: Cells of a tile along each axis, as a power of two.
_TILE = 3
_SALTS = 64


def _cells(df: DataFrame, x: str, y: str, limit: float) -> DataFrame:
    # a hair under limit/sqrt(2) keeps the diagonal strictly within the limit
    side = limit / 2**0.5 * (1 - 1e-9)
    return df.withColumns({
        "__cx": F.floor(F.col(x) / F.lit(side)).cast("bigint"),
        "__cy": F.floor(F.col(y) / F.lit(side)).cast("bigint"),
    })


def _tile() -> dict[str, Column]:
    return {"__tx": F.shiftright("__cx", _TILE), "__ty": F.shiftright("__cy", _TILE)}


def _around(cells: DataFrame, reach: int = 2) -> DataFrame:
    """Rows of cells, once for each tile that has a cell at most ``reach`` cells away."""
    for c, t in (("__cx", "__tx"), ("__cy", "__ty")):
        ends = [F.shiftright(F.col(c) + d, _TILE) for d in (-reach, reach)]
        cells = cells.withColumn(t, F.explode(F.sequence(*ends)))
    return cells


def _dist(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) ** 2 + (ay - by) ** 2)


def _crowded(points: DataFrame, img: list[str]) -> list:
    """Hashes of tiles that hold a large share of the points."""
    return heavy_keys(points.select(F.xxhash64(*img, *_tile().values()).alias("__k")), "__k")


def _tile_join(points: DataFrame, firsts: DataFrame, img: list[str], cond: Column, crowded: list, how: str = "inner") -> DataFrame:
    """Points with the representatives (columns ``__f...``) about their tile; rows of crowded tiles are spread over salts."""
    on = [*img, "__tx", "__ty"]
    p, f = points.withColumns(_tile()), _around(firsts)
    if crowded:
        hot = F.xxhash64(*on).isin(crowded)
        p = p.withColumn("__salt", F.when(hot, F.pmod(F.xxhash64(*points.columns), F.lit(_SALTS))).otherwise(F.lit(0)).cast("int"))
        f = f.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))))
        on.append("__salt")
    f = f.select(*[F.col(c).alias(f"__on_{i}") for i, c in enumerate(on)], "__cx", "__cy", *[c for c in f.columns if c.startswith("__f")])
    f = f.withColumnsRenamed({"__cx": "__fcx", "__cy": "__fcy"})
    for i, c in enumerate(on):
        cond = (F.col(c) == F.col(f"__on_{i}")) & cond
    return p.join(f, cond, how)


def _firsts(points: DataFrame, cell: list[str], order: str, x: str, y: str) -> DataFrame:
    """The row with the least ``order`` of each cell as (cell, __fo, __fx, __fy); plain values, so that they are hashed and not sorted."""
    return points.groupBy(*cell).agg(F.min(order).alias("__fo"), F.min_by(x, order).alias("__fx"), F.min_by(y, order).alias("__fy"))


def keep_spaced(df: DataFrame, image: Sequence[str], x: str, y: str, order: str, limit: float) -> DataFrame:
    """Rows farther than ``limit`` from every earlier row of their image, kept or not.

    ``order`` is unique inside an image.  Not iterative, because rejected rows also suppress.
    """
    img = list(image)
    cell = [*img, "__cx", "__cy"]
    # of copies at one spot only the earliest can survive, and it suppresses whatever the others do
    spots = df.groupBy(*img, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.min(order).alias("__o"))
    pts = _cells(written(spots, "spots"), "__x", "__y", limit)
    # a later point of a cell is always within the limit of the cell's first one
    first = _firsts(pts, cell, "__o", "__x", "__y")
    near = (F.col("__o") < F.col("__fo")) & (_dist(F.col("__x"), F.col("__y"), F.col("__fx"), F.col("__fy")) <= limit)
    hit = _tile_join(pts, first, img, near, _crowded(pts, img)).select(*img, F.col("__fo").alias(order)).distinct()
    survivors = first.select(*img, F.col("__fo").alias(order)).join(hit, [*img, order], "left_anti")
    return df.join(survivors, [*img, order], "left_semi")


def suppress_greedy(df: DataFrame, image: Sequence[str], x: str, y: str, rank: str, limit: float) -> DataFrame:
    """Non-maximum suppression: repeatedly keep the best row and drop all closer than ``limit``.

    ``rank`` is unique inside an image, lower is better.  Each round keeps, in parallel, every
    alive row with no better alive row in reach, which gives the same set as the serial greedy.
    Rows without an image, place or rank take no part and are not kept.
    """
    img = list(image)
    cell = [*img, "__cx", "__cy"]
    rows = df.where(F.lit(True) if not img else F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in img)))
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(rank).isNotNull())
    # the best of several copies at one spot decides for all of them
    spots = rows.groupBy(*img, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.min(rank).alias("__r"))
    columns = [*img, "__r", "__x", "__y"]
    alive = _cells(written(spots, "alive"), "__x", "__y", limit)
    crowded = _crowded(alive, img)
    reach = _dist(F.col("__x"), F.col("__y"), F.col("__fx"), F.col("__fy")) < limit
    own = (F.col("__cx") == F.col("__fcx")) & (F.col("__cy") == F.col("__fcy"))
    kept: DataFrame | None = None
    while True:
        best = _firsts(alive, cell, "__r", "__x", "__y")
        beaten = _tile_join(alive, best, img, (F.col("__r") < F.col("__fo")) & reach, crowded)
        beaten = beaten.select(*img, F.col("__fcx").alias("__cx"), F.col("__fcy").alias("__cy")).distinct()
        won = written(best.join(beaten, cell, "left_anti").select(*img, "__fo", "__fx", "__fy"), "won")
        kept = won if kept is None else kept.unionByName(won)
        won = _cells(won, "__fx", "__fy", limit)
        left = _tile_join(alive, won, img, reach | own, crowded, "left_anti").select(*columns)
        left = written(left, "alive")
        if left.isEmpty():
            break
        alive = _cells(left, "__x", "__y", limit)
    return df.join(kept.select(*img, F.col("__fo").alias(rank)), [*img, rank], "left_semi")
