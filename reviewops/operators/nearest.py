"""The nearest place of every point (D15) by descent in a pyramid of occupied cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from reviewops.sources.tables import stored

#: A cell with at most this many places is not split any more.
LEAF = 64
#: A descent starts at the finest level with at most this many occupied cells.
START = 64
#: A cell of the next coarser level is 2**SHIFT times as wide.
SHIFT = 3


def _distance2(lat: Column, lng: Column) -> Column:
    return (F.col("_plat") - lat) ** 2 + (F.col("_plng") - lng) ** 2


def _outside(value: Column, low: Column, high: Column) -> Column:
    """How far a value lies outside an interval."""
    return F.greatest(low - value, value - high, F.lit(0.0))


def _up(cell: Column, levels: Column | int) -> Column:
    """The cell ``levels`` levels up; an arithmetic shift, so cells nest exactly."""
    return F.floor(cell / F.pow(F.lit(2.0 ** SHIFT), F.lit(levels) if isinstance(levels, int) else levels)).cast("long")


def pyramid(locations: DataFrame, cell: float, levels: int) -> DataFrame:
    """(level, x, y, n, box, rep): occupied cells of all levels (0 is the finest) with number and bounds of their places, and one of them.

    Tasks give one row per cell and level, however many places lie in it.
    """
    fine = [F.floor(F.col(c) / cell).cast("long").alias(n) for c, n in (("_slat", "fx"), ("_slng", "fy"))]
    rows = locations.select("_slat", "_slng", *fine).select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    return rows.groupBy("level", _up(F.col("fx"), F.col("level")).alias("x"), _up(F.col("fy"), F.col("level")).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_slat").alias("lat0"), F.max("_slat").alias("lat1"), F.min("_slng").alias("lng0"), F.max("_slng").alias("lng1"),
        F.min(F.struct("_slat", "_slng")).alias("rep"))


def tree(cells: DataFrame, top: int, bottom: int) -> DataFrame:
    """The cells of ``pyramid`` that a descent from level ``top`` meets: those whose cell above is split."""
    cells = cells.filter(F.col("level").between(bottom, top))
    above = cells.select((F.col("level") - 1).alias("level"), F.col("x").alias("_ux"), F.col("y").alias("_uy"), F.col("n").alias("_un"))
    met = cells.withColumn("_ux", _up(F.col("x"), 1)).withColumn("_uy", _up(F.col("y"), 1)).join(above, ["level", "_ux", "_uy"], "left")
    return met.filter((F.col("level") == top) | (F.col("_un") > LEAF)).drop("_un").withColumn("leaf", (F.col("n") <= LEAF) | (F.col("level") == bottom))


def _pruned(cells: DataFrame) -> DataFrame:
    """Rows (point, cell) that may hold the nearest place: no farther than the nearest known one."""
    seen = F.least("_u", F.min(_distance2(F.col("rep._slat"), F.col("rep._slng"))).over(Window.partitionBy("_pid")))
    least = _outside(F.col("_plat"), F.col("lat0"), F.col("lat1")) ** 2 + _outside(F.col("_plng"), F.col("lng0"), F.col("lng1")) ** 2
    near = cells.withColumn("_u", seen).filter(least <= F.col("_u"))
    return near.select("_pid", "_plat", "_plng", "_u", "level", "x", "y")


def descend(points: DataFrame, nodes: DataFrame, top: int, bottom: int) -> DataFrame:
    """(point, leaf cell) for the leaf cells that may hold the point's nearest place.

    A join a level: a cell is replaced by its occupied cells of the next level, a leaf by itself.
    """
    box = ["lat0", "lat1", "lng0", "lng1", "rep"]
    start = nodes.filter(F.col("level") == top).agg(F.collect_list(F.struct("level", "x", "y", *box)).alias("a"))
    found = _pruned(points.select("*", F.explode(start.scalar()).alias("c")).select("_pid", "_plat", "_plng", "_u", "c.*"))
    for level in range(top - 1, bottom - 1, -1):
        below = F.col("level") == level
        onward = nodes.filter(below | (F.col("leaf") & (F.col("level") > level))).select(
            F.when(below, F.col("level") + 1).otherwise(F.col("level")).alias("_l"), F.when(below, F.col("_ux")).otherwise(F.col("x")).alias("_x"),
            F.when(below, F.col("_uy")).otherwise(F.col("y")).alias("_y"), "level", "x", "y", *box)
        found = found.select("_pid", "_plat", "_plng", "_u", F.col("level").alias("_l"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        found = _pruned(found.join(onward, ["_l", "_x", "_y"]).drop("_l", "_x", "_y"))
    return found


def nearest_place(points: DataFrame, places: DataFrame, cell: float = 1e-5, levels: int = 9,
                  point_key: str = "point_id", place_key: str = "place_id") -> DataFrame:
    """For every point the place with the least squared lat/lng distance; ties go to the smaller key.

    The occupied cells of a pyramid (``cell`` is the side of the finest, each
    level is 8 times as wide) carry bounds and one of their places.  A point
    starts with the few cells of a coarse level and goes down level by level,
    keeping the cells whose bounds are no farther than the nearest place known
    so far; cells with at most LEAF places are not split.  So a point meets the
    places of a few small cells only, however far it lies from all places and
    however many of them lie together, and the result is exact.

    Places at one location count as their smallest key.  Points and places
    without finite coordinates are left out.  The pyramid is stored once; the
    descent is one plan without further steps.  How far down it goes depends on
    the fullest cells, read from one row per level.
    """
    def located(df: DataFrame, key: str, names: tuple[str, str, str]) -> DataFrame:
        fine = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("lat", "lng")]
        return df.filter(fine[0] & fine[1]).select(F.col(key).alias(names[0]), F.col("lat").cast("double").alias(names[1]), F.col("lng").cast("double").alias(names[2]))

    locations = located(places, place_key, ("_sid", "_slat", "_slng")).groupBy("_slat", "_slng").agg(F.min("_sid").alias("_sid"))
    # two cells of the coarsest level hold all latitudes or longitudes
    levels = max(levels, math.ceil(math.log(1024.0 / cell, 2 ** SHIFT)) + 1)
    cells = stored(pyramid(locations, cell, levels), "pyramid")
    by_level = {r["level"]: r for r in cells.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.max("n").alias("fullest")).collect()}
    top = min((k for k, r in by_level.items() if r["cells"] <= START), default=levels - 1)
    bottom = max((k for k, r in by_level.items() if k <= top and r["fullest"] <= LEAF), default=0)
    nodes = stored(tree(cells, top, bottom), "cells")

    found = descend(located(points, point_key, ("_pid", "_plat", "_plng")).withColumn("_u", F.lit(float("inf"))), nodes, top, bottom)
    leaves = nodes.filter("leaf").select("level", "x", "y")
    inside = locations.select("*", F.explode(F.sequence(F.lit(bottom), F.lit(top))).alias("level")).select(
        "_sid", "_slat", "_slng", "level", *[_up(F.floor(F.col(c) / cell).cast("long"), F.col("level")).alias(n) for c, n in (("_slat", "x"), ("_slng", "y"))])
    met = found.join(inside.join(leaves, ["level", "x", "y"]), ["level", "x", "y"]).withColumn("_d", _distance2(F.col("_slat"), F.col("_slng")))
    best = met.filter(F.col("_d") <= F.col("_u")).groupBy("_pid").agg(F.min(F.struct("_d", "_sid")).alias("_b"))
    return best.select(F.col("_pid").alias(point_key), F.col("_b._sid").alias(place_key), F.col("_b._d").alias("distance2"))
