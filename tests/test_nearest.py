"""Nearest place: exact on clusters, ties, far points and odd coordinates; no point meets many places."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewops.operators import nearest
from reviewops.operators.nearest import nearest_place

PLACES, POINTS = "place_id string, lat double, lng double", "point_id long, lat double, lng double"


def brute(points, places):
    out = {}
    for i, a, b in points:
        if a is None or b is None or not np.isfinite([a, b]).all():
            continue
        ok = [((a - x) ** 2 + (b - y) ** 2, k) for k, x, y in places if x is not None and y is not None and np.isfinite([x, y]).all()]
        if ok:
            out[i] = min(ok)
    return out


def got(spark, points, places, **options):
    plain = lambda rows: [(k, *[None if x is None else float(x) for x in at]) for k, *at in rows]
    df = nearest_place(spark.createDataFrame(plain(points), POINTS), spark.createDataFrame(plain(places), PLACES), **options)
    return {r["point_id"]: (r["distance2"], r["place_id"]) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"cell": 0.01}, {"cell": 0.7, "levels": 2}])
def test_clusters_ties_and_far_points(spark, monkeypatch, options):
    monkeypatch.setattr(nearest, "LEAF", 3)
    monkeypatch.setattr(nearest, "START", 5)
    rng = np.random.default_rng(1)
    places = [(f"a{i}", 25 + round(x, 3), 121 + round(y, 3)) for i, (x, y) in enumerate(rng.normal(0, 0.01, (300, 2)))]
    places += [(f"b{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-8, 8, (80, 2)))]
    places += [("same2", 25.0, 121.0), ("same1", 25.0, 121.0), ("null", None, 1.0), ("nan", float("nan"), 1.0), ("edge", -90.0, 180.0)]
    points = [(i, 25 + x, 121 + y) for i, (x, y) in enumerate(rng.normal(0, 0.02, (150, 2)))]
    points += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-10, 10, (150, 2)))]
    points += [(2000 + i, x, y) for i, (x, y) in enumerate(rng.uniform((-90, -180), (90, 180), (150, 2)))]
    points += [(3000, 0.5, 0.5), (3001, None, 2.0), (3002, 1e9, -1e9), (3003, float("inf"), 0.0), (3004, 25.0, 121.0)]
    assert got(spark, points, places, **options) == brute(points, places)


def test_nothing_there(spark):
    assert got(spark, [(1, 1.0, 1.0)], []) == {} == got(spark, [], [("a", 1.0, 1.0)])


def test_far_points_and_hot_cells_meet_few_places(spark):
    """20,000 places in one town, points around the world and in its middle: rows of the last join, and one start for all."""
    n = 20_000
    places = spark.range(n).select(F.concat(F.lit("p"), "id").alias("place_id"), (25 + F.rand(3) / 100).alias("lat"), (121 + F.rand(4) / 100).alias("lng"))
    points = spark.range(2000).select(F.col("id").alias("point_id"), F.when(F.col("id") % 2 == 0, F.rand(5) * 180 - 90).otherwise(25 + F.rand(6) / 100).alias("lat"),
                                      F.when(F.col("id") % 2 == 0, F.rand(7) * 360 - 180).otherwise(121 + F.rand(8) / 100).alias("lng"))
    where = places.select(F.col("place_id").alias("_sid"), F.col("lat").alias("_slat"), F.col("lng").alias("_slng"))
    cells = nearest.pyramid(where, 1e-5, 9)
    nodes = nearest.tree(cells, 5, 0).cache()
    pts = points.select(F.col("point_id").alias("_pid"), F.col("lat").alias("_plat"), F.col("lng").alias("_plng"), F.lit(float("inf")).alias("_u"))
    found = nearest.descend(pts, nodes, 5, 0)
    met = found.join(nodes.filter("leaf").select("level", "x", "y", "n"), ["level", "x", "y"]).groupBy("_pid").agg(F.sum("n").alias("n"))
    stat = met.agg(F.max("n"), F.avg("n"), F.count("*")).first()
    assert stat[2] == 2000 and stat[0] < n / 20 and stat[1] < 300
