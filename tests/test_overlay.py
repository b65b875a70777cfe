"""Unions of polygons against counting: cells of a grid, and places dropped at random."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillway.operators import courses as K
from rillway.operators import overlay

RINGS = "basin string, rings array<array<struct<x:double,y:double>>>"


def closed(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def frame(spark, polygons):
    return spark.createDataFrame([(name, [closed(*ring) for ring in rings]) for name, rings in polygons.items()], RINGS)


def members(spark, of):
    return spark.createDataFrame([(r, b) for r, basins in of.items() for b in basins], "river_id string, basin string")


def areas(spark, polygons, of):
    covered = overlay.cover(frame(spark, polygons))
    return {r.river_id: r.area for r in overlay.union_areas(overlay.union_edges(members(spark, of), covered)).collect()}


def inside(x, y, rings):
    odd = np.zeros(len(x), dtype=bool)
    for ring in rings:
        for (xa, ya), (xb, yb) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if ya != yb:
                odd ^= ((ya > y) != (yb > y)) & (xa + (y - ya) / (yb - ya) * (xb - xa) > x)
    return odd


def box(x, y, w, h):
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]


def test_boxes_by_cells(spark):
    rng = random.Random(3)
    polygons = {f"b{k}": box(rng.randrange(12), rng.randrange(12), rng.randrange(1, 6), rng.randrange(1, 6)) for k in range(25)}
    polygons["again"], polygons["hole"] = polygons["b0"], [box(0, 0, 9, 9)[0], box(2, 2, 3, 3)[0]]
    of = {f"r{k}": rng.sample(sorted(polygons), rng.randrange(1, 9)) for k in range(12)} | {"same": ["b0", "again"], "ring": ["hole"]}
    x, y = (v.ravel() + 0.5 for v in np.mgrid[0:20, 0:20])
    got = areas(spark, polygons, of)
    for r, basins in of.items():
        assert got[r] == pytest.approx(np.logical_or.reduce([inside(x, y, polygons[b]) for b in basins]).sum(), abs=1e-6)


def test_stars_by_places(spark):
    rng = random.Random(5)
    polygons = {}
    for k in range(8):  # rings that cross themselves and one another at any angle
        cx, cy = rng.uniform(0, 6), rng.uniform(0, 6)
        polygons[f"s{k}"] = [[(cx + rng.uniform(-3, 3), cy + rng.uniform(-3, 3)) for _ in range(rng.randrange(4, 9))]]
    of = {"all": sorted(polygons), "two": ["s1", "s4"], **{b: [b] for b in polygons}}
    got = areas(spark, polygons, of)
    x, y = np.random.default_rng(1).uniform(-4, 10, (2, 400_000))
    for r, basins in of.items():
        share = np.logical_or.reduce([inside(x, y, polygons[b]) for b in basins]).mean() * 14 * 14
        assert got[r] == pytest.approx(share, abs=0.25)


def test_bowtie_is_repaired(spark):
    polygons = {"tie": [[(0, 0), (2, 2), (2, 0), (0, 2)]], "plain": box(5, 5, 1, 2), "line": [[(0, 0), (1, 1), (0, 0)]]}
    edges = overlay.repaired(frame(spark, polygons))
    got = {r.river_id: r.rings for r in K.rings_of_edges(edges).collect()}
    assert set(got) == {"tie", "plain"} and len(got["tie"]) == 2 and len(got["plain"]) == 1
    assert {tuple(sorted({(p.lon, p.lat) for p in ring})) for ring in got["tie"]} == {((0.0, 0.0), (0.0, 2.0), (1.0, 1.0)), ((1.0, 1.0), (2.0, 0.0), (2.0, 2.0))}
    assert {r.river_id: r.area for r in overlay.union_areas(edges).collect()} == pytest.approx({"tie": 2.0, "plain": 2.0})


def test_measured_in_lambert(spark):
    side = 0.06
    polygons = {"a": box(-0.075, 42.88, side, side), "b": box(-0.055, 42.9, side, side)}
    covered = overlay.cover(frame(spark, polygons))
    of = members(spark, {"a": ["a"], "b": ["b"], "ab": ["a", "b"]})
    got = {r.river_id: r.area for r in overlay.union_areas(overlay.union_edges(of, covered), lambert=True).collect()}
    assert got["a"] == pytest.approx(32.7, abs=0.2) and got["ab"] == pytest.approx((got["a"] + got["b"]) * (1 - 4 / 18), rel=1e-3)


def test_nothing(spark):
    none = spark.createDataFrame([("a", None), ("b", []), ("c", [[]])], RINGS)
    assert overlay.cover(none).count() == 0 and overlay.cover(none.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("over_all", [False, True])
def test_far_apart(spark, monkeypatch, over_all):
    """Two groups of boxes far apart: what meets in squares doesn't grow with the extent, nor do the squares of a box over everything."""
    rng, far, dealt = random.Random(7), 1_000_000, []
    polygons = {f"b{g}_{k}": box(g * far + rng.randrange(30), g * far + rng.randrange(20), rng.randrange(1, 4), rng.randrange(1, 4)) for g in range(2) for k in range(600)}
    of = {"near": [b for b in polygons if b < "b1"], "each": sorted(polygons)[::3]}
    if over_all:
        polygons["all"] = box(-1, -1, far + 60, far + 60)
        of["all"] = ["all", "b0_1"]
    for name in ("in_squares", "_boxes_in_squares"):
        monkeypatch.setattr(overlay, name, lambda *a, deal=getattr(overlay, name): dealt.append(deal(*a)) or dealt[-1])
    got = areas(spark, polygons, of)
    x, y = (v.ravel() + 0.5 for v in np.mgrid[0:33, 0:23])
    for r in ("near", "each"):
        parts = [np.logical_or.reduce([inside(x + g * far, y + g * far, polygons[b]) for b in of[r] if b[1] == str(g)] or [np.zeros(len(x), dtype=bool)]) for g in range(2)]
        assert got[r] == pytest.approx(sum(p.sum() for p in parts), abs=1e-3)
    assert got.get("all", (far + 60) ** 2) == pytest.approx((far + 60) ** 2)
    lines, boxes = [[r["count"] for r in d.groupBy("gx", "gy").count().collect()] for d in dealt]
    assert sum(boxes) < 6 * len(polygons)
    assert over_all or (sum(n * n for n in lines) < 100 * sum(lines) and max(boxes) < 60)
