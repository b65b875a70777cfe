"""Closed forms of relief, kernels, geometry, sources and jobs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillway.functions import flood, geo, kernels
from rillway.operators import nearest, raster, relief, watershed
from rillway.plans import terrain_queries


def grid(spark, z):
    return spark.createDataFrame([(r, c, float(z[r][c])) for r in range(len(z)) for c in range(len(z[0]))], "r int, c int, z double")


def test_flat_and_ramp(spark):
    flat = relief.composed(relief.lit(relief.gradient(grid(spark, np.zeros((6, 7)))), 135, 30), 0.5).collect()
    assert all(abs(r.hillshade - 0.5) < 1e-9 and r.slope == 0 and not r.core and abs(r.relief - 0.75) < 1e-9 for r in flat)
    ramp = relief.lit(relief.gradient(grid(spark, np.tile(np.arange(8) * 10.0, (5, 1))))).collect()
    assert all(abs(r.slope - math.atan(0.5) / (math.pi / 2)) < 1e-9 for r in ramp)


def test_step_shadow(spark):
    z = np.zeros((3, 100))
    z[:, 60:] = 200.0
    rows = relief.cast_shadow_east(grid(spark, z), 25.0, 10.0).filter("r = 1 and shadow").collect()
    reach = 200 / math.tan(math.radians(25)) / 10
    assert {r.c for r in rows} == set(range(60 - math.floor(reach), 60))
    hidden = kernels.cast_shadow(z, 90.0, 25.0, 10.0)
    assert abs(hidden[1].sum() - reach) <= 1.5 and not hidden[1, 60:].any()


def test_flood_and_flow(spark):
    z = np.array([[5, 5, 5, 5, 5], [5, 1, 1, 1, 5], [5, 1, 0, 1, 4], [5, 1, 1, 1, 5], [5, 5, 5, 5, 5]], float)
    assert (flood.fill(z)[1:4, 1:4] == 4).all()
    slope = grid(spark, np.tile(np.arange(6)[:, None] * 1.0, (1, 3)))
    acc = {r.cell: r.acc for r in raster.accumulation(raster.d8(slope)).collect()}
    assert acc["0:1"] == 6 and sum(v for k, v in acc.items() if k.startswith("0:")) == 18
    with pytest.raises(ValueError):
        raster.channel_mask(spark.createDataFrame([(0, 0, 3)], "r int, c int, acc long"), 2)


def test_candidates(spark):
    rows = [("a", 0, 0.99), ("a", 1, 1.0), ("b", 0, 0.03), ("b", 1, 0.02), ("b", 2, 0.91), ("b", 3, 0.96), ("b", 4, 0.94), ("c", 0, 0.2)]
    got = raster.best_candidate(spark.createDataFrame(rows, "river_id string, seq int, frac double")).collect()
    assert {(r.river_id, r.seq) for r in got} == {("a", 0), ("b", 3)}


def test_kernels_on_lines():
    line = np.array([[0, 0], [1, 0.001], [2, 0], [3, 2], [4, 0]], float)
    assert len(kernels.simplify(line, 0.01)) == 4 and len(kernels.simplify_to(line, 2, 0.01, 10)) == 2
    merged = kernels.merge_lines([np.array([[0, 0], [1, 0]]), np.array([[2, 0], [1, 0]]), np.array([[5, 5], [6, 6]])])
    assert sorted(len(m) for m in merged) == [2, 3]
    ring = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], float)
    assert abs(kernels.length_inside(np.array([[-1, 0.5], [2, 0.5]]), ring) - 1) < 1e-12
    gap = np.array([[1.0, np.nan, 3.0]])
    assert kernels.fill_nan(gap)[0, 1] == 2
    assert len(kernels.contours(np.array([[0, 0], [10, 10.0]]), 5)) == 1


def test_lambert_and_area(spark):
    x, y = geo.lambert93(F.lit(3.0), F.lit(46.5))
    lon, lat = geo.lambert93_inverse(F.lit(652709.401), F.lit(6859290.946))
    row = spark.range(1).select(x.alias("x"), y.alias("y"), lon.alias("lon"), lat.alias("lat")).first()
    assert abs(row.x - 700000) < 1e-3 and abs(row.y - 6600000) < 1e-3
    bx, by = geo.lambert93(F.lit(row.lon), F.lit(row.lat))
    back = spark.range(1).select(bx.alias("x"), by.alias("y")).first()
    assert abs(back.x - 652709.401) < 1e-3 and abs(back.y - 6859290.946) < 1e-3


def test_unit_squares(spark):
    sq = lambda i: [(i, 0), (i + 1, 0), (i + 1, 1), (i, 1), (i, 0)]
    rows = spark.createDataFrame([("r", sq(0)), ("r", sq(1))], "river_id string, ring array<struct<x:int,y:int>>")
    assert watershed.dissolve_edges(rows).count() == 6


def test_slug(spark):
    rows = spark.createDataFrame([("La Garonne",), ("L'Adour",), ("Neste de Rioumajou",), ("l'Échez",)], "t string")
    assert [r[0] for r in rows.select(geo.slug(F.col("t"))).collect()] == ["la-garonne", "l-adour", "neste-de-rioumajou", "l-echez"]


def test_sources(spark, tmp_path):
    from rillway.sources import config, dem, geojson, osm, wfs

    f = {"type": "Feature", "properties": {"cleabs": "T1", "fictif": False}, "geometry": {"type": "LineString", "coordinates": [[0, 42, 7], [0.1, 42.1, 8]]}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [f]}))
    lines = geojson.segments(geojson.read_lines(spark, str(tmp_path / "a.json")))
    row = lines.first()
    assert row.cleabs == "T1" and 13000 < row.length_m < 14500
    assert geojson.write_features(lines, f"file://{tmp_path}/out") == 1
    with pytest.raises(RuntimeError):
        geojson.write_features(lines.limit(0), f"file://{tmp_path}/none")
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "hits.xml").write_text('<FeatureCollection numberMatched="3"/>')
    for start, n in ((0, 2), (2, 1)):
        (pages / f"{start}.json").write_text(json.dumps({"features": [{"id": f"x{start + i}", "properties": {}, "geometry": None} for i in range(n)]}))
    spark.dataSource.register(wfs.WfsSource)
    got = spark.read.format("wfs").options(fetch=f"file:{pages}", type="t", page="2").load()
    assert {r.id for r in got.collect()} == {"x0", "x1", "x2"}
    assert wfs.exception_text(b"<R><Exception exceptionCode='A'><ExceptionText>no</ExceptionText></Exception></R>") == "A | no"
    assert wfs.exception_text(b"plain") == "plain"
    with pytest.raises(ValueError):
        wfs.params("t", bbox="1", cql="2")
    boxes = spark.createDataFrame([(0.30, 42.95, 0.35, 43.05), (-2.0, -1.0, -1.5, -0.5)], "west double, south double, east double, north double")
    assert {r.tile for r in dem.tile_name(dem.tile_grid(boxes)).collect()} == {"N42_00_E000_00", "N43_00_E000_00", "S01_00_W002_00"}
    (tmp_path / "area.yaml").write_text("name: x\nbbox_wgs84: [0, 42, 1, 43]\nroots: [{name: a, cours_d_eau_id: A}, {name: b}]\n")
    area = config.study_area(str(tmp_path / "area.yaml"))
    assert config.roots_table(spark, area).count() == 1 and config.overrides(spark, str(tmp_path / "no.yaml")).count() == 0
    e = spark.createDataFrame([("node", 1, {"natural": "peak", "ele": "2 345,5 m"}, [(0.0, 1.0)]), ("way", 2, {"highway": "path"}, [(0.0, 1.0), (1.0, 1.0)])], "type string, id long, tags map<string,string>, points array<struct<lon:double,lat:double>>")
    assert {(r.id, r.layer) for r in osm.layers(e).collect()} == {(1, "peaks"), (2, "paths")}
    assert e.select(osm.elevation(F.col("tags")["ele"]).alias("m")).first().m == 2.0


def test_resumable_job(spark, tmp_path):
    from rillway.streaming import jobs

    todo = spark.range(10).select(F.col("id").cast("string").alias("river_id"))
    work = lambda df: df.withColumn("area_km2", F.lit(1.0)).withColumn("error", F.when(F.col("river_id") == "3", "broken"))
    schema, path = "river_id string, area_km2 double, error string", f"file://{tmp_path}/cache"
    assert jobs.run(todo, "river_id", work, path, schema, 3) == {"skipped": 0, "done": 9, "failed": 1, "stopped": 0}
    assert jobs.run(todo, "river_id", work, path, schema, 3)["skipped"] == 9


def test_catalog_json(spark):
    from rillway.sinks import catalog_json

    rows = [("R", None, "root", 1, 0, "Root", 2.0), ("M", "R", "mainline", 1, 1, None, 1.0), ("T", "R", "tributary", 1, 1, "T", 1.0)]
    got = catalog_json.nested(spark.createDataFrame(rows, "river_id string, parent_id string, role string, ordinal int, depth int, name string, length_km double"))
    assert got["meta"]["n_nodes"] == 3 and got["tree"]["mainline"]["id"] == "M" and len(catalog_json.listing(got["tree"])) == 3
    assert "&lt;" in catalog_json.page("<x>")


def test_nearest_segment_looks_at_every_line(spark, tmp_path):
    rng = np.random.default_rng(4)
    short, long = rng.uniform(0, 1e5, (60, 4)), rng.uniform(0, 1e5, (60, 4))
    short[:, 2:] = short[:, :2] + rng.uniform(-500, 500, (60, 2))
    upright = np.array([[5e4, 0, 5e4, 9e4], [0, 3e4, 9e4, 3e4], [7e4, 7e4, 7e4, 7e4]])
    lines = np.concatenate([short, long, upright, long[:3]])
    # Some are far from every line.
    points = np.concatenate([rng.uniform(0, 1e5, (80, 2)), [[2e6, 2e6], [-9e5, 4e4], [5e4, 5e4], [7e4, 7e4]]])

    def brute(points, lines):
        d = lines[:, 2:] - lines[:, :2]
        size = (d**2).sum(axis=1)
        best = []
        for p in points:
            t = np.where(size > 0, np.clip(((p - lines[:, :2]) * d).sum(axis=1) / np.where(size > 0, size, 1), 0, 1), 0)
            m = np.hypot(*(p - lines[:, :2] - t[:, None] * d).T)
            best.append(float(m.min()))
        return best

    ps = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "p long, px double, py double")
    for kept in (lines, long, short[:2], upright[1:2], upright[2:]):
        ls = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(kept)], "k long, x1 double, y1 double, x2 double, y2 double")
        want = brute(points, kept)
        for side in (None, 3000.0):
            got = {r.p: r for r in nearest.nearest_lines(ps, ls, side).collect()}
            assert len(got) == len(points) and all(abs(got[i].metres - m) < 0.002 for i, m in enumerate(want))
            assert all(abs(brute(points[i : i + 1], kept[[got[i].k]])[0] - m) < 0.002 for i, m in enumerate(want))
    assert nearest.nearest_lines(ps, ls.limit(0)).count() == 0
    # The registered query, on lines that all span more than 0.2 degrees.
    spark.createDataFrame([(i,) for i in range(1, 12)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i,) for i in range(40, 100)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert terrain_queries.q_nearest(spark, str(tmp_path)).count() == 11
