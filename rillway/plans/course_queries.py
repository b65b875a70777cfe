"""Queries on courses, delineation, map layers and drawn values, with their DuckDB equivalents."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rillway.functions import drawing
from rillway.operators import courses as K
from rillway.operators import delineate as D
from rillway.operators import rivers as R
from rillway.operators import raster, tiled, watershed
from rillway.plans.catalog_queries import TREE_SQL, _parts, _tree
from rillway.plans.river_queries import RIVER_SQL, _with_counts, network
from rillway.plans.tables import written
from rillway.plans.terrain_queries import FLOOD, _basins, _cells, _conditioned, _members, _points
from rillway.plans.views import CELL, LINE, SEG, view
from rillway.sources import osm

_WAY = f"SELECT s.cleabs, s.sens, l.lon1, l.lat1, l.lon2, l.lat2 FROM ({SEG}) s JOIN ({LINE}) l USING (k)"


def _lines(spark, sf):
    way = _points(view(spark, sf, LINE), ("lon1", "lat1"), ("lon2", "lat2")).withColumn("cleabs", F.concat(F.lit("T"), "k"))
    return K.downstream_lines(way.join(view(spark, sf, SEG).select("cleabs", "sens"), "cleabs"))


def q_outlet_point(spark, sf):
    p = K.outlet_points(network(spark, sf), _lines(spark, sf))
    return p.select("river_id", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


_OFFSETS = (0, 50_000, 250_000, 600_000)


def q_offset_point(spark, sf):
    p = K.offset_points(network(spark, sf), _lines(spark, sf), _OFFSETS)
    return p.select("river_id", "offset_m", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


def q_longest(spark, sf):
    return K.longest_segment(K.own_edges(network(spark, sf)), "dst").select("river_id", "dst", "cleabs")


def q_candidates(spark, sf):
    points = network(spark, sf).rivers.select("river_id", F.explode(F.array(*[F.lit(float(o)) for o in K.OFFSETS])).alias("offset_m"))
    return K.candidates(points).select("river_id", "offset_m", F.col("threshold").cast("long").alias("threshold"), "seq")


def q_header(spark, sf):
    return R.header(network(spark, sf))


def q_list(spark, sf):
    return R.listed(network(spark, sf).rivers, named=True, roots=True, least_km=200).select("river_id", "length_km")


def q_identified(spark, sf):
    return network(spark, sf).rivers.select("river_id", (~F.col("river_id").startswith("UNNAMED:")).alias("identified"))


def q_child_order(spark, sf):
    return R.child_order(network(spark, sf).rivers)


def q_walk(spark, sf):
    """The tree in reading order: each river's path of places, main line first."""
    from rillway.operators.catalog import breadcrumb

    tree = _tree(spark, sf).select("river_id", "parent_id", F.when(F.col("role") == "mainline", 0).otherwise(F.col("ordinal")).cast("int").alias("place"))
    up = breadcrumb(tree).join(tree.select(F.col("river_id").alias("ancestor"), F.col("parent_id").alias("_top"), F.col("place").alias("_p")), "ancestor").filter("_top is not null")
    own = tree.filter("parent_id is not null").select("river_id", F.lit(0).cast("long").alias("up"), F.col("place").alias("_p"))
    path = own.unionByName(up.select("river_id", F.col("up").cast("long").alias("up"), "_p")).groupBy("river_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("u"), "_p"))).alias("path"))
    return path.select("river_id", F.array_join(F.transform("path", lambda p: F.format_string("%04d", p["_p"])), "/").alias("path"))


# Map elements on ``part``: two tags each.
_TAGS = [
    ("natural", "peak"), ("natural", "saddle"), ("mountain_pass", "yes"), ("tourism", "alpine_hut"), ("tourism", "wilderness_hut"), ("tourism", "hotel"), ("amenity", "shelter"), ("building", "cabin"), ("building", "yes"),
    ("place", "village"), ("place", "ocean"), ("route", "hiking"), ("route", "bus"), ("waterway", "river"), ("waterway", "canal"), ("waterway", "weir"), ("natural", "water"), ("landuse", "reservoir"), ("landuse", "forest"),
    ("natural", "glacier"), ("highway", "path"), ("highway", "cycleway"), ("highway", "primary"), ("natural", "spring"), ("ele", "2 345,5 m"), ("ele", "1999.5"), ("ele", "high"),
]
_pick = lambda x, k: f"CASE {x} " + " ".join(f"WHEN {i} THEN '{t[k]}'" for i, t in enumerate(_TAGS)) + " END"
_A, _B = f"(p_partkey % {len(_TAGS)})", f"((p_partkey * 7 + 3) % {len(_TAGS)})"
ELEMENT = f"SELECT p_partkey AS id, {_pick(_A, 0)} AS k1, {_pick(_A, 1)} AS v1, {_pick(_B, 0)} AS k2, {_pick(_B, 1)} AS v2 FROM part"


def _tagged(spark, sf):
    tags = F.when(F.col("k1") == F.col("k2"), F.create_map("k1", "v1")).otherwise(F.create_map("k1", "v1", "k2", "v2"))
    return view(spark, sf, ELEMENT).select("id", tags.alias("tags"))


def q_osm(spark, sf):
    return _tagged(spark, sf).select("id", osm.classify(F.col("tags")).alias("layer"))


def q_osm_layers(spark, sf):
    point = F.struct((F.col("id") % 7).cast("double").alias("lon"), F.lit(1.0).alias("lat"))
    n = (F.col("id") % 4 + 1).cast("int")
    ring = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i % 3).cast("double").alias("lon"), F.when(i == n, F.lit(1.0)).otherwise(i.cast("double")).alias("lat")))
    e = _tagged(spark, sf).withColumn("type", F.when(F.col("id") % 3 == 0, "node").otherwise("way")).withColumn("points", F.when(F.col("id") % 3 == 0, F.array(point)).otherwise(ring))
    return osm.layers(e).select("id", "layer", "kind", "ele", "role")


_has = lambda k, *v: f"((k1 = '{k}' AND v1 IN ({', '.join(repr(x) for x in v)})) OR (k1 <> k2 AND k2 = '{k}' AND v2 IN ({', '.join(repr(x) for x in v)})))"
_LAYER = f"""CASE WHEN {_has('natural', 'peak')} THEN 'peaks' WHEN {_has('natural', 'saddle')} OR {_has('mountain_pass', 'yes')} THEN 'cols'
 WHEN {_has('tourism', 'alpine_hut', 'wilderness_hut')} OR {_has('amenity', 'shelter')} OR {_has('building', 'cabin')} THEN 'huts' WHEN {_has('place', 'city', 'town', 'village', 'hamlet', 'isolated_dwelling')} THEN 'settlements'
 WHEN {_has('route', 'hiking')} THEN 'routes' WHEN {_has('waterway', 'river', 'stream', 'canal')} THEN 'water_lines' WHEN {_has('natural', 'water')} OR {_has('landuse', 'reservoir')} THEN 'water_areas'
 WHEN {_has('natural', 'glacier')} THEN 'glaciers' WHEN {_has('highway', 'path', 'footway', 'track', 'bridleway', 'steps', 'cycleway')} THEN 'paths' WHEN {_has('highway', 'primary')} THEN 'roads' END"""
# A way has id % 4 + 1 points; the last of four returns to the first.
_OSM_KIND = "CASE WHEN id % 3 = 0 THEN 'point' WHEN id % 4 = 3 THEN 'area' WHEN id % 4 >= 1 THEN 'line' END"
_ELE = "CASE WHEN k1 = 'ele' THEN v1 WHEN k2 = 'ele' THEN v2 END"


def q_inside(spark, sf):
    tri = _points(view(spark, sf, LINE), ("lon1", "lat1"), ("lon2", "lat1"), ("lon2", "lat2"), ("lon1", "lat1"))
    lon = F.col("lon1").cast("double") + 0.7 * (F.col("lon2") - F.col("lon1")).cast("double")
    lat = F.col("lat1").cast("double") + (F.col("k") % 10 + 0.5) / 10 * (F.col("lat2") - F.col("lat1")).cast("double")
    return tri.select("k", drawing.inside(lon, lat, F.col("line")).alias("inside"))


def q_containing(spark, sf):
    """Which squares of a grid hold each supplier's place."""
    spark.read.parquet(f"{sf}/supplier.parquet").createOrReplaceTempView("_rillway_supplier")
    pts = spark.sql("SELECT s_suppkey AS p, (s_suppkey * 37 % 400) / 10.0D + 0.05D AS lon, (s_suppkey * 11 % 350) / 10.0D + 0.05D AS lat FROM _rillway_supplier")
    squares = _basins(spark, sf).select(F.col("basin").alias("q"), F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("lon"), p["y"].cast("double").alias("lat"))).alias("ring"))
    return K.containing(pts, squares)


def q_rings(spark, sf):
    """Outer rings of dissolved catchments, by number, vertices and area."""
    r = K.rings_of_edges(watershed.dissolve_edges(_members(spark, sf)), most=10**6)
    area = lambda ring: F.abs(F.aggregate(F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b")), F.lit(0.0), lambda t, e: t + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])) / 2
    return r.select("river_id", F.size("rings").cast("long").alias("n_rings"), F.aggregate(F.transform("rings", area), F.lit(0.0), lambda t, x: t + x).alias("area"))


def q_river_lines(spark, sf):
    r = K.river_lines(network(spark, sf), _lines(spark, sf))
    return r.select("river_id", F.size("lines").cast("long").alias("n_lines"), F.aggregate(F.transform("lines", lambda x: F.size(x)), F.lit(0), lambda t, x: t + x).cast("long").alias("n_vertices"))


def q_geo_block(spark, sf):
    net, lines = network(spark, sf), written(_lines(spark, sf))
    b = K.geo_block(K.river_lines(net, lines), K.outlet_points(net, lines))
    return b.select("river_id", *[F.round(c, 5).alias(c) for c in ("west", "south", "east", "north")])


def _mask(spark, sf):
    return _cells(spark, sf).filter("z % 4 = 1").select("r", "c")


def q_mask_edges(spark, sf):
    return raster.mask_edges(_mask(spark, sf))


def q_dilate(spark, sf):
    return raster.dilated(_mask(spark, sf), _cells(spark, sf), 2)


def q_fill_stats(spark, sf):
    cells = _cells(spark, sf)
    raised = raster.fill_pits(cells).withColumnRenamed("z", "filled").join(cells, ["r", "c"]).withColumn("tile", F.lit("t"))
    return tiled.statistics(raised).select("n_cells", "z_min", "z_max", F.round("raised", 6).alias("raised"))


def q_bilinear(spark, sf):
    """Heights at places between cells, from the four around each."""
    cells = _cells(spark, sf)
    places = cells.select("r", "c", (F.col("r") + (F.col("r") % 4) / 4).alias("pr"), (F.col("c") + (F.col("c") % 3) / 3).alias("pc"))
    return raster.sampled(cells, places).select("r", "c", F.round("height", 6).alias("height"))


def q_condition_stats(spark, sf):
    return tiled.statistics(_conditioned(spark, sf)).withColumn("raised", F.round("raised", 6))


def q_shaded(spark, sf):
    tiles = _cells(spark, sf).withColumn("tile", F.concat(F.lit("t"), F.floor(F.col("r") / 64).cast("string")))
    return D.shaded_relief(tiles, 20.0, 225.0, 20.0).select("tile", "r", "c", F.round("hillshade", 6).alias("hillshade"), "core", "cast")




def _here(spark, sf):
    return view(spark, sf, LINE).select("k", *[F.col(c).cast("double").alias(c) for c in ("lon1", "lat1", "lon2", "lat2")])


def _in_box():
    return [F.lit(v) for v in (-1.7, 42.0, 3.1, 43.15)]


def q_local(spark, sf):
    x, z = drawing.local_xz(F.col("lon1"), F.col("lat1"), *_in_box())
    return _here(spark, sf).select("k", F.round(x, 3).alias("x"), F.round(z, 3).alias("z"))


def q_camera(spark, sf):
    ex, ez = drawing.local_xz(F.col("lon1"), F.col("lat1"), *_in_box())
    ox, oz = drawing.local_xz(F.col("lon2"), F.col("lat2"), *_in_box())
    none = F.lit(None).cast("double")
    camera = F.when(F.col("k") % 3 == 0, F.struct((F.col("k") % 360).cast("double").alias("azimuth_deg"), F.when(F.col("k") % 2 == 0, 30.0).alias("elevation_deg"), none.alias("distance_m"), none.alias("target_height_m")))
    shot = drawing.camera_shot(ox, oz, ex, ez, F.lit(5000.0), camera)
    return _here(spark, sf).select("k", *[F.round(c, 3).alias(n) for n, c in shot.items()])


def q_tint(spark, sf):
    return _here(spark, sf).select("k", *[F.round(c, 6).alias(n) for n, c in zip(("red", "green", "blue"), drawing.height_tint((F.col("k") % 101) / 100), strict=True)])


def q_stroke(spark, sf):
    width, colour = drawing.tree_stroke((F.col("k") % 10).cast("int"))
    state = F.when(F.col("k") % 4 == 0, "selected").when(F.col("k") % 4 == 1, "upstream")
    return _here(spark, sf).select("k", width.alias("width"), colour.alias("colour"), F.round(drawing.map_width((F.col("k") % 10).cast("int"), state), 6).alias("map_width"))


def q_block(spark, sf):
    z, x, y = F.lit(5) + F.col("k") % 12, F.col("k") % 32, F.col("k") % 30
    b = drawing.tile_block_bounds(x, y, x + 1, y + 2, z)
    return _here(spark, sf).select("k", *[F.round(c, 2).alias(n) for n, c in zip(("west", "south", "east", "north"), b, strict=True)])


def q_flat(spark, sf):
    uv = lambda a, b: F.struct(F.round(F.col(a), 2).alias("u"), F.round(F.col(b), 2).alias("v"))
    lines = F.array(F.array(uv("lon1", "lat1"), uv("lon2", "lat2")), F.array(uv("lon2", "lat1"), uv("lon1", "lat2")))
    flat = drawing.flat_with_breaks(lines)
    return _here(spark, sf).select("k", F.size(flat).cast("long").alias("n"), F.size(F.filter(flat, lambda x: x.isNull())).cast("long").alias("n_breaks"), F.round(F.aggregate(flat, F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0))), 4).alias("total"))


_XZ = lambda lon, lat: (f"(({lon}) - 0.7::DOUBLE) * 111320.0::DOUBLE * cos(radians(42.575::DOUBLE))", f"(42.575::DOUBLE - ({lat})) * 110540.0::DOUBLE")
_L = f"SELECT k, CAST(lon1 AS DOUBLE) AS lon1, CAST(lat1 AS DOUBLE) AS lat1, CAST(lon2 AS DOUBLE) AS lon2, CAST(lat2 AS DOUBLE) AS lat2 FROM ({LINE})"
_EX, _EZ = _XZ("lon1", "lat1")
_OX, _OZ = _XZ("lon2", "lat2")
_END = "last_edge AS (SELECT p.river_id, arg_max(p.cleabs, (p.length_m, p.cleabs)) AS cleabs FROM part p JOIN outlet o ON o.river_id = p.river_id AND o.outlet = p.dst GROUP BY p.river_id)"
_WAYS = f"way AS ({_WAY}), flow_line AS (SELECT cleabs, CAST(CASE WHEN sens = 'Sens inverse' THEN lon2 ELSE lon1 END AS DOUBLE) AS x1, CAST(CASE WHEN sens = 'Sens inverse' THEN lat2 ELSE lat1 END AS DOUBLE) AS y1, CAST(CASE WHEN sens = 'Sens inverse' THEN lon1 ELSE lon2 END AS DOUBLE) AS x2, CAST(CASE WHEN sens = 'Sens inverse' THEN lat1 ELSE lat2 END AS DOUBLE) AS y2 FROM way)"
_UP = f"""{TREE_SQL}, {_WAYS}, {_END},
into_node AS (SELECT river_id, dst, arg_max(src, (length_m, cleabs)) AS src, arg_max(cleabs, (length_m, cleabs)) AS cleabs, max(length_m) AS m FROM part GROUP BY river_id, dst),
climb(river_id, src, cleabs, from_m, to_m) AS (
  SELECT o.river_id, i.src, i.cleabs, 0::DOUBLE, i.m::DOUBLE FROM outlet o JOIN into_node i ON i.river_id = o.river_id AND i.dst = o.outlet
  UNION ALL SELECT c.river_id, i.src, i.cleabs, to_m, to_m + i.m::DOUBLE FROM climb c JOIN into_node i ON i.river_id = c.river_id AND i.dst = c.src),
at_offset AS (SELECT c.river_id, o.offset_m, f.*, o.offset_m - c.from_m AS need, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) * 111320 AS m FROM climb c JOIN (VALUES (50000::DOUBLE), (250000::DOUBLE), (600000::DOUBLE)) o(offset_m) ON c.from_m < o.offset_m AND o.offset_m <= c.to_m JOIN flow_line f USING (cleabs))
SELECT river_id, offset_m, round(CASE WHEN m >= need AND m > 0 THEN x2 + (x1 - x2) * need / m WHEN m >= need THEN x2 ELSE x1 END, 5) AS lon, round(CASE WHEN m >= need AND m > 0 THEN y2 + (y1 - y2) * need / m WHEN m >= need THEN y2 ELSE y1 END, 5) AS lat FROM at_offset
UNION ALL SELECT river_id, 0::DOUBLE, round(x2, 5), round(y2, 5) FROM last_edge JOIN flow_line USING (cleabs)"""
_MASK = f"SELECT r, c FROM ({CELL}) WHERE z % 4 = 1"
_tint = lambda k: "CASE " + " ".join(f"WHEN t <= {b}::DOUBLE THEN {lo[k]}::DOUBLE + ({hi[k]}::DOUBLE - {lo[k]}::DOUBLE) * (t - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE)" for (a, lo), (b, hi) in zip(drawing.RAMP, drawing.RAMP[1:], strict=False)) + " END"
_TURN = 2 * math.pi * drawing.RADIUS
_SET = "(k % 3 = 0)"
_ELV = "radians(CASE WHEN k % 2 = 0 THEN 30.0::DOUBLE ELSE 20.0::DOUBLE END)"
_SHOT = f"s AS (SELECT *, sqrt(pow(ox - ex, 2) + pow(oz - ez, 2)) AS d FROM (SELECT k, {_EX} AS ex, {_EZ} AS ez, {_OX} AS ox, {_OZ} AS oz FROM ({_L})))"

QUERIES = {
    "outlet_point": (q_outlet_point, f"{TREE_SQL}, {_WAYS}, {_END} SELECT river_id, round(x2, 5) AS lon, round(y2, 5) AS lat FROM last_edge JOIN flow_line USING (cleabs)"),
    "upstream_offset_point": (q_offset_point, _UP),
    "longest_segment": (q_longest, f"{RIVER_SQL} SELECT river_id, dst, arg_max(cleabs, (length_m, cleabs)) AS cleabs FROM part GROUP BY river_id, dst"),
    "candidate_grid": (q_candidates, f"{RIVER_SQL} SELECT river_id, o::DOUBLE AS offset_m, CAST(t AS BIGINT) AS threshold, CAST(2 * i + j AS BIGINT) AS seq FROM river, (VALUES (0, 0), (1, 100), (2, 200), (3, 300), (4, 500), (5, 700), (6, 900), (7, 1100)) a(i, o), (VALUES (0, 200), (1, 1000)) b(j, t)"),
    "header_counts": (q_header, f"{RIVER_SQL} SELECT (SELECT count(*) FROM river) AS rivers, (SELECT count(name) FROM river) AS named, (SELECT count(*) FROM river WHERE river_id NOT IN (SELECT river_id FROM parent)) AS roots, (SELECT count(*) FROM river WHERE river_id NOT IN (SELECT parent_id FROM parent)) AS leaves, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM flow)) AS links"),
    "list_filters": (q_list, f"{RIVER_SQL} SELECT river_id, CAST(round(length_m / 1000, 2) AS DOUBLE) AS length_km FROM river WHERE name IS NOT NULL AND river_id NOT IN (SELECT river_id FROM parent) AND round(length_m / 1000, 2) >= 200"),
    "identified": (q_identified, f"{RIVER_SQL} SELECT river_id, NOT starts_with(river_id, 'UNNAMED:') AS identified FROM river"),
    "child_order": (q_child_order, f"{RIVER_SQL} SELECT parent_id, river_id, row_number() OVER (PARTITION BY parent_id ORDER BY length_m DESC, river_id) AS place FROM parent JOIN river USING (river_id)"),
    "tree_walk": (q_walk, f"{TREE_SQL}, walk_down(river_id, path) AS (SELECT river_id, '' FROM node WHERE parent_id IS NULL UNION ALL SELECT x.river_id, concat(w.path, CASE WHEN w.path = '' THEN '' ELSE '/' END, lpad(CAST(CASE WHEN x.role = 'mainline' THEN 0 ELSE x.ordinal END AS VARCHAR), 4, '0')) FROM walk_down w JOIN node x ON x.parent_id = w.river_id) SELECT river_id, path FROM walk_down WHERE path <> ''"),
    "osm_classify": (q_osm, f"SELECT id, {_LAYER} AS layer FROM ({ELEMENT})"),
    "osm_layers": (q_osm_layers, f"SELECT id, layer, kind, CASE WHEN layer IN ('peaks', 'cols') THEN TRY_CAST(replace(regexp_extract({_ELE}, '^\\s*(\\S+)', 1), ',', '.') AS DOUBLE) END AS ele, CASE WHEN layer = 'huts' THEN CASE WHEN {_has('tourism', 'alpine_hut')} THEN 'refuge' ELSE 'cabane' END END AS role FROM (SELECT *, {_LAYER} AS layer, {_OSM_KIND} AS kind FROM ({ELEMENT})) WHERE CASE WHEN layer IN ('peaks', 'cols', 'huts', 'settlements') THEN 'point' WHEN layer IN ('water_areas', 'glaciers') THEN 'area' ELSE 'line' END = kind AND layer IS NOT NULL"),
    "point_in_polygon": (q_inside, f"SELECT k, (k % 10 + 0.5) / 10 < 0.7 AND lon1 <> lon2 AND lat1 <> lat2 AS inside FROM ({LINE})"),
    "polygons_containing": (q_containing, "SELECT p, c_custkey AS q FROM (SELECT s_suppkey AS p, (s_suppkey * 37 % 400) / 10.0::DOUBLE + 0.05::DOUBLE AS lon, (s_suppkey * 11 % 350) / 10.0::DOUBLE + 0.05::DOUBLE AS lat FROM supplier) JOIN customer ON c_custkey % 40 = floor(lon) AND floor(c_custkey / 40) = floor(lat)"),
    "catchment_rings": (q_rings, None),
    "river_lines": (q_river_lines, None),
    "geo_block": (q_geo_block, None),
    "mask_edges": (q_mask_edges, f"WITH m AS ({_MASK}), e AS (SELECT c AS x1, r AS y1, c + 1 AS x2, r AS y2 FROM m UNION ALL SELECT c, r + 1, c + 1, r + 1 FROM m UNION ALL SELECT c, r, c, r + 1 FROM m UNION ALL SELECT c + 1, r, c + 1, r + 1 FROM m) SELECT x1, y1, x2, y2 FROM e GROUP BY ALL HAVING count(*) = 1"),
    "mask_dilate": (q_dilate, f"WITH cell AS ({CELL}), m AS (SELECT r, c FROM cell WHERE z % 4 = 1) SELECT r, c FROM cell a WHERE EXISTS (SELECT 1 FROM m WHERE pow(m.r - a.r, 2) + pow(m.c - a.c, 2) <= 4)"),
    "fill_stats": (q_fill_stats, f"WITH cell AS ({CELL}), low AS (SELECT a.r, a.c, min(b.z) AS m, count(*) AS n FROM cell a JOIN cell b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY a.r, a.c) SELECT count(*) AS n_cells, min(z) AS z_min, max(z) AS z_max, round(avg(CASE WHEN n = 8 AND m - z > 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS raised FROM cell LEFT JOIN low USING (r, c)"),
    "bilinear_sample": (q_bilinear, f"WITH cell AS ({CELL}), box AS (SELECT max(r) AS r1, max(c) AS c1 FROM cell), q AS (SELECT r, c, least(r + r % 4 / 4.0::DOUBLE, r1) AS y, least(c + c % 3 / 3.0::DOUBLE, c1) AS x, r1, c1 FROM cell, box), b AS (SELECT *, least(floor(y), r1 - 1) AS i, least(floor(x), c1 - 1) AS j FROM q) SELECT b.r, b.c, round((k.z * (1 - (x - j)) + l.z * (x - j)) * (1 - (y - i)) + (m.z * (1 - (x - j)) + n.z * (x - j)) * (y - i), 6) AS height FROM b JOIN cell k ON k.r = i AND k.c = j JOIN cell l ON l.r = i AND l.c = j + 1 JOIN cell m ON m.r = i + 1 AND m.c = j JOIN cell n ON n.r = i + 1 AND n.c = j + 1"),
    "condition_stats": (q_condition_stats, f"{FLOOD} SELECT tile, count(*) AS n_cells, min(z) AS z_min, max(z) AS z_max, round(avg(CASE WHEN filled - z > 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS raised, max(acc) AS most_acc, avg(CASE WHEN filled - z > 0.5 THEN 1.0::DOUBLE ELSE 0 END) > 0.05 AS much_raised FROM done GROUP BY tile"),
    "shaded_relief": (q_shaded, None),
    "local_xz": (q_local, f"SELECT k, round({_EX}, 3) AS x, round({_EZ}, 3) AS z FROM ({_L})"),
    "camera_shot": (q_camera, f"WITH {_SHOT} SELECT k, round(CASE WHEN {_SET} THEN ox + 3000 * cos({_ELV}) * sin(radians(k % 360)) ELSE ex - (ox - ex) / CASE WHEN d > 0 THEN d ELSE 1 END * 750 END, 3) AS x, round(CASE WHEN {_SET} THEN 150 + 3000 * sin({_ELV}) ELSE 1400 END, 3) AS y, round(CASE WHEN {_SET} THEN oz + 3000 * cos({_ELV}) * cos(radians(k % 360)) ELSE ez - (oz - ez) / CASE WHEN d > 0 THEN d ELSE 1 END * 750 END, 3) AS z, round(CASE WHEN {_SET} THEN 150.0::DOUBLE ELSE 168.0::DOUBLE END, 3) AS target_y FROM s"),
    "height_tint": (q_tint, f"SELECT k, round({_tint(0)}, 6) AS red, round({_tint(1)}, 6) AS green, round({_tint(2)}, 6) AS blue FROM (SELECT k, (k % 101) / 100.0::DOUBLE AS t FROM ({LINE}))"),
    "stroke_style": (q_stroke, "SELECT k, w AS width, col AS colour, round(CASE WHEN k % 4 = 0 THEN greatest(m * 1.7::DOUBLE, 2.2::DOUBLE) WHEN k % 4 = 1 THEN greatest(m * 1.25::DOUBLE, 2.2::DOUBLE) ELSE m END, 6) AS map_width FROM (SELECT o_orderkey AS k, 1.1::DOUBLE + 0.7::DOUBLE * (least(7, greatest(o_orderkey % 10, 1)) - 1) AS m, greatest(1, least(7, o_orderkey % 10)) AS o FROM orders) JOIN (VALUES " + ", ".join(f"({i}, {w}::DOUBLE, '{c}')" for i, (w, c) in enumerate(drawing.STROKES, 1)) + ") s(o, w, col) USING (o)"),
    "tile_block_bounds": (q_block, f"SELECT k, round(x * t - {_TURN / 2!r}::DOUBLE, 2) AS west, round({_TURN / 2!r}::DOUBLE - (y + 3) * t, 2) AS south, round((x + 2) * t - {_TURN / 2!r}::DOUBLE, 2) AS east, round({_TURN / 2!r}::DOUBLE - y * t, 2) AS north FROM (SELECT k, k % 32 AS x, k % 30 AS y, {_TURN!r}::DOUBLE / pow(2.0::DOUBLE, 5 + k % 12) AS t FROM ({LINE}))"),
    "flat_with_breaks": (q_flat, f"SELECT k, CAST(12 AS BIGINT) AS n, CAST(4 AS BIGINT) AS n_breaks, round(2 * (round(lon1, 2) + round(lat1, 2) + round(lon2, 2) + round(lat2, 2)), 4) AS total FROM ({_L})"),
}
