"""Queries on geometry, basins, relief and terrain hydrology, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.functions import drawing, geo
from rillway.operators import nearest, raster, relief, tiled, watershed
from rillway.operators import rivers as R

from rillway.plans.river_queries import RIVER_SQL, network
from rillway.plans.tables import written
from rillway.plans.views import BASIN, CELL, LINE, ROUGH, view


def _cells(spark, sf):
    return view(spark, sf, CELL)


def _points(df, *pairs):
    return df.withColumn("line", F.array(*[F.struct(F.col(a).cast("double").alias("lon"), F.col(b).cast("double").alias("lat")) for a, b in pairs]))


def q_length(spark, sf):
    lines = _points(view(spark, sf, LINE), ("lon1", "lat1"), ("lon2", "lat2"))
    return lines.select("k", F.round(geo.line_length(F.col("line")), 2).alias("length_m"))


def q_lambert(spark, sf):
    x, y = geo.lambert93(F.col("lon1").cast("double"), F.col("lat1").cast("double"))
    return view(spark, sf, LINE).select("k", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def q_area(spark, sf):
    tri = _points(view(spark, sf, LINE), ("lon1", "lat1"), ("lon2", "lat1"), ("lon2", "lat2"), ("lon1", "lat1"))
    return tri.select("k", F.round(geo.ring_area_km2(F.col("line")), 3).alias("km2"))


def q_tile(spark, sf):
    z = F.lit(5) + F.col("k") % 12
    x, y = geo.tile_xy(F.col("lon1").cast("double"), F.col("lat1").cast("double"), z)
    return view(spark, sf, LINE).select("k", z.cast("long").alias("zoom"), x.alias("tx"), y.alias("ty"))


def q_zoom(spark, sf):
    lon, lat = F.col("lon1").cast("double"), F.col("lat1").cast("double")
    w = 0.001 + (F.col("k") % 100) * 0.02
    return view(spark, sf, LINE).select("k", geo.pick_zoom(lon, lat, lon + w, lat + w, 1024).cast("long").alias("zoom"))


def q_bbox_pad(spark, sf):
    v = view(spark, sf, LINE)
    w, e = F.least("lon1", "lon2").cast("double"), F.greatest("lon1", "lon2").cast("double")
    s, n = F.least("lat1", "lat2").cast("double"), F.greatest("lat1", "lat2").cast("double")
    box = geo.padded_bbox(w, s, e, n, F.col("lon1").cast("double"), F.col("lat1").cast("double"))
    return v.select("k", *[(F.round(b + 1e-8, 5) + 0.0).alias(name) for b, name in zip(box, ("w", "s", "e", "n"), strict=True)])


def q_nearest(spark, sf):
    """For each supplier's place the nearest of all lines."""
    spark.read.parquet(f"{sf}/supplier.parquet").createOrReplaceTempView("_rillway_supplier")
    pts = spark.sql("SELECT s_suppkey AS p, -1.7 + (s_suppkey * 37 % 480) * 0.01D AS lon, 42.0 + (s_suppkey * 11 % 115) * 0.01D AS lat FROM _rillway_supplier")
    px, py = geo.lambert93(F.col("lon"), F.col("lat"))
    v = view(spark, sf, LINE).select("k", *[F.col(c).cast("double").alias(c) for c in ("lon1", "lat1", "lon2", "lat2")])
    x1, y1 = geo.lambert93(F.col("lon1"), F.col("lat1"))
    x2, y2 = geo.lambert93(F.col("lon2"), F.col("lat2"))
    return nearest.nearest_lines(pts.select("p", px.alias("px"), py.alias("py")), v.select("k", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def _xy(lon: str, lat: str) -> tuple[str, str]:
    s = f"sin(radians({lat}))"
    iso = f"(atanh({s}) - {geo.E} * atanh({geo.E} * {s}))"
    r, turn = f"({geo.C} * exp(-{geo.N} * {iso}))", f"({geo.N} * radians({lon} - 3.0))"
    return f"({geo.XS} + {r} * sin({turn}))", f"({geo.YS} - {r} * cos({turn}))"


X1, Y1 = _xy("CAST(lon1 AS DOUBLE)", "CAST(lat1 AS DOUBLE)")
X2, Y2 = _xy("CAST(lon2 AS DOUBLE)", "CAST(lat2 AS DOUBLE)")
XB, YB = _xy("CAST(lon2 AS DOUBLE)", "CAST(lat1 AS DOUBLE)")
PX, PY = _xy("lon", "lat")


def _tile(lon: str, lat: str, z: str) -> tuple[str, str]:
    n = f"pow(2.0, {z})"
    return (
        f"CAST(greatest(0, least(floor(({lon} + 180.0) / 360.0 * {n}), {n} - 1)) AS BIGINT)",
        f"CAST(greatest(0, least(floor((1.0 - asinh(tan(radians({lat}))) / pi()) / 2.0 * {n}), {n} - 1)) AS BIGINT)",
    )


TX, TY = _tile("CAST(lon1 AS DOUBLE)", "CAST(lat1 AS DOUBLE)", "(5 + k % 12)")
ZX0, ZY0 = _tile("lon", "lat + w", "z")
ZX1, ZY1 = _tile("lon + w", "lat", "z")


def _basins(spark, sf):
    b = view(spark, sf, BASIN)
    return b.withColumn("area_km2", F.round((F.col("basin") % 37 + 1) * 0.5, 1)).withColumn("ring", F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]))


def _members(spark, sf):
    """Only rivers with sub-basins are followed down, and each is a member of all that it passes."""
    net, basins = network(spark, sf), _basins(spark, sf)
    pairs = R.downstream(net, basins.join(net.rivers, "river_id", "left_semi"))
    return watershed.membership(basins, pairs, net.rivers)


def q_membership(spark, sf):
    return _members(spark, sf).select("river_id", "basin")


def _areas(spark, sf):
    net = network(spark, sf)
    return watershed.drainage_areas(net.rivers, net.flows, _basins(spark, sf))


def q_basin_area(spark, sf):
    return _areas(spark, sf).select("river_id", "area_km2", "n_sub_basins")


def q_dissolve(spark, sf):
    return watershed.dissolve_edges(_members(spark, sf))


def _cache(spark, sf):
    n = F.expr("cast(substring(river_id, 5) as bigint)")
    r = network(spark, sf).rivers.filter("river_id like 'CDE%'").select("river_id", n.alias("n"))
    return r.filter("n % 3 = 0").select("river_id", F.when(F.col("n") % 9 == 0, "dem").when(F.col("n") % 9 == 3, "discarded").otherwise("undetermined").alias("source"), ((F.col("n") % 400) * 0.5).alias("area_km2"))


def q_precedence(spark, sf):
    return watershed.precedence(network(spark, sf).rivers, _areas(spark, sf), _cache(spark, sf))


def q_never(spark, sf):
    return watershed.never_gets_catchment(network(spark, sf).rivers, _areas(spark, sf), _cache(spark, sf))


def q_gate(spark, sf):
    return watershed.area_gate(_areas(spark, sf)).select("river_id", "source")


def q_resume(spark, sf):
    return network(spark, sf).rivers.join(_cache(spark, sf), "river_id", "left_anti").select("river_id")


def q_batch(spark, sf):
    return _cache(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def q_gradient(spark, sf):
    return relief.gradient(_cells(spark, sf)).select("r", "c", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


def _lit(spark, sf):
    return relief.lit(relief.gradient(_cells(spark, sf)))


def q_hillshade(spark, sf):
    return _lit(spark, sf).select("r", "c", F.round("hillshade", 6).alias("hillshade"))


def q_slope(spark, sf):
    return _lit(spark, sf).select("r", "c", F.round("slope", 6).alias("slope"))


def q_core(spark, sf):
    return relief.lit(relief.gradient(_cells(spark, sf), 5.0), 90.0, 20.0).select("r", "c", "core")


def q_compose(spark, sf):
    return relief.composed(_lit(spark, sf)).select("r", "c", F.round("relief", 6).alias("relief"))


def q_blur(spark, sf):
    return relief.box_blur(_cells(spark, sf), 2).select("r", "c", F.round("blurred", 6).alias("blurred"))


def q_shadow(spark, sf):
    return relief.cast_shadow_east(_cells(spark, sf), 10.3).select("r", "c", "shadow")


def q_pits(spark, sf):
    return raster.fill_pits(_cells(spark, sf))


def _d8(spark, sf):
    return written(raster.d8(_cells(spark, sf)))


def q_d8(spark, sf):
    return _d8(spark, sf).withColumn("d", F.coalesce("d", F.lit(-1)))


def _acc(spark, sf):
    a = raster.accumulation(_d8(spark, sf))
    return a.select(F.split_part("cell", F.lit(":"), F.lit(1)).cast("int").alias("r"), F.split_part("cell", F.lit(":"), F.lit(2)).cast("int").alias("c"), "acc")


def q_acc(spark, sf):
    return _acc(spark, sf)


def q_catchment(spark, sf):
    return raster.catchment(_d8(spark, sf), 0, 25)


def q_mask(spark, sf):
    return raster.channel_mask(_acc(spark, sf), 8)


def q_snap(spark, sf):
    return raster.snap(raster.channel_mask(_acc(spark, sf), 8), 12.0, 7.0).withColumn("d2", F.col("d2").cast("double"))


def q_component(spark, sf):
    return raster.largest_component(_cells(spark, sf).filter("z % 4 = 1"))


def q_quantise(spark, sf):
    return raster.quantised(_cells(spark, sf))


def q_contours(spark, sf):
    return raster.contour_crossings(_cells(spark, sf))


_CAND = "SELECT o_custkey AS river_id, o_orderkey AS seq, (o_orderkey * 7919 % 1000) / 1000.0D AS frac FROM orders"


def q_candidate(spark, sf):
    return raster.best_candidate(view(spark, sf, _CAND))


def _conditioned(spark, sf):
    """The terrain, with noise that makes pits and lakes across its tiles' borders, conditioned in tiles of 12 by 13 cells."""
    return tiled.condition(view(spark, sf, ROUGH).withColumn("tile", F.concat_ws("_", F.floor(F.col("r") / 12).cast("string"), F.floor(F.col("c") / 13).cast("string"))))


def q_condition(spark, sf):
    return _conditioned(spark, sf).select("tile", "r", "c", "filled", "d", "acc")


def q_slug(spark, sf):
    spark.read.parquet(f"{sf}/customer.parquet").createOrReplaceTempView("_rillway_customer")
    return spark.sql("SELECT c_custkey AS k, concat(\"L'Échez du \", c_name, ' -- Ça ', c_mktsegment) AS t FROM _rillway_customer").select("k", geo.slug(F.col("t")).alias("slug"))


def q_uv(spark, sf):
    """The lines draped over their box, a twentieth of a degree apart; all moved by a little, so that nothing lies half-way between two roundings."""
    lines = _points(view(spark, sf, LINE), ("lon1", "lat1"), ("lon2", "lat2"))
    box = [F.lit(v) for v in (-1.7 - 4.8e-8, 42.0 - 1.15e-8, 3.1 - 4.8e-8, 43.15 - 1.15e-8)]
    return lines.select("k", F.explode(drawing.draped(F.col("line"), *box, 0.05)).alias("p")).select("k", "p.u", "p.v")


_NB = "nb AS (SELECT a.r, a.c, a.z, b.z AS nz, d.d, d.dr, d.dc FROM cell a CROSS JOIN (VALUES (0,0,1),(1,1,1),(2,1,0),(3,1,-1),(4,0,-1),(5,-1,-1),(6,-1,0),(7,-1,1)) d(d,dr,dc) JOIN cell b ON b.r = a.r + d.dr AND b.c = a.c + d.dc)"
_D8 = f"WITH RECURSIVE cell AS ({CELL}), {_NB}, fall AS (SELECT r, c, d, dr, dc, (z - nz) / CASE WHEN d % 2 = 1 THEN sqrt(2.0) ELSE 1 END AS f FROM nb), dir AS (SELECT r, c, arg_min((d, dr, dc), (-f, d)) AS m FROM fall WHERE f > 0 GROUP BY r, c), e AS (SELECT r, c, r + m[2] AS r2, c + m[3] AS c2 FROM dir), thru(r0, c0, r, c) AS (SELECT r, c, r, c FROM cell UNION ALL SELECT r0, c0, r2, c2 FROM thru t JOIN e ON e.r = t.r AND e.c = t.c)"
_ACC = f"{_D8}, acc AS (SELECT r, c, count(*) AS acc FROM thru GROUP BY r, c)"
#: One flood of the whole terrain, without tiles: levels and steps over flats by relaxing until nothing changes.
FLOOD = f"""WITH RECURSIVE cell AS ({ROUGH}), {_NB}, edge AS (SELECT r, c, z, count(nz) < 8 AS e FROM cell LEFT JOIN nb USING (r, c, z) GROUP BY r, c, z),
lev(r, c, f) USING KEY (r, c) AS (
  SELECT r, c, CASE WHEN e THEN z ELSE 1e18::DOUBLE END FROM edge
  UNION SELECT n.r, n.c, min(greatest(n.z, t.f)) FROM lev t JOIN nb n ON n.r + n.dr = t.r AND n.c + n.dc = t.c JOIN recurring.lev o ON o.r = n.r AND o.c = n.c GROUP BY n.r, n.c HAVING min(greatest(n.z, t.f)) < min(o.f)),
nf AS MATERIALIZED (SELECT n.r, n.c, n.d, n.dr, n.dc, a.f, b.f AS nf FROM nb n JOIN lev a ON a.r = n.r AND a.c = n.c JOIN lev b ON b.r = n.r + n.dr AND b.c = n.c + n.dc),
low AS (SELECT r, c, min(nf) AS m, count(*) AS k FROM nf GROUP BY r, c),
st(r, c, s) USING KEY (r, c) AS (
  SELECT l.r, l.c, CASE WHEN w.m < l.f OR w.k IS NULL OR w.k < 8 THEN 0 ELSE 1000000000 END FROM lev l LEFT JOIN low w ON w.r = l.r AND w.c = l.c
  UNION SELECT n.r, n.c, min(t.s + 1) FROM st t JOIN nf n ON n.r + n.dr = t.r AND n.c + n.dc = t.c AND n.f = n.nf JOIN recurring.st o ON o.r = n.r AND o.c = n.c GROUP BY n.r, n.c HAVING min(t.s + 1) < min(o.s)),
ht AS MATERIALIZED (SELECT r, c, f, f + CASE WHEN s > 0 AND s < 1000000000 THEN s * 1e-7::DOUBLE ELSE 0 END AS h FROM lev JOIN st USING (r, c)),
fall AS (SELECT n.r, n.c, n.d, n.dr, n.dc, (a.h - b.h) / CASE WHEN n.d % 2 = 1 THEN sqrt(2.0) ELSE 1 END AS x FROM nb n JOIN ht a ON a.r = n.r AND a.c = n.c JOIN ht b ON b.r = n.r + n.dr AND b.c = n.c + n.dc),
dir AS MATERIALIZED (SELECT r, c, arg_min((d, dr, dc), (-x, d)) AS m FROM fall WHERE x > 0 GROUP BY r, c),
thru(r0, c0, r, c) AS (SELECT r, c, r, c FROM cell UNION ALL SELECT t.r0, t.c0, t.r + m[2], t.c + m[3] FROM thru t JOIN dir ON dir.r = t.r AND dir.c = t.c),
acc AS (SELECT r, c, count(*) AS acc FROM thru GROUP BY r, c),
done AS (SELECT concat(r // 12, '_', c // 13) AS tile, r, c, z, f AS filled, coalesce(m[1], -1) AS d, acc FROM cell JOIN ht USING (r, c) JOIN acc USING (r, c) LEFT JOIN dir USING (r, c))"""
_GRAD = f"g AS (SELECT *, (coalesce(lead(z) OVER x, z) - coalesce(lag(z) OVER x, z)) / (CASE WHEN lead(z) OVER x IS NULL OR lag(z) OVER x IS NULL THEN 1 ELSE 2 END * CELLSIZE) AS dx, -(coalesce(lead(z) OVER y, z) - coalesce(lag(z) OVER y, z)) / (CASE WHEN lead(z) OVER y IS NULL OR lag(z) OVER y IS NULL THEN 1 ELSE 2 END * CELLSIZE) AS dy FROM ({CELL}) WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r))"
G20, G5 = _GRAD.replace("CELLSIZE", "20.0::DOUBLE"), _GRAD.replace("CELLSIZE", "5.0::DOUBLE")


def _light(az, alt):
    e, n, u = relief.sun(az, alt)
    return f"(({u!r}::DOUBLE - dx * {e!r}::DOUBLE - dy * {n!r}::DOUBLE) / sqrt(dx * dx + dy * dy + 1))"


_SLOPE = "(atan(sqrt(dx * dx + dy * dy)) / (pi() / 2))"
_HS = f"greatest(0, least(1, {_light(315.0, 45.0)}))"
_DROP = f"{20.0 * __import__('math').tan(__import__('math').radians(10.3))!r}::DOUBLE"
_MEM = f"{RIVER_SQL}, basin AS ({BASIN}), mem AS (SELECT e.river_id, b.basin, b.x, b.y, round((b.basin % 37 + 1) * 0.5::DOUBLE, 1) AS km2 FROM (SELECT river_id, river_id AS anc FROM river UNION SELECT river_id, ancestor FROM above) e JOIN basin b ON b.river_id = e.anc), area AS (SELECT river_id, round(sum(km2), 1) AS area_km2, count(*) AS n_sub_basins FROM mem GROUP BY river_id), num AS (SELECT river_id, CAST(substring(river_id, 5) AS BIGINT) AS n FROM river WHERE river_id LIKE 'CDE%'), cache AS (SELECT river_id, CASE WHEN n % 9 = 0 THEN 'dem' WHEN n % 9 = 3 THEN 'discarded' ELSE 'undetermined' END AS source, (n % 400) * 0.5::DOUBLE AS km2 FROM num WHERE n % 3 = 0)"
_BLUR = f"WITH cell AS ({CELL}), ends AS (SELECT r, min(c) AS lo, max(c) AS hi FROM cell GROUP BY r), rows_ AS (SELECT a.r, a.c, sum(b.z) / 5 AS z FROM cell a JOIN ends e ON e.r = a.r CROSS JOIN (VALUES (-2),(-1),(0),(1),(2)) k(k) JOIN cell b ON b.r = a.r AND b.c = least(greatest(a.c + k, e.lo), e.hi) GROUP BY a.r, a.c), vend AS (SELECT c, min(r) AS lo, max(r) AS hi FROM rows_ GROUP BY c) SELECT a.r, a.c, round(sum(b.z) / 5, 6) AS blurred FROM rows_ a JOIN vend e ON e.c = a.c CROSS JOIN (VALUES (-2),(-1),(0),(1),(2)) k(k) JOIN rows_ b ON b.c = a.c AND b.r = least(greatest(a.r + k, e.lo), e.hi) GROUP BY a.r, a.c"
_SEGD = f"""WITH v AS (SELECT k, {X1} AS x1, {Y1} AS y1, {X2} AS x2, {Y2} AS y2 FROM ({LINE})),
p0 AS (SELECT s_suppkey AS p, -1.7::DOUBLE + (s_suppkey * 37 % 480) * 0.01::DOUBLE AS lon, 42.0::DOUBLE + (s_suppkey * 11 % 115) * 0.01::DOUBLE AS lat FROM supplier),
p AS (SELECT p, {PX} AS px, {PY} AS py FROM p0),
t AS (SELECT p, k, px, py, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0))) AS t FROM p CROSS JOIN v),
d AS (SELECT p, k, round(sqrt(pow(px - x1 - t * dx, 2) + pow(py - y1 - t * dy, 2)), 3) AS metres FROM t)
SELECT p, arg_min(k, (metres, k)) AS k, min(metres) AS metres FROM d GROUP BY p"""

QUERIES = {
    "line_length_l93": (q_length, f"SELECT k, round(sqrt(pow({X1} - {X2}, 2) + pow({Y1} - {Y2}, 2)), 2) AS length_m FROM ({LINE})"),
    "lambert93_xy": (q_lambert, f"SELECT k, round({X1}, 3) AS x, round({Y1}, 3) AS y FROM ({LINE})"),
    "polygon_area_km2": (q_area, f"SELECT k, round(abs(({X1} * {YB} - {XB} * {Y1}) + ({XB} * {Y2} - {X2} * {YB}) + ({X2} * {Y1} - {X1} * {Y2})) / 2e6, 3) AS km2 FROM ({LINE})"),
    "tile_xyz": (q_tile, f"SELECT k, 5 + k % 12 AS zoom, {TX} AS tx, {TY} AS ty FROM ({LINE})"),
    "zoom_pick": (q_zoom, f"SELECT k, coalesce(max(z) FILTER (({ZX1} - {ZX0} + 1) * ({ZY1} - {ZY0} + 1) <= 64 AND (greatest({ZX1} - {ZX0} + 1, {ZY1} - {ZY0} + 1) * 256 >= 1024 OR z <= 6)), 6) AS zoom FROM (SELECT k, CAST(lon1 AS DOUBLE) AS lon, CAST(lat1 AS DOUBLE) AS lat, 0.001::DOUBLE + (k % 100) * 0.02::DOUBLE AS w FROM ({LINE})), range(5, 17) t(z) GROUP BY k"),
    "catchment_bbox": (q_bbox_pad, f"SELECT k, round(w - ww * CASE WHEN lon > (w + e) / 2 THEN 0.25 ELSE 0.15 END + 1e-8::DOUBLE, 5) + 0.0 AS w, round(s - hh * CASE WHEN lat > (s + n) / 2 THEN 0.25 ELSE 0.15 END + 1e-8::DOUBLE, 5) + 0.0 AS s, round(e + ww * CASE WHEN lon <= (w + e) / 2 THEN 0.25 ELSE 0.15 END + 1e-8::DOUBLE, 5) + 0.0 AS e, round(n + hh * CASE WHEN lat <= (s + n) / 2 THEN 0.25 ELSE 0.15 END + 1e-8::DOUBLE, 5) + 0.0 AS n FROM (SELECT *, greatest(e - w, 1e-4::DOUBLE) AS ww, greatest(n - s, 1e-4::DOUBLE) AS hh FROM (SELECT k, CAST(lon1 AS DOUBLE) AS lon, CAST(lat1 AS DOUBLE) AS lat, CAST(least(lon1, lon2) AS DOUBLE) AS w, CAST(least(lat1, lat2) AS DOUBLE) AS s, CAST(greatest(lon1, lon2) AS DOUBLE) AS e, CAST(greatest(lat1, lat2) AS DOUBLE) AS n FROM ({LINE})))"),
    "nearest_segment": (q_nearest, _SEGD),
    "stream_uv": (q_uv, f"SELECT k, round((lon1 + (lon2 - lon1) * i / n + 1.7) / 4.8 + 1e-8::DOUBLE, 5) AS u, round((lat1 + (lat2 - lat1) * i / n - 42.0) / 1.15 + 1e-8::DOUBLE, 5) AS v FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT k, CAST(lon1 AS DOUBLE) AS lon1, CAST(lat1 AS DOUBLE) AS lat1, CAST(lon2 AS DOUBLE) AS lon2, CAST(lat2 AS DOUBLE) AS lat2, CAST(greatest(1, floor(sqrt(pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2)) / 0.05::DOUBLE + 1e-9::DOUBLE)) AS BIGINT) AS n FROM ({LINE}))) WHERE u BETWEEN -0.05 AND 1.05 AND v BETWEEN -0.05 AND 1.05"),
    "slug": (q_slug, "SELECT c_custkey AS k, trim(regexp_replace(lower(strip_accents(concat('L''Échez du ', c_name, ' -- Ça ', c_mktsegment))), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer"),
    "basin_membership": (q_membership, f"{_MEM} SELECT river_id, basin FROM mem"),
    "basin_area": (q_basin_area, f"{_MEM} SELECT river_id, area_km2, n_sub_basins FROM area"),
    "basin_dissolve_edges": (q_dissolve, f"{_MEM}, e AS (SELECT river_id, x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM mem UNION ALL SELECT river_id, x, y + 1, x + 1, y + 1 FROM mem UNION ALL SELECT river_id, x, y, x, y + 1 FROM mem UNION ALL SELECT river_id, x + 1, y, x + 1, y + 1 FROM mem) SELECT river_id, x1, y1, x2, y2 FROM e GROUP BY ALL HAVING count(*) % 2 = 1"),
    "catchment_precedence": (q_precedence, f"{_MEM} SELECT r.river_id, CASE WHEN a.area_km2 BETWEEN 5 AND 150 THEN 'basins' WHEN c.source = 'dem' THEN 'dem' END AS shown, CASE WHEN a.area_km2 BETWEEN 5 AND 150 THEN a.area_km2 WHEN c.source = 'dem' THEN c.km2 END AS km2 FROM river r LEFT JOIN area a USING (river_id) LEFT JOIN cache c ON c.river_id = r.river_id"),
    "never_gets_catchment": (q_never, f"{_MEM} SELECT r.river_id FROM river r JOIN cache c USING (river_id) WHERE c.source <> 'dem' AND r.river_id NOT IN (SELECT parent_id FROM parent) AND r.river_id NOT IN (SELECT river_id FROM area)"),
    "area_gate": (q_gate, f"{_MEM} SELECT river_id, CASE WHEN area_km2 BETWEEN 5 AND 150 THEN 'dem' ELSE 'discarded' END AS source FROM area"),
    "resume_anti_join": (q_resume, f"{_MEM} SELECT river_id FROM river WHERE river_id NOT IN (SELECT river_id FROM cache)"),
    "batch_counts": (q_batch, f"{_MEM} SELECT source, count(*) AS n FROM cache GROUP BY source"),
    "dem_gradient": (q_gradient, f"WITH {G20} SELECT r, c, round(dx, 6) AS dx, round(dy, 6) AS dy FROM g"),
    "hillshade": (q_hillshade, f"WITH {G20} SELECT r, c, round({_HS}, 6) AS hillshade FROM g"),
    "slope": (q_slope, f"WITH {G20} SELECT r, c, round({_SLOPE}, 6) AS slope FROM g"),
    "core_shadow": (q_core, f"WITH {G5} SELECT r, c, {_light(90.0, 20.0)} <= 0 AS core FROM g"),
    "compose_relief": (q_compose, f"WITH {G20} SELECT r, c, round(greatest(0, least(1, (1 - 0.55::DOUBLE) * {_HS} + 0.55::DOUBLE * (1 - {_SLOPE}))), 6) AS relief FROM g"),
    "box_blur": (q_blur, _BLUR),
    "cast_shadow_east": (q_shadow, f"WITH l AS (SELECT r, c, z - c * {_DROP} AS l FROM ({CELL})) SELECT r, c, coalesce(max(l) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > l, false) AS shadow FROM l"),
    "fill_pits": (q_pits, f"WITH cell AS ({CELL}), {_NB}, low AS (SELECT r, c, min(nz) AS m, count(*) AS n FROM nb GROUP BY r, c) SELECT r, c, CASE WHEN n = 8 AND z < m THEN m ELSE z END AS z FROM cell LEFT JOIN low USING (r, c)"),
    "d8_direction": (q_d8, f"{_D8} SELECT r, c, coalesce(m[1], -1) AS d FROM cell LEFT JOIN dir USING (r, c)"),
    "flow_accumulation": (q_acc, f"{_ACC} SELECT r, c, acc FROM acc"),
    "d8_catchment": (q_catchment, f"{_D8} SELECT concat(r0, ':', c0) AS cell FROM thru WHERE r = 0 AND c = 25"),
    "channel_mask": (q_mask, f"{_ACC} SELECT r, c, acc FROM acc WHERE acc > 8"),
    "snap_channel": (q_snap, f"{_ACC} SELECT r, c, CAST((r - 12) * (r - 12) + (c - 7) * (c - 7) AS DOUBLE) AS d2 FROM acc WHERE acc > 8 ORDER BY d2, r, c LIMIT 1"),
    "largest_component": (q_component, f"WITH RECURSIVE k AS (SELECT r, c FROM ({CELL}) WHERE z % 4 = 1), reach(r0, c0, r, c) AS (SELECT r, c, r, c FROM k UNION SELECT r0, c0, k.r, k.c FROM reach x JOIN k ON abs(k.r - x.r) + abs(k.c - x.c) = 1), lab AS (SELECT r, c, min((r0, c0)) AS l FROM reach GROUP BY r, c) SELECT r, c FROM lab WHERE l = (SELECT l FROM (SELECT l, count(*) AS n FROM lab GROUP BY l) ORDER BY n DESC, l LIMIT 1)"),
    "quantise_height": (q_quantise, f"WITH cell AS ({CELL}), q AS (SELECT r, c, CAST(round_even((z - (SELECT min(z) FROM cell)) / greatest((SELECT max(z) - min(z) FROM cell), 1e-9) * 65535, 0) AS INT) AS q FROM cell) SELECT r, c, q & 255 AS low, q >> 8 AS high FROM q"),
    "contour_crossings": (q_contours, f"WITH cell AS ({CELL}), {_NB} SELECT r, c, d, k * 20.0::DOUBLE AS level, round((k * 20.0::DOUBLE - z) / (nz - z), 6) AS share FROM (SELECT *, unnest(range(CAST(floor(least(z, nz) / 20) + 1 AS BIGINT), CAST(ceil(greatest(z, nz) / 20) AS BIGINT))) AS k FROM nb WHERE d IN (0, 2))"),
    "candidate_best": (q_candidate, f"WITH cand AS (SELECT o_custkey AS river_id, o_orderkey AS seq, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS frac FROM orders), stop AS (SELECT river_id, min(seq) AS s FROM cand WHERE frac >= 0.99 GROUP BY river_id), b AS (SELECT c.river_id, arg_min((seq, frac), (-frac, seq)) AS b FROM cand c LEFT JOIN stop USING (river_id) WHERE s IS NULL OR seq <= s GROUP BY c.river_id) SELECT river_id, b[1] AS seq, b[2] AS frac FROM b WHERE b[2] >= 0.9"),
    "fill_depressions": (q_condition, f"{FLOOD} SELECT tile, r, c, filled, CAST(d AS INT) AS d, acc FROM done"),
}
