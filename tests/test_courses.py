"""Courses, map layers, drawn values, delineation and drawn terrain, against hand-made cases and brute force."""

import base64
import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillway.functions import delineation, drawing, geo, kernels, terrain
from rillway.operators import courses as K
from rillway.operators import delineate as D
from rillway.operators import rivers as R
from rillway.operators import segments as S
from rillway.sources import osm

SCHEMA = "cleabs string, ini string, fin string, sens string, ord string, river_key string, toponyme string, fictif boolean, length_m double, line array<struct<lon:double,lat:double>>"


def network(spark, rows):
    full = [(c, a, b, s, "1", key, key, False, m, [{"lon": float(x), "lat": float(y)} for x, y in line]) for c, a, b, s, key, m, line in rows]
    raw = spark.createDataFrame(full, SCHEMA)
    return R.build(S.graph(raw)), K.downstream_lines(raw).cache()


@pytest.fixture(scope="module")
def lake(spark):
    # East along the equator; the middle one is drawn against its flow; "Side" joins from the north.
    step = 1000 / K.M_PER_DEG
    return network(
        spark,
        [
            ("w1", "a", "b", "Sens direct", "Long", 1000.0, [(0, 0), (step, 0)]),
            ("w2", "c", "b", "Sens inverse", "Long", 2000.0, [(3 * step, 0), (2 * step, 0), (step, 0)]),
            ("w3", "c", "d", "Sens direct", "Long", 1000.0, [(3 * step, 0), (4 * step, 0)]),
            ("s1", "n", "c", "Sens direct", "Side", 500.0, [(3 * step, step / 2), (3 * step, 0)]),
        ],
    )


def test_points_up_a_course(lake):
    net, lines = lake
    step = 1000 / K.M_PER_DEG
    mouths = {r.river_id: (r.lon, r.lat) for r in K.outlet_points(net, lines).collect()}
    assert mouths == {"Long": pytest.approx((4 * step, 0)), "Side": pytest.approx((3 * step, 0))}
    got = {(r.river_id, r.offset_m): (r.lon / step, r.lat / step) for r in K.offset_points(net, lines, (0, 250, 1000, 1500, 4000, 4001)).collect()}
    want = {("Long", 0): (4, 0), ("Long", 250): (3.75, 0), ("Long", 1000): (3, 0), ("Long", 1500): (2.5, 0), ("Long", 4000): (0, 0), ("Side", 0): (3, 0), ("Side", 250): (3, 0.25)}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_lines_and_block(lake):
    net, lines = lake
    drawn = K.river_lines(net, lines)
    sizes = {r.river_id: [len(x) for x in r.lines] for r in drawn.collect()}
    assert sizes == {"Long": [5], "Side": [2]}
    block = K.geo_block(drawn, K.outlet_points(net, lines))
    assert block.count() == 2 and {r.river_id: r.catchment for r in block.collect()} == {"Long": None, "Side": None}
    box = K.whole_box(block).first()
    assert (box.west, box.east, box.south) == (0, round(4000 / K.M_PER_DEG, 5), 0)


def test_candidates_in_order(spark):
    points = spark.createDataFrame([("r", 100.0, 1.0, 2.0), ("r", 0.0, 0.0, 0.0)], "river_id string, offset_m double, lon double, lat double")
    assert sorted((r.seq, r.offset_m, r.threshold) for r in K.candidates(points).collect()) == [(0, 0, 200), (1, 0, 1000), (2, 100, 200), (3, 100, 1000)]


def test_share_of_course_inside(spark):
    lines = spark.createDataFrame([("r", [{"lon": 0.0, "lat": 0.5}, {"lon": 4.0, "lat": 0.5}]), ("none", [{"lon": 0.0, "lat": 9.0}, {"lon": 1.0, "lat": 9.0}])], "river_id string, line array<struct<lon:double,lat:double>>")
    ring = [{"lon": x, "lat": y} for x, y in ((1.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 0.0))]
    rings = spark.createDataFrame([("r", [ring]), ("none", None)], "river_id string, rings array<array<struct<lon:double,lat:double>>>")
    assert {r.river_id: round(r.frac, 9) for r in K.inside_share(lines, rings).collect()} == {"r": 0.75, "none": 0.0}


def test_rings_leave_holes_out(spark):
    cells = {(x, y) for x in range(5) for y in range(4)} - {(2, 2)} | {(9, 9)}
    count = {}
    for x, y in cells:
        for e in (((x, y), (x + 1, y)), ((x, y + 1), (x + 1, y + 1)), ((x, y), (x, y + 1)), ((x + 1, y), (x + 1, y + 1))):
            count[e] = count.get(e, 0) + 1
    rows = [("r", float(a[0]), float(a[1]), float(b[0]), float(b[1])) for (a, b), n in count.items() if n == 1]
    got = K.rings_of_edges(spark.createDataFrame(rows, "river_id string, x1 double, y1 double, x2 double, y2 double")).first().rings
    assert [len(r) for r in got] == [5, 5] and {(p.lon, p.lat) for p in got[0]} == {(0, 0), (5, 0), (5, 4), (0, 4)}


def test_corner_touch_stays_two_parts():
    mask = np.array([[1, 0], [0, 1]], dtype=bool)
    assert len(delineation.stitch(delineation.mask_edges(mask))) == 2


def test_largest_part_against_flood():
    rng = np.random.default_rng(3)
    for _ in range(20):
        mask = rng.random((9, 11)) < 0.55
        best, seen = [], set()
        for cell in map(tuple, np.argwhere(mask)):
            if cell in seen:
                continue
            stack, part = [cell], {cell}
            while stack:
                r, c = stack.pop()
                for near in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if 0 <= near[0] < 9 and 0 <= near[1] < 11 and mask[near] and near not in part:
                        part.add(near)
                        stack.append(near)
            seen |= part
            best = part if len(part) > len(best) else best
        assert {tuple(x) for x in np.argwhere(delineation.largest_part(mask))} == set(best)


def test_catchment_against_paths():
    rng = np.random.default_rng(5)
    directions = kernels.d8(rng.random((14, 12)))
    for cell in ((7, 6), (0, 0), (13, 11)):
        want = set()
        for at in np.ndindex(directions.shape):
            here, path = at, set()
            while here not in path and here != cell:
                path.add(here)
                k = directions[here]
                if k < 0:
                    break
                here = here[0] + kernels.STEPS[k][0], here[1] + kernels.STEPS[k][1]
                if not (0 <= here[0] < 14 and 0 <= here[1] < 12):
                    break
            if here == cell:
                want.add(at)
        assert {tuple(x) for x in np.argwhere(delineation.catchment(directions, *cell))} == want


FRAME = "tile string, west double, north double, cell double, rows int, cols int"


def _valley():
    """Two valleys that run south, a ridge at column 20 between them."""
    r, c = np.mgrid[0:60, 0:40]
    return 1000.0 - 3 * r + 8 * np.minimum(abs(c - 10), abs(c - 30))


def test_search_takes_the_valley_of_the_course(spark):
    z, cell = _valley(), 0.001
    tiles = [("t", int(r), int(c), float(z[r, c])) for r, c in np.ndindex(z.shape)]
    tiles = spark.createDataFrame(tiles, "tile string, r int, c int, z double")
    frames = spark.createDataFrame([("t", 1.0, 43.0, cell, 60, 40)], FRAME)
    at = lambda r, c: (1.0 + (c + 0.5) * cell, 43.0 - (r + 0.5) * cell)
    # The first point lies nearer to the other valley's channel.
    rows = [("left", 0, 0.0, 30, *at(58, 26)), ("left", 1, 100.0, 30, *at(50, 11)), ("left", 2, 200.0, 10**6, *at(50, 11)), ("lost", 0, 0.0, 10**6, *at(5, 5)), ("other", 0, 0.0, 10, 5.0, 43.0)]
    tries = spark.createDataFrame(rows, "river_id string, seq long, offset_m double, threshold int, lon double, lat double")
    box = (1.0, 42.94, 1.04, 43.0)
    boxes = spark.createDataFrame([("left", *box), ("lost", *box), ("other", 5.0, 43.0, 6.0, 44.0), ("dot", 1.0, 42.95, 1.002, 43.0), ("none", *box)], "river_id string, west double, south double, east double, north double")
    course = [{"lon": x, "lat": y} for x, y in (at(5, 10), at(49, 10))]
    lines = spark.createDataFrame([("left", course)], "river_id string, line array<struct<lon:double,lat:double>>")
    got = {r.river_id: r for r in D.delineate(tiles, frames, tries, lines, boxes).collect()}
    left = got["left"]
    assert (left.source, left.offset_m, left.n_tried, left.error) == ("dem", 100.0, 2, None) and left.frac > 0.99
    assert 0.8 * 50 * 20 < left.n_cells < 1.1 * 51 * 21
    one = geo.M_PER_DEG_LAT * cell * geo.M_PER_DEG_LON * cell * math.cos(math.radians(43)) / 1e6
    assert left.area_km2 == pytest.approx(left.n_cells * one, rel=0.05)
    assert got["lost"].source == "undetermined" and got["lost"].ring is None and got["other"].error == "no cells"
    assert (got["lost"].note, got["none"].note, got["dot"].note) == ("no pour point accepted", "no pour point accepted", "box too narrow") and len(got) == 5


def test_payload(spark):
    z, cell = _valley(), 0.001
    tiles = spark.createDataFrame([("t", int(r), int(c), float(z[r, c])) for r, c in np.ndindex(z.shape)], "tile string, r int, c int, z double")
    frames = spark.createDataFrame([("t", 1.0, 43.0, cell, 60, 40)], FRAME)
    p = lambda x, y: {"lon": 1.0 + x * cell, "lat": 43.0 - y * cell}
    ring = [p(8, 8), p(30, 8), p(30, 40), p(8, 40), p(8, 8)]
    away = [p(900, 8), p(910, 8), p(910, 20), p(900, 8)]
    rivers = spark.createDataFrame([("a", [ring]), ("b", [away])], "river_id string, rings array<array<struct<lon:double,lat:double>>>")
    streams = spark.createDataFrame([("a", [p(10, 10), p(10, 39)]), ("a", [p(-500, 0), p(-400, 0)])], "river_id string, line array<struct<lon:double,lat:double>>")
    got = {r.river_id: r for r in D.payloads(tiles, frames, rivers, streams).collect()}
    assert got["b"].payload is None and "no cell" in got["b"].error
    made = json.loads(got["a"].payload)
    meta = made["meta"]
    # Heights run over the whole tile, or over the river's box, not over what is drawn.
    assert (meta["z_min_tile"], meta["z_max_tile"]) == (z.min(), z.max()) and meta["z_max"] < z.max()
    boxed = rivers.filter("river_id = 'a'").selectExpr("*", "1.0D as west", "42.955D as south", "1.02D as east", "43.0D as north")
    other = json.loads(D.payloads(tiles, frames, boxed, streams).first().payload)["meta"]
    assert (other["z_min_tile"], other["z_max_tile"]) == (z[:45, :20].min(), z[:45, :20].max()) and other["z_max"] == meta["z_max"]
    assert meta["n_valid"] <= meta["rows"] * meta["cols"] and meta["rows"] == 32 + 2 * terrain.APRON and len(made["streams"]) == 1
    image = base64.b64decode(made["heightmap"].split(",")[1])
    cols, rows = struct.unpack(">II", image[16:24])
    at = image.index(b"IDAT")
    size = struct.unpack(">I", image[at - 4 : at])[0]
    raw = np.frombuffer(zlib.decompress(image[at + 4 : at + 4 + size]), dtype=np.uint8).reshape(rows, 1 + 4 * cols)[:, 1:].reshape(rows, cols, 4).astype(int)
    height = meta["z_min_tile"] + (raw[..., 0] + 256 * raw[..., 1]) / 65535 * (meta["z_max_tile"] - meta["z_min_tile"])
    inside = raw[..., 3] == 255
    assert inside.sum() == meta["n_valid"] and abs(height[inside].max() - meta["z_max"]) < 0.02
    breaks = [k for k, v in enumerate(made["contours_minor"]) if v is None]
    assert breaks and len(breaks) % 2 == 0 and made["contours_minor"][-1] is None


def test_contours_lie_on_their_level():
    rng = np.random.default_rng(2)
    z = rng.random((8, 9)) * 100
    z[3, 3] = np.nan
    found = kernels.contours(z, 50.0)
    assert len(found) > 10
    for r, c in found.reshape(-1, 2):
        assert (r == int(r)) or (c == int(c))
        assert kernels.bilinear(z, np.array([r]), np.array([c]))[0] == pytest.approx(50) or np.isnan(z[int(r) : int(r) + 2, int(c) : int(c) + 2]).any()
    lines = kernels.chains(found)
    assert sum(len(x) - 1 for x in lines) == len(found)


def test_cast_shadow_against_rays():
    rng = np.random.default_rng(8)
    z = rng.random((12, 12)) * 30
    for azimuth in (90.0, 45.0, 200.0, 315.0):
        got = kernels.cast_shadow(z, azimuth, 25.0, 10.0)
        east, north = math.sin(math.radians(azimuth)), math.cos(math.radians(azimuth))
        big = max(abs(east), abs(north))
        east, north = east / big, north / big
        for r, c in np.ndindex(z.shape):
            hidden, k = False, 1
            while True:
                y, x = r - k * north, c + k * east
                if not (0 <= y <= 11 and 0 <= x <= 11):
                    break
                level = z[r, c] + k * 10 * math.hypot(east, north) * math.tan(math.radians(25))
                hidden |= kernels.bilinear(z, np.array([y]), np.array([x]))[0] > level + 1e-9
                k += 1
            assert got[r, c] == hidden


def test_shadow_of_cells_that_are_not_square():
    z = np.zeros((5, 60))
    z[:, 50:] = 100.0
    for dx in (5.0, 20.0):
        hidden = kernels.cast_shadow(z, 90.0, 45.0, dx, 10.0)
        assert abs(hidden[2].sum() * dx - 100) <= 1.5 * dx


def test_simplify_keeps_what_is_far_off():
    rng = random.Random(4)
    line = np.array([(x, rng.uniform(-1, 1)) for x in range(60)], dtype=float)
    short = kernels.simplify(line, 0.5)
    assert (short[0] == line[0]).all() and (short[-1] == line[-1]).all()
    for p in line:
        off = min(float(np.hypot(*(p - (a + (b - a) * np.clip(((p - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1))))) for a, b in zip(short[:-1], short[1:], strict=True))
        assert off <= 0.5 + 1e-9


def test_warp_of_a_ramp():
    bounds = (0.0, 0.0, 1000.0, 1000.0)
    image = np.repeat(np.arange(100)[None, :, None], 100, axis=0).astype(float)
    per = math.degrees(1 / drawing.RADIUS)
    out = terrain.warp(image, bounds, {"west": 100 * per, "south": 100 * per, "east": 900 * per, "north": 900 * per}, 4, 8)
    assert out[0, :, 0] == pytest.approx([14.5 + 10 * k for k in range(8)], abs=1e-6)


def test_map_layers(spark, tmp_path):
    body = {"elements": [
        {"type": "node", "id": 1, "lon": 1.0, "lat": 2.0, "tags": {"natural": "peak", "ele": "2345,5 m", "name": "Pic"}},
        {"type": "way", "id": 2, "tags": {"highway": "path"}, "geometry": [{"lon": 0, "lat": 0}, {"lon": 1, "lat": 0}]},
        {"type": "way", "id": 3, "tags": {"highway": "path"}, "geometry": [{"lon": 0, "lat": 0}, {"lon": 1, "lat": 0}, {"lon": 1, "lat": 1}, {"lon": 0, "lat": 0}]},
        {"type": "way", "id": 4, "tags": {"natural": "water"}, "geometry": [{"lon": 0, "lat": 0}, {"lon": 1, "lat": 0}, {"lon": 1, "lat": 1}, {"lon": 0, "lat": 0}]},
        {"type": "way", "id": 5, "tags": {"natural": "water"}, "geometry": [{"lon": 0, "lat": 0}, {"lon": 1, "lat": 0}]},
        {"type": "relation", "id": 6, "tags": {"tourism": "alpine_hut"}, "center": {"lon": 1, "lat": 1}},
        {"type": "node", "id": 7, "lon": 0, "lat": 0},
    ]}
    asked = []

    def post(query, timeout):
        asked.append(query)
        if len(asked) == 1:
            raise osm.urllib.error.HTTPError("u", 429, "busy", None, None)
        return json.dumps(body).encode()

    path = osm.fetch((0.0, 1.0, 2.0, 3.0), str(tmp_path), post=post, pause=0)
    assert osm.fetch((0.0, 1.0, 2.0, 3.0), str(tmp_path), post=post) == path and len(asked) == 2
    assert 'node["natural"="peak"](1.0,0.0,3.0,2.0);' in asked[0] and 'relation["route"="hiking"]' in asked[0]
    got = {r.id: (r.layer, r.kind, r.ele, r.role) for r in osm.layers(osm.elements(spark, path)).collect()}
    assert got == {1: ("peaks", "point", 2345.5, None), 2: ("paths", "line", None, None), 4: ("water_areas", "area", None, None), 6: ("huts", "point", None, "refuge")}
