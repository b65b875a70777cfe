"""GeoParquet: round trips, bytes written by hand, reference systems, and what can't be read."""

import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rillway.functions import delineation
from rillway.sources import geojson
from rillway.sources import geoparquet as G


def test_bytes_by_hand():
    little = struct.pack("<BII4d", 1, 2, 2, 0.0, 1.0, 2.0, 3.0)
    big = struct.pack(">BII4d", 0, 2, 2, 0.0, 1.0, 2.0, 3.0)
    high = struct.pack("<BII6d", 1, 1002, 2, 0.0, 1.0, 9.0, 2.0, 3.0, 9.0)
    flagged = struct.pack("<BIII6d", 1, 0x80000002 | 0x20000000, 4326, 2, 0.0, 1.0, 9.0, 2.0, 3.0, 9.0)
    for blob in (little, big, high, flagged):
        kind, parts = G.decode(blob)
        assert kind == G.LINE and [p.tolist() for p in parts] == [[[0, 1], [2, 3]]]
    square = [(0, 0), (1, 0), (1, 1), (0, 0)]
    ring = struct.pack("<I", 4) + b"".join(struct.pack("<2d", *p) for p in square)
    polygon = struct.pack("<BII", 1, 3, 1) + ring
    many = struct.pack("<BII", 1, 6, 2) + polygon + struct.pack("<BII", 1, 3, 2) + ring + ring
    assert [len(G.decode(b)[1]) for b in (polygon, many)] == [1, 3] and G.decode(many)[0] == G.MULTI_POLYGON
    assert G.decode(struct.pack("<BI2d", 1, 1, float("nan"), float("nan"))) == (G.POINT, []) and G.decode(struct.pack("<BII", 1, 2, 0))[1] == []


def test_every_kind_comes_back():
    rng = np.random.default_rng(3)
    for kind in (G.POINT, G.MULTI_POINT, G.LINE, G.MULTI_LINE, G.POLYGON):
        for n in (1, 3):
            parts = [rng.random((1 if kind in (G.POINT, G.MULTI_POINT) else int(rng.integers(2, 9)), 2)) for _ in range(n)]
            back, got = G.decode(G.encode(kind, parts))
            assert len(got) == n and all((a == b).all() for a, b in zip(parts, got, strict=True))
            assert (back in (G.MULTI_POINT, G.MULTI_LINE)) == (n > 1 and kind != G.POLYGON)


def test_round_trip(spark, tmp_path):
    xy = lambda *p: [{"lon": float(a), "lat": float(b)} for a, b in p]
    rows = [("a", G.LINE, [xy((0, 1), (2, 3), (4, 5))]), ("b", G.MULTI_LINE, [xy((0, 0), (1, 1)), xy((2, 2), (3, 3), (4, 4))]), ("c", G.POLYGON, [xy((0, 0), (1, 0), (1, 1), (0, 0))]), ("d", None, None)]
    df = spark.createDataFrame(rows, f"id string, kind int, parts {G.PARTS}").repartition(3)
    path = str(tmp_path / "all.parquet")
    assert G.write(df, path) == 4
    assert not [p for p in (tmp_path / "all.parquet").iterdir() if p.name.startswith("_")]
    assert G.metadata(spark, path)["columns"]["geometry"]["encoding"] == "WKB"
    got = {r.id: (r.kind, r.parts and [[(p.lon, p.lat) for p in part] for part in r.parts]) for r in G.read(spark, path).collect()}
    assert got == {i: (k, parts and [[(p["lon"], p["lat"]) for p in part] for part in parts]) for i, k, parts in rows}
    # Another engine's reader sees the same metadata.
    one = next((tmp_path / "all.parquet").glob("part-*.parquet"))
    assert json.loads(pq.read_schema(one).metadata[b"geo"])["primary_column"] == "geometry"
    with pytest.raises(RuntimeError):
        G.write(df.limit(0), str(tmp_path / "none.parquet"))


def foreign(path, blobs, geo, name="geom"):
    """A file as another program writes it."""
    table = pa.table({"cleabs": [f"T{k}" for k in range(len(blobs))], "liens_vers_cours_d_eau_principal": ["R"] * len(blobs), name: pa.array(blobs, pa.binary())})
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(geo)} if geo else {}), path)
    return f"file://{path}"


def test_reference_systems(spark, tmp_path):
    places = np.array([(0.5, 43.0), (3.0, 46.5)])
    x, y = delineation.lambert93(places[:, 0], places[:, 1])
    planar = [G.encode(G.LINE, [np.stack([x, y], axis=1)])]
    geo = lambda crs: {"primary_column": "geom", "columns": {"geom": {"encoding": "WKB", "crs": crs}}}
    line = G.lines(spark, foreign(tmp_path / "l93.parquet", planar, geo({"id": {"authority": "EPSG", "code": 2154}}))).first().line
    assert np.abs(np.array([(p.lon, p.lat) for p in line]) - places).max() < 1e-9
    degrees = [G.encode(G.LINE, [places])]
    for k, crs in enumerate((None, {"id": {"authority": "OGC", "code": "CRS84"}}, "EPSG:4326")):
        got = G.read(spark, foreign(tmp_path / f"d{k}.parquet", degrees, geo(crs))).first()
        assert [(p.lon, p.lat) for p in got.parts[0]] == [tuple(p) for p in places] and got.cleabs == "T0"
    with pytest.raises(ValueError, match="reference system 3857"):
        G.read(spark, foreign(tmp_path / "m.parquet", degrees, geo({"id": {"code": 3857}})))
    with pytest.raises(ValueError, match="WKB"):
        G.read(spark, foreign(tmp_path / "e.parquet", degrees, {"primary_column": "geom", "columns": {"geom": {"encoding": "linestring"}}}))
    assert G.read(spark, foreign(tmp_path / "bare.parquet", degrees, None, "geometry")).count() == 1


def test_basins_and_features(spark, tmp_path):
    ring = np.array([(0, 0), (2, 0), (2, 2), (0, 0)], float)
    path = foreign(tmp_path / "b.parquet", [G.encode(G.POLYGON, [ring])] * 2, {"primary_column": "geom", "columns": {"geom": {"encoding": "WKB"}}})
    got = G.basins(spark, path).collect()
    assert len({r.basin for r in got}) == 2 and got[0].river_id == "R" and [(p.x, p.y) for p in got[0].rings[0]] == [tuple(p) for p in ring]
    texts = ['{"type":"Point","coordinates":[1,2]}', '{"type":"LineString","coordinates":[[1,2,9],[3,4,9]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}', None]
    rows = G.from_geojson(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, geometry string"))
    found = {r.id: (r.kind, r.parts and [[(p.lon, p.lat) for p in part] for part in r.parts]) for r in rows.collect()}
    assert found == {0: (1, [[(1.0, 2.0)]]), 1: (2, [[(1.0, 2.0), (3.0, 4.0)]]), 2: (6, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]), 3: (None, None)}
    out = tmp_path / "j.geojson"
    out.write_text('{"type":"Feature","properties":{"liens_vers_cours_d_eau_principal":" "},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}')
    one = geojson.basins(spark, f"file://{out}").withColumn("n", F.size("rings")).first()
    assert one.river_id is None and one.n == 1
