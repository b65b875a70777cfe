"""Whole flows on a small hand-made network, and the feature service's watershed helpers."""

import json

import pytest

from rillway import flows
from rillway.operators import courses as K
from rillway.sinks import catalog_json
from rillway.sources import wfs

SCHEMA = "cleabs string, ini string, fin string, sens string, ord string, river_key string, toponyme string, fictif boolean, length_m double, line array<struct<lon:double,lat:double>>"


@pytest.fixture(scope="module")
def segments(spark):
    way = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    rows = [
        ("m1", "a", "b", "Sens direct", "2", "RV_M", "Mere", False, 3000.0, way((0, 0), (1, 0))),
        ("m2", "b", "c", "Sens direct", "2", "RV_M", "Mere", False, 2000.0, way((1, 0), (2, 0))),
        ("k1", "d", "b", "Sens direct", "1", "RV_K", "Kine", False, 1500.0, way((1, 1), (1, 0))),
        ("l1", "e", "c", "Sens direct", "1", "RV_L", None, False, 500.0, way((2, 1), (2, 0))),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_listing(segments):
    assert [r.river_id for r in flows.rivers(segments).collect()] == ["RV_M", "RV_K", "RV_L"]
    assert [r.river_id for r in flows.rivers(segments, named=True, least_km=1.5).collect()] == ["RV_M", "RV_K"]
    assert [r.river_id for r in flows.rivers(segments, most=1).collect()] == ["RV_M"]


def test_features_and_collection(segments, tmp_path):
    net, lines = flows.network(segments), K.downstream_lines(segments)
    assert {r.cleabs for r in flows.features(net, lines, "mere").collect()} == {"m1", "m2"}
    path = str(tmp_path / "all.geojson")
    assert flows.write_collection(flows.features(net, lines, "RV_M", catchment=True), path) == 3
    made = json.loads(open(path, encoding="utf-8").read())
    assert made["type"] == "FeatureCollection" and [f["properties"]["cleabs"] for f in made["features"]] == ["k1", "m1", "m2"]
    assert made["features"][0]["geometry"]["coordinates"] == [[1.0, 1.0], [1.0, 0.0]]
    with pytest.raises(RuntimeError):
        flows.write_collection(flows.features(net, lines, "RV_M").limit(0), path + "2")


def test_catalog_and_trace(segments, tmp_path):
    tree = flows.catalog(segments, "Mere", str(tmp_path))
    assert {r.river_id for r in tree.collect()} == {"RV_M", "RV_K"}
    assert json.loads((tmp_path / "catalog.json").read_text())["meta"]["n_nodes"] == 2 and "Mere" in (tmp_path / "index.html").read_text()
    assert flows.forest(segments, ["RV_M", "RV_L"]).count() == 4
    assert {r.cleabs for r in flows.trace(segments, "c").collect()} == {"m1", "m2", "k1", "l1"}
    assert catalog_json.printed(flows.trace(segments, "c")) == ["● (pour point)", "├── Mere  (order 2, 2.0 km)", "│   ├── Mere  (order 2, 3.0 km)", "│   └── Kine  (order 1, 1.5 km)", "└── (unnamed)  (order 1, 0.5 km)"]
    folded = flows.trace(segments.filter("cleabs <> 'k1'"), "c", collapse=True)
    assert catalog_json.printed(folded, 0) == ["● (pour point)", "… 2 branch(es), 3 seg"] and "├── Mere  (order 2, 5.0 km, 2 seg)" in catalog_json.printed(folded)


def test_watershed_helpers(spark, tmp_path):
    body = b"<c><FeatureType><Name>n:bassin_versant</Name><Title>t</Title></FeatureType><FeatureType><Name>n:road</Name></FeatureType><FeatureType><Name>x</Name><Abstract>Versant nord</Abstract></FeatureType></c>"
    assert [n for n, _, _ in wfs.watershed_layers(body)] == ["n:bassin_versant", "x"]
    assert wfs.at_point(1.5, 42.0) == "INTERSECTS(geometrie, POINT(42.0 1.5))"
    with pytest.raises(ValueError):
        wfs.watersheds(spark, "file:/nowhere", "n", bbox="1,2,3,4", point=(1, 2))
    rows = spark.createDataFrame([('a"1', '{"x":1}', '{"type":"Point","coordinates":[1,2]}'), (None, None, None)], "id string, properties string, geometry string")
    assert wfs.dump(rows, f"file://{tmp_path}/out") == 2
    lines = sorted(x for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines())
    got = [json.loads(x) for x in lines]
    assert {(f["id"], json.dumps(f["properties"])) for f in got} == {('a"1', '{"x": 1}'), (None, "null")}


def test_delineate(spark):
    # One river that winds down a valley of 40 by 21 cells.
    cell = 0.001
    z = [("t", r, c, 500.0 - 2 * r + 10 * abs(c - 10)) for r in range(40) for c in range(21)]
    at = lambda r, c: {"lon": 1 + (c + 0.5) * cell, "lat": 43 - (r + 0.5) * cell}
    rows = [("v1", "a", "b", "Sens direct", "1", "RV_V", "Val", False, 3000.0, [at(4, 10), at(8, 2), at(12, 18), at(16, 10), at(36, 10)])]
    frames = spark.createDataFrame([("t", 1.0, 43.0, cell, 40, 21)], "tile string, west double, north double, cell double, rows int, cols int")
    got = flows.delineate(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(z, "tile string, r int, c int, z double"), frames, ["Val"], offsets=(0, 100), thresholds=(15,)).collect()
    assert [(r.river_id, r.source, r.error) for r in got] == [("RV_V", "dem", None)] and got[0].frac > 0.95 and got[0].n_cells > 500


def test_delineate_over_tiles(spark):
    # The same valley over four tiles that share their borders' cells; a second river lies beyond all of them.
    cell = 0.001
    z = lambda r, c: 500.0 - 2 * r + 10 * abs(c - 10)
    at = lambda r, c: {"lon": 1 + (c + 0.5) * cell, "lat": 43 - (r + 0.5) * cell}
    whole = [("t", r, c, z(r, c)) for r in range(40) for c in range(21)]
    corners = {f"t{k}{m}": (r0, c0) for k, r0 in enumerate((0, 17)) for m, c0 in enumerate((0, 9))}
    parts = [(t, r, c, z(r + r0, c + c0)) for t, (r0, c0) in corners.items() for r in range(23) for c in range(12) if r + r0 < 40 and c + c0 < 21]
    frames = [(t, 1 + c0 * cell, 43 - r0 * cell, cell, 23, 12) for t, (r0, c0) in corners.items()]
    rows = [("v1", "a", "b", "Sens direct", "1", "RV_V", "Val", False, 3000.0, [at(4, 10), at(8, 2), at(12, 18), at(16, 10), at(36, 10)]), ("w1", "x", "y", "Sens direct", "1", "RV_W", "Away", False, 3000.0, [{"lon": 7.0, "lat": 44.0}, {"lon": 7.1, "lat": 43.9}])]
    kind = "tile string, west double, north double, cell double, rows int, cols int"
    cells = lambda of: spark.createDataFrame(of, "tile string, r int, c int, z double")
    run = lambda of, f: {r.river_id: r for r in flows.delineate(spark.createDataFrame(rows, SCHEMA), cells(of), spark.createDataFrame(f, kind), offsets=(0, 100), thresholds=(15,)).collect()}
    one, four = run(whole, [("t", 1.0, 43.0, cell, 40, 21)]), run(parts, frames)
    assert one["RV_V"] == four["RV_V"] and one["RV_V"].source == "dem" and one["RV_V"].n_cells > 500
    assert (four["RV_W"].source, four["RV_W"].error) == ("undetermined", "no cells")
