"""Batches that are killed, replayed and resumed, and the flows and commands that run on them."""

import json

import pytest
from pyspark.sql import functions as F

from rillway.__main__ import main
from rillway.operators import delineate as D
from rillway.streaming import jobs

SCHEMA = "river_id string, n long, error string"


def counted(df):
    return df.withColumn("n", F.lit(1).cast("long")).withColumn("error", F.when(F.col("river_id") == "bad", "broken"))


def kept(spark, path):
    return sorted(r.river_id for r in jobs.done(spark, path, SCHEMA).collect())


def test_a_replayed_micro_batch_counts_once(spark, tmp_path):
    path, state = f"file://{tmp_path}/out", "file:/some/state"
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "river_id string")
    one = jobs.stream_batch(spark, SCHEMA, "river_id", counted, path, state)
    one(rows("a", "b", "bad", "a"), 0)
    one(rows("a", "b", "bad", "a"), 0)  # nobody heard that it was done
    assert kept(spark, path) == ["a", "b"]
    one(rows("b", "c"), 1)
    one(rows("b", "c"), 1)
    other = jobs.stream_batch(spark, SCHEMA, "river_id", counted, path, "file:/another/state")
    other(rows("c", "d"), 0)
    assert kept(spark, path) == ["a", "b", "c", "d"]


def test_a_killed_run_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    todo = spark.range(30).select(F.col("id").cast("string").alias("river_id"))
    calls = []

    def dies(df):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return counted(df)

    with pytest.raises(KeyboardInterrupt):
        jobs.run(todo, "river_id", dies, path, SCHEMA, 5)
    first = kept(spark, path)
    assert 0 < len(first) < 30
    again = jobs.run(todo, "river_id", counted, path, SCHEMA, 5)
    assert again["skipped"] == len(first) and kept(spark, path) == sorted(str(k) for k in range(30))


def test_stream(spark, tmp_path):
    source, path, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    for ids in (("a", "b"), ("b", "c")):
        spark.createDataFrame([(i,) for i in ids], "river_id string").coalesce(1).write.mode("append").parquet(source)
        jobs.run_stream(spark, source, "river_id string", "river_id", counted, path, state, SCHEMA)
    assert kept(spark, path) == ["a", "b", "c"]


def test_a_file_a_key(spark, tmp_path):
    path = f"file://{tmp_path}/files"
    assert jobs.written_keys(spark, "river_id", path).count() == 0
    rows = lambda *r: spark.createDataFrame(r, "river_id string, text string")
    jobs.write_each(rows(("a", '{"x": 1}'), ("b/c", "two")), "river_id", "text", path)
    jobs.write_each(rows(("a", "again")), "river_id", "text", path)
    assert {r.river_id for r in jobs.written_keys(spark, "river_id", path).collect()} == {"a", "b/c"}
    got = {r.river_id: r.value for r in spark.read.text(path).collect()}
    assert got == {"a": "again", "b/c": "two"} and len(list((tmp_path / "files" / "river_id=a").glob("part-*"))) == 1


@pytest.fixture(scope="module")
def valley(spark, tmp_path_factory):
    """A valley of 60 by 41 cells of a thousandth of a degree, in two tiles; a river that winds down it, one that joins it, and a stray one."""
    to, cell = tmp_path_factory.mktemp("valley"), 0.001
    z = lambda r, c: 900.0 - 4 * r + 10 * abs(c - 20)
    cells = [(t, r, c, z(r + r0, c)) for t, r0 in (("n", 0), ("s", 30)) for r in range(30) for c in range(41)]
    spark.createDataFrame(cells, "tile string, r int, c int, z double").write.parquet(f"{to}/cells.parquet")
    spark.createDataFrame([("n", 1.0, 43.0, cell, 30, 41), ("s", 1.0, 42.97, cell, 30, 41)], "tile string, west double, north double, cell double, rows int, cols int").write.parquet(f"{to}/frames.parquet")
    at = lambda r, c: [round(1 + (c + 0.5) * cell, 5), round(43 - (r + 0.5) * cell, 5)]
    ways = [
        ("v1", "a", "b", "RV_V", "Val", [at(3, 20), at(6, 12), at(12, 28), at(20, 20)]), ("v2", "b", "c", "RV_V", "Val", [at(20, 20), at(30, 20), at(57, 20)]),
        ("t1", "t", "b", "RV_T", "Trib", [at(19, 2), at(16, 8), at(20, 20)]), ("x1", "x", "c", "RV_X", "Dot", [at(57, 20), at(57, 20)]),
    ]
    names = "cleabs", "lien_vers_noeud_hydrographique_ini", "lien_vers_noeud_hydrographique_fin", "liens_vers_cours_d_eau", "cpx_toponyme_de_cours_d_eau"
    given = lambda w: dict(zip(names, w, strict=False)) | {"sens_de_l_ecoulement": "Sens direct", "numero_d_ordre": "1", "fictif": False}
    found = [{"type": "Feature", "properties": given(w), "geometry": {"type": "LineString", "coordinates": w[5]}} for w in ways]
    (to / "segments.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": found}))
    square = lambda w, s, e, n: [[[w, s], [e, s], [e, n], [w, n], [w, s]]]
    own = [("RV_V", "Polygon", square(1.0, 42.94, 1.041, 42.99)), ("RV_T", "Polygon", square(1.0, 42.97, 1.03, 43.0)), ("", "MultiPolygon", [square(2, 2, 3, 3)])]
    found = [{"type": "Feature", "properties": {"liens_vers_cours_d_eau_principal": k}, "geometry": {"type": t, "coordinates": c}} for k, t, c in own]
    (to / "basins.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": found}))
    return to


def test_precompute_terrain_and_catalog(spark, valley, tmp_path, capsys):
    segments, out = f"{valley}/segments.geojson", f"file://{tmp_path}/catchments"
    run = lambda *a: (main([str(x) for x in a]), capsys.readouterr())[1].out.splitlines()
    given = ("precompute", segments, f"file://{valley}", "Val", out, "--area-min", "1")
    first = json.loads(run(*given)[-1])
    table = {r.river_id: r for r in jobs.done(spark, out, D.RESULT).collect()}
    assert table["RV_V"].source == "dem" and table["RV_V"].frac > 0.95 and table["RV_V"].area_km2 > 10
    assert (first["considered"], first["failed"], first["done"]) == (2, 0, 2) and first["dem"] >= 1
    again = json.loads(run(*given)[-1])
    assert (again["skipped"], again["done"], again["dem"]) == (2, 0, first["dem"])
    covered = json.loads(run("precompute", segments, f"file://{valley}", "Val", f"file://{tmp_path}/none", "--basins", f"file://{valley}/basins.geojson")[-1])
    assert (covered["covered"], covered["done"]) == (2, 0)

    drawn = ("terrain", segments, f"file://{valley}", out, f"file://{tmp_path}/terrain")
    assert json.loads(run(*drawn)[0]) == {"done": first["dem"], "skipped": 0, "failed": 0}
    assert json.loads(run(*drawn)[0])["skipped"] == first["dem"]
    file = next((tmp_path / "terrain" / "river_id=RV_V").glob("part-*"))
    made = json.loads(file.read_text())
    assert made["title"] == "Val" and made["outlet_lonlat"] == [1.0205, 42.9425] and made["streams"] and made["meta"]["z_max_tile"] > made["meta"]["z_min_tile"]

    (valley / "o.yaml").write_text("rivers:\n  RV_T:\n    camera: {azimuth_deg: 10}\n")
    tree = [json.loads(x) for x in run("catalog", segments, "Val", "--geo", "--basins", f"file://{valley}/basins.geojson", "--catchments", out, "--folder", tmp_path, "--overrides", valley / "o.yaml") if x.startswith("{")]
    assert {r["river_id"] for r in tree} == {"RV_V", "RV_T"}
    made = json.loads((tmp_path / "catalog.json").read_text())
    assert made["meta"] == {"root_id": "RV_V", "root_name": "Val", "n_nodes": 2, "has_areas": True, "has_geo": True, "model": "git"}
    root = made["tree"]
    # Two squares of 0.041 by 0.05 and 0.03 by 0.03 degrees that share 0.03 by 0.02.
    assert root["n_sub_basins"] == 2 and root["area_km2"] == pytest.approx((0.041 * 0.05 + 0.03 * 0.01) * 111.32 * 0.7317 * 111.09, rel=0.01) and root["mainline"]["n_sub_basins"] == 1
    assert root["mainline"]["pfafstetter"] and root["also_flows_into"] == []
    geo = made["geo"]
    assert set(geo["rivers"]) == {"RV_V", "RV_T"} and geo["rivers"]["RV_V"]["outlet"] == [1.0205, 42.9425] and geo["rivers"]["RV_T"]["camera"] == {"azimuth_deg": 10}
    assert geo["rivers"]["RV_V"]["catchment"] and geo["bbox"][0] < 1.003 and geo["bbox"][1] <= 42.9425


def test_trace_from_a_place(spark, valley, capsys):
    segments = f"{valley}/segments.geojson"
    assert main(["trace", segments, "--at", "1.021,42.9426"]) == 0
    assert {json.loads(x)["cleabs"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")} == {"v1", "t1"}
    assert main(["trace", segments]) == 1
    assert main(["delineate", segments, f"file://{valley}", "Trib"]) == 0
