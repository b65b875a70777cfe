"""The commands on a small network and on recorded answers of a service."""

import json

import pytest

from rillway.__main__ import main
from rillway.sources import wfs


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    rows = [("m1", "a", "b", "RV_M", "Mere", [[0, 0], [1, 0]]), ("m2", "b", "c", "RV_M", "Mere", [[1, 0], [2, 0]]), ("k1", "d", "b", "RV_K", "Kine", [[1, 1], [1, 0.2]]), ("l1", "e", "c", "RV_L", None, [[2, 0.1], [2, 0]])]
    names = "cleabs", "lien_vers_noeud_hydrographique_ini", "lien_vers_noeud_hydrographique_fin", "liens_vers_cours_d_eau", "cpx_toponyme_de_cours_d_eau"
    given = lambda r: dict(zip(names, r, strict=False)) | {"sens_de_l_ecoulement": "Sens direct", "numero_d_ordre": "1", "fictif": False}
    found = [{"type": "Feature", "properties": given(r), "geometry": {"type": "LineString", "coordinates": r[5]}} for r in rows]
    to = tmp_path_factory.mktemp("cli") / "segments.geojson"
    to.write_text(json.dumps({"type": "FeatureCollection", "features": found}))
    return str(to)


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_rivers(path, capsys):
    assert main(["rivers", path, "--named"]) == 0
    assert [r["river_id"] for r in lines(capsys)] == ["RV_M", "RV_K"]


def test_catalog(path, capsys, tmp_path):
    (tmp_path / "o.yaml").write_text("rivers:\n  RV_K:\n    blacklist: true\n")
    assert main(["catalog", path, "mere", "--folder", str(tmp_path), "--overrides", str(tmp_path / "o.yaml")]) == 0
    assert [r["river_id"] for r in lines(capsys)] == ["RV_M"] and json.loads((tmp_path / "catalog.json").read_text())["meta"]["n_nodes"] == 1


def test_features_and_errors(path, capsys, tmp_path):
    out = str(tmp_path / "k.geojson")
    assert main(["features", path, "RV_K", out]) == 0 and len(json.load(open(out))["features"]) == 1
    assert main(["features", path, "nowhere", out]) == 1 and "rillway: " in capsys.readouterr().err
    assert main(["count", "http://nowhere", "t", "--bbox", "1,2"]) == 1
    with pytest.raises(SystemExit):
        main(["rivers"])


def test_service(capsys, monkeypatch):
    asked = []
    answers = {"GetCapabilities": b"<C><FeatureType><Name>n:bassin</Name></FeatureType></C>", "DescribeFeatureType": b"<s><element name='nom' type='string'/></s>", "GetFeature": b"<R numberMatched='12'/>"}
    monkeypatch.setattr(wfs, "get", lambda url, query: asked.append(query) or answers[query["REQUEST"]])
    assert [main(["layers", "u", "--watersheds"]), main(["schema", "u", "t"]), main(["count", "u", "t", "--cql", "a = 1"])] == [0, 0, 0]
    out = capsys.readouterr().out.splitlines()
    assert json.loads(out[0])["name"] == "n:bassin" and json.loads(out[1]) == {"field": "nom", "type": "string"} and out[2] == "12"
    assert asked[2]["CQL_FILTER"] == "a = 1" and asked[2]["RESULTTYPE"] == "hits"
