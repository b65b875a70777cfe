"""Study areas and overrides from YAML, as small tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _load(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def study_area(path: str) -> dict:
    """Name, box, and roots; a box needs four numbers, roots a list."""
    d = _load(path)
    box = [float(x) for x in d.get("bbox_wgs84", [])]
    if len(box) != 4:
        raise ValueError("bbox_wgs84 needs west, south, east, north")
    roots = d.get("roots", [])
    if not isinstance(roots, list):
        raise ValueError("roots must be a list")
    return {"name": d.get("name"), "bbox": box, "roots": [(r.get("name"), r.get("cours_d_eau_id")) for r in roots]}


def roots_table(spark: SparkSession, area: dict) -> DataFrame:
    """Roots whose id is known."""
    return spark.createDataFrame([(n, i) for n, i in area["roots"] if i], "name string, river_id string")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """River ids, whether they are left out, and their camera as JSON; an empty table without a file."""
    import json

    rows = _load(path).get("rivers", {}) if Path(path).exists() else {}
    return spark.createDataFrame([(k, bool(v.get("blacklist")), json.dumps(v["camera"]) if "camera" in v else None) for k, v in rows.items()], "river_id string, blacklist boolean, camera string")


def parse_bbox(text: str) -> list[float]:
    """Four numbers with commas between."""
    got = [float(x) for x in text.split(",")]
    if len(got) != 4:
        raise ValueError("a box is west,south,east,north")
    return got
