"""The flows from a shell: ``python -m rillway rivers segments.geojson --named``.

Rows are printed as JSON, one a line; segments come from a GeoJSON file, from GeoParquet, or
from Parquet with the columns of ``sources.geojson.segments``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from rillway import flows
from rillway.operators import courses, delineate, watershed
from rillway.plans.tables import written
from rillway.sinks import catalog_json
from rillway.sources import config, geojson, geoparquet, geotiff, wfs
from rillway.streaming import jobs


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a GeoJSON file, of GeoParquet, or of Parquet with the columns of ``geojson.segments``."""
    if not path.endswith(".parquet"):
        return geojson.segments(geojson.read_lines(spark, path))
    if "geometry" in spark.read.parquet(path).columns:
        return geojson.segments(geoparquet.lines(spark, path))
    return spark.read.parquet(path)


def read_basins(spark: SparkSession, path: str) -> DataFrame:
    return written((geoparquet if path.endswith(".parquet") else geojson).basins(spark, path))


def show(rows: DataFrame) -> None:
    """Rows stream through the driver."""
    for text in rows.toJSON().toLocalIterator():
        print(text)


def _rivers(spark: SparkSession, a: argparse.Namespace) -> None:
    show(flows.rivers(read_segments(spark, a.segments), a.named, a.roots, a.least_km, a.most))


def _features(spark: SparkSession, a: argparse.Namespace) -> None:
    segments = read_segments(spark, a.segments)
    found = flows.features(flows.network(segments), courses.downstream_lines(segments), a.river, a.catchment)
    print(flows.write_collection(found, a.out), file=sys.stderr)


def _trace(spark: SparkSession, a: argparse.Namespace) -> None:
    if (a.node is None) == (a.at is None):
        raise ValueError("give either a node or a place")
    at = tuple(float(x) for x in a.at.split(",")) if a.at else None
    tree = flows.trace(read_segments(spark, a.segments), a.node, a.skip_fictitious, a.least_order, a.collapse, at)
    if a.draw:
        print("\n".join(catalog_json.printed(tree, a.max_depth)))
    else:
        show(tree)


def _cuts(spark: SparkSession, a: argparse.Namespace) -> dict:
    left_out = config.overrides(spark, a.overrides).filter("blacklist") if a.overrides else None
    # A configuration file's rows, which fit in memory as the file does.
    return {"blacklist": [r.river_id for r in left_out.collect()] if left_out is not None else None, "max_depth": a.max_depth}


def _catalog(spark: SparkSession, a: argparse.Namespace) -> None:
    given = _cuts(spark, a)
    if a.basins:
        given["basins"] = read_basins(spark, a.basins)
    if a.catchments:
        given["catchments"] = jobs.done(spark, a.catchments, delineate.RESULT)
    if a.overrides:
        given["cameras"] = config.overrides(spark, a.overrides).filter("camera is not null").select("river_id", "camera")
    show(flows.catalog(read_segments(spark, a.segments), a.river, a.folder, geo=a.geo, **given))


def _terrain(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """The cells and frames of a folder: the tables of that name, or GeoTIFF files."""
    if not jobs.exists(spark, f"{a.terrain}/cells.parquet"):
        return geotiff.read(spark, a.terrain)
    return spark.read.parquet(f"{a.terrain}/cells.parquet"), spark.read.parquet(f"{a.terrain}/frames.parquet")


def _delineate(spark: SparkSession, a: argparse.Namespace) -> None:
    show(flows.delineate(read_segments(spark, a.segments), *_terrain(spark, a), [a.river]))


def _precompute(spark: SparkSession, a: argparse.Namespace) -> None:
    basins = read_basins(spark, a.basins) if a.basins else None
    print(json.dumps(flows.precompute(read_segments(spark, a.segments), *_terrain(spark, a), a.river, a.out, basins, a.area_min, a.area_max)))


def _draw(spark: SparkSession, a: argparse.Namespace) -> None:
    counts, failed = flows.terrain(read_segments(spark, a.segments), *_terrain(spark, a), jobs.done(spark, a.catchments, delineate.RESULT), a.out, a.exaggeration)
    print(json.dumps(counts))
    show(failed)


def _forest(spark: SparkSession, a: argparse.Namespace) -> None:
    area = config.study_area(a.area)
    known = [i for _, i in area["roots"] if i]
    if not known:
        raise ValueError("no root has an id")
    show(flows.forest(read_segments(spark, a.segments), known, a.folder, area["name"] or "study area", **_cuts(spark, a)))


def _layers(spark: SparkSession | None, a: argparse.Namespace) -> None:
    body = wfs.get(a.url, {"SERVICE": "WFS", "VERSION": "2.0.0", "REQUEST": "GetCapabilities"})
    for row in wfs.watershed_layers(body) if a.watersheds else wfs.feature_types(body, a.keyword):
        print(json.dumps(dict(zip(("name", "title", "abstract"), row, strict=True)), ensure_ascii=False))


def _watersheds(spark: SparkSession, a: argparse.Namespace) -> None:
    at = tuple(float(x) for x in a.at.split(",")) if a.at else None
    print(wfs.dump(wfs.watersheds(spark, a.url, a.layer, a.bbox, at), a.out), file=sys.stderr)


def _schema(spark: SparkSession | None, a: argparse.Namespace) -> None:
    body = wfs.get(a.url, {"SERVICE": "WFS", "VERSION": "2.0.0", "REQUEST": "DescribeFeatureType", "TYPENAMES": a.layer})
    for row in wfs.schema_pairs(body):
        print(json.dumps(dict(zip(("field", "type"), row, strict=True))))


def _count(spark: SparkSession | None, a: argparse.Namespace) -> None:
    print(wfs.matched(wfs.get(a.url, wfs.params(a.layer, a.bbox, a.cql, resulttype="hits"))))


def _dump(spark: SparkSession, a: argparse.Namespace) -> None:
    spark.dataSource.register(wfs.WfsSource)
    given = {k: v for k, v in (("bbox", a.bbox), ("cql", a.cql), ("max", a.most), ("sort", a.sort), ("page", a.page)) if v is not None}
    found = spark.read.format("wfs").options(fetch=a.url, type=a.layer, **given).load()
    print(geoparquet.write(geoparquet.from_geojson(found), a.out) if a.out.endswith(".parquet") else wfs.dump(found, a.out), file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rillway", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(required=True, metavar="command")

    def command(name: str, run, text: str, *given: str, spark: bool = True) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=text, description=text)
        for g in given:
            made.add_argument(g)
        made.set_defaults(run=run, spark=spark)
        return made

    p = command("rivers", _rivers, "list rivers, longest first", "segments")
    p.add_argument("--named", action="store_true")
    p.add_argument("--roots", action="store_true", help="only rivers that flow into no other")
    p.add_argument("--least-km", type=float, default=0)
    p.add_argument("--most", type=int, default=20, help="how many; 0 for all")
    p = command("features", _features, "write a river as GeoJSON", "segments", "river", "out")
    p.add_argument("--catchment", action="store_true", help="with all that flows into it")
    p = command("trace", _trace, "the tree of segments above a node or a place", "segments")
    p.add_argument("node", nargs="?")
    p.add_argument("--at", help="longitude,latitude: begin above the nearest segment")
    p.add_argument("--draw", action="store_true", help="as a drawn tree")
    p.add_argument("--max-depth", type=int)
    p.add_argument("--collapse", action="store_true", help="fold only children of their parent's name into it")
    p.add_argument("--skip-fictitious", action="store_true")
    p.add_argument("--least-order", type=int)
    for p in (command("catalog", _catalog, "a river's catalog", "segments", "river"), command("forest", _forest, "the catalogs of a study area's roots", "segments", "area")):
        p.add_argument("--folder", help="where to write the catalog and its page")
        p.add_argument("--overrides", help="YAML file of rivers to leave out")
        p.add_argument("--max-depth", type=int)
        if p.prog.endswith("catalog"):
            p.add_argument("--geo", action="store_true", help="with lines, mouths and catchments")
            p.add_argument("--basins", help="GeoJSON of sub-basins")
            p.add_argument("--catchments", help="what precompute has written")
    p = command("delineate", _delineate, "a river's catchment from terrain", "segments", "terrain", "river")
    p = command("precompute", _precompute, "catchments from terrain of a river and all above it", "segments", "terrain", "river", "out")
    p.add_argument("--basins", help="GeoJSON of sub-basins; rivers that have any are skipped")
    p.add_argument("--area-min", type=float, default=watershed.AREA_MIN)
    p.add_argument("--area-max", type=float, default=watershed.AREA_MAX)
    p = command("terrain", _draw, "the drawn terrain of each catchment, a file a river", "segments", "terrain", "catchments", "out")
    p.add_argument("--exaggeration", type=float, default=1.0)
    p = command("layers", _layers, "list a service's feature types", "url", spark=False)
    p.add_argument("--keyword")
    p.add_argument("--watersheds", action="store_true")
    command("schema", _schema, "fields of a feature type", "url", "layer", spark=False)
    for p in (command("count", _count, "how many features a service has", "url", "layer", spark=False), command("dump", _dump, "copy features to GeoJSON parts, or to GeoParquet if the path ends so", "url", "layer", "out")):
        p.add_argument("--bbox")
        p.add_argument("--cql")
    q = command("watersheds", _watersheds, "a layer's watersheds in a box, or that hold a place, as GeoJSON parts", "url", "layer", "out")
    q.add_argument("--bbox")
    q.add_argument("--at", help="longitude,latitude")
    for option, kind in (("--most", int), ("--sort", str), ("--page", int)):
        p.add_argument(option, type=kind)
    return top


def main(given: list[str] | None = None) -> int:
    """What a user can mend is told in one line; the answer is the exit code."""
    a = parser().parse_args(given)
    try:
        if getattr(a, "bbox", None):
            config.parse_bbox(a.bbox)
        a.run(SparkSession.builder.appName("rillway").getOrCreate() if a.spark else None, a)
    except (ValueError, RuntimeError, OSError) as e:
        print(f"rillway: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
