"""GeoJSON features as tables, and tables as GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.plans.tables import written

SEGMENT_PROPERTIES = "cleabs string, lien_vers_noeud_hydrographique_ini string, lien_vers_noeud_hydrographique_fin string, sens_de_l_ecoulement string, numero_d_ordre string, cpx_toponyme_de_cours_d_eau string, liens_vers_cours_d_eau string, nature string, fictif boolean, reseau_principal_coulant boolean"


def read_lines(spark: SparkSession, path: str, properties: str = SEGMENT_PROPERTIES) -> DataFrame:
    """LineString features of a collection, or one feature a line; heights are dropped."""
    one = f"type string, properties struct<{properties.replace(' ', ':').replace(',:', ',')}>, geometry struct<type:string, coordinates:array<array<double>>>"
    raw = spark.read.schema(f"type string, features array<struct<{_nested(one)}>>, {one.split(', ', 1)[1]}").json(path, multiLine=True)
    each = raw.select(F.explode(F.coalesce("features", F.array(F.struct("type", "properties", "geometry")))).alias("f"))
    line = F.transform("f.geometry.coordinates", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return each.select("f.properties.*", line.alias("line"))


def basins(spark: SparkSession, path: str, key: str = "liens_vers_cours_d_eau_principal") -> DataFrame:
    """Polygons and multipolygons of a collection, or one feature a line: ``basin`` (a number), ``river_id`` (null if blank), ``rings``.

    Rings may cross themselves and one another; ``overlay`` repairs them.
    """
    kind = "struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>"
    raw = spark.read.schema(f"type string, features array<{kind}>, properties map<string,string>, geometry struct<type:string, coordinates:string>").json(path, multiLine=True)
    each = raw.select(F.explode(F.coalesce("features", F.array(F.struct("type", "properties", "geometry")))).alias("f")).filter("f.geometry is not null")
    # Parts of a multipolygon nest one deeper.
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    found = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
    rings = F.transform(found, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    river = F.trim(F.col("f.properties").getItem(key))
    return each.select(F.monotonically_increasing_id().alias("basin"), F.when(river != "", river).alias("river_id"), rings.alias("rings")).filter("rings is not null")


def _nested(schema: str) -> str:
    kind, rest = schema.split(", ", 1)
    properties, geometry = rest.split(">, geometry ", 1)
    return f"{kind.replace(' ', ':')}, {properties.replace('properties ', 'properties:')}>, geometry:{geometry}"


def segments(lines: DataFrame) -> DataFrame:
    """The segment columns that the graph operators take, with planar lengths."""
    from rillway.functions.geo import line_length

    return lines.select(
        "cleabs", F.col("lien_vers_noeud_hydrographique_ini").alias("ini"), F.col("lien_vers_noeud_hydrographique_fin").alias("fin"), F.col("sens_de_l_ecoulement").alias("sens"), F.col("numero_d_ordre").alias("ord"),
        F.col("liens_vers_cours_d_eau").alias("river_key"), F.col("cpx_toponyme_de_cours_d_eau").alias("toponyme"), "fictif", line_length(F.col("line")).alias("length_m"), "line",
    )


def write_features(df: DataFrame, path: str, line: str = "line") -> int:
    """One feature a line, in part files; an empty table is an error. Returns how many."""
    kept = written(df)
    n = kept.count()
    if not n:
        raise RuntimeError("nothing to write")
    rest = [c for c in df.columns if c != line]
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), geometry.alias("geometry"))
    kept.select(F.to_json(feature).alias("value")).write.text(path)
    return n
