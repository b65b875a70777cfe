"""GeoParquet: WKB geometries as arrays of points, and tables as GeoParquet files.

A file's ``geo`` metadata names the geometry column, its encoding and its reference system; it
is read from a footer, never from the data. Geometries are ``parts``: an array of lines for
line strings and multi line strings, of rings for polygons and multi polygons, of one-point
arrays for points; heights are dropped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from rillway.functions.geo import lambert93_inverse
from rillway.plans.tables import written

#: WKB's geometry codes.
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = 1, 2, 3, 4, 5, 6, 7
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTI_POINT: "MultiPoint", MULTI_LINE: "MultiLineString", MULTI_POLYGON: "MultiPolygon"}
#: Codes of reference systems in degrees, longitude first as stored; and the planar one that is turned back into degrees.
DEGREES, LAMBERT = {"4326", "CRS84", "4258"}, "2154"
PARTS = "array<array<struct<lon:double,lat:double>>>"


def decode(blob: bytes) -> tuple[int, list[np.ndarray]]:
    """A geometry's code, and its parts as arrays of (x, y); both byte orders, heights and measures in either notation."""

    def one(at: int) -> tuple[int, list[np.ndarray], int]:
        order = "<" if blob[at] else ">"
        code = int(np.frombuffer(blob, f"{order}u4", 1, at + 1)[0])
        at += 5
        if code & 0x20000000:  # a reference system's number comes first
            at += 4
        more = (code >> 31 & 1) + (code >> 30 & 1) if code >> 29 else {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        kind, width = (code & 0xFF) % 1000 if code >> 29 else code % 1000, 2 + more

        def points(n: int, at: int) -> tuple[np.ndarray, int]:
            return np.frombuffer(blob, f"{order}f8", n * width, at).reshape(n, width)[:, :2].astype(float), at + 8 * n * width

        def count(at: int) -> tuple[int, int]:
            return int(np.frombuffer(blob, f"{order}u4", 1, at)[0]), at + 4

        if kind == POINT:
            p, at = points(1, at)
            return kind, [] if np.isnan(p).any() else [p], at
        n, at = count(at)
        if kind == LINE:
            p, at = points(n, at)
            return kind, [p] if n else [], at
        found = []
        for _ in range(n):
            if kind == POLYGON:
                m, at = count(at)
                p, at = points(m, at)
                found.append(p)
            else:
                _, inner, at = one(at)
                found += inner
        return kind, found, at

    kind, parts, _ = one(0)
    return kind, parts


def encode(kind: int, parts: list[np.ndarray]) -> bytes:
    """WKB of parts, the smaller byte first; more than one part of a line, or of a point, is a multi geometry.

    All rings of a polygon count as rings of one, an outer one and its holes.
    """
    head = lambda k, n: b"\x01" + np.array([k, n], "<u4").tobytes()
    body = lambda p: np.ascontiguousarray(p, "<f8").tobytes()
    if kind in (POLYGON, MULTI_POLYGON):
        return head(POLYGON, len(parts)) + b"".join(np.array([len(p)], "<u4").tobytes() + body(p) for p in parts)
    single = lambda p: b"\x01" + np.array([POINT], "<u4").tobytes() + body(p) if kind in (POINT, MULTI_POINT) else head(LINE, len(p)) + body(p)
    if len(parts) == 1:
        return single(parts[0])
    return head(MULTI_POINT if kind in (POINT, MULTI_POINT) else MULTI_LINE, len(parts)) + b"".join(map(single, parts))


def metadata(spark: SparkSession, path: str) -> dict | None:
    """The ``geo`` metadata of a file's footer, or of the first file of a folder; None without any."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = spark.read.parquet(path).inputFiles()
    if not files:
        return None
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(sorted(files)[0]), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        found = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    return json.loads(found) if found else None


def _system(column: dict) -> str:
    """A column's reference system as a code; degrees where none is named."""
    crs = column.get("crs")
    if crs is None:
        return "4326"
    return str(crs.get("id", {}).get("code", crs.get("name"))) if isinstance(crs, dict) else str(crs).rsplit(":", 1)[-1]


def read(spark: SparkSession, path: str) -> DataFrame:
    """A GeoParquet file's columns, with ``kind`` and ``parts`` (degrees) in place of its geometry.

    Coordinates in Lambert-93 are turned into degrees; another system, or another encoding than
    WKB, is an error. Without ``geo`` metadata a binary column ``geometry`` is taken as WKB in degrees.
    """
    geo = metadata(spark, path) or {"primary_column": "geometry", "columns": {}}
    name = geo["primary_column"]
    column, raw = geo["columns"].get(name, {}), spark.read.parquet(path)
    if column.get("encoding", "WKB") != "WKB" or dict(raw.dtypes).get(name) != "binary":
        raise ValueError(f"{path}: {name} isn't WKB")
    system = _system(column)
    if system not in DEGREES | {LAMBERT}:
        raise ValueError(f"{path}: reference system {system}")
    rest = [c for c in raw.columns if c not in (name, "kind", "parts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(b) if b is not None else (None, None) for b in batch.column(0).to_pylist()]
            every = [p for _, parts in found for p in parts or []]
            flat = np.concatenate(every) if every else np.zeros((0, 2))
            points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["lon", "lat"])
            lines = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, every)]), pa.int32()), points)
            ends = np.cumsum([0, *(len(parts or []) for _, parts in found)])
            nulls = pa.array([parts is None for _, parts in found], pa.bool_())
            whole = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines, mask=nulls)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([k for k, _ in found], pa.int32()), whole], names=[*rest, "kind", "parts"])

    kept = raw.select(name, *rest)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]), "kind int", f"parts {PARTS}"])
    out = kept.mapInArrow(run, schema)
    if system == LAMBERT:
        lon, lat = (lambda p: lambert93_inverse(p["lon"], p["lat"])[0]), (lambda p: lambert93_inverse(p["lon"], p["lat"])[1])
        out = out.withColumn("parts", F.transform("parts", lambda part: F.transform(part, lambda p: F.struct(lon(p).alias("lon"), lat(p).alias("lat")))))
    return out


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Line features as ``geojson.read_lines`` gives them: the columns and ``line``, all parts of a multi line string in one."""
    return read(spark, path).withColumn("line", F.flatten("parts")).drop("kind", "parts")


def basins(spark: SparkSession, path: str, key: str = "liens_vers_cours_d_eau_principal") -> DataFrame:
    """Polygons as ``geojson.basins`` gives them."""
    rings = F.transform("parts", lambda part: F.transform(part, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))))
    river = F.trim(F.col(key))
    found = read(spark, path).filter(F.col("kind").isin(POLYGON, MULTI_POLYGON))
    return found.select(F.monotonically_increasing_id().alias("basin"), F.when(river != "", river).alias("river_id"), rings.alias("rings"))


class GeoParquet(DataSource):
    """Writes ``kind``, ``parts`` and other columns as GeoParquet files; ``path`` is a folder in a store that tasks can write to."""

    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def writer(self, schema, overwrite: bool) -> "Writer":
        return Writer(self.options["path"])


class Writer(DataSourceArrowWriter):
    """Each task writes a file of its own into a folder beside the others; the commit moves all of them, an abort drops them."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _store(self, path: str) -> tuple[pa.fs.FileSystem, str]:
        import pyarrow.fs

        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import pyarrow.parquet as pq

        store, base = self._store(self.path)
        file, writer, n = f"{base}/_writing-{self.job}/part-{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            rest = [c for c in batch.schema.names if c not in ("kind", "parts")]
            blobs = []
            for kind, parts in zip(batch.column("kind").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                blobs.append(None if parts is None or kind is None else encode(kind, [np.array([(p["lon"], p["lat"]) for p in part], dtype=float).reshape(-1, 2) for part in parts]))
            table = pa.table([batch.column(c) for c in rest] + [pa.array(blobs, pa.binary())], names=[*rest, "geometry"])
            if writer is None:
                kinds = sorted(NAMES.values())
                geo = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": kinds}}}
                store.create_dir(f"{base}/_writing-{self.job}", recursive=True)
                writer = pq.ParquetWriter(store.open_output_stream(file), table.schema.with_metadata({"geo": json.dumps(geo)}))
            writer.write_table(table.cast(writer.schema))
            n += table.num_rows
        if writer is not None:
            writer.close()
        message = WriterCommitMessage()
        message.file, message.n = file if writer is not None else None, n
        return message

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = self._store(self.path)
        for m in messages:
            if m is not None and m.file:
                store.move(m.file, f"{base}/{m.file.rsplit('/', 1)[-1]}")
        self._drop()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        import pyarrow.fs

        store, base = self._store(self.path)
        if store.get_file_info(f"{base}/_writing-{self.job}").type == pyarrow.fs.FileType.Directory:
            store.delete_dir(f"{base}/_writing-{self.job}")


def write(rows: DataFrame, path: str) -> int:
    """``rows`` (``kind``, ``parts`` and other columns) as GeoParquet files in a folder; none is an error. Returns how many."""
    kept = written(rows)
    n = kept.count()
    if not n:
        raise RuntimeError("nothing to write")
    rows.sparkSession.dataSource.register(GeoParquet)
    kept.write.format("geoparquet").mode("append").option("path", path).save()
    return n


def from_geojson(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Rows whose ``geometry`` is GeoJSON text, with ``kind`` and ``parts`` in its place."""
    kind, text = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    nested = lambda depth: F.from_json(text, "array<" * depth + "double" + ">" * depth)
    point, line = F.array(F.array(nested(1))), F.array(nested(2))
    parts = F.when(kind == "Point", point).when(kind == "LineString", line).when(kind.isin("MultiLineString", "Polygon"), nested(3)).when(kind == "MultiPolygon", F.flatten(nested(4))).when(kind == "MultiPoint", F.transform(nested(2), lambda p: F.array(p)))
    code = F.coalesce(*[F.when(kind == name, F.lit(k)) for k, name in NAMES.items()])
    return features.select("*", code.alias("kind"), F.transform(parts, lambda part: F.transform(part, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))).alias("parts")).drop(geometry)
