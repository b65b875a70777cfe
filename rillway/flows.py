"""Whole flows from a segment table: listings, one river, traces, catalogs, catchments.

``segments`` has the columns of ``sources.geojson.segments``; flows that draw need its ``line``.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.functions import geo
from rillway.operators import catalog as C
from rillway.operators import courses as K
from rillway.operators import delineate as D
from rillway.operators import nearest
from rillway.operators import rivers as R
from rillway.operators import segments as S
from rillway.operators import trace as T
from rillway.operators import overlay as O
from rillway.operators import watershed as W
from rillway.plans.tables import written
from rillway.sinks import catalog_json
from rillway.streaming import jobs


def network(segments: DataFrame) -> R.Network:
    return R.build(S.graph(segments))


def rivers(segments: DataFrame, named: bool = False, roots: bool = False, least_km: float = 0, most: int = 0) -> DataFrame:
    """The listing of rivers, filtered, longest first."""
    return R.listed(R.n_upstream(network(segments)), named, roots, least_km, most)


def features(net: R.Network, lines: DataFrame, query: str, catchment: bool = False) -> DataFrame:
    """One GeoJSON feature (``feature``) for each segment of the river that an id or name means, or of its whole catchment."""
    river = R.resolve(net.rivers, query).select("river_id")
    own = (R.catchment_segments(net, river) if catchment else net.segment_river.join(river, "river_id", "left_semi")).select("cleabs")
    e = net.edges.join(own, "cleabs", "left_semi").join(lines, "cleabs")
    shown = F.struct("cleabs", F.col("name").alias("toponyme"), F.col("ord").alias("order"), "fictif", F.round("length_m", 1).cast("double").alias("length_m"))
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("line", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return e.select("cleabs", F.to_json(F.struct(F.lit("Feature").alias("type"), shown.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def write_collection(found: DataFrame, path: str) -> int:
    """A feature collection in one file, a feature a line; no feature is an error. Features stream through the driver one by one."""
    n = 0
    part = Path(path + ".part")
    with part.open("w", encoding="utf-8") as f:
        f.write('{"type": "FeatureCollection", "features": [\n')
        for row in found.orderBy("cleabs").toLocalIterator():
            f.write((",\n" if n else "") + row.feature)
            n += 1
        f.write("\n]}\n")
    if not n:
        part.unlink()
        raise RuntimeError("nothing to write")
    part.rename(path)
    return n


def trace(segments: DataFrame, node: str | None = None, skip_fictitious: bool = False, least_order: int | None = None, collapse: bool = False, at: tuple[float, float] | None = None) -> DataFrame:
    """The tree of segments above a node, or above the upstream node of the segment nearest to a place ``at`` (longitude, latitude)."""
    if node is None:
        node = snap(segments, *at).first().node
    tree = written(T.tree_totals(T.trace_tree(S.graph(segments), node)))
    if collapse:
        tree = written(T.collapse_chains(tree))
    if least_order is not None:
        tree = written(tree.join(T.prune_order(tree, least_order).select("cleabs"), "cleabs", "left_semi"))
    return T.splice_fictitious(tree) if skip_fictitious else T.ordered_children(tree)


def _counted(net: R.Network) -> tuple[DataFrame, DataFrame]:
    counted = written(R.n_upstream(net))
    return counted, written(C.partition_children(counted, C.join_ranks(net.edges, net.segment_river, net.rivers)))


def catalog(segments: DataFrame, query: str, folder: str | None = None, blacklist: list[str] | None = None, max_depth: int | None = None, basins: DataFrame | None = None, catchments: DataFrame | None = None, cameras: DataFrame | None = None, geo: bool = False) -> DataFrame:
    """The catalog tree of the river that an id or name means, with all of its facts; with ``folder``, its JSON and a page are written there.

    ``basins`` (``river_id``, ``basin``, ``rings`` of ``x``, ``y``) gives drainage areas and, in range, catchments;
    ``catchments`` (``precompute``'s table) fills in those that they lack, and tells which
    headwaters will never have one. With ``geo`` the JSON has every river's lines, mouth,
    catchment and camera (``cameras``: ``river_id``, ``camera``), and the box of them all.
    """
    net = network(segments)
    root = R.resolve(net.rivers, query).first().river_id
    counted, children = _counted(net)
    tree = written(C.nodes(counted, children, root, blacklist, max_depth))
    shown = tree.select("river_id")
    facts = C.pfafstetter(counted, root).select("river_id", F.col("code").alias("pfafstetter"))
    names = counted.select(F.col("river_id").alias("also"), F.struct(F.col("river_id").alias("id"), "name").alias("_to"))
    also = C.also_flows_into(net.flows).join(names, "also").groupBy("river_id").agg(F.array_sort(F.collect_list("_to")).alias("also_flows_into"))
    full = tree.join(facts, "river_id", "left").join(also, "river_id", "left").withColumn("also_flows_into", F.coalesce("also_flows_into", F.array().cast("array<struct<id:string,name:string>>")))
    measured, rings = None, None
    if basins is not None:
        members = written(W.membership(basins.select("river_id", "basin"), R.upstream(net, shown), shown))
        edges = written(O.union_edges(members, O.cover(basins)))
        size = O.union_areas(edges, lambert=True).select("river_id", F.round("area", 1).alias("area_km2"))
        measured = written(size.join(members.groupBy("river_id").agg(F.count(F.lit(1)).alias("n_sub_basins")), "river_id"))
        full = full.join(measured, "river_id", "left").withColumn("n_sub_basins", F.coalesce("n_sub_basins", F.lit(0).cast("long")))
        rings = K.rings_of_edges(edges).withColumn("source", F.lit("basins"))
    full = written(full)
    block = None
    if geo:
        lines = written(K.downstream_lines(segments))
        drawn = written(K.river_lines(net, lines.join(net.segment_river.join(shown, "river_id", "left_semi"), "cleabs", "left_semi")))
        none = segments.sparkSession.createDataFrame([], "river_id string, area_km2 double")
        cache = catchments if catchments is not None else none.withColumn("source", F.lit(None).cast("string"))
        if catchments is not None:
            from_dem = catchments.filter("source = 'dem'").select("river_id", F.array("ring").alias("rings"), F.lit("dem").alias("source"))
            rings = from_dem if rings is None else rings.unionByName(from_dem)
        which = W.precedence(shown, none if measured is None else measured, cache)
        block = written(K.geo_block(drawn, K.outlet_points(net, lines), which, rings, cameras))
    return _shown(full, folder, block, basins is not None)


def forest(segments: DataFrame, queries: list[str], folder: str | None = None, name: str = "study area", **cuts) -> DataFrame:
    """Several catalogs under one root, as ``catalog``."""
    net = network(segments)
    roots = [R.resolve(net.rivers, q).first().river_id for q in queries]
    return _shown(written(C.forest(*_counted(net), roots, name, **cuts)), folder)


def _shown(tree: DataFrame, folder: str | None, block: DataFrame | None = None, has_areas: bool = False) -> DataFrame:
    if folder is not None:
        made = catalog_json.nested(tree.drop("root_id"))
        made["meta"] |= {"has_areas": has_areas, "has_geo": block is not None, "model": "git"}
        if block is not None:
            made["geo"] = catalog_json.geo(block)
        Path(folder).mkdir(parents=True, exist_ok=True)
        catalog_json.dump(made, f"{folder}/catalog.json")
        (Path(folder) / "index.html").write_text(catalog_json.page(made["meta"]["root_name"] or made["meta"]["root_id"]), encoding="utf-8")
    return tree


def delineate(segments: DataFrame, cells: DataFrame, frames: DataFrame, queries: list[str] | None = None, offsets: tuple[float, ...] = K.OFFSETS, thresholds: tuple[int, ...] = K.THRESHOLDS, accept: float = 0.9) -> DataFrame:
    """Catchments from terrain of the rivers that ids or names mean, or of all rivers (``delineate.RESULT``).

    A river's terrain is the mosaic of its padded box over the tiles of ``frames`` (``tile``, ``west``,
    ``north``, ``cell``, ``rows``, ``cols``); a river without any is undetermined, and says so.
    """
    net = network(segments)
    wanted = net.rivers.select("river_id")
    if queries is not None:
        wanted = segments.sparkSession.createDataFrame([(R.resolve(net.rivers, q).first().river_id,) for q in queries], "river_id string")
    return delineated(net, written(K.downstream_lines(segments)), cells, frames, wanted, offsets, thresholds, accept)


def delineated(net: R.Network, lines: DataFrame, cells: DataFrame, frames: DataFrame, wanted: DataFrame, offsets: tuple[float, ...] = K.OFFSETS, thresholds: tuple[int, ...] = K.THRESHOLDS, accept: float = 0.9) -> DataFrame:
    """As ``delineate``, of the rivers ``wanted`` (``river_id``) of a network whose lines run downstream."""
    boxes = written(K.catchment_boxes(net, lines).join(wanted, "river_id", "left_semi"))
    points = written(K.offset_points(net, lines, offsets).join(wanted, "river_id", "left_semi"))
    own = net.segment_river.join(wanted, "river_id", "left_semi").join(lines, "cleabs").select("river_id", "line")
    return D.delineate(cells, frames, K.candidates(points, offsets, thresholds), own, boxes, accept)


def precompute(segments: DataFrame, cells: DataFrame, frames: DataFrame, query: str, path: str, basins: DataFrame | None = None, low: float = W.AREA_MIN, high: float = W.AREA_MAX, batches: int = 8, offsets: tuple[float, ...] = K.OFFSETS, thresholds: tuple[int, ...] = K.THRESHOLDS) -> dict[str, int]:
    """Catchments from terrain of a river and of all rivers upstream of it, into the table at ``path`` (``delineate.RESULT``).

    Rivers that the table has, whatever came of them, and rivers with sub-basins (``basins``:
    ``river_id``, ``basin``) are skipped. A catchment whose area is out of range is ``discarded``,
    without its ring. A river that fails isn't kept, so it is tried again next time.
    """
    net = network(segments)
    root = written(R.resolve(net.rivers, query).select("river_id"))
    wanted = written(root.unionByName(R.upstream(net, root).select(F.col("ancestor").alias("river_id"))))
    todo = wanted
    if basins is not None:
        own = basins.filter("river_id is not null and trim(river_id) <> \'\'").groupBy("river_id").agg(F.count(F.lit(1)).alias("n"))
        todo = wanted.join(R.upstream_sums(net.rivers, net.flows, own, ["n"]).filter("n > 0"), "river_id", "left_anti")
    todo, lines = written(todo), written(K.downstream_lines(segments))
    boxes = written(K.catchment_boxes(net, lines).join(todo, "river_id", "left_semi"))
    points = written(K.candidates(K.offset_points(net, lines, offsets).join(todo, "river_id", "left_semi"), offsets, thresholds))
    course = written(net.segment_river.join(todo, "river_id", "left_semi").join(lines, "cleabs").select("river_id", "line"))

    def work(part: DataFrame) -> DataFrame:
        of = lambda df: df.join(part.select("river_id"), "river_id", "left_semi")
        made = D.delineate(cells, frames, of(points), of(course), of(boxes))
        out = F.col("area_km2").isNotNull() & ~F.col("area_km2").between(low, high)
        return made.withColumns({"source": F.when(out, "discarded").otherwise(F.col("source")), "ring": F.when(~out, F.col("ring"))})

    # Rivers without a line have no box, and nothing to try.
    counts = jobs.run(boxes.select("river_id"), "river_id", work, path, D.RESULT, batches)
    spark = segments.sparkSession
    kinds = {r.source: r["count"] for r in jobs.done(spark, path, D.RESULT).join(wanted, "river_id", "left_semi").groupBy("source").count().collect()}
    return counts | {"considered": wanted.count(), "covered": wanted.count() - todo.count()} | {k: kinds.get(k, 0) for k in ("dem", "discarded", "undetermined")}


def terrain(segments: DataFrame, cells: DataFrame, frames: DataFrame, catchments: DataFrame, folder: str, exaggeration: float = 1.0) -> tuple[dict[str, int], DataFrame]:
    """The drawn terrain of every river with a catchment from terrain, a file each in ``folder``; how many were done, skipped and failed, and why (``river_id``, ``error``).

    Rivers that have a file are skipped. ``catchments``: ``precompute``'s table.
    """
    spark = segments.sparkSession
    known = catchments.filter("source = 'dem'").select("river_id", F.array("ring").alias("rings"))
    earlier = jobs.written_keys(spark, "river_id", folder)
    todo = written(known.join(earlier, "river_id", "left_anti"))
    skipped = known.count() - todo.count()
    if not todo.take(1):
        return {"done": 0, "skipped": skipped, "failed": 0}, spark.createDataFrame([], "river_id string, error string")
    net, lines = network(segments), written(K.downstream_lines(segments))
    boxes = K.catchment_boxes(net, lines)
    streams = R.catchment_segments(net, todo.select("river_id")).join(lines, "cleabs").select("river_id", "line")
    title = net.rivers.select("river_id", F.coalesce("name", "river_id").alias("_title")).join(K.outlet_points(net, lines), "river_id", "left")
    made = D.payloads(cells, frames, todo.join(boxes, "river_id"), streams, exaggeration).join(title, "river_id")
    # A viewer's file also says whose it is, and where the river ends.
    also = F.to_json(F.struct(F.col("_title").alias("title"), F.when(F.col("lon").isNotNull(), F.array("lon", "lat")).alias("outlet_lonlat")))
    whole = written(made.withColumn("payload", F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(", "), F.substring(also, 2, 1 << 20))))
    jobs.write_each(whole.filter("error is null"), "river_id", "payload", folder)
    failed = whole.filter("error is not null").select("river_id", "error")
    n_failed = failed.count()
    return {"done": whole.count() - n_failed, "skipped": skipped, "failed": n_failed}, failed


def snap(segments: DataFrame, lon: float, lat: float) -> DataFrame:
    """The segment nearest to a place, in metres, and its upstream node: ``cleabs``, ``node``, ``metres``."""
    lines, edges = K.downstream_lines(segments), S.graph(segments)
    n = F.size("line")
    pairs = F.zip_with(F.slice("line", 1, n - 1), F.slice("line", 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = edges.select("cleabs").join(lines, "cleabs").select("cleabs", F.explode(pairs).alias("e"))
    (x1, y1), (x2, y2) = (geo.lambert93(F.col(f"e.{k}.lon"), F.col(f"e.{k}.lat")) for k in "ab")
    px, py = geo.lambert93(F.lit(float(lon)), F.lit(float(lat)))
    point = segments.sparkSession.range(1).select(F.lit(0).alias("p"), px.alias("px"), py.alias("py"))
    found = nearest.nearest_lines(point, each.select(F.col("cleabs").alias("k"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))
    return found.join(edges, found["k"] == edges["cleabs"]).select("cleabs", F.col("src").alias("node"), "metres")
