"""A river's own course: its mouth, points upstream of it, its drawn lines, its catchment's rings, the geo block.

Lines are arrays of (lon, lat) in flow order, one for each segment (``downstream_lines``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.functions import drawing, geo
from rillway.operators.iterate import subtree_fold
from rillway.operators.rivers import Network
from rillway.operators.segments import INVERSE
from rillway.plans.tables import Grown, written

#: Metres in a degree along a line, places of coordinates, and most vertices of drawn rings and lines.
M_PER_DEG, DECIMALS, RING_MOST, LINE_MOST = 111_320.0, 5, 60, 40
#: Upstream offsets and channel thresholds that are tried in turn.
OFFSETS, THRESHOLDS = (0, 100, 200, 300, 500, 700, 900, 1100), (200, 1000)
#: Rivers of up to so many segments are walked in a row, in steps by the square of that at most.
SHORT = 256
_POINT = "struct<lon:double,lat:double>"


def downstream_lines(segments: DataFrame) -> DataFrame:
    """``cleabs`` and ``line``, turned where a segment is drawn against its flow."""
    return segments.select("cleabs", F.when(F.col("sens") == INVERSE, F.reverse("line")).otherwise(F.col("line")).alias("line"))


def own_edges(network: Network) -> DataFrame:
    return network.edges.join(network.segment_river, "cleabs").select("river_id", "cleabs", "src", "dst", F.coalesce("length_m", F.lit(0)).cast("double").alias("length_m"))


def longest_segment(own: DataFrame, node: str) -> DataFrame:
    """For each river and ``node`` (``src`` or ``dst``) its longest own segment there; of equally long ones the last by id."""
    last = Window.partitionBy("river_id", node).orderBy(F.desc("length_m"), F.desc("cleabs"))
    return own.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def _in_rows(network: Network) -> DataFrame:
    """A row for each river of at most ``SHORT`` segments: ``river_id``, ``outlet``, and its ``own`` segments, longest first, of equally long ones the last by id."""
    few = network.rivers.filter(F.col("outlet").isNotNull() & (F.col("n_segments") <= SHORT)).select("river_id", "outlet")
    return own_edges(network).join(few, "river_id").groupBy("river_id", "outlet").agg(F.sort_array(F.collect_list(F.struct("length_m", "cleabs", "src", "dst")), asc=False).alias("own"))


def _long_rivers(network: Network) -> tuple[DataFrame, DataFrame] | None:
    """The own segments and the outlets (``river_id``, ``node``) of rivers of more than ``SHORT`` segments, written; None without any."""
    at = network.rivers.filter(F.col("outlet").isNotNull() & (F.col("n_segments") > SHORT)).select("river_id", F.col("outlet").alias("node"))
    if not at.take(1):
        return None
    at = written(at)
    part = written(network.segment_river.join(at, "river_id", "left_semi"))
    return written(own_edges(Network(network.edges, part, network.rivers, network.flows))), at


def _walk(state: Column, node: str, then: Callable[[Column], Column]) -> Column:
    """``state`` (``at`` and others) after ``then`` of the first of a row's ``own`` segments at its ``at``; unchanged where there is none."""
    here = F.slice(F.filter("own", lambda x: x[node] == state["at"]), 1, 1)
    return F.coalesce(F.get(F.transform(here, then), F.lit(0)), state)


def _mouth_in_row() -> Column:
    """The segment whose end is the mouth, of a row of ``_in_rows``."""
    none = F.lit(None).cast("string")

    def step(state: Column, _: Column) -> Column:
        def then(e: Column) -> Column:
            fresh = ~F.array_contains(state["seen"], e["dst"])
            return F.struct(F.when(fresh, e["dst"]).alias("at"), e["cleabs"].alias("last"), F.array_append(state["seen"], e["dst"]).alias("seen"))

        return _walk(state, "src", then)

    start = F.struct(F.col("outlet").alias("at"), none.alias("last"), F.array("outlet").alias("seen"))
    into = F.get(F.filter("own", lambda x: x["dst"] == F.col("outlet")), F.lit(0))["cleabs"]
    return F.coalesce(F.aggregate("own", start, step, lambda s: s["last"]), into)


def _course_in_row(most: float) -> Column:
    """The segments up a row's river (``cleabs``, ``from_m``, ``to_m``), the longest into each node, until ``most`` metres."""
    none = F.array().cast("array<struct<cleabs:string,from_m:double,to_m:double>>")

    def step(state: Column, _: Column) -> Column:
        def then(e: Column) -> Column:
            to_m = state["from_m"] + e["length_m"]
            on = (to_m < most) & ~F.array_contains(state["seen"], e["src"])
            each = F.struct(e["cleabs"].alias("cleabs"), state["from_m"].alias("from_m"), to_m.alias("to_m"))
            return F.struct(F.when(on, e["src"]).alias("at"), to_m.alias("from_m"), F.array_append(state["seen"], e["src"]).alias("seen"), F.array_append(state["course"], each).alias("course"))

        return _walk(state, "dst", then)

    start = F.struct(F.col("outlet").alias("at"), F.lit(0.0).alias("from_m"), F.array("outlet").alias("seen"), none.alias("course"))
    return F.aggregate("own", start, step, lambda s: s["course"])


def _mouths_by_rounds(own: DataFrame, at: DataFrame) -> DataFrame:
    """``river_id``, ``cleabs``: the segments whose ends are the mouths of rivers, all of which go on together."""
    out = written(longest_segment(own, "src").select("river_id", F.col("src").alias("node"), F.col("dst").alias("to"), "cleabs"))
    outlet, seen, last = at, at, None
    while True:
        step = written(at.join(out, ["river_id", "node"]).select("river_id", F.col("to").alias("node"), "cleabs"))
        if not step.take(1):
            break
        last = step.select("river_id", "cleabs") if last is None else written(last.join(step, "river_id", "left_anti").unionByName(step.select("river_id", "cleabs")))
        at = written(step.select("river_id", "node").join(seen, ["river_id", "node"], "left_anti"))
        seen = written(seen.unionByName(at))
    into = longest_segment(own, "dst").withColumnRenamed("dst", "node").join(outlet, ["river_id", "node"]).select("river_id", "cleabs")
    return into if last is None else into.join(last, "river_id", "left_anti").unionByName(last)


def _courses_by_rounds(own: DataFrame, at: DataFrame, most: float) -> DataFrame:
    """``river_id``, ``cleabs``, ``from_m``, ``to_m``: all rivers go up together, one own segment a round, so the rounds are bounded by ``most`` and not by the rivers."""
    into = written(longest_segment(own, "dst").select("river_id", F.col("dst").alias("node"), "src", "cleabs", "length_m"))
    seen, at = Grown(at), at.withColumn("from_m", F.lit(0.0))
    course = None
    while course is None or at.take(1):
        step = written(at.join(into, ["river_id", "node"]).select("river_id", "src", "cleabs", "from_m", (F.col("from_m") + F.col("length_m")).alias("to_m")))
        if course is None:
            course = Grown(step.drop("src"))
        else:
            course.append(step.drop("src"))
        on = step.filter(F.col("to_m") < most).select("river_id", F.col("src").alias("node"), F.col("to_m").alias("from_m"))
        at = written(on.join(seen.table(), ["river_id", "node"], "left_anti"))
        seen.append(at)
    return course.table()


def outlet_points(network: Network, lines: DataFrame) -> DataFrame:
    """``river_id``, ``lon``, ``lat``: where a river ends.

    From its outlet node it goes on along its own longest segments, as merged cycles may leave
    the node in mid-course; the end of the last one counts, or that of the longest segment into
    the node. A river of up to ``SHORT`` segments is walked in its row, longer ones in rounds.
    """
    ends = _in_rows(network).select("river_id", _mouth_in_row().alias("cleabs"))
    if (long_ := _long_rivers(network)) is not None:
        ends = ends.unionByName(_mouths_by_rounds(*long_))
    return ends.join(lines, "cleabs").select("river_id", F.element_at("line", -1).alias("p")).select("river_id", "p.lon", "p.lat")


def catchment_boxes(network: Network, lines: DataFrame) -> DataFrame:
    """``river_id`` and the padded box of all segments of a river and of what flows into it: ``west``, ``south``, ``east``, ``north``.

    Boxes grow along primary parents in rounds by the logarithm of the tree's depth, and over a
    fork's other branches until none grows; rivers without a line or an outlet have none.
    """
    side = lambda f, k: f(F.transform("line", lambda p: p[k]))
    low, high = ["west", "south"], ["east", "north"]
    own = network.segment_river.join(lines, "cleabs").groupBy("river_id").agg(F.min(side(F.array_min, "lon")).alias("west"), F.min(side(F.array_min, "lat")).alias("south"), F.max(side(F.array_max, "lon")).alias("east"), F.max(side(F.array_max, "lat")).alias("north"))
    tree = written(network.rivers.select(F.col("river_id").alias("id"), F.col("parent_id").alias("next")))
    extra = written(network.flows.join(tree, network.flows["src"] == tree["id"]).filter("dst <> next").select("src", "dst"))
    boxes = subtree_fold(tree.join(own.withColumnRenamed("river_id", "id"), "id", "left"), least=low, most=high)
    while True:
        sent = boxes.join(extra, boxes["id"] == extra["src"]).groupBy(F.col("dst").alias("id")).agg(*[F.min(c).alias(f"_{c}") for c in low], *[F.max(c).alias(f"_{c}") for c in high])
        wider = written(boxes.join(sent, "id").filter(" or ".join(f"_{c} < {c}" for c in low) + " or " + " or ".join(f"_{c} > {c}" for c in high)))
        if not wider.take(1):
            break
        grown = boxes.join(wider.select("id", *[f"_{c}" for c in low + high]), "id", "left").join(tree, "id")
        boxes = subtree_fold(grown.select("id", "next", *[F.least(c, f"_{c}").alias(c) for c in low], *[F.greatest(c, f"_{c}").alias(c) for c in high]), least=low, most=high)
    at = boxes.withColumnRenamed("id", "river_id").filter("west is not null").join(outlet_points(network, lines), "river_id")
    padded = geo.padded_bbox(*[F.col(c) for c in ("west", "south", "east", "north", "lon", "lat")])
    return at.select("river_id", *[b.alias(c) for b, c in zip(padded, ("west", "south", "east", "north"), strict=True)])


def _back_along(line: Column, metres: Column) -> Column:
    """The point so many metres before a line's end; its first point if it is shorter."""
    back = F.reverse(line)
    pairs = F.arrays_zip(F.slice(back, 1, F.size(back) - 1).alias("a"), F.slice(back, 2, F.size(back) - 1).alias("b"))
    none = F.lit(None).cast(_POINT)

    def step(state: Column, e: Column) -> Column:
        long_ = F.hypot(e["b"]["lon"] - e["a"]["lon"], e["b"]["lat"] - e["a"]["lat"]) * M_PER_DEG
        share = F.when(long_ > 0, (metres - state["gone"]) / long_).otherwise(0.0)
        there = F.struct((e["a"]["lon"] + (e["b"]["lon"] - e["a"]["lon"]) * share).alias("lon"), (e["a"]["lat"] + (e["b"]["lat"] - e["a"]["lat"]) * share).alias("lat"))
        found = F.when(state["at"].isNotNull(), state["at"]).when(state["gone"] + long_ >= metres, there)
        return F.struct((state["gone"] + long_).alias("gone"), found.alias("at"))

    return F.coalesce(F.aggregate(pairs, F.struct(F.lit(0.0).alias("gone"), none.alias("at")), step, lambda s: s["at"]), F.get(line, F.lit(0)))


def offset_points(network: Network, lines: DataFrame, offsets: tuple[float, ...] = OFFSETS) -> DataFrame:
    """``river_id``, ``offset_m``, ``lon``, ``lat``: points so far up a river's own course; none beyond its length.

    A river of up to ``SHORT`` segments is walked in its row, so that segments are dealt to
    rivers once, whatever the offsets; longer ones go up together (``_courses_by_rounds``).
    Lines join what was found: a mouth, or a segment in which an offset lies.
    """
    up, mouth = [float(o) for o in offsets if o > 0], min(offsets) <= 0
    kind = "array<struct<offset_m:double,cleabs:string,back_m:double>>"
    found = F.array().cast(kind)
    if up:
        each = lambda o: F.transform(F.filter("course", lambda c: (c["from_m"] < o) & (c["to_m"] >= o)), lambda c: F.struct(F.lit(o).alias("offset_m"), c["cleabs"].alias("cleabs"), (o - c["from_m"]).alias("back_m")))
        found = F.concat(found, *[each(o) for o in up])
    if mouth:
        found = F.concat(found, F.array(F.struct(F.lit(0.0).alias("offset_m"), _mouth_in_row().alias("cleabs"), F.lit(None).cast("double").alias("back_m"))))
    rows = _in_rows(network).withColumn("course", _course_in_row(max(up))) if up else _in_rows(network)
    on = rows.select("river_id", F.inline(found)).filter("cleabs is not null")
    if (long_ := _long_rivers(network)) is not None:
        if up:
            wanted = F.explode(F.array(*[F.lit(o) for o in up]))
            course = _courses_by_rounds(*long_, max(up)).withColumn("offset_m", wanted).filter("from_m < offset_m and offset_m <= to_m")
            on = on.unionByName(course.select("river_id", "offset_m", "cleabs", (F.col("offset_m") - F.col("from_m")).alias("back_m")))
        if mouth:
            on = on.unionByName(_mouths_by_rounds(*long_).select("river_id", F.lit(0.0).alias("offset_m"), "cleabs", F.lit(None).cast("double").alias("back_m")))
    p = F.when(F.col("back_m").isNull(), F.element_at("line", -1)).otherwise(_back_along(F.col("line"), F.col("back_m")))
    return on.join(lines, "cleabs").select("river_id", "offset_m", p.alias("p")).select("river_id", "offset_m", "p.lon", "p.lat")


def candidates(points: DataFrame, offsets: tuple[float, ...] = OFFSETS, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Each point with each channel threshold, in the order ``seq`` in which they are tried."""
    place = F.array_position(F.array(*[F.lit(float(o)) for o in offsets]), F.col("offset_m")) - 1
    each = points.select("*", F.posexplode(F.array(*[F.lit(t) for t in thresholds])).alias("_t", "threshold"))
    return each.withColumn("seq", (place * len(thresholds) + F.col("_t")).cast("long")).drop("_t")


def _joined(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of ``river_id`` and ``lines`` with each river's lines merged, simplified and rounded."""
    from rillway.functions import kernels

    import numpy as np

    column = batch.column("lines")
    first, at = column.offsets.to_numpy(), column.values.offsets.to_numpy()
    xy = np.column_stack([column.values.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
    made, n_lines, n_points = [], [0], [0]
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        own = [xy[at[k] : at[k + 1]] for k in range(lo, hi)]
        merged = kernels.merge_lines(own) if len(own) > 1 else own
        out = [kernels.simplify_to(m, LINE_MOST) for m in merged]
        made += out
        n_lines.append(n_lines[-1] + len(out))
        n_points += [len(m) for m in out]
    flat = np.concatenate(made) if made else np.empty((0, 2))
    points = pa.StructArray.from_arrays([pa.array([round(v, DECIMALS) for v in flat[:, k].tolist()], pa.float64()) for k in (0, 1)], ["lon", "lat"])
    lines = pa.ListArray.from_arrays(pa.array(np.cumsum(n_points), pa.int32()), points)
    return pa.RecordBatch.from_arrays([batch.column("river_id"), pa.ListArray.from_arrays(pa.array(n_lines, pa.int32()), lines)], ["river_id", "lines"])


def river_lines(network: Network, lines: DataFrame) -> DataFrame:
    """``river_id``, ``lines``: a river's segments joined where two ends meet, with at most ``LINE_MOST`` vertices each if tolerance allows.

    Spark collects a river's lines in a row, and a task takes rivers by the batch, as most have a segment or two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _joined(batch)

    own = network.segment_river.join(lines, "cleabs").groupBy("river_id").agg(F.sort_array(F.collect_list(F.struct("cleabs", "line"))).alias("_s"))
    drawn = own.select("river_id", F.filter(F.transform("_s", lambda s: s["line"]), lambda x: F.size(x) > 1).alias("lines"))
    return drawn.mapInArrow(run, f"river_id string, lines array<array<{_POINT}>>")


def rings_of_edges(edges: DataFrame, most: int = RING_MOST, decimals: int = DECIMALS) -> DataFrame:
    """``river_id``, ``rings``: boundary edges (``x1``, ``y1``, ``x2``, ``y2``) stitched to closed rings, outer ones only, simplified.

    The rows of one river's boundary meet in one task, as its ring does in one row.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from rillway.functions import delineation, kernels

        found = delineation.outer_rings(delineation.stitch(rows[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float)))
        made = [[{"lon": round(float(x), decimals), "lat": round(float(y), decimals)} for x, y in kernels.simplify_to(r, most)] for r in found]
        return pd.DataFrame({"river_id": [rows["river_id"].iloc[0]], "rings": [made]})

    return edges.groupBy("river_id").applyInPandas(run, f"river_id string, rings array<array<{_POINT}>>")


def inside_share(lines: DataFrame, rings: DataFrame) -> DataFrame:
    """``river_id``, ``frac``: the share of a river's length that lies in its catchment, 0 without any length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from rillway.functions import kernels

        import numpy as np

        xy = lambda points: np.array([(p["lon"], p["lat"]) for p in points])
        for rows in batches:
            inner = []
            for line, found in zip(rows["line"], rows["rings"], strict=True):
                inner.append(sum(kernels.length_inside(xy(line), r) for r in kernels.parts(found)))
            long_ = [float(np.hypot(*np.diff(xy(line), axis=0).T).sum()) for line in rows["line"]]
            yield pd.DataFrame({"river_id": rows["river_id"], "long": long_, "inner": inner})

    flat = rings.withColumn("rings", geo.numbered_points(F.col("rings")))
    each = lines.join(flat, "river_id").mapInPandas(run, "river_id string, long double, inner double")
    return each.groupBy("river_id").agg(F.when(F.sum("long") > 0, F.sum("inner") / F.sum("long")).otherwise(0.0).alias("frac"))


def geo_block(lines: DataFrame, outlets: DataFrame, shown: DataFrame | None = None, rings: DataFrame | None = None, cameras: DataFrame | None = None) -> DataFrame:
    """One row a river: ``lines``, ``outlet``, ``catchment`` (rings or null), ``camera``, and the box of what is drawn.

    ``shown`` (``watershed.precedence``) says whose rings count: ``rings`` has ``river_id``,
    ``source`` (``basins`` or ``dem``) and ``rings``. A river without a line is left out.
    """
    out = lines.filter(F.size("lines") > 0).join(outlets, "river_id", "left")
    end = F.element_at(F.element_at("lines", -1), -1)
    at = F.when(F.col("lon").isNotNull(), F.struct(F.round("lon", DECIMALS).alias("lon"), F.round("lat", DECIMALS).alias("lat"))).otherwise(end)
    out = out.select("river_id", "lines", at.alias("outlet"))
    if shown is not None and rings is not None:
        own = shown.filter("shown is not null").join(rings, (shown["river_id"] == rings["river_id"]) & (shown["shown"] == rings["source"])).select(shown["river_id"], F.col("rings").alias("catchment"))
        out = out.join(own, "river_id", "left")
    else:
        out = out.withColumn("catchment", F.lit(None).cast(f"array<array<{_POINT}>>"))
    if cameras is not None:
        out = out.join(cameras.select("river_id", "camera"), "river_id", "left")
    every = F.concat(F.flatten("lines"), F.array("outlet"))
    side = lambda f, k: f(F.transform(every, lambda p: p[k]))
    return out.withColumns({"west": side(F.array_min, "lon"), "south": side(F.array_min, "lat"), "east": side(F.array_max, "lon"), "north": side(F.array_max, "lat")})


def whole_box(block: DataFrame) -> DataFrame:
    return block.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def containing(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points (``p``, ``lon``, ``lat``) with the polygons (``q``, ``ring``) that hold them: met on squares of
    a hundredth of a degree or, where rings are larger, of their mean side, then tested exactly."""
    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    box = {"w": F.array_min(lon), "s": F.array_min(lat), "e": F.array_max(lon), "n": F.array_max(lat)}
    boxed = written(polygons.withColumns(box))
    mean = boxed.agg(F.avg(F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s")))).first()[0]
    side = max(mean or 0.0, 0.01)
    square = lambda c: F.floor(c / F.lit(side))
    dealt = boxed.withColumn("gx", F.explode(F.sequence(square(F.col("w")), square(F.col("e"))))).withColumn("gy", F.explode(F.sequence(square(F.col("s")), square(F.col("n")))))
    near = points.withColumns({"gx": square(F.col("lon")), "gy": square(F.col("lat"))}).join(dealt, ["gx", "gy"])
    return near.filter(drawing.inside(F.col("lon"), F.col("lat"), F.col("ring"))).select("p", "q")
