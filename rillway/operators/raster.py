"""Hydrology on a terrain table: pits, flow directions, accumulation, catchments, channels.

All of it works on tables of cells and is exact for any size; ``tiled`` does the same with a
tile to a task, and what needs a level over which water leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillway.operators.iterate import follow, subtree_sums
from rillway.plans.tables import written

#: The eight neighbours, from east clockwise: number, row step, column step.
NEIGHBOURS = [(0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)]


def neighbours(cells: DataFrame) -> DataFrame:
    """Each cell with each neighbour's height ``nz``, by one equi-join on shifted places."""
    spark = cells.sparkSession
    steps = F.broadcast(spark.createDataFrame(NEIGHBOURS, "d int, dr int, dc int"))
    shifted = cells.select("r", "c", F.col("z").alias("nz")).join(steps).select((F.col("r") - F.col("dr")).alias("r"), (F.col("c") - F.col("dc")).alias("c"), "d", "nz")
    return cells.join(shifted, ["r", "c"])


def fill_pits(cells: DataFrame) -> DataFrame:
    """Inner cells under all eight neighbours are raised to the lowest of them."""
    low = neighbours(cells).groupBy("r", "c").agg(F.min("nz").alias("_low"), F.count(F.lit(1)).alias("_n"))
    return cells.join(low, ["r", "c"], "left").select("r", "c", F.when((F.col("_n") == 8) & (F.col("z") < F.col("_low")), F.col("_low")).otherwise(F.col("z")).alias("z"))


def d8(cells: DataFrame) -> DataFrame:
    """The neighbour of steepest descent, 0 to 7 from east clockwise; the first of equals, null without descent."""
    fall = (F.col("z") - F.col("nz")) / F.when(F.col("d") % 2 == 1, F.sqrt(F.lit(2.0))).otherwise(1.0)
    best = neighbours(cells).withColumn("_f", fall).filter("_f > 0").groupBy("r", "c").agg(F.min_by("d", F.struct(-F.col("_f"), "d")).alias("d"))
    return cells.select("r", "c").join(best, ["r", "c"], "left")


def flow_edges(directions: DataFrame) -> DataFrame:
    """``src`` and ``dst`` cells as ``r:c``; flow off the table has no edge."""
    steps = F.broadcast(directions.sparkSession.createDataFrame(NEIGHBOURS, "d int, dr int, dc int"))
    name = lambda r, c: F.concat_ws(":", r, c)
    return directions.join(steps, "d").select(name(F.col("r"), F.col("c")).alias("src"), name(F.col("r") + F.col("dr"), F.col("c") + F.col("dc")).alias("dst"))


def _pointers(directions: DataFrame) -> DataFrame:
    """``id`` and ``next``: each cell and where it drains to, null where it doesn't."""
    return directions.select(F.concat_ws(":", "r", "c").alias("id")).join(flow_edges(directions).select(F.col("src").alias("id"), F.col("dst").alias("next")), "id", "left")


def accumulation(directions: DataFrame) -> DataFrame:
    """How many cells drain through each cell, itself included: a round for each bit of the longest flow path's length."""
    counted = subtree_sums(written(_pointers(directions).withColumn("acc", F.lit(1).cast("long"))), ["acc"])
    return counted.select(F.col("id").alias("cell"), "acc")


def catchment(directions: DataFrame, r: int, c: int) -> DataFrame:
    """All cells that drain through one cell, itself included: those whose chains end there once it drains no further."""
    cut = _pointers(directions).withColumn("next", F.when(F.col("id") != f"{r}:{c}", F.col("next")))
    return follow(written(cut)).filter(F.col("last") == f"{r}:{c}").select(F.col("id").alias("cell"))


def outlets(directions: DataFrame) -> DataFrame:
    """Where the water of each cell ends, by pointer doubling."""
    return follow(written(_pointers(directions))).select(F.col("id").alias("cell"), F.col("last").alias("outlet"), "hops")


def channel_mask(acc: DataFrame, threshold: int, least: int = 5) -> DataFrame:
    """Cells with more than ``threshold`` cells upstream; an error if fewer than ``least`` are left."""
    mask = acc.filter(F.col("acc") > threshold)
    if mask.limit(least).count() < least:
        raise ValueError(f"fewer than {least} channel cells above {threshold}")
    return mask


def snap(mask: DataFrame, r: float, c: float) -> DataFrame:
    """The channel cell nearest to a place; of equally near ones the smallest row, then column."""
    d2 = (F.col("r") - r) * (F.col("r") - r) + (F.col("c") - c) * (F.col("c") - c)
    return mask.select("r", "c", d2.alias("d2")).orderBy("d2", "r", "c").limit(1)


def best_candidate(candidates: DataFrame, early: float = 0.99, accept: float = 0.9) -> DataFrame:
    """Of pour points tried in order ``seq``, the one with the largest share ``frac``, up to the first of ``early``.

    Groups by ``river_id``; a river whose best is under ``accept`` has none.
    """
    w = Window.partitionBy("river_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = candidates.withColumn("_hit", F.coalesce(F.max((F.col("frac") >= early).cast("int")).over(w), F.lit(0)))
    best = seen.filter("_hit = 0").groupBy("river_id").agg(F.min_by(F.struct("seq", "frac"), F.struct(-F.col("frac"), "seq")).alias("_b"))
    return best.select("river_id", "_b.seq", "_b.frac").filter(F.col("frac") >= accept)


def largest_component(cells: DataFrame) -> DataFrame:
    """Of 4-connected groups of cells the largest; of equally large ones that of the smallest first cell."""
    name = F.concat_ws(":", F.format_string("%09d", "r"), F.format_string("%09d", "c"))
    steps = neighbours(cells).filter("d % 2 = 0").join(F.broadcast(cells.sparkSession.createDataFrame(NEIGHBOURS, "d int, dr int, dc int")), "d")
    other = F.concat_ws(":", F.format_string("%09d", F.col("r") + F.col("dr")), F.format_string("%09d", F.col("c") + F.col("dc")))
    links = written(steps.select(name.alias("a"), other.alias("b")))
    labels = written(cells.select("r", "c", name.alias("id"), name.alias("label")))
    while True:
        near = links.join(labels.select(F.col("id").alias("b"), F.col("label").alias("_n")), "b").groupBy("a").agg(F.min("_n").alias("_n")).withColumnRenamed("a", "id")
        took = labels.join(near, "id", "left").select("r", "c", "id", F.col("label").alias("_was"), F.least("label", F.coalesce("_n", "label")).alias("label"))
        took = written(took)
        up = took.select(F.col("id").alias("label"), F.col("label").alias("_up"))
        moved = written(took.join(up, "label").select("r", "c", "id", "_was", F.col("_up").alias("label")))
        labels = moved.select("r", "c", "id", "label")
        if not moved.filter("label <> _was").take(1):
            break
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1)
    return labels.join(F.broadcast(sizes), "label").select("r", "c")


def mask_edges(mask: DataFrame) -> DataFrame:
    """Sides of cells (``x1``, ``y1``, ``x2``, ``y2``, in columns and rows) where a mask (``r``, ``c``) ends: those of one cell only."""
    side = lambda x1, y1, x2, y2: F.struct((F.col("c") + x1).alias("x1"), (F.col("r") + y1).alias("y1"), (F.col("c") + x2).alias("x2"), (F.col("r") + y2).alias("y2"))
    each = mask.select(F.explode(F.array(side(0, 0, 1, 0), side(0, 1, 1, 1), side(0, 0, 0, 1), side(1, 0, 1, 1))).alias("e")).select("e.*")
    return each.groupBy("x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


def dilated(mask: DataFrame, cells: DataFrame, radius: int) -> DataFrame:
    """The cells (``r``, ``c``) that lie within ``radius`` cells of a mask's."""
    near = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    wide = mask.select(F.explode(F.array(*[F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i, j in near])).alias("p")).select("p.*").distinct()
    return wide.join(cells.select("r", "c"), ["r", "c"], "left_semi")


def sampled(cells: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (with ``pr``, ``pc`` in rows and columns) with ``height`` between the four cells around each, if these are there; places beyond the terrain's box take its edge."""
    box = cells.agg(F.min("r").alias("_r0"), F.max("r").alias("_r1"), F.min("c").alias("_c0"), F.max("c").alias("_c1"))
    at = places.join(F.broadcast(box)).withColumns({"_y": F.greatest("_r0", F.least("pr", "_r1")), "_x": F.greatest("_c0", F.least("pc", "_c1"))})
    # A place on the last row or column takes the cells before it.
    at = at.withColumns({"_r": F.least(F.floor("_y"), F.col("_r1") - 1).cast("int"), "_c": F.least(F.floor("_x"), F.col("_c1") - 1).cast("int")}).drop("_r0", "_r1", "_c0", "_c1")
    corner = lambda dr, dc, name: cells.select((F.col("r") - dr).alias("_r"), (F.col("c") - dc).alias("_c"), F.col("z").alias(name))
    for dr, dc, name in ((0, 0, "_za"), (0, 1, "_zb"), (1, 0, "_zc"), (1, 1, "_zd")):
        at = at.join(corner(dr, dc, name), ["_r", "_c"])
    u, v = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
    mixed = (F.col("_za") * (1 - v) + F.col("_zb") * v) * (1 - u) + (F.col("_zc") * (1 - v) + F.col("_zd") * v) * u
    return at.select(*places.columns, mixed.alias("height"))


def quantised(cells: DataFrame) -> DataFrame:
    """Heights as 16 bits over their range, in a low and a high byte."""
    ends = cells.agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    q = F.bround((F.col("z") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9)) * 65535).cast("int")
    return cells.join(F.broadcast(ends)).withColumn("_q", q).select("r", "c", F.col("_q").bitwiseAND(255).alias("low"), F.shiftright("_q", 8).alias("high"))


def contour_crossings(cells: DataFrame, step: float = 20.0) -> DataFrame:
    """Where contour levels cross the edges between neighbouring cells: level, cell, direction, share of the edge."""
    pairs = neighbours(cells).filter("d in (0, 2)")
    lo, hi = F.least("z", "nz"), F.greatest("z", "nz")
    levels = F.sequence((F.floor(lo / step) + 1).cast("long"), F.ceil(hi / step).cast("long") - 1)
    some = pairs.filter(F.floor(lo / step) + 1 <= F.ceil(hi / step) - 1)
    out = some.select("r", "c", "d", "z", "nz", F.explode(levels).alias("k"))
    level = F.col("k") * step
    return out.select("r", "c", "d", level.alias("level"), F.round((level - F.col("z")) / (F.col("nz") - F.col("z")), 6).alias("share"))
