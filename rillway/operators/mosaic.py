"""Boxes on a terrain of tiles: the tiles that each box meets, and its own mosaic of their cells.

``boxes``: ``key``, ``west``, ``south``, ``east``, ``north``. ``frames``: ``tile``, ``west``, ``north`` (the
corner of its cell (0, 0)), ``cell`` (degrees), ``rows``, ``cols``. Tiles share a cell's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.plans.tables import written

#: Cells of a square along a side: boxes and cells meet on squares of tiles.
SQUARE = 64
#: So many boxes of a square meet its cells in one task, and a task has about so many cells of boxes.
BOXES, CELLS = 64, 2**19
#: Most squares along a tile's side on which tiles and boxes meet.
ALONG = 64


def met(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """The tiles that each box meets, with the rows and columns of their cells in it: ``key``, ``tile``, ``r0``, ``r1``, ``c0``, ``c1``.

    Both are dealt to squares of the mean tile's size, boxes within the terrain only, and joined
    on these; a pair that shares several squares counts in the first.
    """
    f = frames.select("tile", F.col("west").alias("_w"), F.col("north").alias("_n"), "cell", "rows", "cols")
    f = f.withColumns({"_e": F.col("_w") + F.col("cols") * F.col("cell"), "_s": F.col("_n") - F.col("rows") * F.col("cell")})
    long_ = F.greatest("rows", "cols") * F.col("cell")
    whole = f.agg(F.greatest(F.avg(long_), F.max(long_) / ALONG).alias("_side"), F.min("_w").alias("_w0"), F.min("_s").alias("_s0"), F.max("_e").alias("_e0"), F.max("_n").alias("_n0"))
    at = lambda x: F.floor(x / F.col("_side"))

    def dealt(df: DataFrame, w: str, s: str, e: str, n: str, own: str) -> DataFrame:
        lo = {f"{own}_lat": at(F.greatest(s, "_s0")), f"{own}_lon": at(F.greatest(w, "_w0"))}
        hi = {"_top": at(F.least(n, "_n0")), "_right": at(F.least(e, "_e0"))}
        on = df.join(F.broadcast(whole)).withColumns(lo | hi).filter(f"{own}_lat <= _top and {own}_lon <= _right")
        each = on.withColumn("_lat", F.explode(F.sequence(f"{own}_lat", "_top"))).withColumn("_lon", F.explode(F.sequence(f"{own}_lon", "_right")))
        return each.select(*df.columns, *lo, "_lat", "_lon")

    wanted = dealt(boxes.select("key", "west", "south", "east", "north").filter("west <= east and south <= north"), "west", "south", "east", "north", "_box")
    both = wanted.join(dealt(f, "_w", "_s", "_e", "_n", "_tile"), ["_lat", "_lon"]).filter("_lat = greatest(_box_lat, _tile_lat) and _lon = greatest(_box_lon, _tile_lon)")
    # A cell is in a box if it is so by more than rounding.
    low = lambda x: F.floor(x + 1e-6).cast("int")
    high = lambda x: (F.ceil(x - 1e-6) - 1).cast("int")
    ends = {
        "c0": F.greatest(low((F.col("west") - F.col("_w")) / F.col("cell")), F.lit(0)), "c1": F.least(high((F.col("east") - F.col("_w")) / F.col("cell")), F.col("cols") - 1),
        "r0": F.greatest(low((F.col("_n") - F.col("north")) / F.col("cell")), F.lit(0)), "r1": F.least(high((F.col("_n") - F.col("south")) / F.col("cell")), F.col("rows") - 1),
    }
    return both.withColumns(ends).filter("r0 <= r1 and c0 <= c1").select("key", "tile", "r0", "r1", "c0", "c1")


def mosaic(boxes: DataFrame, cells: DataFrame, frames: DataFrame, whole: bool = False) -> DataFrame:
    """The cells of each box: ``key``, ``r``, ``c``, ``z``; where tiles overlap, the first by name counts.

    ``r`` and ``c`` count in cells from latitude and longitude zero, so that all boxes and tiles
    share one grid: the corner of a cell is ``c * cell`` east and ``-r * cell`` north. A box is
    replicated to the squares of the tiles that it meets, and cells join it there; a cell only
    ever meets boxes that cover its square. Of a square that many boxes meet each ``BOXES`` of them
    have a copy, and tasks are as many as the boxes' cells need. With ``whole`` the cells
    of a box lie together in one task, as a caller needs who groups them by ``key``.
    """
    part = written(met(boxes, frames))
    total = part.agg(F.sum((F.col("r1") - F.col("r0") + 1).cast("long") * (F.col("c1") - F.col("c0") + 1))).first()[0] or 0
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // CELLS))
    square = ["tile", "_sr", "_sc"]
    squares = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / SQUARE).cast("int"), F.floor(F.col(hi) / SQUARE).cast("int")))
    dealt = part.withColumn("_sr", squares("r0", "r1")).withColumn("_sc", squares("c0", "c1"))
    copies = dealt.groupBy(*square).agg(F.ceil(F.count(F.lit(1)) / BOXES).alias("_n"))
    asked = dealt.join(copies, square).withColumn("_copy", F.pmod(F.xxhash64("key"), F.col("_n"))).drop("_n")
    corner = frames.select("tile", F.round(F.col("west") / F.col("cell")).cast("int").alias("_c"), F.round(-F.col("north") / F.col("cell")).cast("int").alias("_r"))
    placed = cells.filter("z is not null and not isnan(z)").select("tile", "r", "c", "z", F.floor(F.col("r") / SQUARE).cast("int").alias("_sr"), F.floor(F.col("c") / SQUARE).cast("int").alias("_sc"))
    here = placed.repartition(tasks, *square).join(copies.join(corner, "tile"), square)
    spread = here.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    on = [*square, "_copy"]
    own = spread.repartition(tasks, *on).join(asked.repartition(tasks, *on), on).filter("r between r0 and r1 and c between c0 and c1")
    shared = own.select("key", (F.col("r") + F.col("_r")).alias("r"), (F.col("c") + F.col("_c")).alias("c"), "z", "tile")
    first = F.min_by("z", "tile").alias("z")
    if whole:
        return shared.repartition(tasks, "key").groupBy("key", "r", "c").agg(first)
    near = shared.withColumns({"_qr": F.floor(F.col("r") / SQUARE), "_qc": F.floor(F.col("c") / SQUARE)})
    return near.repartition(tasks, "key", "_qr", "_qc").groupBy("key", "_qr", "_qc", "r", "c").agg(first).select("key", "r", "c", "z")
