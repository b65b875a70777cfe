"""Nearest line to each point: squares of lines, searched from large ones to small ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions import geo
from rillway.plans.tables import written

#: At most so many squares are where the search begins.
TOP = 64
#: A square holds some lines (SIDE times the square that each line would have to itself), and a line crosses at most about 2 * MOST squares.
SIDE, MOST = 4.0, 1024
#: Metres: how far a line is widened, and a proof held back, for rounding.
EPS = 0.01


def _square(v: Column, side: float) -> Column:
    return F.floor(v / F.lit(side)).cast("long")


def in_squares(lines: DataFrame, side: float, eps: float = EPS) -> DataFrame:
    """A row for each line (``x1``, ``y1``, ``x2``, ``y2``) and each square (``gx``, ``gy``) that it touches, widened by ``eps``."""
    west, east = F.least("x1", "x2") - eps, F.greatest("x1", "x2") + eps
    cols = lines.withColumn("gx", F.explode(F.sequence(_square(west, side), _square(east, side))))
    dx = F.when(F.abs(F.col("x2") - F.col("x1")) > eps, F.col("x2") - F.col("x1"))

    def share(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("x1")) / dx))

    # The part of the line that lies in this column of squares.
    a, b = share(F.col("gx") * side - eps), share((F.col("gx") + 1) * side + eps)
    y = [F.when(dx.isNotNull(), F.col("y1") + t * (F.col("y2") - F.col("y1"))).otherwise(F.col(end)) for t, end in ((a, "y1"), (b, "y2"))]
    cols = cols.withColumn("_ya", y[0]).withColumn("_yb", y[1])
    south, north = F.least("_ya", "_yb") - eps, F.greatest("_ya", "_yb") + eps
    return cols.withColumn("gy", F.explode(F.sequence(_square(south, side), _square(north, side)))).drop("_ya", "_yb")


def _measured(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("metres", F.round(geo.point_segment_m(*[F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")]), 3))


def _best(measured: DataFrame) -> DataFrame:
    return measured.groupBy("p").agg(F.min(F.struct("metres", "k")).alias("b")).select("p", "b.k", "b.metres")


def _pyramid(squares: DataFrame) -> list[DataFrame]:
    """The squares that hold lines, then those of four times the side that hold these, and so on up to at most ``TOP``."""
    levels = [written(squares.select(F.col("gx").alias("x"), F.col("gy").alias("y")).distinct())]
    while levels[-1].count() > TOP:
        levels.append(written(levels[-1].select(F.shiftright("x", 2).alias("x"), F.shiftright("y", 2).alias("y")).distinct()))
    return levels


def _within_reach(near: DataFrame, side: float) -> DataFrame:
    """Of the squares (``x``, ``y``) that each point may have its nearest line in, those that are no farther than some line must be.

    A square that holds part of a line has it no farther away than its farthest corner.
    """
    low, high = (lambda g: F.col(g) * side - EPS), (lambda g: (F.col(g) + 1) * side + EPS)
    out = lambda p, g: F.greatest(F.lit(0.0), low(g) - F.col(p), F.col(p) - high(g))
    far = lambda p, g: F.greatest(F.abs(F.col(p) - low(g)), F.abs(high(g) - F.col(p)))
    measured = near.withColumns({"_lo": F.hypot(out("px", "x"), out("py", "y")), "_hi": F.hypot(far("px", "x"), far("py", "y"))})
    best = measured.groupBy("p").agg(F.min("_hi").alias("_most"))
    return measured.join(best, "p").filter(F.col("_lo") <= F.col("_most") + EPS).drop("_lo", "_hi", "_most")


def _reached(places: DataFrame, levels: list[DataFrame], side: float) -> DataFrame:
    """The squares (``gx``, ``gy``) that each place (``p``, ``px``, ``py``) may have its nearest line in, with ``lo``, the least that it is away."""
    # The largest squares, at most TOP of them, are part of the plan.
    top = F.array(*[F.struct(F.lit(r.x).alias("x"), F.lit(r.y).alias("y")) for r in levels[-1].collect()])
    near = places.select("p", "px", "py", F.explode(top).alias("s")).select("p", "px", "py", "s.x", "s.y")
    for k in range(len(levels) - 1, -1, -1):
        near = written(_within_reach(near, side * 4**k))
        if k:
            below = levels[k - 1].select(F.shiftright("x", 2).alias("_x"), F.shiftright("y", 2).alias("_y"), F.col("x").alias("_cx"), F.col("y").alias("_cy"))
            near = near.join(below, (near["x"] == below["_x"]) & (near["y"] == below["_y"])).select("p", "px", "py", F.col("_cx").alias("x"), F.col("_cy").alias("y"))
    out = lambda p, g: F.greatest(F.lit(0.0), F.col(g) * side - EPS - F.col(p), F.col(p) - (F.col(g) + 1) * side - EPS)
    return near.select("p", "px", "py", F.col("x").alias("gx"), F.col("y").alias("gy"), F.hypot(out("px", "x"), out("py", "y")).alias("lo"))


def nearest_lines(points: DataFrame, lines: DataFrame, side: float | None = None) -> DataFrame:
    """``p``, ``k`` and ``metres`` of the nearest line, by (metres to a millimetre, k).

    ``points`` has ``p``, ``px``, ``py``; ``lines`` has ``k``, ``x1``, ``y1``, ``x2``, ``y2``, in
    metres. Squares that hold lines are searched from a few large ones down to those of some
    lines each: a point goes on to the parts of the squares that can't be ruled out. So a point
    far from all lines costs as much as one among them, and no point meets all lines.

    Points of one place are asked once. A place first meets the lines of its closest square, and
    then those of other squares only that are no farther than the best of these. The squares of
    lines are made as they are read and not written, and are no smaller than a place has to
    itself, so that long lines among few places cross few of them.
    """
    # A line becomes many rows, so that lines are dealt to as many tasks as may run, however small their table.
    lines = written(lines.repartition(4 * lines.sparkSession.sparkContext.defaultParallelism))
    x0, x1, y0, y1, n = lines.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2")), F.count(F.lit(1))).first()
    if not n:
        return _best(_measured(points.join(lines.withColumnRenamed("k", "p").select("p", "x1", "y1", "x2", "y2"), "p").withColumn("k", F.col("p"))))
    places = written(points.select("px", "py").distinct().withColumn("p", F.struct("px", "py")))
    w, h = x1 - x0, y1 - y0
    side = side or max(SIDE * (w * h / n) ** 0.5, (w * h / max(places.count(), 1)) ** 0.5, max(w, h) / MOST, 1.0)
    near = written(_reached(places, _pyramid(in_squares(lines, side)), side))
    closest = written(near.groupBy("p").agg(F.min(F.struct("lo", "gx", "gy", "px", "py")).alias("c")).select("p", "c.*"))
    known = written(_measured(closest.join(in_squares(lines, side), ["gx", "gy"])).groupBy("p").agg(F.min("metres").alias("_m")))
    # Places whose closest square has no line after all meet all that are within reach.
    asked = written(near.join(known, "p", "left").filter(F.col("_m").isNull() | (F.col("lo") <= F.col("_m") + EPS)).select("p", "px", "py", "gx", "gy", "_m"))
    met = _measured(asked.join(in_squares(lines, side), ["gx", "gy"])).filter(F.col("_m").isNull() | (F.col("metres") <= F.col("_m")))
    return points.join(_best(met).select("p.px", "p.py", "k", "metres"), ["px", "py"]).select("p", "k", "metres")
