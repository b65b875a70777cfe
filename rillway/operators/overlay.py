"""Unions and repair of polygons that overlap, touch or cross themselves.

``polygons``: ``basin``, ``rings`` (closed arrays of structs with ``x`` and ``y``); a place is in a
polygon if a ray from it crosses its rings an odd number of times, so a ring that crosses
itself has the parts that ``make_valid`` leaves. All rings are cut where they meet, once for all
polygons (``cover``): a row for each piece and each polygon on a side of it. The union of any
set of polygons is then what has one of them on just one side, by a join and a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions import geo
from rillway.operators.nearest import in_squares
from rillway.plans.tables import written

#: Places after the point that coordinates are rounded to: a tenth of a millimetre in degrees.
PLACES = 9
#: Squares along the longer side of everything, at most: those of a line are an array in its row. What a square holds grows beyond that, with the square of the extent.
MOST = 1 << 20


def _edges_of(rings: Column) -> Column:
    pairs = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a["x"].alias("xa"), a["y"].alias("ya"), b["x"].alias("xb"), b["y"].alias("yb")))
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 3), pairs))


def _prepared(polygons: DataFrame, places: int) -> DataFrame:
    """``basin``, its edges as one array, and its box."""
    near = lambda v: F.round(v.cast("double"), places)
    rounded = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(near(p["x"]).alias("x"), near(p["y"]).alias("y"))))
    own = polygons.filter("rings is not null").select("basin", _edges_of(rounded).alias("edges")).filter(F.size("edges") > 0)
    side = lambda f, k: f(F.transform("edges", lambda e: e[k]))
    return own.withColumns({"w": side(F.array_min, "xa"), "e": side(F.array_max, "xa"), "s": side(F.array_min, "ya"), "n": side(F.array_max, "ya")})


def _cuts(lines: DataFrame, side: float, tol: float, places: int) -> DataFrame:
    """Where lines (``x1``, ``y1``, ``x2``, ``y2``) meet others: ``k``, the line's ends, and ``x``, ``y``. A crossing is computed once, so both lines get the same place."""
    c, ends = F.col, ("x1", "y1", "x2", "y2")
    dealt = written(in_squares(lines.select(*ends, F.hypot(c("x2") - c("x1"), c("y2") - c("y1")).alias("size")), side, 2 * tol))
    a, b = (dealt.select("gx", "gy", *[c(n).alias(f"{s}_{n}") for n in (*ends, "size")]) for s in "ab")
    dx, dy = {s: c(f"{s}_x2") - c(f"{s}_x1") for s in "ab"}, {s: c(f"{s}_y2") - c(f"{s}_y1") for s in "ab"}
    size, key = {s: c(f"{s}_size") for s in "ab"}, lambda s: F.struct(F.struct(c(f"{s}_x1").alias("x"), c(f"{s}_y1").alias("y")).alias("a"), F.struct(c(f"{s}_x2").alias("x"), c(f"{s}_y2").alias("y")).alias("b")).alias("k")

    def on(s: str, px: Column, py: Column) -> Column:
        off = F.abs(dx[s] * (py - c(f"{s}_y1")) - dy[s] * (px - c(f"{s}_x1"))) / size[s]
        along = (dx[s] * (px - c(f"{s}_x1")) + dy[s] * (py - c(f"{s}_y1"))) / size[s]
        return (off <= tol) & (along > tol) & (along < size[s] - tol)

    # Ends of some that lie on others.
    points = lines.select(F.explode(F.array(F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y")))).alias("p")).select("p.*").distinct()
    there = points.withColumns({"gx": F.floor(c("x") / F.lit(side)).cast("long"), "gy": F.floor(c("y") / F.lit(side)).cast("long")})
    near = " and ".join(f"{v} between least(a_{v}1, a_{v}2) - {2 * tol!r}D and greatest(a_{v}1, a_{v}2) + {2 * tol!r}D" for v in "xy")
    ended = a.join(there, ["gx", "gy"]).filter(near).filter(on("a", c("x"), c("y"))).select(key("a"), "x", "y")
    # Crossings of both within; a pair that meets in several squares gives the same place in each.
    apart = " or ".join(f"greatest(a_{v}1, a_{v}2) < least(b_{v}1, b_{v}2) - {tol!r}D or greatest(b_{v}1, b_{v}2) < least(a_{v}1, a_{v}2) - {tol!r}D" for v in "xy")
    ordered = "a_y2 < b_y2"
    for n in ("x2", "y1", "x1"):
        ordered = f"a_{n} < b_{n} or a_{n} = b_{n} and ({ordered})"
    det = dx["a"] * dy["b"] - dy["a"] * dx["b"]
    ox, oy = c("b_x1") - c("a_x1"), c("b_y1") - c("a_y1")
    det = F.when(F.abs(det) > 1e-14 * size["a"] * size["b"], det)
    t, u = (ox * dy["b"] - oy * dx["b"]) / det, (ox * dy["a"] - oy * dx["a"]) / det
    within = lambda share, s: (share * size[s] > tol) & (share * size[s] < size[s] - tol)
    crossed = a.join(b, ["gx", "gy"]).filter(f"not ({apart}) and ({ordered})").filter(within(t, "a") & within(u, "b"))
    # What touches an end of the other is cut at that end alone.
    touch = on("a", c("b_x1"), c("b_y1")) | on("a", c("b_x2"), c("b_y2")) | on("b", c("a_x1"), c("a_y1")) | on("b", c("a_x2"), c("a_y2"))
    at = [F.struct(key(s), F.round(c("a_x1") + t * dx["a"], places).alias("x"), F.round(c("a_y1") + t * dy["a"], places).alias("y")) for s in "ab"]
    # Asked for the few pairs that cross, within the array: as a filter it would make the join's own code too long to be compiled.
    both = crossed.select(F.explode(F.filter(F.array(*[F.when(~touch, f) for f in at]), lambda f: f.isNotNull())).alias("f")).select("f.*")
    return ended.unionByName(both).distinct()


def pieces(polygons: DataFrame, places: int = PLACES) -> DataFrame:
    """All rings of ``_prepared`` polygons cut where they meet: distinct ``x1``, ``y1``, ``x2``, ``y2``, the smaller end first."""
    e = polygons.select(F.explode("edges").alias("e")).select("e.*")
    first = F.least(F.struct(F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.col("xb").alias("x"), F.col("yb").alias("y")))
    last = F.greatest(F.struct(F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.col("xb").alias("x"), F.col("yb").alias("y")))
    ends = e.select(first.alias("a"), last.alias("b")).filter("a <> b").distinct()
    lines = written(ends.select(F.struct("a", "b").alias("k"), F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")))
    facts = lines.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))), F.max(F.greatest("x1", "x2")) - F.min("x1"), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).first()
    if facts[0] is None:
        return lines.drop("k")
    tol = 2.0 * 10**-places
    # By the mean, so that all lines together lie in a few squares each, whatever the extent.
    side = max(facts[0], max(facts[1], facts[2]) / MOST, 100 * tol)
    cuts = _cuts(lines, side, tol, places)
    along = lambda x, y: (x - F.col("x1")) * (F.col("x2") - F.col("x1")) + (y - F.col("y1")) * (F.col("y2") - F.col("y1"))
    inner = lines.join(cuts, "k").groupBy("k").agg(F.collect_set(F.struct(along(F.col("x"), F.col("y")).alias("t"), "x", "y")).alias("at"))
    whole = lines.join(inner, "k", "left")
    end = lambda n: F.struct(along(F.col(f"x{n}"), F.col(f"y{n}")).alias("t"), F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y"))
    points = F.array_sort(F.concat(F.array(end(1), end(2)), F.coalesce("at", F.array().cast("array<struct<t:double,x:double,y:double>>"))))
    place = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    cut = whole.select(points.alias("p")).select(F.explode(F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.struct(F.least(place(a), place(b)).alias("a"), F.greatest(place(a), place(b)).alias("b")))).alias("e"))
    return cut.filter("e.a <> e.b").select(F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).distinct()


def _boxes_in_squares(boxes: DataFrame, side: float, tol: float) -> DataFrame:
    square = lambda v: F.floor(v / F.lit(side))
    return boxes.withColumn("gx", F.explode(F.sequence(square(F.col("w") - tol), square(F.col("e") + tol)))).withColumn("gy", F.explode(F.sequence(square(F.col("s") - tol), square(F.col("n") + tol))))


def cover(polygons: DataFrame, places: int = PLACES) -> DataFrame:
    """``x1``, ``y1``, ``x2``, ``y2``, ``basin``, ``left``, ``right``: each piece of the rings with each polygon that lies on a side of it."""
    own = written(_prepared(polygons, places))
    cut = pieces(own, places)
    steep = F.abs(F.col("y2") - F.col("y1")) >= F.col("x2") - F.col("x1")
    mid = written(cut.withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2, "steep": steep}))
    wide, high = F.col("e") - F.col("w"), F.col("n") - F.col("s")
    mean, area, extent = own.agg(F.avg(F.greatest(wide, high)), F.avg(wide * high), F.greatest(F.max("e") - F.min("w"), F.max("n") - F.min("s"))).first()
    tol = 4.0 * 10**-places
    # By the mean side and the mean area, so that all boxes together lie in a few squares each.
    side = max(mean or 0.0, (area or 0.0) ** 0.5, (extent or 0.0) / MOST, 100 * tol)
    met = mid.withColumns({"gx": F.floor(F.col("mx") / F.lit(side)), "gy": F.floor(F.col("my") / F.lit(side))}).join(_boxes_in_squares(own, side, tol), ["gx", "gy"])
    met = met.filter(f"mx between w - {tol!r}D and e + {tol!r}D and my between s - {tol!r}D and n + {tol!r}D")

    def crossed(p: str, q: str) -> Column:
        """Edges that cross the line of equal ``q`` through the middle: those beyond it in the direction of ``p``, and 2^32 for each at it."""
        at, level = F.col(f"m{p}"), F.col(f"m{q}")

        def step(state: Column, e: Column) -> Column:
            cuts = (e[f"{q}a"] > level) != (e[f"{q}b"] > level)
            past = e[f"{p}a"] + (level - e[f"{q}a"]) / (e[f"{q}b"] - e[f"{q}a"]) * (e[f"{p}b"] - e[f"{p}a"]) - at
            return F.when(cuts, state + F.when(F.abs(past) <= tol, F.lit(1 << 32)).when(past > 0, F.lit(1)).otherwise(F.lit(0))).otherwise(state)

        return F.aggregate("edges", F.lit(0).cast("long"), step)

    # A steep piece is crossed by a ray to the east, a level one by a ray to the north.
    count = F.when(F.col("steep"), crossed("x", "y")).otherwise(crossed("y", "x"))
    sided = met.withColumn("_n", count).withColumns({"_far": F.expr("_n & 1") == 1, "_near": F.expr("(_n ^ shiftright(_n, 32)) & 1") == 1}).filter("_far or _near")
    # East of a piece that runs upwards is to its right; all else that a ray goes to is to its left.
    swap = F.col("steep") & (F.col("y2") > F.col("y1"))
    return sided.select("x1", "y1", "x2", "y2", "basin", F.when(swap, F.col("_near")).otherwise(F.col("_far")).alias("left"), F.when(swap, F.col("_far")).otherwise(F.col("_near")).alias("right"))


def union_edges(members: DataFrame, covered: DataFrame) -> DataFrame:
    """The boundary of the union of each river's polygons: ``river_id``, the piece, and ``left``: whether the union is to its left.

    ``members``: ``river_id``, ``basin``.
    """
    each = members.select("river_id", "basin").distinct().join(covered, "basin")
    return each.groupBy("river_id", "x1", "y1", "x2", "y2").agg(F.max("left").alias("left"), F.max("right").alias("right")).filter("left <> right").drop("right")


def union_areas(edges: DataFrame, lambert: bool = False) -> DataFrame:
    """``river_id``, ``area`` of the unions whose boundaries ``union_edges`` gives; with ``lambert``, of longitudes and latitudes in square kilometres."""
    if lambert:
        (ax, ay), (bx, by) = geo.lambert93(F.col("x1"), F.col("y1")), geo.lambert93(F.col("x2"), F.col("y2"))
    else:
        ax, ay, bx, by = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    # From the first vertex of all, so that large coordinates don't cancel.
    each = edges.select("river_id", "left", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    origin = each.groupBy("river_id").agg(F.min("ax").alias("ox"), F.min("ay").alias("oy"))
    twice = (F.col("ax") - F.col("ox")) * (F.col("by") - F.col("oy")) - (F.col("bx") - F.col("ox")) * (F.col("ay") - F.col("oy"))
    total = F.sum(F.when(F.col("left"), twice).otherwise(-twice)) / (2e6 if lambert else 2)
    return each.join(origin, "river_id").groupBy("river_id").agg(total.alias("area"))


def repaired(polygons: DataFrame, places: int = PLACES) -> DataFrame:
    """The boundaries of polygons that may cross themselves, each by itself, as ``union_edges`` under ``basin``'s name."""
    alone = polygons.select(F.col("basin").alias("river_id"), "basin")
    return union_edges(alone, cover(polygons, places))
