"""Hydrology of a terrain that is cut into tiles, as if it were one grid.

``cells``: ``tile``, ``r``, ``c``, ``z``; places are those of the whole terrain, and each is in
one tile. A task holds one tile. What the tiles must agree on goes through tables that are as
long as the tiles' edges: which groups of basins touch and over which pass (filling), how many
steps a flat drains in (flats), the neighbours' heights (directions), and where water that
enters a tile leaves it (accumulation).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.operators.iterate import follow, subtree_sums
from rillway.plans.tables import written

#: The group of all that water can leave for.
OUTSIDE = -(1 << 63)
_AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


def place(r: str = "r", c: str = "c") -> Column:
    """A cell's place as one long."""
    return F.shiftleft(F.col(r).cast("long"), 32).bitwiseOR(F.col(c).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def _places(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (r.astype(np.int64) << 32) | (c.astype(np.int64) & 0xFFFFFFFF)


def _grids(pdf: pd.DataFrame, *columns: str, margin: int = 0) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Grids of ``columns`` over the rows' box and a margin, NaN where there is no row, and each row's place in them."""
    r, c = pdf.r.to_numpy(), pdf.c.to_numpy()
    i, j = r - r.min() + margin, c - c.min() + margin
    shape = int(i.max()) + 1 + margin, int(j.max()) + 1 + margin
    grids = []
    for name in columns:
        grid = np.full(shape, np.nan)
        grid[i, j] = pdf[name].to_numpy(dtype=float)
        grids.append(grid)
    return grids, i, j


def _per_tile(table: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return table.groupBy("tile").applyInPandas(run, schema)


def halo(edge: DataFrame) -> DataFrame:
    """For each tile the cells of other tiles that touch it: ``tile``, ``r``, ``c``, and ``owner``, which tile they are of.

    ``edge``: ``tile``, ``r``, ``c`` of the cells that lack a neighbour in their own tile.
    """
    near = F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in _AROUND]))
    asked = edge.select(F.col("tile"), near.alias("p")).select("tile", "p.*").distinct()
    return asked.join(edge.select(F.col("tile").alias("owner"), "r", "c"), ["r", "c"]).filter("tile <> owner").select("tile", "r", "c", "owner")


def spill_levels(passes: DataFrame) -> DataFrame:
    """``node``, ``level``: how high water rises in each node before it can leave for ``OUTSIDE``.

    ``passes``: ``a``, ``b``, ``w``. In each round every group that isn't joined to the outside
    yet joins its neighbour over its lowest pass, and all of its nodes rise to that; so there are
    at most as many rounds as the number of nodes has bits.
    """
    ends = passes.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    edges = written(ends.select("a", "b", "w", F.col("a").alias("ga"), F.col("b").alias("gb")))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    state = written(nodes.select("node", F.col("node").alias("group"), F.lit(None).cast("double").alias("level")))
    while True:
        one = F.struct("w", "a", "b")
        sides = edges.select(F.col("ga").alias("group"), one.alias("p"), F.col("gb").alias("other")).union(edges.select("gb", one, "ga"))
        best = written(sides.filter(F.col("group") != OUTSIDE).groupBy("group").agg(F.min_by("other", "p").alias("next"), F.min("p.w").alias("rise")))
        if not best.take(1):
            return state.select("node", "level")
        # Two groups that choose each other: the smaller is where both end.
        back = best.select(F.col("group").alias("next"), F.col("next").alias("_back"))
        first = F.when((F.col("_back") == F.col("group")) & (F.col("group") < F.col("next")), None).otherwise(F.col("next"))
        chosen = best.join(back, "next", "left").select(F.col("group").alias("id"), first.alias("next"))
        stays = best.select(F.col("next").alias("id")).distinct().join(best.select(F.col("group").alias("id")), "id", "left_anti").select("id", F.lit(None).cast("long").alias("next"))
        ended = follow(written(chosen.unionByName(stays))).select(F.col("id").alias("group"), "last")
        moved = state.join(best.select("group", "rise"), "group", "left").join(ended, "group", "left")
        state = written(moved.select("node", F.coalesce("last", "group").alias("group"), F.greatest("level", "rise").alias("level")))
        for side in ("ga", "gb"):
            edges = edges.join(ended.withColumnRenamed("group", side), side, "left").withColumn(side, F.coalesce("last", side)).drop("last")
        # Of the passes between two groups only the lowest can ever be chosen.
        pair = [F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")]
        edges = written(edges.filter("ga <> gb").groupBy(*pair).agg(F.min(one).alias("p")).select("p.a", "p.b", "p.w", "ga", "gb"))


def fill(cells: DataFrame) -> DataFrame:
    """``cells`` with ``filled``, the lowest level over which each cell's water can leave the terrain, and ``edge``: whether it lacks a neighbour in its tile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from rillway.functions import flood

        pdf = pdf[pdf.z.notna()].reset_index(drop=True)
        if pdf.empty:
            return pd.DataFrame(columns=["tile", "r", "c", "z", "filled", "edge", "group", "passes"])
        (grid,), i, j = _grids(pdf, "z")
        r0, c0, cols = int(pdf.r.min()), int(pdf.c.min()), grid.shape[1]
        filled, group, (a, b, w) = flood.fill_open(grid)
        name = lambda flat: _places(flat // cols + r0, flat % cols + c0)
        out = pd.DataFrame({"tile": pdf.tile, "r": pdf.r, "c": pdf.c, "z": pdf.z, "filled": filled[i, j], "edge": flood.at_edge(grid)[i, j], "group": name(group[i, j]), "passes": None})
        out.at[0, "passes"] = [{"a": int(x), "b": int(y), "w": float(h)} for x, y, h in zip(name(a), name(b), w, strict=True)]
        return out

    schema = "tile string, r int, c int, z double, filled double, edge boolean, group long, passes array<struct<a:long,b:long,w:double>>"
    made = written(_per_tile(cells.select(F.col("tile").cast("string").alias("tile"), "r", "c", "z"), run, schema))
    edge = made.filter("edge").select("tile", "r", "c", F.col("z").alias("_z"), F.col("group").alias("a"))
    around = edge.withColumn("p", F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in _AROUND])))
    # A neighbour inside the same tile is no pass of the table, but it is there.
    met = around.select("_z", "a", "tile", "p.*").join(made.select("r", "c", F.col("z").alias("_nz"), F.col("group").alias("b"), F.col("tile").alias("_of")), ["r", "c"], "left")
    across = met.filter("_of is null or _of <> tile").select("a", F.coalesce("b", F.lit(OUTSIDE)).alias("b"), F.greatest("_z", "_nz").alias("w"))
    inside = made.filter("passes is not null").select(F.explode("passes").alias("p")).select("p.*")
    levels = spill_levels(written(inside.unionByName(across.groupBy("a", "b").agg(F.min("w").alias("w")))))
    raised = made.join(levels.withColumnRenamed("node", "group"), "group", "left")
    return raised.select("tile", "r", "c", "z", F.greatest("filled", "level").alias("filled"), "edge")


def _with_halo(table: DataFrame, ring: DataFrame, columns: list[str]) -> DataFrame:
    """Each tile's cells (``own``) and those around it, with ``columns`` of both."""
    edge = table.filter("edge").select(F.col("tile").alias("owner"), "r", "c", *columns)
    outer = ring.join(edge, ["owner", "r", "c"]).select("tile", "r", "c", *columns, F.lit(False).alias("own"))
    return table.select("tile", "r", "c", *columns, F.lit(True).alias("own")).unionByName(outer)


def flat_steps(filled: DataFrame, ring: DataFrame) -> DataFrame:
    """``filled`` with ``steps``: over how many cells of its height each cell drains; null where it never does.

    A tile first counts from its own drains. Then, round by round, tiles whose neighbours know
    of a shorter way take it over, until none does; a lake takes a round for each tile's border
    that the longest of its shortest ways crosses.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from rillway.functions import flood

        (z, known), i, j = _grids(pdf, "filled", "steps")
        start = np.where(np.isnan(known), -1, known).astype(np.int64)
        drain = flood.drains(z)
        own = pdf.own.to_numpy()
        # A halo's own neighbours aren't all here: what it drains to, its tile says.
        at = np.zeros(z.shape, dtype=bool)
        at[i[own], j[own]] = True
        steps = flood.flat_steps(z, np.where(drain & at, 0, start))[i, j][own]
        pdf = pdf[own]
        return pd.DataFrame({"tile": pdf.tile, "r": pdf.r, "c": pdf.c, "steps": np.where(steps < 0, None, steps)}).astype({"steps": "Int64"})

    base = filled.withColumn("steps", F.lit(None).cast("long"))
    facts = ["tile", "r", "c"]
    found = written(_per_tile(_with_halo(base, ring, ["filled", "steps"]), run, "tile string, r int, c int, steps long"))
    table = written(filled.join(found, facts))
    sides = written(_touching(table, ring))
    while True:
        known = table.filter("edge").select("tile", "r", "c", "steps")
        mine, theirs = known.withColumnRenamed("steps", "_s"), known.select(F.col("tile").alias("owner"), F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("steps").alias("_t"))
        better = sides.join(mine, facts).join(theirs, ["owner", "nr", "nc"]).filter("_t is not null and (_s is null or _t + 1 < _s)")
        todo = written(better.select("tile").distinct())
        if not todo.take(1):
            return table
        again = _with_halo(table, ring, ["filled", "steps"]).join(todo, "tile", "left_semi")
        found = written(_per_tile(again, run, "tile string, r int, c int, steps long").withColumnRenamed("steps", "_new"))
        table = written(table.join(found, facts, "left").withColumn("steps", F.coalesce("_new", "steps")).drop("_new"))


def _touching(table: DataFrame, ring: DataFrame) -> DataFrame:
    """Cells of two tiles that touch and are equally high: ``tile``, ``r``, ``c``, ``owner``, ``nr``, ``nc``."""
    edge = table.filter("edge")
    near = F.explode(F.array(*[F.struct((F.col("r") + dr).alias("nr"), (F.col("c") + dc).alias("nc")) for dr, dc in _AROUND]))
    mine = edge.select("tile", "r", "c", "filled", near.alias("p")).select("tile", "r", "c", "filled", "p.*")
    theirs = edge.select(F.col("tile").alias("owner"), F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("filled").alias("_f"))
    return mine.join(theirs, ["nr", "nc"]).filter("tile <> owner and filled = _f").select("tile", "r", "c", "owner", "nr", "nc")


def directions(flats: DataFrame, ring: DataFrame) -> DataFrame:
    """``flats`` with ``d``, the neighbour of steepest descent over all tiles, -1 without one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from rillway.functions import kernels

        (z, steps), i, j = _grids(pdf, "filled", "steps")
        down = kernels.d8(z + np.where(np.nan_to_num(steps) > 0, np.nan_to_num(steps) * kernels.TINY, 0))
        own = pdf.own.to_numpy()
        pdf = pdf[own]
        return pd.DataFrame({"tile": pdf.tile, "r": pdf.r, "c": pdf.c, "d": down[i[own], j[own]].astype("int32")})

    found = _per_tile(_with_halo(flats, ring, ["filled", "steps"]), run, "tile string, r int, c int, d int")
    return flats.join(found, ["tile", "r", "c"])


def _routed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tile's directions, those that leave it cut off, with each row's place, and where each row's water goes next."""
    from rillway.functions import kernels

    (d,), i, j = _grids(pdf, "d")
    down = np.where(np.isnan(d), -1, d).astype(int)
    to = kernels.targets(down)
    # Water that flows to a cell that isn't in the tile leaves it too.
    there = ~np.isnan(d).ravel()
    leaves = (down.ravel() >= 0) & ((to < 0) | ~there[np.maximum(to, 0)])
    return np.where(leaves.reshape(down.shape), -1, down), leaves[i * d.shape[1] + j], i * d.shape[1] + j


def accumulation(routed: DataFrame) -> DataFrame:
    """``routed`` (``tile``, ``r``, ``c``, ``d``, ``edge``) with ``acc``: cells of all tiles that drain through each, itself included."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        from rillway.functions import flood, kernels

        down, leaves, at = _routed(pdf)
        to, acc = kernels.targets(down), kernels.accumulate(down).ravel()
        end = flood.jump(np.where(to < 0, np.arange(to.size), to))
        row = np.full(down.size, -1)
        row[at] = np.arange(len(pdf))
        r, c, d = pdf.r.to_numpy(), pdf.c.to_numpy(), pdf.d.to_numpy()
        steps = np.array(kernels.STEPS)
        last = row[end[at]]
        exits = leaves[last]
        edge = pdf.edge.to_numpy()
        nr, nc = r[last] + steps[d[last], 0], c[last] + steps[d[last], 1]
        out = pd.DataFrame({"id": _places(r, c), "next": np.where(exits, _places(nr, nc), 0), "goes": exits, "out": np.where(leaves, acc[at], 0)})
        return out[edge]

    thin = routed.select("tile", "r", "c", "d", "edge")
    found = written(_per_tile(thin, links, "id long, next long, goes boolean, out long"))
    # Water that goes to a place without a cell has left the terrain.
    known = found.select(F.col("id").alias("next"), F.lit(True).alias("_there"))
    chained = found.join(known, "next", "left").select("id", F.when(F.col("goes") & F.col("_there"), F.col("next")).alias("next"), "out")
    entered = chained.filter("out > 0 and next is not null").groupBy(F.col("next").alias("id")).agg(F.sum("out").alias("inflow"))
    forest = chained.join(entered, "id", "left").select("id", "next", F.coalesce("inflow", F.lit(0)).alias("inflow"))
    total = subtree_sums(written(forest), ["inflow"]).filter("inflow > 0").select("id", "inflow")
    given = thin.withColumn("id", place()).join(total, "id", "left").withColumn("inflow", F.coalesce("inflow", F.lit(0)))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        from rillway.functions import kernels

        down, _, at = _routed(pdf)
        own = np.zeros(down.size, dtype=np.int64)
        own[at] = 1 + pdf.inflow.to_numpy()
        return pd.DataFrame({"tile": pdf.tile, "r": pdf.r, "c": pdf.c, "acc": kernels.accumulate(down, own).ravel()[at]})

    counted = _per_tile(given, finish, "tile string, r int, c int, acc long")
    return routed.join(counted, ["tile", "r", "c"])


def condition(cells: DataFrame) -> DataFrame:
    """``tile``, ``r``, ``c``, ``z``, ``filled``, ``d``, ``acc``: filled, flats drained, routed and accumulated over all tiles.

    Cells without a height are left out, and count as outside.
    """
    filled = written(fill(cells))
    ring = written(halo(filled.filter("edge").select("tile", "r", "c")))
    routed = written(directions(flat_steps(filled, ring), ring))
    return accumulation(routed).select("tile", "r", "c", "z", "filled", "d", "acc")


def statistics(conditioned: DataFrame, raised_m: float = 0.5, much: float = 0.05) -> DataFrame:
    """One row a tile: cells, range of heights, the share raised by more than ``raised_m``, and whether that deserves a warning."""
    share = F.avg(F.when(F.col("filled") - F.col("z") > raised_m, 1.0).otherwise(0.0))
    each = conditioned.groupBy("tile").agg(F.count(F.lit(1)).alias("n_cells"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), share.alias("raised"), *([F.max("acc").alias("most_acc")] if "acc" in conditioned.columns else []))
    return each.withColumn("much_raised", F.col("raised") > much)
