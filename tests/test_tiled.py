"""Hydrology over tiles against one flood of the whole grid, and that against a queue of cells."""

import heapq

import numpy as np
import pytest

from rillway.functions import flood, kernels
from rillway.operators import raster, tiled
from rillway.operators.iterate import subtree_sums


def queue_fill(grid):
    """Lowest levels by a priority queue from the edge inwards, cell by cell."""
    out, seen = grid.copy(), np.isnan(grid)
    heap = [(grid[at], at) for at in np.ndindex(grid.shape) if flood.at_edge(grid)[at]]
    for _, at in heap:
        seen[at] = True
    heapq.heapify(heap)
    while heap:
        level, (r, c) = heapq.heappop(heap)
        for dr, dc in kernels.STEPS:
            at = r + dr, c + dc
            if 0 <= at[0] < grid.shape[0] and 0 <= at[1] < grid.shape[1] and not seen[at]:
                seen[at], out[at] = True, max(grid[at], level)
                heapq.heappush(heap, (out[at], at))
    return out


def walk_steps(filled):
    """Steps to the nearest drain over equal heights, one step at a time."""
    steps = np.where(flood.drains(filled), 0, -1)
    for k in range(filled.size):
        for r, c in np.argwhere(steps == k):
            for dr, dc in kernels.STEPS:
                at = r + dr, c + dc
                if 0 <= at[0] < filled.shape[0] and 0 <= at[1] < filled.shape[1] and steps[at] < 0 and filled[at] == filled[r, c]:
                    steps[at] = k + 1
    return steps


def grids():
    rng = np.random.default_rng(1)
    rough = rng.integers(0, 6, (24, 31)).astype(float)
    holes = rng.integers(0, 40, (20, 20)).astype(float)
    holes[rng.random(holes.shape) < 0.04] = np.nan
    lake = rng.integers(1, 4, (30, 30)).astype(float)
    lake[3:26, 3:27] = 1
    lake[12, 18:] = 0
    bowl = np.hypot(*np.mgrid[-12:13, -12:13])  # one pit in the middle of all tiles
    return {"rough": (rough, (7, 9)), "holes": (holes, (4, 20)), "lake": (lake, (6, 8)), "bowl": (bowl, (5, 5)), "one tile": (rough[:8, :8], (50, 50)), "a cell a tile": (rough[:4, :4], (1, 1))}


def test_one_grid():
    rng = np.random.default_rng(3)
    for k in range(40):
        grid = rng.integers(0, rng.integers(2, 50), (rng.integers(1, 25), rng.integers(1, 25))).astype(float)
        if k % 3 == 0:
            grid[rng.random(grid.shape) < 0.05] = np.nan
        filled = flood.fill(grid)
        assert np.array_equal(filled, queue_fill(grid), equal_nan=True)
        assert np.array_equal(flood.flat_steps(filled, np.where(flood.drains(filled), 0, -1)), walk_steps(filled))


@pytest.mark.parametrize("name", list(grids()))
def test_tiles_give_the_rows_of_one_flood(spark, name):
    grid, (high, wide) = grids()[name]
    filled = queue_fill(grid)
    d = np.where(np.isnan(grid), -1, kernels.d8(kernels.resolve_flats(filled)))
    acc = kernels.accumulate(d)
    # Places below zero, and cells without a height among the rows.
    rows = [(f"{r // high}/{c // wide}", r - 10, c - 10, None if np.isnan(grid[r, c]) else float(grid[r, c])) for r, c in np.ndindex(grid.shape)]
    got = tiled.condition(spark.createDataFrame(rows, "tile string, r int, c int, z double").repartition(3)).collect()
    want = {(r - 10, c - 10): (filled[r, c], d[r, c], acc[r, c]) for r, c in np.ndindex(grid.shape) if not np.isnan(grid[r, c])}
    assert len(got) == len(want) and {(r.r, r.c): (r.filled, r.d, r.acc) for r in got} == want


def test_statistics(spark):
    rows = [("a", r, c, 5.0 if r in (0, 3) or c in (0, 3) else 1.0) for r in range(4) for c in range(4)] + [("b", 0, 9, 2.0)]
    got = {r.tile: r for r in tiled.statistics(tiled.condition(spark.createDataFrame(rows, "tile string, r int, c int, z double"))).collect()}
    assert (got["a"].n_cells, got["a"].z_min, got["a"].z_max, got["a"].raised, got["a"].much_raised) == (16, 1.0, 5.0, 0.25, True)
    assert (got["b"].n_cells, got["b"].raised, got["b"].much_raised) == (1, 0.0, False)


def test_nothing(spark):
    assert tiled.condition(spark.createDataFrame([], "tile string, r int, c int, z double")).collect() == []


def test_subtree_sums(spark):
    # A chain of 70 into a fan, and a row of its own.
    rows = [(k, k - 1 if k else None, 1, k) for k in range(70)] + [(100 + k, 3, 1, 0) for k in range(5)] + [(500, None, 1, 7)]
    got = {r.id: (r.n, r.s) for r in subtree_sums(spark.createDataFrame(rows, "id long, next long, n long, s long"), ["n", "s"]).collect()}
    assert got[0] == (75, sum(range(70))) and got[69] == (1, 69) and got[3] == (72, sum(range(3, 70))) and got[104] == (1, 0) and got[500] == (1, 7)


def test_accumulation_and_catchment(spark):
    rng = np.random.default_rng(6)
    d = kernels.d8(rng.random((13, 17)))
    acc = kernels.accumulate(d)
    df = spark.createDataFrame([(r, c, None if d[r, c] < 0 else int(d[r, c])) for r, c in np.ndindex(d.shape)], "r int, c int, d int")
    assert {x.cell: x.acc for x in raster.accumulation(df).collect()} == {f"{r}:{c}": acc[r, c] for r, c in np.ndindex(d.shape)}
    at = np.unravel_index(int(acc.argmax()), acc.shape)
    assert raster.catchment(df, *map(int, at)).count() == acc.max()


def test_tables_and_kernels_agree(spark):
    from pyspark.sql import functions as F

    from rillway.functions import delineation, drawing, terrain

    rng = np.random.default_rng(9)
    z = rng.random((9, 11)) * 100
    mask = rng.random(z.shape) < 0.4
    cells = spark.createDataFrame([(r, c, float(z[r, c])) for r, c in np.ndindex(z.shape)], "r int, c int, z double")
    on = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(mask)], "r int, c int")
    assert sorted(map(tuple, raster.mask_edges(on).collect())) == sorted(tuple(map(int, e)) for e in delineation.mask_edges(mask))
    assert {tuple(x) for x in raster.dilated(on, cells, 3).collect()} == {tuple(x) for x in np.argwhere(delineation.dilated(mask, 3))}
    at = [(float(a), float(b)) for a, b in rng.uniform(-1, 11, (40, 2))]
    got = raster.sampled(cells, spark.createDataFrame(at, "pr double, pc double")).collect()
    assert len(got) == 40 and all(abs(kernels.bilinear(z, np.array([x.pr]), np.array([x.pc]))[0] - x.height) < 1e-9 for x in got)
    lines = [rng.uniform(-0.5, 1.5, (5, 2)) for _ in range(6)]
    meta = {"bounds": {"west": 0.0, "south": 0.0, "east": 1.0, "north": 1.0}, "cell_deg": 0.07}
    df = spark.createDataFrame([(k, [{"lon": float(x), "lat": float(y)} for x, y in line]) for k, line in enumerate(lines)], "k int, line array<struct<lon:double,lat:double>>")
    draped = {r.k: [[p.u, p.v] for p in r.p] for r in df.select("k", drawing.draped(F.col("line"), *[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)], 0.07).alias("p")).collect()}
    assert [draped[k] for k in range(6) if len(draped[k]) > 1] == terrain.draped(lines, meta)
