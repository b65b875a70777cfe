"""Steps whose work grew faster than their input: how many rows and tables they write, beside their results."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillway.functions import delineation
from rillway.operators import catalog as C
from rillway.operators import courses as K
from rillway.operators import iterate, nearest
from rillway.operators import mosaic as M
from rillway.operators import rivers as R


@pytest.fixture
def writes(monkeypatch):
    """The number of rows of each table that the patched modules write."""
    counts = []

    def counting(df):
        out = written(df)
        counts.append(out.count())
        return out

    written = iterate.written
    for module in (iterate, nearest, C):
        monkeypatch.setattr(module, "written", counting)
    return counts


def test_many_rings_in_one_catchment():
    mask = np.random.default_rng(3).random((2500, 40)) < 0.5
    rings = delineation.stitch(delineation.mask_edges(mask))
    began = time.monotonic()
    outer = delineation.outer_rings(rings)
    assert time.monotonic() - began < 15 and len(rings) > 6000
    few = delineation.stitch(delineation.mask_edges(mask[:60]))
    middle = [(r[0] + r[1]) / 2 for r in few]
    want = sum(sum(delineation.kernels.in_ring(*m, s) for j, s in enumerate(few) if j != k) % 2 == 0 for k, m in enumerate(middle))
    assert len(delineation.outer_rings(few)) == want < len(few) and len(outer) < len(rings)


def test_rings_counted_in_bounded_runs(monkeypatch):
    mask = np.random.default_rng(4).random((30, 20)) < 0.5
    rings = delineation.stitch(delineation.mask_edges(mask))
    want = [r.tolist() for r in delineation.outer_rings(rings)]
    monkeypatch.setattr(delineation, "EDGES_AT_ONCE", 7)
    assert [r.tolist() for r in delineation.outer_rings(rings)] == want and delineation.outer_rings([]) == []


def test_river_lines_by_the_batch(spark):
    rows = [("a", "s1", [(0.0, 0.0), (1.0, 0.0)]), ("a", "s2", [(1.0, 0.0), (2.0, 0.123456)]), ("b", "s3", [(5.0, 5.0), (6.0, 6.0)]), ("c", "s4", [(7.0, 7.0)]), ("d", "s5", None)]
    s = spark.createDataFrame(rows, "river_id string, cleabs string, line array<struct<lon:double,lat:double>>")
    made = K.river_lines(R.Network(None, s.select("river_id", "cleabs"), None, None), s.select("cleabs", "line"))
    plan = made._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan
    got = {r.river_id: [[(p.lon, p.lat) for p in line] for line in r.lines] for r in made.collect()}
    assert got == {"a": [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.12346)]], "b": [[(5.0, 5.0), (6.0, 6.0)]], "c": [], "d": []}


def test_long_lines_among_few_places(spark, writes):
    """Lines across the whole map: their squares aren't written."""
    rng = np.random.default_rng(5)
    ends = rng.uniform(0, 1e5, (3000, 4))
    lines = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(ends)], "k long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(i, float(ends[i % 5, 0]), float(ends[i % 5, 1])) for i in range(40)], "p long, px double, py double")
    got = {r.p: (r.k, r.metres) for r in nearest.nearest_lines(points, lines).collect()}
    assert got == {i: (i % 5, 0.0) for i in range(40)}
    assert sum(writes) < 2 * 3000


def test_pairs_of_a_forest_in_few_steps(spark, writes):
    """Two chains of 90 and a star: each pair once, in as many tables as the depth has bits."""
    links = [(f"a{i}", f"a{i + 1}") for i in range(90)] + [(f"b{i}", f"b{i + 1}") for i in range(90)] + [(f"s{i}", "a45") for i in range(20)]
    flows = spark.createDataFrame(links, "src string, dst string")
    got = R.upstream(R.Network(None, None, None, flows)).select("river_id", "ancestor", "depth").collect()
    after = dict(links)
    want = set()
    for s in after:
        at, n = s, 0
        while at in after:
            at, n = after[at], n + 1
            want.add((at, s, n))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert len(writes) <= 12


def test_forest_that_turns_falls_back(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string")
    assert {(r.src, r.dst, r.depth) for r in iterate.forest_closure(links).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "b", 2), ("c", "b", 1), ("c", "c", 2)}


def test_catalog_of_a_deep_tree_in_few_steps(spark, writes):
    """A chain of 80 with a tributary at each tenth place; cut at depth 3, without what lies above a banned river."""
    kids = [(f"r{i + 1}", f"r{i}", "mainline", 1) for i in range(80)] + [(f"t{i}", f"r{i}", "tributary", 1) for i in range(0, 80, 10)]
    children = spark.createDataFrame(kids, "river_id string, parent_id string, role string, ordinal int")
    names = ["r0"] + [k[0] for k in kids]
    rivers = spark.createDataFrame([(n, n, 1.0, 1, 0) for n in names], "river_id string, name string, length_m double, strahler int, n_upstream long")
    every = {r.river_id: r for r in C.nodes(rivers, children, "r0").collect()}
    assert set(every) == set(names) and every["r80"].depth == 8 and every["t70"].depth == 8 and every["r0"].depth == 0
    assert len(writes) <= 14
    cut = {r.river_id: r for r in C.nodes(rivers, children, "r0", blacklist=["t10", "r25"], max_depth=1).collect()}
    assert set(cut) == {f"r{i}" for i in range(21)} | {"t0"} and cut["r20"].truncated and cut["r10"].n_folded == 1 and not cut["t0"].truncated


def test_members_are_followed_from_basins_only(spark):
    flows = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "b"), ("b", "d")], "src string, dst string")
    net = R.Network(None, None, None, flows)
    got = {(r.river_id, r.ancestor) for r in R.downstream(net, spark.createDataFrame([("a",)], "river_id string")).collect()}
    assert got == {("b", "a"), ("c", "a"), ("d", "a")}


def test_extremes_over_a_fork_and_a_tree(spark):
    rivers = spark.createDataFrame([(n, None) for n in "abcd"], "river_id string, parent_id string")
    values = spark.createDataFrame([("a", 1, "k"), ("b", 2, "z"), ("c", 4, "m"), ("d", 8, "b")], "river_id string, n long, s string")
    for links, want in (([("a", "b"), ("b", "c"), ("d", "c")], {"a": 1, "b": 3, "c": 15, "d": 8}), ([("a", "b"), ("a", "d"), ("b", "c"), ("d", "c")], {"a": 1, "b": 3, "c": 15, "d": 9})):
        net = R.Network(None, None, rivers, spark.createDataFrame(links, "src string, dst string"))
        got = R.upstream_fold(net, values, ["n"], ["s"])
        assert {r.river_id: r.n for r in got.collect()} == want
        assert got.filter(F.col("river_id") == "c").first().s == "b"


def _walked(own, outlet, offsets):
    """A river's mouth segment and the segments in which offsets lie, one step at a time."""
    first = lambda k, node: max(((m, c, s, d) for c, s, d, m in own if (s, d)[k] == node), default=None)
    at, seen, mouth = outlet, {outlet}, None
    while e := first(0, at):
        mouth, at = e[1], e[3]
        if at in seen:
            break
        seen.add(at)
    mouth = mouth or (first(1, outlet) or (0, None))[1]
    found, at, seen, gone = {0.0: mouth} if mouth else {}, outlet, {outlet}, 0.0
    while e := first(1, at):
        found |= {o: e[1] for o in offsets if gone < o <= gone + e[0]}
        gone, at = gone + e[0], e[2]
        if at in seen or gone >= max(offsets):
            break
        seen.add(at)
    return found


def test_courses_in_rows_and_in_rounds(spark, monkeypatch):
    """Rivers that braid, turn back on themselves and run on beyond their outlet: each way of walking agrees with single steps, and short rivers write nothing."""
    rng, rows, rivers, want, offsets = np.random.default_rng(6), [], [], set(), (0.0, 3.0, 7.0, 12.0)
    for k in range(60):
        n = int(rng.integers(1, 12))
        own = [(f"s{k}_{i:02}", *(f"n{x}" for x in rng.choice(6, 2, replace=False)), float(rng.integers(0, 5))) for i in range(n)]
        outlet = own[0][2] if k % 20 else None
        # A segment's first point tells which it is.
        rows += [(*e, f"r{k}", [(float(k), 10.0 * i), (float(k), 10.0 * i)]) for i, e in enumerate(own)]
        rivers.append((f"r{k}", outlet, n))
        if outlet:
            want |= {(f"r{k}", o, float(k), 10.0 * int(c[-2:])) for o, c in _walked(own, outlet, offsets[1:]).items()}
    s = spark.createDataFrame(rows, "cleabs string, src string, dst string, length_m double, river_id string, line array<struct<lon:double,lat:double>>")
    net = R.Network(s.select("cleabs", "src", "dst", "length_m"), s.select("cleabs", "river_id"), spark.createDataFrame(rivers, "river_id string, outlet string, n_segments long"), None)
    made, write = [], K.written
    monkeypatch.setattr(K, "written", lambda df: made.append(df) or write(df))
    for short in (256, 5):
        monkeypatch.setattr(K, "SHORT", short)
        got = [tuple(r) for r in K.offset_points(net, s.select("cleabs", "line"), offsets).collect()]
        assert set(got) == want and len(got) == len(want) > 100
        assert {(r.river_id, 0.0, r.lon, r.lat) for r in K.outlet_points(net, s.select("cleabs", "line")).collect()} == {w for w in want if w[1] == 0}
        assert bool(made) == (short < 12)


def test_mosaics_of_many_boxes_on_few_tiles(spark, monkeypatch):
    """Tiles of unequal size that overlap, and boxes far larger, outside and within: as by hand, whatever the copies, with tasks by the boxes' cells."""
    rng, cell = np.random.default_rng(9), 0.001
    tiles = {"a": (0, 0, 40, 30), "b": (36, 25, 10, 10), "c": (40, 0, 5, 80), "d": (-7, -9, 9, 9)}
    frames = spark.createDataFrame([(t, c * cell, -r * cell, cell, n, m) for t, (r, c, n, m) in tiles.items()], "tile string, west double, north double, cell double, rows int, cols int")
    height = {(t, r, c): float(rng.integers(0, 1000)) for t, (_, _, n, m) in tiles.items() for r in range(n) for c in range(m) if rng.random() < 0.9}
    cells = spark.createDataFrame([(*k, z) for k, z in height.items()], "tile string, r int, c int, z double")
    spans = [(k, *(int(x) for x in rng.integers(-10, 40, 2)), *(int(x) for x in rng.integers(1, 12, 2))) for k in range(400)]
    spans += [(400, -900, -900, 5000, 5000), (401, 500, 500, 3, 3), (402, -7, -9, 1, 1)]
    # A box ends within cells: it holds those that it covers by any part.
    boxes = spark.createDataFrame([(f"k{k}", (c + 0.25) * cell, -(r + n - 0.25) * cell, (c + m - 0.25) * cell, -(r + 0.25) * cell) for k, r, c, n, m in spans], "key string, west double, south double, east double, north double")
    want, pairs = {}, set()
    for k, r0, c0, n, m in spans:
        for t, (tr, tc, rows, cols) in sorted(tiles.items(), reverse=True):
            at = max(r0 - tr, 0), min(r0 + n - 1 - tr, rows - 1), max(c0 - tc, 0), min(c0 + m - 1 - tc, cols - 1)
            if at[0] <= at[1] and at[2] <= at[3]:
                pairs.add((f"k{k}", t, *at))
                want |= {(f"k{k}", r + tr, c + tc): z for r in range(at[0], at[1] + 1) for c in range(at[2], at[3] + 1) if (z := height.get((t, r, c))) is not None}
    got = [tuple(r) for r in M.met(boxes, frames).collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    monkeypatch.setattr(M, "BOXES", 16)
    monkeypatch.setattr(M, "CELLS", 1000)
    for whole in (False, True):
        made = M.mosaic(boxes, cells, frames, whole).withColumn("task", F.spark_partition_id()).collect()
        assert {(r.key, r.r, r.c): r.z for r in made} == want and len(made) == len(want) > 8000
        tasks = [r.task for r in made if whole is False or r.key != "k400"]
        assert max(tasks.count(t) for t in set(tasks)) < 4000
        assert not whole or len({(r.key, r.task) for r in made}) == len({r.key for r in made})
