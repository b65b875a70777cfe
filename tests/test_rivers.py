"""The hand-made networks: their rivers, links, trees and traces."""

import pytest

from rillway.operators import catalog as C
from rillway.operators import rivers as R
from rillway.operators import segments as S
from rillway.operators import trace as T

SCHEMA = "cleabs string, ini string, fin string, sens string, ord string, river_key string, toponyme string, fictif boolean, length_m double"


def seg(spark, rows):
    full = [(c, a, b, k.get("sens", "Sens direct"), str(k.get("ord", 1)), k.get("key"), k.get("name"), k.get("fictif"), float(k.get("m", 1000))) for c, a, b, k in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def orme(spark):
    # Four reaches of the Orme; the Quille comes in at p2 below two nameless reaches, the Bise at p1.
    o = lambda m, ord: {"key": "RV_O", "name": "Orme", "m": m, "ord": ord}
    rows = [("o1", "p0", "p1", o(1100, 3)), ("o2", "p1", "p2", o(900, 3)), ("o3", "p2", "p3", o(1500, 4)), ("o4", "p3", "p4", o(700, 4))]
    rows += [("q1", "q0", "q1", {"key": "RV_Q", "name": "Quille", "m": 1300, "ord": 2}), ("q2", "q1", "p2", {"key": "RV_Q", "name": "Quille", "m": 800, "ord": 2})]
    rows += [("x1", "x0", "q0", {"m": 450}), ("x2", "x9", "x0", {"m": 350}), ("b1", "b0", "p1", {"key": "RV_B", "name": "Bise", "m": 600})]
    return R.build(S.graph(seg(spark, rows)))


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_rivers_of_the_orme(orme):
    rivers = {r.river_id: r for r in orme.rivers.collect()}
    assert {k: (r.length_m, r.strahler, r.parent_id, r.outlet) for k, r in rivers.items()} == {"RV_O": (4200, 4, None, "p4"), "RV_Q": (2900, 2, "RV_O", "p2"), "RV_B": (600, 1, "RV_O", "p1")}
    owner = dict(pairs(orme.segment_river))
    assert owner["x1"] == owner["x2"] == "RV_Q"
    assert pairs(R.ends(orme.edges, orme.segment_river, "sources")) == {("RV_O", "p0"), ("RV_Q", "x9"), ("RV_B", "b0")}
    above = R.catchment_segments(orme)
    assert above.filter("river_id = 'RV_O'").count() == 9 and {r.cleabs for r in above.filter("river_id = 'RV_Q'").collect()} == {"q1", "q2", "x1", "x2"}


def test_catalog_of_the_orme(orme):
    counted = R.n_upstream(orme)
    kids = C.partition_children(counted, C.join_ranks(orme.edges, orme.segment_river, orme.rivers))
    tree = {r.river_id: r for r in C.nodes(counted, kids, "RV_O").collect()}
    assert {k: (r.role, r.depth, r.is_headwater) for k, r in tree.items()} == {"RV_O": ("root", 0, False), "RV_Q": ("mainline", 1, True), "RV_B": ("tributary", 1, True)}
    assert tree["RV_O"].n_tributaries == 1
    assert pairs(C.pfafstetter(counted, "RV_O")) == {("RV_Q", "1"), ("RV_B", "3")}


def test_resolve_says_what_is_loose(orme):
    assert R.resolve(orme.rivers, "RV_Q").first().name == "Quille"
    assert R.resolve(orme.rivers, "ORM").first().river_id == "RV_O"
    with pytest.raises(ValueError):
        R.resolve(orme.rivers, "nowhere")
    with pytest.raises(ValueError, match="Quille"):
        R.resolve(orme.rivers, "i")


def test_forks_and_many_tributaries(spark):
    # A trunk t0..t6. E comes in at t1 and has F above it, G at t3; H, I and J at t5, and I forks to Z too.
    k = lambda name, m: {"key": f"RV_{name[0]}", "name": name, "m": m}
    rows = [(f"t{i}", f"t{i}", f"t{i + 1}", k("Tronc", 1000)) for i in range(6)]
    rows += [("e0", "e0", "e1", k("Est", 1500)), ("e1", "e1", "t1", k("Est", 1000)), ("f0", "f0", "e1", k("Fer", 900)), ("g0", "g0", "t3", k("Gris", 3000)), ("h0", "h0", "t5", k("Haut", 2000))]
    rows += [("i0", "i0", "t5", k("Ile", 1200)), ("i1", "i0", "z1", k("Ile", 1200)), ("j0", "j0", "t5", k("Jonc", 500)), ("z1", "z1", "z2", k("Zone", 1800))]
    net = R.build(S.graph(seg(spark, rows)))
    counted = R.n_upstream(net)
    assert {r.river_id[3:]: r.n_upstream for r in counted.collect()} == {"T": 6, "E": 1, "F": 0, "G": 0, "H": 0, "I": 0, "J": 0, "Z": 1}
    assert {r.river_id: r.outlet for r in net.rivers.collect()}["RV_I"] == "t5"
    kids = C.partition_children(counted, C.join_ranks(net.edges, net.segment_river, net.rivers))
    below = sorted((r.ordinal, r.river_id[3:]) for r in kids.filter("parent_id = 'RV_T' and role = 'tributary'").collect())
    assert below == [(1, "I"), (2, "H"), (3, "J"), (4, "G")]
    assert pairs(C.also_flows_into(net.flows)) == {("RV_I", "RV_Z")}
    assert {r.river_id[3:]: r.code for r in C.pfafstetter(counted, "RV_T").collect()} == {"E": "1", "F": "1", "G": "3", "I": "5", "H": "7", "J": "9"}
    cut = C.nodes(counted, kids, "RV_T", max_depth=0).collect()
    assert [(r.river_id, r.truncated, r.n_tributaries) for r in cut] == [("RV_T", True, 4)]
    folded = {r.river_id[3:]: r.n_folded for r in C.nodes(counted, kids, "RV_T", blacklist=["RV_H"]).collect()}
    assert folded == {"T": 1, "E": 0, "F": 0, "G": 0, "I": 0, "J": 0}
    both = C.forest(counted, kids, ["RV_Z", "RV_T"]).collect()
    assert len(both) == 9 and {(r.river_id, r.ordinal, r.depth) for r in both if r.parent_id == "_forest"} == {("RV_Z", 1, 1), ("RV_T", 2, 1)}
    every = C.forest(counted, kids, net.rivers.filter("parent_id is null")).collect()
    assert len(every) == 9 and {(r.river_id, r.ordinal) for r in every if r.parent_id == "_forest"} == {("RV_T", 1), ("RV_Z", 2)}


def test_confluence_and_direction(spark):
    rows = [("L", "k0", "k1", {"name": "Links", "m": 3000}), ("R", "k1", "r0", {"sens": "Sens inverse", "name": "Rechts", "m": 2500}), ("D1", "k1", "k2", {"ord": 2, "name": "Unten", "m": 1000}), ("D2", "k2", "k3", {"ord": 2, "name": "Unten", "m": 1500})]
    edges = S.graph(seg(spark, rows)).cache()
    assert {(r.src, r.dst) for r in edges.collect()} == {("k0", "k1"), ("r0", "k1"), ("k1", "k2"), ("k2", "k3")}
    assert {r.cleabs for r in T.trace_upstream(edges, "k3").collect()} == {"L", "R", "D1", "D2"}
    assert {r.cleabs for r in T.trace_upstream(edges, "k1").collect()} == {"L", "R"}
    assert T.trace_upstream(edges, "k9").count() == 0
    tree = T.ordered_children(T.trace_tree(edges, "k3"))
    assert {r.cleabs: (r.n_upstream, r.ordinal) for r in tree.collect()} == {"D2": (4, 1), "D1": (3, 1), "L": (1, 1), "R": (1, 2)}


def test_braids_that_turn_in_circles(spark):
    # Three reaches turn around an eyot; a feeder comes in at its head, and one arm leaves for the sea.
    eyot = [("w1", "m1", "m2", {}), ("w2", "m2", "m3", {}), ("w3", "m3", "m1", {}), ("feed", "h", "m1", {})]
    open_ring = S.graph(seg(spark, [*eyot, ("arm", "m3", "sea", {})]))
    assert {r.cleabs for r in T.trace_upstream(open_ring, "sea").collect()} == {"w1", "w2", "w3", "feed", "arm"}
    assert {r.cleabs for r in T.trace_upstream(open_ring, "m2").collect()} == {"w1", "w2", "w3", "feed"}
    assert dict(pairs(R.resolve_unnamed(open_ring)))["arm"] == "UNNAMED:sea"
    # Without the arm nothing leaves, and all four go by the ring's first node.
    assert dict(pairs(R.resolve_unnamed(S.graph(seg(spark, eyot))))) == dict.fromkeys(["w1", "w2", "w3", "feed"], "UNNAMED:m1")


def test_chains_above_a_fork(spark):
    # One reach above the foot, then two branches: one of four reaches in a row, one of two that fork again.
    trunk = [("g", "g1", "foot", {"name": "Lauter"})]
    long = [(f"l{k}", f"p{k}", f"p{k - 1}" if k > 1 else "g1", {"name": "Lauter"}) for k in range(1, 5)]
    forked = [("s1", "q1", "g1", {"name": "Sulz"}), ("s2", "q2", "q1", {"name": "Sulz"}), ("u", "u0", "q2", {"name": "Ur"}), ("v", "v0", "q2", {"name": "Vils"})]
    tree = T.trace_tree(S.graph(seg(spark, trunk + long + forked)), "foot")
    assert {r.cleabs: r.n_folded for r in T.collapse_chains(tree).collect()} == {"g": 0, "l1": 3, "s1": 1, "u": 0, "v": 0}


def test_fictitious_reaches_between_real_ones(spark):
    # A lake of two drawn-in reaches lies between the outflow and two brooks.
    rows = [("outflow", "lake", "mouth", {"m": 1200}), ("f1", "mid", "lake", {"fictif": True, "m": 90}), ("f2", "inlet", "mid", {"fictif": True, "m": 70})]
    rows += [("brook", "b0", "inlet", {"m": 640}), ("rill", "r0", "mid", {"m": 310})]
    spliced = T.splice_fictitious(T.trace_tree(S.graph(seg(spark, rows)), "mouth"))
    assert pairs(spliced.select("cleabs", "parent")) == {("outflow", None), ("brook", "outflow"), ("rill", "outflow")}


def test_cycles_of_rivers_and_nameless_forks(spark):
    rivers = spark.createDataFrame([("A", "a", 5.0), ("B", "b", 9.0), ("C", None, 1.0), ("D", "d", 1.0), ("E", "e", 1.0)], "river_id string, name string, length_m double")
    links = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "D"), ("C", "E"), ("D", "B")], "src string, dst string")
    moved, rest = R.merge_cycles(rivers, links)
    assert pairs(moved.filter("river_id <> into")) == {("A", "B")} and ("D", "B") in pairs(rest)
    moved, rest = R.fold_nameless(rivers, rest)
    assert pairs(moved) == {("C", "D")} and pairs(rest) == {("D", "B"), ("D", "E")}


def test_clean_values(spark):
    rows = spark.createDataFrame([("x", " CDE1/CDE2 ", "2"), ("nan", "/", "2.0"), ("", "NaN", None)], "a string, b string, c string")
    got = rows.select(S.clean_text("a"), S.first_of("b"), S.strict_int("c")).collect()
    assert [tuple(r) for r in got] == [("x", "CDE1", 2), (None, None, None), (None, None, None)]
