"""Queries on the drainage tree, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.operators import catalog as C
from rillway.operators import rivers as R
from rillway.plans.river_queries import RIVER_SQL, _with_counts, network
from rillway.plans.tables import written
from rillway.plans.views import LINE

ROOTS = ["CDE_1", "CDE_97"]


def _parts(spark, sf):
    net = network(spark, sf)
    if not hasattr(net, "kids"):
        net.counted = written(_with_counts(spark, sf))
        net.kids = written(C.partition_children(net.counted, C.join_ranks(net.edges, net.segment_river, net.rivers)))
    return net.counted, net.kids


def _tree(spark, sf):
    net = network(spark, sf)
    if not hasattr(net, "tree"):
        net.tree = written(C.nodes(*_parts(spark, sf), "CDE_1"))
    return net.tree


def q_mainline(spark, sf):
    return _parts(spark, sf)[1].filter("role = 'mainline'").select("parent_id", "river_id")


def q_tributaries(spark, sf):
    return _parts(spark, sf)[1].filter("role = 'tributary'").select("parent_id", "river_id", F.col("ordinal").cast("long").alias("ordinal"))


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def q_nodes(spark, sf):
    t = _tree(spark, sf).select("river_id", "parent_id", "role", "ordinal", "depth", "length_km", "n_upstream", "n_tributaries", "is_headwater")
    return _long(t, "ordinal", "depth", "n_upstream", "n_tributaries")


def q_truncated(spark, sf):
    t = C.nodes(*_parts(spark, sf), "CDE_1", blacklist=["CDE_5"], max_depth=2)
    return _long(t.select("river_id", "depth", "n_tributaries", "n_folded", "truncated"), "depth", "n_tributaries", "n_folded")


def q_forest(spark, sf):
    rivers, kids = _parts(spark, sf)
    trees = C.forest(rivers, kids, rivers.filter("parent_id is null"))
    return _long(trees.select("river_id", "parent_id", "depth", "n_upstream"), "depth", "n_upstream")


def q_pfafstetter(spark, sf):
    return C.pfafstetter(_parts(spark, sf)[0], "CDE_1")


def q_siblings(spark, sf):
    return C.siblings(_tree(spark, sf))


def q_breadcrumb(spark, sf):
    return C.breadcrumb(_tree(spark, sf)).select("river_id", "ancestor", F.col("up").cast("long").alias("up"))


def q_bbox(spark, sf):
    net = network(spark, sf)
    from rillway.plans.views import LINE, view

    lines = view(spark, sf, LINE).select(F.concat(F.lit("T"), "k").alias("cleabs"), "lon1", "lat1", "lon2", "lat2")
    own = net.segment_river.join(lines, "cleabs").groupBy("river_id").agg(
        F.min(F.least("lon1", "lon2")).alias("w"), F.min(F.least("lat1", "lat2")).alias("s"), F.max(F.greatest("lon1", "lon2")).alias("e"), F.max(F.greatest("lat1", "lat2")).alias("n")
    )
    return R.upstream_fold(net, own, least=["w", "s"], most=["e", "n"]).filter("w is not null").select("river_id", *[F.round(c, 5).alias(c) for c in ("w", "s", "e", "n")])


_KIDS = """
full_r AS (SELECT r.river_id, r.name, r.length_m, r.strahler, p.parent_id, coalesce(n, 0) AS n_upstream FROM river r LEFT JOIN parent p USING (river_id) LEFT JOIN n_up USING (river_id)),
tails AS (SELECT DISTINCT river_id, dst AS node FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.river_id = a.river_id AND b.src = a.dst)),
outlet AS (SELECT river_id, arg_min(node, (CASE WHEN other THEN 0 WHEN n = 0 THEN 1 ELSE 2 END, node)) AS outlet
  FROM (SELECT a.river_id, node, coalesce(bool_or(b.river_id <> a.river_id), false) AS other, count(b.river_id) AS n FROM tails a LEFT JOIN part b ON b.src = a.node GROUP BY a.river_id, node) GROUP BY river_id),
step AS (SELECT river_id, dst, min(src) AS src FROM part GROUP BY ALL),
course(river_id, node, hops) AS (SELECT river_id, outlet, 0 FROM outlet UNION ALL SELECT c.river_id, s.src, hops + 1 FROM course c JOIN step s ON s.river_id = c.river_id AND s.dst = c.node),
meets AS (SELECT f.river_id, f.parent_id, min(p.dst) AS node FROM full_r f JOIN outlet o USING (river_id) JOIN part p ON p.river_id = f.parent_id AND p.src = o.outlet GROUP BY ALL),
ranked AS (SELECT m.river_id, c.hops FROM meets m LEFT JOIN course c ON c.river_id = m.parent_id AND c.node = m.node),
main AS (
  SELECT c.*, k.hops, row_number() OVER (PARTITION BY c.parent_id ORDER BY coalesce(c.name = p.name, false) DESC, c.n_upstream DESC, c.length_m DESC, coalesce(c.name, c.river_id), c.river_id) AS pick
  FROM full_r c JOIN full_r p ON p.river_id = c.parent_id LEFT JOIN ranked k ON k.river_id = c.river_id),
kids AS (
  SELECT river_id, parent_id, CASE WHEN pick = 1 THEN 'mainline' ELSE 'tributary' END AS role,
    row_number() OVER (PARTITION BY parent_id, pick = 1 ORDER BY hops IS NULL, hops, n_upstream DESC, length_m DESC, coalesce(name, river_id), river_id) AS ordinal FROM main),
n_trib AS (SELECT parent_id, count(*) FILTER (role = 'tributary') AS n FROM kids GROUP BY parent_id),
node(river_id, parent_id, role, ordinal, depth) AS (
  SELECT 'CDE_1', CAST(NULL AS VARCHAR), 'root', CAST(1 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT k.river_id, k.parent_id, k.role, k.ordinal, depth + CASE WHEN t.n > 0 THEN 1 ELSE 0 END FROM node x JOIN kids k ON k.parent_id = x.river_id JOIN n_trib t ON t.parent_id = x.river_id)
"""
TREE_SQL = f"{RIVER_SQL}, {_KIDS}"
_CUT = """, kept AS (SELECT * FROM kids WHERE river_id <> 'CDE_5'),
kt AS (SELECT parent_id, count(*) FILTER (role = 'tributary') AS n FROM kept GROUP BY parent_id),
cutnode(river_id, depth, nt) AS (
  SELECT 'CDE_1', CAST(0 AS BIGINT), (SELECT n FROM kt WHERE parent_id = 'CDE_1')
  UNION ALL SELECT k.river_id, x.depth + CASE WHEN x.nt > 0 THEN 1 ELSE 0 END, coalesce(t.n, 0) FROM cutnode x JOIN kept k ON k.parent_id = x.river_id LEFT JOIN kt t ON t.parent_id = k.river_id WHERE NOT (x.depth >= 2 AND x.nt > 0))"""

QUERIES = {
    "mainline_pick": (q_mainline, f"{TREE_SQL} SELECT parent_id, river_id FROM kids WHERE role = 'mainline'"),
    "tributary_order": (q_tributaries, f"{TREE_SQL} SELECT parent_id, river_id, ordinal FROM kids WHERE role = 'tributary'"),
    "catalog_nodes": (q_nodes, f"{TREE_SQL} SELECT x.river_id, x.parent_id, x.role, x.ordinal, x.depth, CAST(round(f.length_m / 1000, 2) AS DOUBLE) AS length_km, f.n_upstream, coalesce(t.n, 0) AS n_tributaries, t.parent_id IS NULL AS is_headwater FROM node x JOIN full_r f USING (river_id) LEFT JOIN n_trib t ON t.parent_id = x.river_id"),
    "catalog_truncated": (q_truncated, f"{TREE_SQL}{_CUT} SELECT river_id, depth, nt AS n_tributaries, (SELECT count(*) FROM kids k WHERE k.parent_id = x.river_id AND k.river_id = 'CDE_5') AS n_folded, depth >= 2 AND nt > 0 AS truncated FROM cutnode x"),
    "forest_nodes": (q_forest, f"{TREE_SQL}, grove(river_id, parent_id, depth) AS (SELECT river_id, '_forest', CAST(1 AS BIGINT) FROM full_r WHERE parent_id IS NULL UNION ALL SELECT k.river_id, k.parent_id, depth + CASE WHEN t.n > 0 THEN 1 ELSE 0 END FROM grove x JOIN kids k ON k.parent_id = x.river_id JOIN n_trib t ON t.parent_id = x.river_id) SELECT river_id, g.parent_id, depth, n_upstream FROM grove g JOIN full_r USING (river_id) UNION ALL SELECT '_forest', NULL, 0, (SELECT count(*) FROM grove)"),
    "pfafstetter_codes": (q_pfafstetter, None),
    "sibling_window": (q_siblings, f"{TREE_SQL}, s AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY parent_id) AS n, lag(river_id) OVER w AS previous, lead(river_id) OVER w AS following FROM node WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY parent_id ORDER BY CASE WHEN role = 'mainline' THEN 0 ELSE 1 END, ordinal)) SELECT river_id, previous, following, greatest(k - 2, 0) AS more_before, greatest(n - k - 1, 0) AS more_after FROM s"),
    "breadcrumb": (q_breadcrumb, f"{TREE_SQL}, crumb(river_id, ancestor, up) AS (SELECT river_id, parent_id, CAST(1 AS BIGINT) FROM node WHERE parent_id IS NOT NULL UNION ALL SELECT c.river_id, x.parent_id, up + 1 FROM crumb c JOIN node x ON x.river_id = c.ancestor WHERE x.parent_id IS NOT NULL) SELECT river_id, ancestor, up FROM crumb"),
    "network_bbox": (q_bbox, f"{RIVER_SQL}, line AS ({LINE}), every AS (SELECT river_id, river_id AS ancestor FROM river UNION SELECT river_id, ancestor FROM above), box_of AS (SELECT p.river_id AS ancestor, min(least(lon1, lon2)) AS w, min(least(lat1, lat2)) AS s, max(greatest(lon1, lon2)) AS e, max(greatest(lat1, lat2)) AS n FROM part p JOIN line l ON concat('T', l.k) = p.cleabs GROUP BY p.river_id) SELECT river_id, round(min(w), 5) AS w, round(min(s), 5) AS s, round(max(e), 5) AS e, round(max(n), 5) AS n FROM every JOIN box_of USING (ancestor) GROUP BY river_id"),
}
