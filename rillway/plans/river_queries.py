"""Queries on segments and rivers, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.operators import rivers as R
from rillway.operators import segments as S
from rillway.operators import trace as T
from rillway.operators.iterate import closure
from rillway.plans.tables import written
from rillway.plans.views import SEG, SEG_PARALLEL, view

_NETWORKS: dict = {}


def forget() -> None:
    """Lets the next query build its network anew."""
    _NETWORKS.clear()


def network(spark: SparkSession, sf_dir: str) -> R.Network:
    """The river network of ``sf_dir``, kept for the application as long as the files that it
    came from are the same, by name, size and time, and the tables that it was written to are there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def status(name: str):
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        return (name, fs.getFileStatus(path).getLen(), fs.getFileStatus(path).getModificationTime()) if fs.exists(path) else None

    source = spark.read.parquet(f"{sf_dir}/orders.parquet").inputFiles()
    key = spark.sparkContext.applicationId, sf_dir, tuple(status(f) for f in sorted(source))
    if key in _NETWORKS:
        net = _NETWORKS[key]
        tables = [net.edges, net.segment_river, net.rivers, net.flows, *[t for n in ("closed", "counted", "kids", "tree") if (t := getattr(net, n, None)) is not None]]
        if all(status(f) for t in tables for f in t.inputFiles()):
            return net
    _NETWORKS.clear()
    _NETWORKS[key] = R.build(S.graph(view(spark, sf_dir, SEG)))
    return _NETWORKS[key]


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    if not hasattr(net, "closed"):
        net.closed = written(R.upstream(net))
    return net.closed


# DuckDB ---------------------------------------------------------------------------------
_BASE = f"""
seg AS ({SEG}),
edge AS (
  SELECT cleabs, CASE WHEN sens = 'Sens inverse' THEN fin ELSE ini END AS src, CASE WHEN sens = 'Sens inverse' THEN ini ELSE fin END AS dst,
         ord, river_key, toponyme AS name, fictif, length_m FROM seg WHERE sens NOT IN ('Double sens', 'Indéterminé') AND ini <> fin)
"""
_WALK = """
walk(cleabs, spot, key, n) AS (
  SELECT cleabs, dst, river_key, 0 FROM edge
  UNION ALL SELECT w.cleabs, e.dst, e.river_key, n + 1 FROM walk w JOIN edge e ON e.src = w.spot WHERE w.key IS NULL),
owner AS (SELECT cleabs, coalesce(key, concat('UNNAMED:', spot)) AS river_id FROM (SELECT *, row_number() OVER (PARTITION BY cleabs ORDER BY n DESC) AS r FROM walk) WHERE r = 1)
"""
_RAW = f"WITH RECURSIVE {_BASE}, {_WALK}"
# The heap network has no cycles and no forks: folding follows the one link of each nameless river.
_FOLD = """
raw AS (SELECT o.river_id, e.* FROM edge e JOIN owner o USING (cleabs)),
names AS (SELECT river_id, name, count(*) AS n, min((src, dst)) AS f FROM raw WHERE name IS NOT NULL GROUP BY ALL),
modal AS (SELECT river_id, arg_min(name, (-n, f)) AS name FROM names GROUP BY river_id),
own AS (SELECT DISTINCT river_id FROM raw),
only_end AS (SELECT DISTINCT river_id, dst AS node FROM raw a WHERE NOT EXISTS (SELECT 1 FROM raw b WHERE b.river_id = a.river_id AND b.src = a.dst)),
link AS (SELECT DISTINCT a.river_id AS src, b.river_id AS dst FROM only_end a JOIN raw b ON b.src = a.node WHERE a.river_id <> b.river_id),
up1(river_id, spot, depth) AS (
  SELECT river_id, river_id, 0 FROM own
  UNION ALL SELECT u.river_id, l.dst, depth + 1 FROM up1 u JOIN link l ON l.src = u.spot LEFT JOIN modal m ON m.river_id = u.spot WHERE m.name IS NULL),
final AS (SELECT river_id, arg_max(spot, depth) AS target FROM up1 GROUP BY river_id),
part AS (SELECT e.*, f.target AS river_id FROM edge e JOIN owner o USING (cleabs) JOIN final f USING (river_id)),
flow AS (SELECT DISTINCT a.target AS src, b.target AS dst FROM link l JOIN final a ON a.river_id = l.src JOIN final b ON b.river_id = l.dst WHERE a.target <> b.target),
river AS (
  SELECT p.river_id, any_value(m.name) AS name, sum(length_m) AS length_m, max(ord) AS strahler, count(*) AS n_segments
  FROM part p LEFT JOIN modal m USING (river_id) GROUP BY p.river_id),
parent AS (SELECT src AS river_id, min(dst) AS parent_id FROM flow GROUP BY src),
above(river_id, ancestor, depth) AS (SELECT dst, src, 1 FROM flow UNION ALL SELECT a.river_id, f.src, depth + 1 FROM above a JOIN flow f ON f.dst = a.ancestor),
n_up AS (SELECT river_id, count(DISTINCT ancestor) AS n FROM above GROUP BY river_id)
"""
RIVER_SQL = f"{_RAW}, {_FOLD}"


def _lines(spark, sf):
    return S.graph(view(spark, sf, SEG))


def q_segment_clean(spark, sf):
    return S.clean(view(spark, sf, SEG)).select("cleabs", "ini", "fin", "ord", "river_key", "name", "fictif", "ambiguous", F.col("length_m").cast("double").alias("length_m"))


def q_segment_edges(spark, sf):
    return _lines(spark, sf).select("cleabs", "src", "dst", "ord", "river_key")


def q_parallel(spark, sf):
    return S.graph(view(spark, sf, SEG_PARALLEL)).select("cleabs", "src", "dst", F.col("length_m").cast("double").alias("length_m"))


def q_ambiguous(spark, sf):
    return S.oriented(S.clean(view(spark, sf, SEG))).filter("ambiguous").select("cleabs", "src", "dst")


def _raw(spark, sf):
    edges = written(_lines(spark, sf))
    return edges, written(R.resolve_unnamed(edges))


def q_resolve(spark, sf):
    return R.resolve_unnamed(written(_lines(spark, sf)))


def q_rollup(spark, sf):
    return R.roll_up(*_raw(spark, sf)).select("river_id", "name", F.col("length_m").cast("double").alias("length_m"), "strahler", "n_segments")


def q_modal(spark, sf):
    return R.roll_up(*_raw(spark, sf)).filter("name is not null").select("river_id", "name")


def q_outflows(spark, sf):
    return R.ends(*_raw(spark, sf), "outflows").select("river_id", "node")


def q_sources(spark, sf):
    return R.ends(*_raw(spark, sf), "sources").select("river_id", "node")


def q_edges(spark, sf):
    e, o = _raw(spark, sf)
    return R.flows(e, o, R.ends(e, o, "outflows"))


def q_outlet(spark, sf):
    e, o = _raw(spark, sf)
    return R.outlets(e, o, R.ends(e, o, "outflows"))


def q_fold(spark, sf):
    e, o = _raw(spark, sf)
    return R.fold_nameless(written(R.roll_up(e, o)), written(R.flows(e, o, R.ends(e, o, "outflows"))))[0].select("river_id", "into")


def q_cycles(spark, sf):
    links = view(spark, sf, _RING)
    rivers = links.select(F.col("src").alias("river_id"), (F.expr("cast(substring(src, 2) as bigint)") % 13).alias("length_m")).distinct()
    return R.merge_cycles(rivers, links)[0].select("river_id", "into")


# Of ten customers five flow in a ring, the others one into the next and so into it.
_RING = """
SELECT concat('R', c_custkey) AS src, concat('R', CASE WHEN c_custkey % 10 = 4 THEN c_custkey - 4 WHEN c_custkey % 10 = 9 THEN c_custkey - 5 ELSE c_custkey + 1 END) AS dst FROM customer
"""


def q_parents(spark, sf):
    return network(spark, sf).rivers.select("river_id", "parent_id")


def q_roots_leaves(spark, sf):
    net = network(spark, sf)
    kids = net.rivers.filter("parent_id is not null").select(F.col("parent_id").alias("river_id")).distinct().withColumn("_k", F.lit(True))
    r = net.rivers.join(kids, "river_id", "left")
    return r.select("river_id", F.col("parent_id").isNull().alias("is_root"), F.col("_k").isNull().alias("is_leaf")).filter("is_root or is_leaf")


def q_search(spark, sf):
    return R.search(network(spark, sf).rivers, "rIVER 1").select("river_id", "name")


def q_top(spark, sf):
    return network(spark, sf).rivers.orderBy(F.desc("length_m"), "river_id").limit(25).select("river_id", F.col("length_m").cast("double").alias("length_m"))


def q_closure(spark, sf):
    return _closed(spark, sf).select("river_id", "ancestor")


def _with_counts(spark, sf):
    return R.n_upstream(network(spark, sf))


def q_n_upstream(spark, sf):
    return _with_counts(spark, sf).select("river_id", F.col("n_upstream").cast("long").alias("n_upstream"))


def q_summary(spark, sf):
    return R.summary(_with_counts(spark, sf))


def q_downstream(spark, sf):
    return R.downstream_path(network(spark, sf)).select("river_id", "below", F.col("depth").cast("long").alias("depth"))


def q_catchment(spark, sf):
    net = network(spark, sf)
    own = net.segment_river.groupBy("river_id").agg(F.count(F.lit(1)).alias("n_segments"), F.min("cleabs").alias("first"), F.max("cleabs").alias("last"))
    return R.upstream_fold(net, own, ["n_segments"], ["first"], ["last"]).filter("first is not null").select("river_id", "n_segments", "first", "last")


def q_trace(spark, sf):
    return T.trace_upstream(written(_lines(spark, sf)), "N1").select("cleabs", F.col("depth").cast("long").alias("depth"))


def q_trace_totals(spark, sf):
    return T.tree_totals(T.trace_tree(written(_lines(spark, sf)), "N1")).select("cleabs", "n_upstream", F.col("upstream_m").cast("double").alias("upstream_m"))


def q_drop_fictif(spark, sf):
    return T.splice_fictitious(T.trace_tree(written(_lines(spark, sf)), "N1")).select("cleabs", "parent")


def q_collapse(spark, sf):
    return T.collapse_chains(T.trace_tree(written(_lines(spark, sf)), "N1")).select("cleabs", F.col("n_folded").cast("long").alias("n_folded"))


def q_min_order(spark, sf):
    return T.prune_order(T.trace_tree(written(_lines(spark, sf)), "N1"), 4).select("cleabs")


_TREE = f"""WITH RECURSIVE {_BASE},
t(cleabs, src, parent, depth, name, fictif, length_m, ord) AS (
  SELECT cleabs, src, CAST(NULL AS VARCHAR), 1, name, fictif, length_m, ord FROM edge WHERE dst = 'N1'
  UNION ALL SELECT e.cleabs, e.src, t.cleabs, depth + 1, e.name, e.fictif, e.length_m, e.ord FROM t JOIN edge e ON e.dst = t.src),
under(top, cleabs, length_m, ord) AS (SELECT cleabs, cleabs, length_m, ord FROM t UNION ALL SELECT u.top, t.cleabs, t.length_m, t.ord FROM under u JOIN t ON t.parent = u.cleabs)"""

QUERIES = {
    "segment_clean": (q_segment_clean, f"SELECT cleabs, ini, fin, ord, river_key, toponyme AS name, fictif, sens IN ('Double sens', 'Indéterminé') AS ambiguous, CAST(length_m AS DOUBLE) AS length_m FROM ({SEG})"),
    "segment_edges": (q_segment_edges, f"WITH {_BASE} SELECT cleabs, src, dst, ord, river_key FROM edge"),
    "parallel_edge_collapse": (q_parallel, f"WITH {_BASE.replace(SEG, SEG_PARALLEL)} SELECT cleabs, src, dst, CAST(length_m AS DOUBLE) AS length_m FROM edge QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY length_m DESC, cleabs) = 1"),
    "ambiguous_edges": (q_ambiguous, f"SELECT cleabs, ini AS src, fin AS dst FROM ({SEG}) WHERE sens = 'Double sens' AND ini <> fin"),
    "resolve_unnamed": (q_resolve, f"{_RAW} SELECT cleabs, river_id FROM owner"),
    "river_rollup": (q_rollup, f"{_RAW}, {_FOLD} SELECT r.river_id, any_value(m.name) AS name, CAST(sum(length_m) AS DOUBLE) AS length_m, max(ord) AS strahler, count(*) AS n_segments FROM raw r LEFT JOIN modal m USING (river_id) GROUP BY r.river_id"),
    "river_modal_name": (q_modal, f"{_RAW}, {_FOLD} SELECT river_id, name FROM modal"),
    "river_outflows": (q_outflows, f"{_RAW}, {_FOLD} SELECT river_id, node FROM only_end"),
    "river_sources": (q_sources, f"{_RAW}, {_FOLD} SELECT DISTINCT river_id, src AS node FROM raw a WHERE NOT EXISTS (SELECT 1 FROM raw b WHERE b.river_id = a.river_id AND b.dst = a.src)"),
    "river_edges": (q_edges, f"{_RAW}, {_FOLD} SELECT src, dst FROM link"),
    "river_outlet": (q_outlet, f"{_RAW}, {_FOLD} SELECT river_id, arg_min(node, (CASE WHEN other THEN 0 WHEN n = 0 THEN 1 ELSE 2 END, node)) AS outlet FROM (SELECT a.river_id, node, coalesce(bool_or(b.river_id <> a.river_id), false) AS other, count(b.river_id) AS n FROM only_end a LEFT JOIN raw b ON b.src = a.node GROUP BY a.river_id, node) GROUP BY river_id"),
    "fold_nameless": (q_fold, f"{_RAW}, {_FOLD} SELECT river_id, target AS into FROM final WHERE river_id <> target"),
    "merge_cycles": (q_cycles, f"""WITH RECURSIVE link AS ({_RING}), reach(a, b) AS (SELECT src, dst FROM link UNION SELECT a, dst FROM reach JOIN link ON src = b),
 len AS (SELECT DISTINCT src AS river_id, CAST(substring(src, 2) AS BIGINT) % 13 AS l FROM link)
 SELECT x.a AS river_id, arg_min(x.b, (-len.l, x.b)) AS into FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a JOIN len ON len.river_id = x.b GROUP BY x.a"""),
    "river_parents": (q_parents, f"{RIVER_SQL} SELECT river_id, parent_id FROM river LEFT JOIN parent USING (river_id)"),
    "roots_leaves": (q_roots_leaves, f"{RIVER_SQL} SELECT * FROM (SELECT river_id, p.parent_id IS NULL AS is_root, river_id NOT IN (SELECT parent_id FROM parent) AS is_leaf FROM river LEFT JOIN parent p USING (river_id)) WHERE is_root OR is_leaf"),
    "river_search": (q_search, f"{RIVER_SQL} SELECT river_id, name FROM river WHERE contains(lower(name), 'river 1')"),
    "river_top_k": (q_top, f"{RIVER_SQL} SELECT river_id, CAST(length_m AS DOUBLE) AS length_m FROM river ORDER BY river.length_m DESC, river_id LIMIT 25"),
    "upstream_closure": (q_closure, f"{RIVER_SQL} SELECT DISTINCT river_id, ancestor FROM above"),
    "n_upstream": (q_n_upstream, f"{RIVER_SQL} SELECT river_id, coalesce(n, 0) AS n_upstream FROM river LEFT JOIN n_up USING (river_id)"),
    "river_summary": (q_summary, f"{RIVER_SQL} SELECT river_id, name, CAST(round(length_m / 1000, 2) AS DOUBLE) AS length_km, strahler, n_segments, parent_id, coalesce(n, 0) AS n_upstream FROM river LEFT JOIN parent USING (river_id) LEFT JOIN n_up USING (river_id)"),
    "downstream_path": (q_downstream, f"{RIVER_SQL}, below(river_id, below, depth) AS (SELECT river_id, parent_id, 1 FROM parent UNION ALL SELECT b.river_id, p.parent_id, depth + 1 FROM below b JOIN parent p ON p.river_id = b.below) SELECT river_id, below, CAST(depth AS BIGINT) AS depth FROM below"),
    "catchment_segments": (q_catchment, f"{RIVER_SQL}, every AS (SELECT river_id, river_id AS ancestor FROM river UNION SELECT river_id, ancestor FROM above) SELECT e.river_id, count(*) AS n_segments, min(cleabs) AS first, max(cleabs) AS last FROM every e JOIN part p ON p.river_id = e.ancestor GROUP BY e.river_id"),
    "trace_upstream": (q_trace, f"{_TREE} SELECT cleabs, CAST(depth AS BIGINT) AS depth FROM t"),
    "trace_tree_totals": (q_trace_totals, f"{_TREE} SELECT top AS cleabs, count(*) AS n_upstream, CAST(sum(length_m) AS DOUBLE) AS upstream_m FROM under GROUP BY top"),
    "drop_fictif": (q_drop_fictif, f"{_TREE}, up(cleabs, spot) AS (SELECT cleabs, parent FROM t UNION ALL SELECT u.cleabs, t.parent FROM up u JOIN t ON t.cleabs = u.spot WHERE t.fictif) SELECT t.cleabs, (SELECT u.spot FROM up u LEFT JOIN t p ON p.cleabs = u.spot WHERE u.cleabs = t.cleabs AND (u.spot IS NULL OR NOT p.fictif)) AS parent FROM t WHERE NOT fictif"),
    "collapse_chains": (q_collapse, f"{_TREE}, kids AS (SELECT parent, count(*) AS n FROM t GROUP BY parent), folds AS (SELECT c.cleabs, c.parent FROM t c JOIN t p ON p.cleabs = c.parent JOIN kids k ON k.parent = c.parent WHERE k.n = 1 AND c.name IS NOT DISTINCT FROM p.name), head(cleabs, spot) AS (SELECT cleabs, cleabs FROM t UNION ALL SELECT h.cleabs, f.parent FROM head h JOIN folds f ON f.cleabs = h.spot) SELECT spot AS cleabs, count(*) - 1 AS n_folded FROM head WHERE spot NOT IN (SELECT cleabs FROM folds) GROUP BY spot"),
    "trace_min_order": (q_min_order, f"{_TREE}, best AS (SELECT top, max(ord) AS m FROM under GROUP BY top), kept(cleabs) AS (SELECT t.cleabs FROM t JOIN best ON top = t.cleabs WHERE parent IS NULL AND m >= 4 UNION ALL SELECT t.cleabs FROM kept k JOIN t ON t.parent = k.cleabs JOIN best ON top = t.cleabs WHERE m >= 4) SELECT cleabs FROM kept"),
}
