"""Segment-level traces upstream of a node, and the tree they span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillway.operators.iterate import follow, subtree_fold
from rillway.plans.tables import written


def trace_upstream(edges: DataFrame, root: str) -> DataFrame:
    """Every edge from which ``root`` can be reached, with the least number of edges to it.

    The edges between visited nodes all count, so an edge of a cycle or a side arm is there
    too. An unknown node has none.
    """
    spark = edges.sparkSession
    seen = front = written(spark.createDataFrame([(root, 0)], "node string, depth int"))
    depth = 0
    while front.take(1):
        depth += 1
        more = edges.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        front = written(more.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = written(seen.unionByName(front))
    at = seen.select(F.col("node").alias("dst"), (F.col("depth") + 1).alias("depth"))
    return edges.join(seen.select(F.col("node").alias("src")), "src", "left_semi").join(at, "dst")


def trace_tree(edges: DataFrame, root: str) -> DataFrame:
    """The trace as a tree: each node keeps one way down, the shortest, then the smallest edge id.

    Columns of ``edges``, ``depth``, and ``parent``: the edge that an edge flows into.
    """
    traced = written(trace_upstream(edges, root))
    best = Window.partitionBy("src").orderBy("depth", "cleabs")
    one = written(traced.filter(F.col("src") != root).withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k"))
    below = one.select(F.col("src").alias("dst"), F.col("cleabs").alias("parent"))
    return written(one.join(below, "dst", "left"))


def tree_totals(tree: DataFrame) -> DataFrame:
    """Segments and metres upstream of each edge, itself included."""
    chain = tree.select(F.col("cleabs").alias("id"), F.col("parent").alias("next"), F.lit(1).cast("long").alias("n_upstream"), F.col("length_m").alias("upstream_m"))
    return tree.join(subtree_fold(chain, sums=["n_upstream", "upstream_m"]).withColumnRenamed("id", "cleabs"), "cleabs")


def ordered_children(tree: DataFrame) -> DataFrame:
    """The tree with each edge's place among its siblings: most metres upstream first, as far as the totals are known of the whole tree."""
    first = Window.partitionBy("parent").orderBy(F.desc("upstream_m"), "cleabs")
    whole = tree if "upstream_m" in tree.columns else tree_totals(tree)
    return whole.withColumn("ordinal", F.row_number().over(first))


def splice_fictitious(tree: DataFrame) -> DataFrame:
    """The tree without fictitious edges: what they carry hangs on the nearest real edge downstream."""
    # From each edge's parent on, a fictitious edge points to its own parent.
    chain = tree.select(F.col("cleabs").alias("id"), F.when(F.col("fictif"), F.col("parent")).alias("next"))
    real = follow(written(chain)).select(F.col("id").alias("parent"), F.col("last").alias("_p"))
    made = tree.filter("not fictif").join(real, "parent", "left")
    fictitious = tree.select(F.col("cleabs").alias("_p"), F.col("fictif").alias("_f"))
    out = made.join(fictitious, "_p", "left").withColumn("_new", F.when(~F.coalesce("_f", F.lit(False)), F.col("_p")))
    return out.drop("parent", "_p", "_f").withColumnRenamed("_new", "parent")


def collapse_chains(tree: DataFrame) -> DataFrame:
    """The tree with only children of the same name folded into their parents; ``n_folded`` counts them, ``folded_m`` are their metres."""
    kids = tree.groupBy("parent").agg(F.count(F.lit(1)).alias("_n"))
    names = tree.select(F.col("cleabs").alias("parent"), F.col("name").alias("_pn"))
    folds = tree.join(kids, "parent").join(names, "parent").withColumn("_fold", (F.col("_n") == 1) & F.col("name").eqNullSafe(F.col("_pn")))
    chain = tree.select("cleabs").join(folds.filter("_fold").select("cleabs", F.col("parent").alias("next")), "cleabs", "left").select(F.col("cleabs").alias("id"), "next")
    heads = written(follow(written(chain)))
    long_ = tree.select(F.col("cleabs").alias("id"), F.coalesce("length_m", F.lit(0)).cast("double").alias("_m"))
    counts = heads.join(long_, "id").groupBy(F.col("last").alias("cleabs")).agg((F.count(F.lit(1)) - 1).alias("n_folded"), F.sum(F.when(F.col("id") != F.col("last"), F.col("_m")).otherwise(0.0)).alias("folded_m"))
    moved = heads.select(F.col("id").alias("parent"), F.col("last").alias("_p"))
    return tree.join(counts, "cleabs").join(moved, "parent", "left").drop("parent").withColumnRenamed("_p", "parent")


def prune_order(tree: DataFrame, least: int) -> DataFrame:
    """The tree without branches whose largest order is under ``least``."""
    top = subtree_fold(tree.select(F.col("cleabs").alias("id"), F.col("parent").alias("next"), F.col("ord").alias("_m")), most=["_m"]).withColumnRenamed("id", "cleabs")
    # An edge that carries a larger order carries it down to every edge below, so no walk is needed.
    return tree.join(top.filter(F.col("_m") >= least).select("cleabs"), "cleabs", "left_semi")
