"""Drainage-tree catalogs: main line and tributaries, nodes, codes, neighbourhoods, forests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.operators.iterate import chain_fold, chain_sums, follow, forest_closure
from rillway.plans.tables import Grown, written


def join_ranks(edges: DataFrame, segment_river: DataFrame, rivers: DataFrame) -> DataFrame:
    """``river_id``, ``hops``: how far up its parent's own course a river joins it; null if it isn't met there.

    The course is walked from the parent's outlet, to the smallest of its own nodes upstream
    each time; a river joins where the parent's segment from the river's outlet ends.
    """
    own = edges.join(segment_river, "cleabs").select("river_id", "src", "dst")
    course = own.groupBy("river_id", "dst").agg(F.min("src").alias("src")).groupBy("river_id", "src").agg(F.min("dst").alias("dst"))
    key = lambda n: F.concat_ws("|", "river_id", n)
    mouth = rivers.select("river_id", "outlet").filter("outlet is not null")
    steps = course.select(key("src").alias("id"), key("dst").alias("next")).unionByName(mouth.select(key("outlet").alias("id"), F.lit(None).cast("string").alias("next")))
    # An outlet ends the walk even where its river goes on.
    steps = steps.groupBy("id").agg(F.max(F.col("next").isNull()).alias("_end"), F.min("next").alias("next")).select("id", F.when(~F.col("_end"), F.col("next")).alias("next"))
    walked = follow(written(steps)).filter("not cyclic")
    placed = walked.join(mouth.select(key("outlet").alias("last")), "last", "left_semi").select(F.col("id").alias("_at"), "hops")
    child = rivers.filter("parent_id is not null").select("river_id", "parent_id", F.col("outlet").alias("src"))
    meets = child.join(own.select(F.col("river_id").alias("parent_id"), "src", "dst"), ["parent_id", "src"]).groupBy("river_id", "parent_id").agg(F.min("dst").alias("_node"))
    return meets.withColumn("_at", F.concat_ws("|", "parent_id", "_node")).join(placed, "_at", "left").select("river_id", "hops")


def partition_children(rivers: DataFrame, ranks: DataFrame) -> DataFrame:
    """Each river's role under its primary parent and its place there.

    ``rivers`` has ``n_upstream``. The main line is a child of the parent's name, else the
    largest: most rivers upstream, then the longest, then the smallest name or id. Tributaries
    follow from mouth to source, and those that no walk has met after them by size.
    """
    parent = rivers.select(F.col("river_id").alias("parent_id"), F.col("name").alias("_pname"))
    kids = rivers.filter("parent_id is not null").join(parent, "parent_id")
    size = [F.desc("n_upstream"), F.desc("length_m"), F.coalesce("name", "river_id"), F.col("river_id")]
    same = F.coalesce(F.col("name") == F.col("_pname"), F.lit(False))
    ranked = kids.withColumn("_k", F.row_number().over(Window.partitionBy("parent_id").orderBy(F.desc(same.cast("int")), *size)))
    tagged = ranked.join(ranks, "river_id", "left").withColumn("role", F.when(F.col("_k") == 1, "mainline").otherwise("tributary"))
    place = Window.partitionBy("parent_id", "role").orderBy(F.col("hops").isNull(), "hops", *size)
    return tagged.withColumn("ordinal", F.row_number().over(place)).drop("_k", "_pname", "hops")


def _cut(max_depth: int | None) -> Column:
    return F.lit(False) if max_depth is None else (F.col("depth") >= max_depth) & (F.col("n_tributaries") > 0)


def _counted(places: DataFrame, counts: DataFrame) -> DataFrame:
    return places.join(counts, "river_id", "left").withColumn("n_tributaries", F.coalesce("n_tributaries", F.lit(0))).withColumn("_kids", F.coalesce("_kids", F.lit(0)))


def _by_chains(kept: DataFrame, counts: DataFrame, roots: DataFrame, max_depth: int | None) -> DataFrame:
    """The places of trees that don't hold one another, by pointer doubling: a chain that ends at a root is in its tree.

    Depth grows by one at most, and only below tributaries' parents, so what is deeper than ``max_depth`` is what lies above a cut.
    """
    below = counts.select(F.col("river_id").alias("parent_id"), F.when(F.col("n_tributaries") > 0, 1).otherwise(0).alias("depth"))
    links = written(kept.join(roots, "river_id", "left_anti").join(below, "parent_id"))
    steps = links.select(F.col("river_id").alias("id"), F.col("parent_id").alias("next"), "depth").unionByName(roots.select(F.col("river_id").alias("id"), F.lit(None).cast("string").alias("next"), F.lit(0).alias("depth")))
    at = chain_sums(steps, "depth").join(roots.select(F.col("river_id").alias("last")), "last", "left_semi").select(F.col("id").alias("river_id"), "depth", F.col("last").alias("root_id"))
    if max_depth is not None:
        at = at.filter(F.col("depth") <= max(max_depth, 0))
    role = lambda c, other: F.coalesce(F.col(c), F.lit(other)).alias(c)
    placed = at.join(links.drop("depth"), "river_id", "left").select("river_id", "parent_id", role("role", "root"), role("ordinal", 1), "depth", "root_id")
    return _counted(placed, counts).withColumn("truncated", _cut(max_depth))


def _by_levels(kept: DataFrame, counts: DataFrame, roots: DataFrame, max_depth: int | None) -> DataFrame:
    """The places of trees that may hold one another, a level at a time."""
    level = written(roots.select("river_id", F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("role"), F.lit(1).alias("ordinal"), F.lit(0).alias("depth"), F.col("river_id").alias("root_id")))
    found = None
    while level.take(1):
        here = written(_counted(level, counts).withColumn("truncated", _cut(max_depth)))
        if found is None:
            found = Grown(here)
        else:
            found.append(here)
        below = here.filter("not truncated").select(F.col("river_id").alias("parent_id"), (F.col("depth") + F.when(F.col("n_tributaries") > 0, 1).otherwise(0)).alias("depth"), "root_id")
        level = written(kept.join(below, "parent_id").select("river_id", "parent_id", "role", "ordinal", "depth", "root_id"))
    return found.table()


def nodes(rivers: DataFrame, children: DataFrame, root: str | DataFrame, blacklist: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """The catalog tree under ``root``, or the trees under all of a table's ``river_id``: one row per
    river with its parent, role, depth and facts.

    A blacklisted river goes with all above it; its parent counts it in ``n_folded``, and keeps
    no main line if that was it. A child is one deeper only where its parent has a tributary.
    At ``max_depth`` a river with tributaries has no children, and says what was cut.
    """
    banned = children.sparkSession.createDataFrame([(b,) for b in blacklist or []], "river_id string")
    links = children.select("river_id", "parent_id", "role", "ordinal")
    folded = links.join(banned, "river_id", "left_semi").groupBy(F.col("parent_id").alias("river_id")).agg(F.count(F.lit(1)).alias("n_folded"))
    kept = written(links.join(banned, "river_id", "left_anti"))
    counts = written(kept.groupBy(F.col("parent_id").alias("river_id")).agg(F.count_if(F.col("role") == "tributary").alias("n_tributaries"), F.count(F.lit(1)).alias("_kids")))
    spark = rivers.sparkSession
    roots = spark.createDataFrame([(root,)], "river_id string") if isinstance(root, str) else root.select("river_id")
    many = written(roots)
    nested = many.count() > 1 and bool(kept.join(many, "river_id", "left_semi").take(1))
    found = (_by_levels if nested else _by_chains)(kept, counts, many, max_depth)
    facts = rivers.select("river_id", "name", "length_m", "strahler", "n_upstream")
    return found.join(facts, "river_id").join(folded, "river_id", "left").select(
        "river_id", "parent_id", "role", "ordinal", "depth", "name", F.round(F.col("length_m") / 1000, 2).cast("double").alias("length_km"), "strahler", "n_upstream",
        "n_tributaries", F.coalesce("n_folded", F.lit(0)).alias("n_folded"), (F.col("_kids") == 0).alias("is_headwater"), "truncated", "root_id",
    )


def forest(rivers: DataFrame, children: DataFrame, roots: list[str] | DataFrame, name: str = "study area", **cuts) -> DataFrame:
    """Several catalogs under one made-up root ``_forest``; a river in two of them is an error.

    All trees grow together, a level at a time. They stand in the order of ``roots``, a table by its ``river_id``.
    """
    spark = rivers.sparkSession
    if isinstance(roots, list):
        at = spark.createDataFrame([(r, k) for k, r in enumerate(roots, 1)], "root_id string, _o int")
    else:
        at = roots.select(F.col("river_id").alias("root_id"), F.row_number().over(Window.orderBy("river_id")).alias("_o"))
    at = written(at)
    every = written(nodes(rivers, children, at.select(F.col("root_id").alias("river_id")), **cuts))
    twice = [r.river_id for r in every.groupBy("river_id").count().filter("count > 1").select("river_id").take(5)]
    if twice:
        raise ValueError(f"rivers in more than one tree: {twice}")
    moved = every.join(at, "root_id")
    is_root = F.col("role") == "root"
    moved = moved.withColumn("parent_id", F.when(is_root, F.lit("_forest")).otherwise(F.col("parent_id"))).withColumn("ordinal", F.when(is_root, F.col("_o")).otherwise(F.col("ordinal")))
    moved = moved.withColumn("role", F.when(is_root, "tributary").otherwise(F.col("role"))).withColumn("depth", F.col("depth") + 1).drop("_o")
    n_roots = at.count()
    top = every.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("_forest").alias("river_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("role"), F.lit(1).alias("ordinal"), F.lit(0).alias("depth"), F.lit(name).alias("name"),
        F.lit(None).cast("double").alias("length_km"), F.lit(None).cast("int").alias("strahler"), F.col("n").alias("n_upstream"), F.lit(n_roots).cast("long").alias("n_tributaries"),
        F.lit(0).cast("long").alias("n_folded"), F.lit(False).alias("is_headwater"), F.lit(False).alias("truncated"), F.lit("_forest").alias("root_id"),
    )
    return moved.unionByName(top)


def also_flows_into(flows: DataFrame) -> DataFrame:
    """The rivers that a river flows into besides its primary parent."""
    first = flows.groupBy("src").agg(F.min("dst").alias("_p"))
    return flows.join(first, "src").filter("dst <> _p").select(F.col("src").alias("river_id"), F.col("dst").alias("also"))


def pfafstetter(rivers: DataFrame, root: str, max_depth: int = 6, fanout: int = 4) -> DataFrame:
    """A Pfafstetter-like code for each river above ``root``.

    All stems of the tree come from one pass of pointer doubling: a river is on its parent's
    stem if it is the parent's largest child. Levels of areas are then coded in turn: the
    four largest tributaries of a stem get 3, 5, 7, 9 from the mouth on, the stem's reaches
    between their joins 2, 4, 6, 8, its head 1; other tributaries take the code of their
    reach, as does all that is above them.
    """
    r = written(rivers.select("river_id", "parent_id", "n_upstream", "length_m", F.coalesce("name", "river_id").alias("_label")))
    largest = Window.partitionBy("parent_id").orderBy(F.desc("n_upstream"), F.desc("length_m"), F.desc("_label"), F.desc("river_id"))
    steps = r.withColumn("_k", F.row_number().over(largest)).select(F.col("river_id").alias("id"), F.when((F.col("_k") == 1) & (F.col("river_id") != root), F.col("parent_id")).alias("next"))
    stems = written(follow(written(steps)).select(F.col("id").alias("river_id"), F.col("last").alias("stem"), F.col("hops").alias("i")))
    length = stems.groupBy("stem").agg((F.max("i") + 1).alias("len"))
    spot = stems.select(F.col("river_id").alias("parent_id"), F.col("stem").alias("on"), F.col("i").alias("join_i"))
    tribs = r.join(stems.filter("river_id = stem").select("river_id"), "river_id", "left_semi").filter(F.col("river_id") != root).join(spot, "parent_id")
    by_size = Window.partitionBy("on").orderBy(F.desc("n_upstream"), F.desc("length_m"), "_label", "river_id")
    tribs = tribs.withColumn("_rank", F.row_number().over(by_size))
    from_mouth = Window.partitionBy("on").orderBy("join_i", "_rank")
    top = written(tribs.filter(F.col("_rank") <= fanout).withColumn("digit", F.row_number().over(from_mouth) * 2 + 1).select("river_id", "on", "join_i", "digit"))
    rest = written(tribs.filter(F.col("_rank") > fanout).select("river_id", "on", "join_i"))
    cuts = top.groupBy("on").agg(F.array_sort(F.collect_set(F.col("join_i") + 1)).alias("cuts"))
    reach = written(length.join(cuts, length["stem"] == cuts["on"], "left").select("stem", F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array(F.col("len").cast("long")))).alias("bounds")))
    k = F.size(F.filter("bounds", lambda b: b <= F.col("i"))) - 1
    digit = F.when(k == F.size("bounds") - 2, 1).when(k < 4, 2 * (k + 1)).otherwise(2)
    placed = written(stems.join(reach, "stem").select("river_id", "stem", "i", digit.alias("digit")))
    spark = rivers.sparkSession
    areas = written(spark.createDataFrame([(root, "")], "stem string, prefix string"))
    codes, whole = None, None
    for level in range(max_depth):
        if not areas.take(1):
            break
        on = areas.join(placed, "stem").select("river_id", "stem", "i", F.concat("prefix", F.col("digit").cast("string")).alias("code"))
        late = rest.withColumnRenamed("on", "stem").join(on.select("stem", F.col("i").alias("join_i"), "code"), ["stem", "join_i"]).select("river_id", "code")
        big = written(areas.join(top.withColumnRenamed("on", "stem"), "stem").select("river_id", F.concat("prefix", F.col("digit").cast("string")).alias("code")))
        own = on.filter("river_id <> stem").select("river_id", "code").unionByName(big)
        codes = written(own if codes is None else codes.unionByName(own))
        inherit = late.unionByName(big) if level + 1 == max_depth else late
        whole = written(inherit if whole is None else whole.unionByName(inherit))
        areas = big.select(F.col("river_id").alias("stem"), F.col("code").alias("prefix"))
    # What lies above takes the longest code of those that it passes on its way down.
    heard = whole.groupBy("river_id").agg(F.max_by("code", F.length("code")).alias("code"))
    told = r.join(heard, "river_id", "left").select(F.col("river_id").alias("id"), F.col("parent_id").alias("next"), F.when(F.col("code").isNotNull(), F.struct(F.length("code").alias("n"), "code")).alias("c"))
    free = chain_fold(told, "c", lambda x, y: F.greatest(x, y)).filter("c is not null").select(F.col("id").alias("river_id"), "c.code").join(codes, "river_id", "left_anti")
    return codes.unionByName(free).filter(F.col("river_id") != root)


def siblings(tree: DataFrame) -> DataFrame:
    """Each node's neighbours among its siblings, and how many more lie beyond them on either side."""
    w = Window.partitionBy("parent_id").orderBy((F.col("role") != "mainline").cast("int"), "ordinal")
    k, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy("parent_id"))
    zero = F.lit(0).cast("long")
    return tree.filter("parent_id is not null").select(
        "river_id", F.lag("river_id").over(w).alias("previous"), F.lead("river_id").over(w).alias("following"), F.greatest(k - 2, zero).cast("long").alias("more_before"), F.greatest(n - k - 1, zero).cast("long").alias("more_after")
    )


def breadcrumb(tree: DataFrame) -> DataFrame:
    """All (``river_id``, ``ancestor``, ``up``) in the tree; ``up`` counts steps towards the root."""
    links = tree.filter("parent_id is not null").select(F.col("river_id").alias("src"), F.col("parent_id").alias("dst"))
    return forest_closure(links).select(F.col("src").alias("river_id"), F.col("dst").alias("ancestor"), F.col("depth").alias("up"))


def neighbourhood(tree: DataFrame, river_id: str) -> DataFrame:
    """What a viewer shows around one river: its parent, its nearest siblings, itself and its children."""
    me = tree.filter(F.col("river_id") == river_id).select("river_id", "parent_id")
    near = siblings(tree).join(F.broadcast(me.select("river_id")), "river_id", "left_semi")
    rows = me.select(F.col("parent_id").alias("river_id"), F.lit("parent").alias("shown"))
    rows = rows.unionByName(near.select(F.explode(F.array(F.struct(F.col("previous").alias("river_id"), F.lit("previous").alias("shown")), F.struct(F.col("following").alias("river_id"), F.lit("following").alias("shown")))).alias("s")).select("s.*"))
    rows = rows.unionByName(me.select("river_id", F.lit("selected").alias("shown"))).unionByName(tree.filter(F.col("parent_id") == river_id).select("river_id", F.lit("child").alias("shown")))
    return rows.filter("river_id is not null")
