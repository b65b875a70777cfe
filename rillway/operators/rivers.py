"""Rivers: rolling segments up, linking rivers, merging cycles and nameless ones, closures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillway.operators.iterate import closure, follow, forest_closure, inside, strong_components, subtree_fold, subtree_sums, tree_order
from rillway.plans.tables import Grown, written


@dataclass
class Network:
    """Edges of the segment graph, the river of each segment, rivers, and which flows into which."""

    edges: DataFrame
    segment_river: DataFrame
    rivers: DataFrame
    flows: DataFrame


def resolve_unnamed(edges: DataFrame) -> DataFrame:
    """``cleabs``, ``river_id``: a keyed edge's own key, else that of the first keyed edge downstream.

    An edge goes on to one successor: a keyed one first, then the one with the smallest end. A
    chain that leaves the network is ``UNNAMED:`` and its last node; chains that end in a
    cycle are named after the cycle edge where the basin's smallest edge enters it.
    """
    e = edges.select("cleabs", "src", "dst", "river_key")
    nxt = e.select(F.col("cleabs").alias("next"), F.col("src").alias("dst"), F.col("river_key").alias("_k"), F.col("dst").alias("_d"))
    pick = Window.partitionBy("cleabs").orderBy(F.col("_k").isNull(), "_d", "next")
    one = e.filter("river_key is null").join(nxt, "dst", "left").withColumn("_r", F.row_number().over(pick)).filter("_r = 1")
    pointers = one.select(F.col("cleabs").alias("id"), "next").unionByName(e.filter("river_key is not null").select(F.col("cleabs").alias("id"), F.lit(None).cast("string").alias("next")))
    pointers = written(pointers)
    ends = written(follow(pointers))
    last = e.select(F.col("cleabs").alias("last"), F.col("river_key").alias("_k"), F.col("dst").alias("_d"))
    named = ends.filter("not cyclic").join(last, "last").select(F.col("id").alias("cleabs"), F.coalesce("_k", F.concat(F.lit("UNNAMED:"), "_d")).alias("river_id"))
    lost = ends.filter("cyclic")
    if not lost.take(1):
        return named
    # Rows of cycles: where a long enough walk can end. With these as ends, the walk gives each row's entry.
    on = written(lost.select(F.col("last").alias("id")).distinct().join(pointers, "id"))
    while True:
        wider = written(on.select("id").unionByName(on.select(F.col("next").alias("id"))).distinct().join(pointers, "id"))
        if wider.count() == on.count():
            break
        on = wider
    stopped = pointers.join(lost.select("id"), "id", "left_semi").join(on.select("id", F.lit(True).alias("_on")), "id", "left").select("id", F.when(F.col("_on").isNull(), F.col("next")).alias("next"))
    entry = follow(written(stopped)).select("id", F.col("last").alias("entry"))
    ring = closure(on.select(F.col("id").alias("src"), F.col("next").alias("dst"))).groupBy("src").agg(F.min("dst").alias("ring"))
    where = e.select(F.col("cleabs").alias("id"), "src", "dst")
    full = entry.join(ring.withColumnRenamed("src", "entry"), "entry").join(where, "id")
    first = full.groupBy("ring").agg(F.min_by("entry", F.struct("src", "dst")).alias("entry"))
    label = first.join(where.select(F.col("id").alias("entry"), F.col("src").alias("_s")), "entry").select("ring", F.concat(F.lit("UNNAMED:"), "_s").alias("river_id"))
    return named.unionByName(full.join(label, "ring").select(F.col("id").alias("cleabs"), "river_id"))


def roll_up(edges: DataFrame, segment_river: DataFrame) -> DataFrame:
    """One row per river: name (the most frequent, then the first met), order, length, segments."""
    s = edges.join(segment_river, "cleabs")
    names = s.filter("name is not null").groupBy("river_id", "name").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("src", "dst")).alias("_first"))
    modal = names.groupBy("river_id").agg(F.min_by("name", F.struct((-F.col("_n")).alias("n"), "_first")).alias("name"))
    sums = s.groupBy("river_id").agg(F.sum(F.coalesce("length_m", F.lit(0))).alias("length_m"), F.max("ord").alias("strahler"), F.count(F.lit(1)).alias("n_segments"))
    return sums.join(modal, "river_id", "left")


def ends(edges: DataFrame, segment_river: DataFrame, which: str) -> DataFrame:
    """``sources``: nodes where a river only begins; ``outflows``: where it only ends (all its ends if none)."""
    s = edges.join(segment_river, "cleabs")
    heads, tails = s.select("river_id", F.col("src").alias("node")).distinct(), s.select("river_id", F.col("dst").alias("node")).distinct()
    if which == "sources":
        return heads.join(tails, ["river_id", "node"], "left_anti")
    only = tails.join(heads, ["river_id", "node"], "left_anti")
    return only.unionByName(tails.join(only.select("river_id").distinct(), "river_id", "left_anti"))


def flows(edges: DataFrame, segment_river: DataFrame, outflows: DataFrame) -> DataFrame:
    """Which river flows into which: a river's outflow is where a segment of another begins."""
    begins = edges.join(segment_river, "cleabs").select(F.col("src").alias("node"), F.col("river_id").alias("dst"))
    met = outflows.select(F.col("river_id").alias("src"), "node").join(begins, "node")
    return met.filter("src <> dst").select("src", "dst").distinct()


def outlets(edges: DataFrame, segment_river: DataFrame, outflows: DataFrame) -> DataFrame:
    """A river's outlet: its first outflow into another river, else its first dead end, else its first."""
    begins = edges.join(segment_river, "cleabs").select(F.col("src").alias("node"), F.col("river_id").alias("_to"))
    seen = outflows.join(begins, "node", "left").groupBy("river_id", "node").agg(
        F.max((F.col("_to") != F.col("river_id")).cast("int")).alias("_other"), F.count("_to").alias("_out")
    )
    rank = F.when(F.col("_other") == 1, 0).when(F.col("_out") == 0, 1).otherwise(2)
    return seen.groupBy("river_id").agg(F.min_by("node", F.struct(rank.alias("r"), "node")).alias("outlet"))


def merge_cycles(rivers: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``river_id``, ``into`` for rivers on a common cycle (the longest stays, then the smallest id), and links without them."""
    rings = written(strong_components(links))
    keep = rings.join(rivers, rings["node"] == rivers["river_id"]).groupBy("label").agg(F.min_by("node", F.struct((-F.col("length_m")).alias("l"), "node")).alias("into"))
    moved = written(rings.join(keep, "label").select(F.col("node").alias("river_id"), "into"))
    return moved, relink(links, moved)


def relink(links: DataFrame, moved: DataFrame) -> DataFrame:
    a = moved.select(F.col("river_id").alias("src"), F.col("into").alias("_s"))
    b = moved.select(F.col("river_id").alias("dst"), F.col("into").alias("_d"))
    out = links.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"))
    return out.filter("src <> dst").distinct()


def fold_nameless(rivers: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``river_id``, ``into`` of nameless rivers that flow into another, and the links after folding.

    A nameless river goes where its smallest successor goes, up to a named river or a root; a
    river with several successors leaves the others to the one that it goes into. Where such
    a fork is nameless, its links change what follows, so its component is folded in order.
    """
    named = rivers.select("river_id", F.col("name").isNotNull().alias("_named"))
    first = links.groupBy("src").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("_n"))
    nameless = named.filter("not _named").select(F.col("river_id").alias("src"))
    forks = first.filter("_n > 1").join(nameless, "src", "left_semi")
    if forks.take(1):
        return _fold_in_order(rivers, links)
    pointers = named.join(first.withColumnRenamed("src", "river_id"), "river_id", "left").select(F.col("river_id").alias("id"), F.when(~F.col("_named"), F.col("dst")).alias("next"))
    moved = written(follow(written(pointers)).filter("id <> last and not cyclic").select(F.col("id").alias("river_id"), F.col("last").alias("into")))
    return moved, relink(links, moved)


def _fold_in_order(rivers: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folding one weakly connected component per task, level by level, then by id."""
    from collections.abc import Iterator

    import pandas as pd

    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    part = closure(both).groupBy("src").agg(F.min("dst").alias("part")).select(F.col("src").alias("river_id"), F.least("src", "part").alias("part"))
    rows = links.join(part.withColumnRenamed("river_id", "src"), "src").join(rivers.select(F.col("river_id").alias("src"), F.col("name").isNull().alias("nameless")), "src")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, set] = {}
        for s, d in zip(pdf.src, pdf.dst, strict=True):
            after.setdefault(s, set()).add(d)
            after.setdefault(d, set())
        level: dict[str, int] = {}
        waiting = {n: 0 for n in after}
        for targets in after.values():
            for d in targets:
                waiting[d] += 1
        front, k = sorted(n for n, w in waiting.items() if not w), 0
        while front:
            for n in front:
                level[n] = k
            more = []
            for n in front:
                for d in after[n]:
                    waiting[d] -= 1
                    if not waiting[d]:
                        more.append(d)
            front, k = sorted(more), k + 1
        into: dict[str, str] = {}
        open_ = set(pdf.src[pdf.nameless])
        for n in sorted(level, key=lambda n: (level[n], n)):
            if n in open_ and after[n]:
                target, others = min(after[n]), after.pop(n)
                after[target] |= others - {target}
                into[n] = target
                for targets in after.values():
                    if n in targets:
                        targets.discard(n)
                        targets.add(target)
                after[target].discard(target)
        out = [("link", s, d) for s, ds in after.items() for d in ds] + [("into", n, t) for n, t in into.items()]
        return pd.DataFrame(out, columns=["kind", "src", "dst"])

    done = written(rows.groupBy("part").applyInPandas(fold, "kind string, src string, dst string"))
    chain = rivers.select(F.col("river_id").alias("id")).join(done.filter("kind = 'into'").select(F.col("src").alias("id"), F.col("dst").alias("next")), "id", "left")
    moved = written(follow(written(chain)).filter("id <> last").select(F.col("id").alias("river_id"), F.col("last").alias("into")))
    return moved, done.filter("kind = 'link'").select("src", "dst").distinct()


def build(edges: DataFrame) -> Network:
    """The river network of a segment graph: resolve, link, merge cycles, fold nameless, merge again."""
    edges = written(edges)
    owner = written(resolve_unnamed(edges))
    rivers = written(roll_up(edges, owner))
    links = written(flows(edges, owner, ends(edges, owner, "outflows")))
    for step in (merge_cycles, fold_nameless, merge_cycles):
        moved, links = step(rivers, links)
        links = written(links)
        if moved.take(1):
            owner = written(owner.join(moved, "river_id", "left").select("cleabs", F.coalesce("into", "river_id").alias("river_id")))
            keep = rivers.join(moved, "river_id", "left_anti")
            rivers = written(roll_up(edges, owner).join(keep.select("river_id", F.col("name").alias("_own")), "river_id", "left").withColumn("name", F.coalesce("_own", "name")).drop("_own") if step is fold_nameless else roll_up(edges, owner))
    main = links.groupBy("src").agg(F.min("dst").alias("parent_id")).withColumnRenamed("src", "river_id")
    mouth = outlets(edges, owner, ends(edges, owner, "outflows"))
    full = rivers.join(main, "river_id", "left").join(mouth, "river_id", "left")
    return Network(edges, owner, written(full), links)


def forks(links: DataFrame) -> bool:
    """Whether any river flows into more than one other."""
    return bool(links.groupBy("src").agg(F.countDistinct("dst").alias("_n")).filter("_n > 1").take(1))


def downstream(network: Network, of: DataFrame) -> DataFrame:
    """(``river_id``, ``ancestor``) pairs of ``upstream`` whose ``ancestor`` is one of the rivers ``of``: walked down from these, so that no others are made."""
    start = of.select(F.col("river_id").alias("src")).distinct()
    return closure(network.flows, start).select(F.col("dst").alias("river_id"), F.col("src").alias("ancestor"), "depth")


def upstream(network: Network, of: DataFrame | None = None) -> DataFrame:
    """(``river_id``, ``ancestor``) pairs: which rivers drain into which, over all links; only those of the rivers ``of``, if given."""
    if of is None and not forks(network.flows):
        return forest_closure(network.flows).select(F.col("dst").alias("river_id"), F.col("src").alias("ancestor"), "depth")
    up = network.flows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = None if of is None else of.select(F.col("river_id").alias("src"))
    return closure(up, start).select(F.col("src").alias("river_id"), F.col("dst").alias("ancestor"), "depth")


def upstream_sums(rivers: DataFrame, links: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """``river_id`` and ``columns`` of ``values`` (by ``river_id``) summed over a river and all rivers upstream of it, each once.

    Along primary parents these are sums over a tree, in rounds by the logarithm of its depth.
    Only what a fork's other branches bring to a river from outside its tree is kept as pairs,
    up to where both branches have met again; there the tree's intervals tell which of them
    lie within one another.
    """
    tree = written(rivers.select(F.col("river_id").alias("id"), F.col("parent_id").alias("next")))
    own = tree.join(values.withColumnRenamed("river_id", "id"), "id", "left").select("id", "next", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])
    sums = written(subtree_sums(own, columns).withColumnRenamed("id", "river_id"))
    extra = written(links.join(tree, links["src"] == tree["id"]).filter("dst <> next").select("src", "dst"))
    if not extra.take(1):
        return sums
    span = written(tree_order(tree).select("id", F.struct("root", "first", "size").alias("span")))
    mine, theirs = span.select(F.col("id").alias("river_id"), F.col("span").alias("_v")), span.select(F.col("id").alias("other"), F.col("span").alias("_x"))
    outside = lambda pairs: pairs.distinct().join(mine, "river_id").join(theirs, "other").filter(f"not {inside('_x', '_v')}").select("river_id", "other")
    front = written(outside(extra.select(F.col("dst").alias("river_id"), F.col("src").alias("other"))))
    found = Grown(front)
    while front.take(1):
        on = front.join(links.withColumnRenamed("src", "river_id"), "river_id").select(F.col("dst").alias("river_id"), "other")
        front = written(outside(on).join(found.table(), ["river_id", "other"], "left_anti"))
        found.append(front)
    placed = found.table().join(theirs, "other").select("river_id", "other", "_x.*")
    earlier = Window.partitionBy("river_id", "root").orderBy("first", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    outer = placed.withColumn("_to", F.max(F.col("first") + F.col("size")).over(earlier)).filter("_to is null or _to <= first")
    more = outer.join(sums.withColumnRenamed("river_id", "other"), "other").groupBy("river_id").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    return sums.join(more, "river_id", "left").select("river_id", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns])


def upstream_fold(network: Network, values: DataFrame, sums: list[str] | None = None, least: list[str] | None = None, most: list[str] | None = None) -> DataFrame:
    """``river_id`` and columns of ``values`` (by ``river_id``) summed, or their least or largest, over a river and all upstream of it; over a tree without pairs."""
    columns = [*(sums or []), *(least or []), *(most or [])]
    if not forks(network.flows):
        links = network.flows.select(F.col("src").alias("river_id"), F.col("dst").alias("next"))
        tree = network.rivers.select("river_id").join(links, "river_id", "left").join(values, "river_id", "left")
        return subtree_fold(tree.select(F.col("river_id").alias("id"), "next", *columns), sums, least, most).withColumnRenamed("id", "river_id")
    every = network.rivers.select("river_id", F.col("river_id").alias("ancestor")).unionByName(upstream(network).select("river_id", "ancestor"))
    folds = [F.sum(c).alias(c) for c in sums or []] + [F.min(c).alias(c) for c in least or []] + [F.max(c).alias(c) for c in most or []]
    return every.join(values.withColumnRenamed("river_id", "ancestor"), "ancestor").groupBy("river_id").agg(*folds)


def n_upstream(network: Network) -> DataFrame:
    """The rivers with ``n_upstream``, how many others drain into each, over all links."""
    one = network.rivers.select("river_id", F.lit(1).cast("long").alias("n"))
    counts = upstream_sums(network.rivers, network.flows, one, ["n"])
    return network.rivers.join(counts.select("river_id", (F.col("n") - 1).alias("n_upstream")), "river_id")


def downstream_path(network: Network) -> DataFrame:
    """All (``river_id``, ``below``, ``depth``) along primary parents."""
    main = network.rivers.filter("parent_id is not null").select(F.col("river_id").alias("src"), F.col("parent_id").alias("dst"))
    return forest_closure(main).select(F.col("src").alias("river_id"), F.col("dst").alias("below"), "depth")


def catchment_segments(network: Network, of: DataFrame | None = None) -> DataFrame:
    """Segments of a river and of all rivers upstream of it; only of the rivers ``of``, if given."""
    own = (network.rivers if of is None else of).select("river_id", F.col("river_id").alias("ancestor"))
    every = own.unionByName(upstream(network, of).select("river_id", "ancestor"))
    return every.join(network.segment_river.withColumnRenamed("river_id", "ancestor"), "ancestor").select("river_id", "cleabs")


def search(rivers: DataFrame, text: str, exact: bool = False) -> DataFrame:
    """Rivers by name, whatever the case; longest first."""
    name, wanted = F.lower("name"), text.lower()
    return rivers.filter(name == wanted if exact else F.contains(name, F.lit(wanted))).orderBy(F.desc("length_m"), "river_id")


def resolve(rivers: DataFrame, text: str) -> DataFrame:
    """The one river that an id, else a name, means; a ValueError lists what a loose name could mean."""
    found = rivers.filter(F.col("river_id") == text)
    if not found.take(1):
        found = search(rivers, text)
    few = [(r.river_id, r.name) for r in found.select("river_id", "name").take(21)]
    if len(few) != 1:
        raise ValueError(f"no river matches {text!r}" if not few else f"{text!r} could be any of {few[:20]}")
    return found


def summary(rivers: DataFrame) -> DataFrame:
    """The listing of rivers, longest first."""
    return rivers.select("river_id", "name", F.round(F.col("length_m") / 1000, 2).cast("double").alias("length_km"), "strahler", F.col("n_segments").cast("long").alias("n_segments"), "parent_id", F.col("n_upstream").cast("long").alias("n_upstream")).orderBy(F.desc("length_km"), "river_id")


def listed(rivers: DataFrame, named: bool = False, roots: bool = False, least_km: float = 0, most: int = 0) -> DataFrame:
    """The listing's filters: named ones, roots, rounded length, and the first ``most`` (0: all), longest first."""
    r = rivers.withColumn("length_km", F.round(F.col("length_m") / 1000, 2).cast("double"))
    for wanted, test in ((named, F.col("name").isNotNull()), (roots, F.col("parent_id").isNull()), (bool(least_km), F.col("length_km") >= least_km)):
        r = r.filter(test) if wanted else r
    r = r.orderBy(F.desc("length_m"), "river_id")
    return r.limit(most) if most else r


def header(network: Network) -> DataFrame:
    """One row: how many rivers, named ones, roots, leaves and links there are."""
    kids = network.rivers.filter("parent_id is not null").select(F.col("parent_id").alias("river_id")).distinct().withColumn("_k", F.lit(1))
    r = network.rivers.join(kids, "river_id", "left")
    counts = r.agg(F.count(F.lit(1)).alias("rivers"), F.count("name").alias("named"), F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.col("_k").isNull()).alias("leaves"))
    return counts.crossJoin(network.flows.agg(F.count(F.lit(1)).alias("links")))


def child_order(rivers: DataFrame) -> DataFrame:
    """Each river's place among its parent's children, the longest first."""
    by_length = Window.partitionBy("parent_id").orderBy(F.desc("length_m"), "river_id")
    return rivers.filter("parent_id is not null").select("parent_id", "river_id", F.row_number().over(by_length).cast("long").alias("place"))
