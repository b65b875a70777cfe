"""Interaction audit of quality filters on a packed bitmap index.

Each task packs its rows into an index: a row for each part, with one NumPy bitset a filter
(set where the row fails it) and a label, padded with a bitset of the rows that are there.
The index is a table in the shared folder; from it alone any order of the filters is audited.
For each of the ``2 ** k`` sets of filters, AND-NOT and a popcount give how many rows of a part
pass all of them, and how many of these carry each label. These counts, summed over all
tasks, hold everything else: what a filter removes after others is a difference of two of
them, and its Shapley value the sum of such differences over all orders.

The text filters A to E are ``flag_texts``; E compares with all texts of the table, by their
SHA-256, before any filter is applied.

Defined cases: a null text is empty (it has no words: A fails, B, C and D don't); a row with a
null id has no smaller one and isn't one; rows that share id and text don't fail E because of
each other; a null part is the empty string; rows of ``labels`` that share an id count as
labelled 1 where any of them is, null ids and null labels as not labelled; repeated rows
count each; very long texts are taken whole; other columns are left out, so their names can't
clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.common import materialise, release_memory, ship_package, table, with_hot_keys_broadcast

#: Fixed values of the text filters: fewest words, least share of distinct words and most capitals (in hundredths), marks.
FEWEST_WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
TEXT_FILTERS = "ABCDE"
#: Rows of one part that a row of the index holds at most.
_HELD = 1 << 20


def _byte_counts(texts: list[bytes], wanted: np.ndarray) -> np.ndarray:
    """How many bytes of each text are ``wanted`` (256 flags)."""
    out = np.zeros(len(texts), dtype=np.int64)
    full = [i for i, t in enumerate(texts) if t]
    if full:
        size = np.array([len(texts[i]) for i in full])
        hit = wanted[np.frombuffer(b"".join(texts[i] for i in full), dtype=np.uint8)]
        out[full] = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
    return out


_CAPITAL = np.zeros(256, dtype=np.uint8)
_CAPITAL[65:91] = 1
_MARK = np.zeros(256, dtype=np.uint8)
_MARK[list(MARKS)] = 1
#: All bytes of UTF-8 but those that continue a character.
_START = np.ones(256, dtype=np.uint8)
_START[128:192] = 0


def own_flags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each text fails A, B, C and D."""
    words = np.array([(len(w), len(set(w))) for w in (t.split() for t in texts)], dtype=np.int64).reshape(-1, 2)
    short = words[:, 0] < FEWEST_WORDS
    repeats = 100 * words[:, 1] < DISTINCT * words[:, 0]
    loud = 100 * _byte_counts(texts, _CAPITAL) > CAPITALS * _byte_counts(texts, _START)
    return short, repeats, loud, _byte_counts(texts, _MARK) > 0


def flag_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id``, ``part`` and a boolean for each of the filters A to E, true where the row fails it."""
    ship_package(docs.sparkSession)
    kind = docs.select(F.col(doc_id).alias("i")).schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            flags = [pa.array(x) for x in own_flags(texts)]
            sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *flags, sha], names=["doc_id", "part", "A", "B", "C", "D", "_sha"])
        release_memory()

    thin = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").cast("binary").alias("text"))
    marked = materialise(thin.mapInArrow(run, f"doc_id {kind}, part string, A boolean, B boolean, C boolean, D boolean, _sha binary"))
    groups = materialise(marked.groupBy("_sha").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    joined = with_hot_keys_broadcast(marked, groups, "_sha", "_n", marked.count())
    return joined.select("doc_id", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame, names: dict[str, str], doc_id: str = "doc_id") -> DataFrame:
    """``rows`` with a boolean for each of ``names``: whether that column of ``labels`` is 1 for the row's id."""
    thin = labels.select(F.col(doc_id).alias("_id"), *[(F.col(c) == 1).alias(n) for n, c in names.items()])
    each = thin.filter("_id is not null").groupBy("_id").agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in names])
    joined = rows.join(each, rows["doc_id"] == each["_id"], "left")
    return joined.select(*[rows[c] for c in rows.columns], *[F.coalesce(each[n], F.lit(False)).alias(n) for n in names])


def build_index(rows: DataFrame, flags: list[str], part: str = "part") -> DataFrame:
    """The packed index of boolean columns: a row for each part of each task, ``part``, ``n_rows`` and ``bits``.

    ``bits`` has a little-endian bitset of whole 64-bit words for each of ``flags``, and last one of the rows that are there.
    """
    ship_package(rows.sparkSession)
    n_flags = len(flags)

    def pack(names: list[str], held: np.ndarray) -> pa.RecordBatch:
        """``held``: a row of 0 and 1 for each flag, in the order of ``names``."""
        order = np.argsort(codes := np.unique(names, return_inverse=True)[1], kind="stable")
        first = np.flatnonzero(np.diff(codes[order], prepend=-1))
        parts, sizes, bits = [], [], []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            chosen = np.zeros((n_flags + 1, -(-(b - a) // 64) * 64), dtype=np.uint8)
            chosen[:n_flags, : b - a] = held[:, order[a:b]]
            chosen[n_flags, : b - a] = 1
            parts.append(names[order[a]])
            sizes.append(b - a)
            bits.append([x.tobytes() for x in np.packbits(chosen, axis=1, bitorder="little")])
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.binary()))], names=["part", "n_rows", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held: list[np.ndarray] = []
        for batch in batches:
            names += batch.column(0).to_pylist()
            held.append(np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(np.uint8) for k in range(n_flags)]))
            if len(names) >= _HELD:
                yield pack(names, np.concatenate(held, axis=1))
                names, held = [], []
        if names:
            yield pack(names, np.concatenate(held, axis=1))
        release_memory()

    thin = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *[F.coalesce(F.col(f), F.lit(False)).alias(f"_f{k}") for k, f in enumerate(flags)])
    return thin.mapInArrow(run, "part string, n_rows long, bits array<binary>")


def passing_counts(index: DataFrame, n_filters: int, n_labels: int) -> DataFrame:
    """For each part and set of filters (a bit each) how many rows pass all of them: ``part``, ``subset``, ``n``, and ``l0``, ``l1``, ... of each label."""
    ship_package(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.frombuffer(b"".join(row[k] for row in batch.column(1).to_pylist()), dtype="<u8") for k in range(n_filters + n_labels + 1)]
            size = np.array([len(row[0]) // 8 for row in batch.column(1).to_pylist()], dtype=np.int64)
            first = np.cumsum(size) - size
            for subset in range(1 << n_filters):
                stays = bits[-1]
                for k in range(n_filters):
                    if subset >> k & 1:
                        stays = stays & ~bits[k]
                counts = [np.add.reduceat(np.bitwise_count(x), first, dtype=np.int64) for x in (stays, *[stays & x for x in bits[n_filters:-1]])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(size), subset, dtype=np.int32)), *map(pa.array, counts)], names=["part", "subset", "n", *[f"l{j}" for j in range(n_labels)]])
        release_memory()

    names = ["n", *[f"l{j}" for j in range(n_labels)]]
    each = index.select("part", "bits").mapInArrow(run, "part string, subset int, " + ", ".join(f"{x} long" for x in names))
    return each.groupBy("part", "subset").agg(*[F.sum(x).alias(x) for x in names])


def shapley_weights(n_filters: int) -> list[int]:
    """By the number of filters before: how many orders begin with these, in any order, and then the filter."""
    from math import factorial

    return [factorial(s) * factorial(n_filters - 1 - s) for s in range(n_filters)]


def audit(counts: DataFrame, filters: str, losses: list[str]) -> DataFrame:
    """A row for each part, order of ``filters`` and step, from ``passing_counts``; ``losses`` names the columns of the labels."""
    n = len(filters)
    full, fact = (1 << n) - 1, shapley_weights(n)
    names = ["n", *[f"l{j}" for j in range(len(losses))]]
    # One row a part: all its counts by subset, of which there are always 2 ** n.
    sets = counts.groupBy("part").agg(*[F.expr(f"transform(array_sort(collect_list(struct(subset, {x}))), s -> s.{x})").alias(x) for x in names])
    sums = []
    for f in range(n):
        terms = [f"{fact[s.bit_count()]}L * (n[{s}] - n[{s | 1 << f}])" for s in range(full + 1) if not s >> f & 1]
        sums.append(F.expr(" + ".join(terms)))
    sets = sets.withColumn("_shapley", F.array(*sums))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(filters[k] for k in order), step, f, before))
            before |= 1 << f
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("_f"), F.lit(b).alias("_b")) for o, s, f, b in steps])
    rows = sets.select("*", F.explode(plan).alias("_p")).select("*", "_p.*").withColumn("_own", F.expr("shiftleft(1, _f)")).withColumn("_a", F.expr("_b | _own"))
    removed = F.expr("n[_b] - n[_a]")
    lost = [F.expr(f"l{j}[_b] - l{j}[_a]").alias(name) for j, name in enumerate(losses)]
    unique = F.expr(f"n[{full} - _own] - n[{full}]")
    return rows.select("part", "filter_order", "step", F.expr("n[_a]").alias("kept"), removed.alias("removed"), (F.expr("n[0] - n[_own]") - removed).alias("redundant"), unique.alias("unique_fails"), *lost, F.expr("_shapley[_f]").alias("shapley"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_labels(flag_texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"), {"good": "quality", "toxic": "toxic"})
    index = materialise(build_index(rows, [*TEXT_FILTERS, "good", "toxic"]))
    counts = materialise(passing_counts(index, len(TEXT_FILTERS), 2))
    return audit(counts, TEXT_FILTERS, ["good_lost", "toxic_lost"])


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flag AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM doc),
mark AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
tally AS (
  SELECT part, f, count(*) AS c, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM flag LEFT JOIN mark USING (doc_id) GROUP BY part, f),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
ord AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
step AS (
  SELECT filter_order, step, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS before, ascii(filter_order[step]) - 64 AS own
  FROM ord, (SELECT unnest(range(1, 6)) AS step)),
seen AS (
  SELECT part, filter_order, step, own, f[own] AS fails, len(list_filter(before, lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda v: v)) AS n_fails, c, g, x FROM step, tally),
found AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(c) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(c) FILTER (NOT gone AND fails), 0) AS removed,
    coalesce(sum(c) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(c) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(g) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(x) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM found
"""
