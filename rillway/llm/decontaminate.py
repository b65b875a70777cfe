"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item, or the whole item if it is
shorter; a document contains it where all its words stand in a row. Both are cut into
shingles of ``SHINGLE`` words. Containment needs every shingle of a window, so the prefix of
a window that a document must share is its single rarest shingle, by the number of places
where it occurs in the documents. Documents meet windows on that shingle alone; the length
bound asks that the window fits between the document's ends, the positional bound that the
shingle's place in the window gives the window's first word, and the pair is verified by
comparing all the shingles at their places.

Documents are cut and tested against the benchmark's shingles in one pass without a shuffle;
only places that match any go on. The benchmark's shingles are broadcast in blocks of at
most ``BLOCK`` distinct ones, with one pass over the documents for each block.

Defined cases: a null or empty text has no words and is clean; an item without words or
without an id has no window; items that share a window all count; rows that repeat id and
text get one result each; other columns are never looked at; an empty table of documents
gives an empty result, an empty benchmark finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.common import ALNUM_WORD, lower_ascii, materialise, table, without_rows

WINDOW, SHINGLE, BLOCK = 13, 5, 1_000_000


def _words(text: str) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def _shingles(words: str, size: int) -> Column:
    """Hashes of all shingles of ``size`` words, in order."""
    n = f"size({words})"
    parts = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(f"case when {n} >= {size} then transform(sequence(0, {n} - {size}), i -> xxhash64({parts})) else cast(array() as array<bigint>) end")


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: their shingle hashes ``_need``, shingle size ``_s``, length ``_len``, and ``_items``."""
    cut = items.select(F.col(item_id).alias("_item"), _words(text).alias("_w")).filter("_item is not null and size(_w) > 0")
    cut = cut.withColumn("_len", F.least(F.size("_w"), F.lit(WINDOW)))
    each = cut.select("_item", "_len", F.explode_outer(F.expr("transform(sequence(0, size(_w) - _len), i -> slice(_w, i + 1, _len))")).alias("_w"))
    by_size = F.lit(None).cast("array<bigint>")
    for s in range(SHINGLE, 0, -1):
        by_size = F.when(F.least(F.col("_len"), F.lit(SHINGLE)) == s, _shingles("_w", s)).otherwise(by_size)
    hashed = each.select("_item", "_len", F.least(F.col("_len"), F.lit(SHINGLE)).alias("_s"), by_size.alias("_need"))
    return hashed.groupBy("_need", "_s", "_len").agg(F.collect_set(F.col("_item").cast("string")).alias("_items"))


def _places(docs: DataFrame, tokens: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """Places of documents whose shingle is among ``tokens``, with the shingles around them."""
    around = WINDOW - size
    d = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_text"), _words(text).alias("_w"))
    d = d.withColumn("_hashes", _shingles("_w", size)).withColumn("_n", F.size("_w"))
    # The outer form, since for the other one Spark adds a filter that cuts the text anew for each place.
    at = d.select("_id", "_text", "_n", "_hashes", F.posexplode_outer("_hashes").alias("_pos", "_token"))
    hit = at.join(F.broadcast(tokens.withColumnRenamed("_h", "_token")), "_token")
    first = F.greatest(F.col("_pos") - around, F.lit(0))
    return hit.select("_id", "_text", "_n", "_pos", "_token", first.alias("_first"), F.slice("_hashes", first + 1, F.col("_pos") - first + around + 1).alias("_near"), F.lit(size).alias("_s"))


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """Documents that contain a window: ``_id``, ``_text``, ``n_hit``, ``items`` (sorted strings)."""
    windows = materialise(windows_of(items, item_id, item_text).withColumn("_window", F.monotonically_increasing_id()))
    tokens = materialise(windows.select("_s", F.explode("_need").alias("_h")).distinct())
    sizes = {r["_s"]: r["count"] for r in tokens.groupBy("_s").count().toArrow().to_pylist()}  # at most SHINGLE rows
    places = None
    for s, n in sorted(sizes.items()):
        blocks = -(-n // block)
        for k in range(blocks):
            part = tokens.filter((F.col("_s") == s) & (F.pmod(F.col("_h"), F.lit(blocks)) == k)).select("_h")
            got = _places(docs, part, s, doc_id, text)
            places = got if places is None else places.unionByName(got)
    if places is None:
        return docs.select(F.col(doc_id).alias("_id"), F.lit(0).cast("long").alias("_text"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    places = materialise(places)
    rarity = places.groupBy("_s", "_token").agg(F.count(F.lit(1)).alias("_freq"))
    # The rarest shingle of each window; windows with a shingle that no document has can't occur.
    each = windows.select("_window", "_s", "_len", "_need", F.posexplode("_need").alias("_k", "_token"))
    known = each.join(rarity, ["_s", "_token"], "left")
    rarest = known.groupBy("_window", "_s", "_len", "_need").agg(
        F.min(F.coalesce("_freq", F.lit(0))).alias("_least"), F.min_by(F.struct("_token", "_k"), F.struct(F.coalesce("_freq", F.lit(0)), "_token", "_k")).alias("_p")
    )
    prefix = materialise(rarest.filter("_least > 0").select("_window", "_s", "_len", "_need", F.col("_p._token").alias("_token"), F.col("_p._k").alias("_k")))
    few = F.broadcast(prefix) if prefix.count() <= BLOCK // 8 else prefix
    start = F.col("_pos") - F.col("_k")
    pairs = places.join(few, ["_s", "_token"]).withColumn("_start", start)
    pairs = pairs.filter((F.col("_start") >= 0) & (F.col("_start") + F.col("_len") <= F.col("_n")))
    exact = pairs.filter(F.slice("_near", F.col("_start") - F.col("_first") + 1, F.size("_need")) == F.col("_need"))
    found = materialise(exact.select("_id", "_text", "_window", "_start", "_len").distinct())
    spans = found.groupBy("_id", "_text").agg(F.sort_array(F.collect_set(F.struct("_start", "_len"))).alias("_spans"))
    covered = F.expr(
        "aggregate(_spans, struct(0L as total, 0 as upto), (acc, x) -> struct("
        "acc.total + greatest(0, x._start + x._len - greatest(x._start, acc.upto)) as total, greatest(acc.upto, x._start + x._len) as upto), acc -> acc.total)"
    )
    named = found.select("_id", "_text", "_window").distinct().join(windows.select("_window", "_items"), "_window")
    by_doc = named.groupBy("_id", "_text").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("items"))
    i, s = by_doc.alias("i"), spans.alias("s")
    on = F.col("i._id").eqNullSafe(F.col("s._id")) & F.col("i._text").eqNullSafe(F.col("s._text"))
    return s.join(i, on).select("s._id", "s._text", covered.alias("n_hit"), "items")


def _counted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    # Capitals make the same words, so counting needs no lower-casing.
    any_case = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_text"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(any_case)).cast("long").alias("n_words"))


def judge(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """One row per document: words, hit words, items found, and whether it is contaminated."""
    d, f = _counted(docs, doc_id, text).alias("d"), find(docs, items, doc_id, text, **names).alias("f")
    on = F.col("d._id").eqNullSafe(F.col("f._id")) & F.col("d._text").eqNullSafe(F.col("f._text"))
    n_hit = F.coalesce("f.n_hit", F.lit(0).cast("long"))
    return d.join(f, on, "left").select(
        F.col("d._id").alias("doc_id"),
        F.col("d._text").alias("_text"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("f.items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated."""
    flagged = materialise(judge(docs, items, doc_id, text).filter("contaminated").select(F.col("doc_id").alias("_id"), "_text").distinct())
    return without_rows(docs, flagged, {"_id": F.col(doc_id), "_text": F.xxhash64(F.col(text))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, len, array_to_string(w[i + 1 : i + len], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS len, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
place AS (
  SELECT doc_id, i, l AS len, array_to_string(w[i + 1 : i + l], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM doc, (SELECT DISTINCT len AS l FROM win) WHERE len(w) >= l)),
found AS (SELECT doc_id, i, p.len, item_id FROM place p JOIN win USING (win)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS k FROM (SELECT DISTINCT doc_id, i, len FROM found)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
