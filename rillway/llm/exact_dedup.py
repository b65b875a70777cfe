"""Exact dedup by two-pass Bloom filtering.

Pass 1 finds what a Bloom filter would call repeated: every text's hash has a pattern, one
64-bit word of the filter and four bits in it, and all rows are grouped by their pattern, so
a pattern of every row shuffles (no first filter is built: at scale each row's bits would
have to reach its word anyway). Patterns of two or more rows make up the second filter, a real
one. Pass 2 tests each row against it: rows that miss it are certainly unique and go straight
to the result, without a shuffle; only the others are grouped by their SHA-256.

The second filter has at most ``max_words`` words of 8 bytes whatever the input, which is
the proven bound of its broadcast. When the repeats outgrow it, it fills up and more rows
take the exact path; the result stays the same.

Defined cases: a null text counts as empty; runs of white space count as one space; of equal
texts the smallest ``doc_id`` stays (nulls are larger than all ids; if all are null, the null
stays). Rows that repeat both id and text each count in ``group_size`` and get the same
answer; ``drop_copies`` returns one of them. Columns besides id and text are never looked
at, so their names may clash with the result's. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.common import (
    MAX_WORDS,
    SPACE_CLASS,
    filter_of,
    filter_words,
    materialise,
    split_by_filter,
    table,
    with_hot_keys_broadcast,
    with_pattern,
)

def _digest(text: str):
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS, " ").cast("binary"), 256)


def _prepare(docs: DataFrame, doc_id: str, text: str, max_words: int):
    thin = materialise(docs.select(F.col(doc_id).alias("doc_id"), _digest(text).alias("_sha")))
    n_rows = thin.count()
    n_words = filter_words(n_rows, max_words)
    marked = with_pattern(thin, F.col("_sha"), n_words)
    # A pattern inserted twice or more goes into the second filter.
    twice = marked.groupBy("_word", "_mask").count().filter("count > 1")
    repeats = materialise(filter_of(twice))
    return marked, repeats, n_rows, n_words


def decide_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """One row per document: which row of its text stays, and how many rows share the text."""
    marked, repeats, n_rows, _ = _prepare(docs, doc_id, text, max_words)
    once, maybe = split_by_filter(marked, repeats)
    groups = materialise(maybe.groupBy("_sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    exact = with_hot_keys_broadcast(maybe.select("doc_id", "_sha"), groups, "_sha", "group_size", n_rows)
    alone = once.select("doc_id", "_sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return alone.unionByName(exact).select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.col("_sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """The documents themselves, all their columns, without the copies.

    Whole rows shuffle only where the second filter says that their text may be repeated.
    """
    marked, repeats, _, n_words = _prepare(docs, doc_id, text, max_words)
    _, maybe = split_by_filter(marked, repeats)
    stays = maybe.groupBy("_sha").agg(F.min("doc_id").alias("_keep"))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_id"), _digest(text).alias("_sha"))
    once, again = split_by_filter(with_pattern(packed, F.col("_sha"), n_words), repeats)
    kept = again.join(stays, (again["_id"].eqNullSafe(stays["_keep"])) & (again["_sha"] == stays["_sha"]), "left_semi")
    # Rows that repeat id and text as well: the first of them by hash of the whole row.
    kept = kept.groupBy("_id", "_sha").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return once.select("_row").unionByName(kept.select("_row")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide_copies(table(spark, sf_dir, "documents"))


ORACLE = r"""
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""
