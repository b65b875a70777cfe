"""Stream segments: cleaning, orientation, the segment graph, and its simple predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a segment table, spellings of null, and flow directions.
NULL_WORDS = ["", "nan", "NaN", "None"]
INVERSE, AMBIGUOUS = "Sens inverse", ["Double sens", "Indéterminé"]


def clean_text(col: Column | str) -> Column:
    """Null for the spellings of null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~c.isin(NULL_WORDS), c)


def first_of(col: Column | str) -> Column:
    """The first of ids or names joined by ``/``; null if blank."""
    c = clean_text(col)
    first = F.trim(F.split_part(c, F.lit("/"), F.lit(1)))
    return F.when((first != "") & ~F.lower(first).isin([w.lower() for w in NULL_WORDS]), first)


def strict_int(col: Column | str) -> Column:
    """An integer written as text, else null."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.expr("1") * F.trim(c).try_cast("int"))


def clean(segments: DataFrame) -> DataFrame:
    """Segments with canonical nulls, integer order and one river key and name each."""
    return segments.select(
        clean_text("cleabs").alias("cleabs"),
        clean_text("ini").alias("ini"),
        clean_text("fin").alias("fin"),
        "sens",
        strict_int("ord").alias("ord"),
        first_of("river_key").alias("river_key"),
        first_of("toponyme").alias("name"),
        F.coalesce("fictif", F.lit(False)).alias("fictif"),
        F.col("sens").isin(AMBIGUOUS).alias("ambiguous"),
        "length_m",
    )


def oriented(segments: DataFrame) -> DataFrame:
    """Downstream-pointing edges ``src`` to ``dst``; rows without two different ends go."""
    swap = F.col("sens") == INVERSE
    s = segments.withColumn("src", F.when(swap, F.col("fin")).otherwise(F.col("ini"))).withColumn("dst", F.when(swap, F.col("ini")).otherwise(F.col("fin")))
    return s.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).drop("ini", "fin", "sens")


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """Of parallel edges the longest; of equally long ones the smallest id."""
    best = Window.partitionBy("src", "dst").orderBy(F.desc_nulls_last("length_m"), "cleabs")
    return edges.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")


def graph(segments: DataFrame, include_ambiguous: bool = False) -> DataFrame:
    """The segment graph of a raw segment table."""
    edges = oriented(clean(segments))
    return collapse_parallel(edges if include_ambiguous else edges.filter(~F.col("ambiguous")))
