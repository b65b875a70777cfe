"""What the text operators share: shared-folder tables, byte-exact lower-casing, hot keys.

Nothing here keeps state between calls, and nothing is cached on one executor: every
intermediate table lives in the folder that ``spark.checkpoint.dir`` names, so a lost
executor costs only the tasks that it was running.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import io
import os
import string
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and the characters that words are made of.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
NON_SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z and nothing else; ``lower`` would also change other alphabets."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = f"file://{tempfile.gettempdir()}/rillway-shared-{os.getuid()}"
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def materialise(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """Writes ``df`` once into the shared folder, in row groups of so many bytes, and reads it back, which cuts its lineage.

    The files go when the driver ends. Parquet rather than ``checkpoint()``, so that later
    readers still prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillway/{uuid.uuid4().hex}"
    (df.write if row_group is None else df.write.option("parquet.block.size", row_group)).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package's sources to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_rillway_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root.parent))), p.read_bytes())
    blob = raw.getvalue()
    path = Path(tempfile.mkdtemp()) / f"rillway_{hashlib.sha1(blob).hexdigest()[:12]}.zip"
    path.write_bytes(blob)
    sc.addPyFile(str(path))
    sc._rillway_shipped = True


def release_memory() -> None:
    """Gives memory that a task has freed back to the system: Python workers live on, and share their executor's bound."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such call in this C library
        ctypes.CDLL(None).malloc_trim(0)


def with_hot_keys_broadcast(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, most_hot: int = 4096) -> DataFrame:
    """``rows`` inner-joined with ``groups`` (one row per ``key``; ``size`` rows each) on ``key``.

    A group of at least ``n_rows / most_hot`` rows is hot; there can be no more than
    ``most_hot`` of them, so that side is broadcast, and its rows never meet in one task.
    The other groups are joined by shuffle, where no key holds more than a small share.
    """
    least = max(2, -(-n_rows // most_hot))
    hot = groups.filter(F.col(size) >= least)
    cold = groups.filter(F.col(size) < least)
    names = [c for c in groups.columns if c != key]
    out = [*rows.columns, *names]
    tagged = rows.join(F.broadcast(hot), key, "left")
    of_hot = tagged.filter(F.col(size).isNotNull()).select(out)
    of_cold = tagged.filter(F.col(size).isNull()).drop(*names).join(cold, key).select(out)
    return of_hot.unionByName(of_cold)


#: Most words of a broadcast Bloom filter: 2^20 words of 8 bytes.
MAX_WORDS = 1 << 20


def filter_words(n_keys: int, most: int = MAX_WORDS) -> int:
    """Words of a filter for ``n_keys`` keys: two keys a word until the bound is reached."""
    return max(64, min(most, 1 << (max(n_keys, 1) // 2).bit_length()))


def with_pattern(df: DataFrame, key: Column, n_words: int) -> DataFrame:
    """Adds the filter word ``_word`` that ``key`` falls in and the four bits ``_mask`` it sets there."""
    bit = lambda k: f"shiftleft(1L, cast(shiftright(_h64, {6 * k}) & 63 as int))"
    return (
        df.withColumn("_h64", F.xxhash64(key))
        .withColumn("_word", F.expr(f"shiftrightunsigned(_h64, 24) % {n_words}L"))
        .withColumn("_mask", F.expr(" | ".join(bit(k) for k in range(4))))
        .drop("_h64")
    )


def filter_of(patterns: DataFrame) -> DataFrame:
    """The filter as a relation: one row a word, at most as many as ``n_words``."""
    return patterns.groupBy("_word").agg(F.expr("bit_or(_mask)").alias("_bits"))


def split_by_filter(patterns: DataFrame, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are certainly not in the filter, and rows that may be."""
    tested = patterns.join(F.broadcast(bits), "_word", "left")
    hit = F.expr("_bits is not null and (_bits & _mask) = _mask")
    return tested.filter(~hit), tested.filter(hit)


def without_rows(docs: DataFrame, flagged: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows whose ``keys`` are in ``flagged``, which has columns of those names.

    A Bloom filter of the flagged keys, bounded by ``MAX_WORDS``, lets the other rows through
    without a shuffle; whole rows shuffle only where the filter says that they may be flagged.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = docs.select(whole, *[c.alias(k) for k, c in keys.items()])
    n_words = filter_words(flagged.count())
    key = F.struct(*[F.col(k) for k in keys])
    bits = materialise(filter_of(with_pattern(flagged, key, n_words)))
    passed, maybe = split_by_filter(with_pattern(rows, key, n_words), bits)
    same = [maybe[k].eqNullSafe(flagged[k]) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return passed.select("_row").unionByName(maybe.join(flagged, on, "left_anti").select("_row")).select("_row.*")


def only_rows(docs: DataFrame, wanted: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are in ``wanted``; rows that its Bloom filter rules out never shuffle."""
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = docs.select(whole, *[c.alias(k) for k, c in keys.items()])
    n_words = filter_words(wanted.count())
    key = F.struct(*[F.col(k) for k in keys])
    bits = materialise(filter_of(with_pattern(wanted, key, n_words)))
    _, maybe = split_by_filter(with_pattern(rows, key, n_words), bits)
    return maybe.join(wanted, list(keys), "left_semi").select("_row.*")


def components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of links between longs: ``node`` and ``label``, its smallest node.

    Each round takes the smallest label among a node's own and its neighbours', then lets
    every node jump to its label's label; it ends when no label changes. Inputs of every join
    are written tables, so that adaptive execution can split the links of a popular node.
    """
    ends = links.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    both = materialise(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    written = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    while True:
        labels = written.select("node", "label")
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("other"))
        took = materialise(labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("was"), F.least("label", "other").alias("label")))
        up = took.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = materialise(took.join(up, "label").select("node", "was", F.col("above").alias("label")))
        discard(written, took)
        written = jumped
        if not jumped.filter("label < was").take(1):
            discard(both)
            return jumped.select("node", "label")
