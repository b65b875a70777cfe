"""Resumable batches: what is done is skipped, what fails says so, a replayed batch counts once.

A batch is one folder, ``batch=<name>``, that its write replaces as a whole. So a batch that is
killed half-way, or replayed because nobody heard that it was done, leaves the rows of one
run; and a key that any other batch has written isn't worked on again.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.plans.tables import written


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def done(spark: SparkSession, path: str, schema: str, but: str | None = None) -> DataFrame:
    """What earlier batches have written, but for the batch ``but``; an empty table before the first."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(f"{schema}, batch string").parquet(path)
    return (found if but is None else found.filter(F.col("batch") != but)).drop("batch")


def commit(made: DataFrame, path: str, batch: str) -> dict[str, int]:
    """Replaces the batch's folder by the rows of ``made`` without an error; counts those with and without one."""
    made = written(made)
    tally = made.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count("error").alias("bad"), F.count_if(F.col("error").startswith("rate limit")).alias("limited")).first()
    if tally.ok:
        made.filter("error is null").write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return {"done": tally.ok, "failed": tally.bad, "stopped": int(bool(tally.limited))}


def run(todo: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, schema: str, batches: int = 8) -> dict[str, int]:
    """Applies ``work`` to the rows of ``todo`` that aren't done, in batches by hash of ``key``.

    Each batch is committed before the next begins, so a lost job costs one batch. ``work``
    returns ``schema``, whose ``error`` is null for a result; failures aren't kept, and are
    tried again next time. A row whose error begins with ``rate limit`` stops the run.
    """
    spark, name = todo.sparkSession, uuid.uuid4().hex[:12]
    counts = {"skipped": 0, "done": 0, "failed": 0, "stopped": 0}
    earlier = written(done(spark, path, schema).select(key).distinct())
    counts["skipped"] = todo.join(earlier, key, "left_semi").count()
    left = written(todo.join(earlier, key, "left_anti"))
    for k in range(batches):
        part = left.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        if not part.take(1):
            continue
        for n, v in commit(work(part), path, f"{name}-{k}").items():
            counts[n] += v
        if counts["stopped"]:
            break
    return counts


def stream_batch(spark: SparkSession, schema: str, key: str, work: Callable[[DataFrame], DataFrame], path: str, state: str) -> Callable[[DataFrame, int], None]:
    """What a stream does with a micro-batch: its folder is named after the stream's state and the batch's number, so a replay replaces it."""

    def one(batch: DataFrame, number: int) -> None:
        name = f"{zlib.crc32(state.encode()):08x}-{number}"
        fresh = batch.dropDuplicates([key]).join(done(spark, path, schema, but=name).select(key), key, "left_anti")
        commit(work(written(fresh)), path, name)

    return one


def run_stream(spark: SparkSession, source: str, schema: str, key: str, work: Callable[[DataFrame], DataFrame], path: str, state: str, result: str | None = None) -> None:
    """The same over files that arrive (``schema``): every key is worked on once, and its rows (``result``, or as ``schema``) are committed once."""
    one = stream_batch(spark, result or schema, key, work, path, state)
    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def write_each(rows: DataFrame, key: str, text: str, path: str) -> None:
    """One file for each key (``path/<key>=.../``) that holds its ``text``; a key's earlier file is replaced, other keys' files stay."""
    one = rows.select(key, F.col(text).alias("value")).repartition(F.col(key))
    one.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def written_keys(spark: SparkSession, key: str, path: str) -> DataFrame:
    """The keys that have a file."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.schema(f"value string, {key} string").text(path).select(key).distinct()
