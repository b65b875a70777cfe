"""Token counts with a whole-token shortcut (see ``piece_table``).

The vocabulary strings that the library encodes alone as one token are listed beforehand,
each one checked; a pre-token in that list counts one, and only the rest are merged.
Defined cases: a null text counts as empty (no bytes, no tokens); very long texts are taken
whole; repeated rows and ids give one row each; other columns are left out, so their names
can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import piece_table
from rillway.llm.common import release_memory, ship_package, table
from rillway.llm.sentencepiece_codec import _id_type, model_bytes

LIMIT = 4096


def count_tokens(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counter = piece_table.load(model)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([counter.count(x.as_py() or "") for x in texts], pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])
        counter.reset()
        release_memory()

    thin = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = thin.mapInArrow(run, f"doc_id {_id_type(thin, 'doc_id')}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_bytes())


ORACLE = None
