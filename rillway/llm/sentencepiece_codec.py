"""SentencePiece encoding and decoding by a distinct-chunk table (see ``piece_table``).

Ids are those of the library without begin or end ids and without sampling; the decoded text
is that of its ``decode(ids)``. Defined cases: a null text counts as empty and gives no ids
and an empty decoded text; very long texts are taken whole; repeated rows and ids give one
row each; other columns are left out, so their names can't clash; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import piece_table
from rillway.llm.common import release_memory, ship_package, table

#: Characters of text whose results are held before they are handed on.
CHARS_AT_ONCE = 2_000_000


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def encode_decode(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` array<int>, ``decoded`` string."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = piece_table.load(model)
        for batch in batches:
            start, chars, ids, decoded = 0, 0, [], []
            for k in range(n := batch.num_rows):
                value = batch.column(1)[k].as_py() or ""
                got, back = codec.encode(value)
                ids.append(got)
                decoded.append(back)
                chars += len(value)
                if chars >= CHARS_AT_ONCE or k == n - 1:
                    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                    np.cumsum([len(x) for x in ids], out=offsets[1:])
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(ids)), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
                    start, chars, ids, decoded = k + 1, 0, [], []
        codec.reset()
        release_memory()

    thin = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return thin.mapInArrow(run, f"doc_id {_id_type(thin, 'doc_id')}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), model_bytes()))


ORACLE = None
