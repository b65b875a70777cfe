"""Written intermediate tables: they cut lineage and survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables that are read once or twice are written small.
CODEC = "zstd"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/rillway-shared-{os.getuid()}"
    return found.rstrip("/")


def _new_path(spark: SparkSession) -> str:
    """A path in the shared folder; what is there goes with the driver."""
    path = f"{work_dir(spark)}/rillway/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back; the files go with the driver."""
    path = _new_path(df.sparkSession)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Grown:
    """A written table that rows are appended to; what is appended must be written itself."""

    def __init__(self, first: DataFrame) -> None:
        self._spark, self._schema, self._path = first.sparkSession, first.schema, _new_path(first.sparkSession)
        self.append(first)

    def append(self, more: DataFrame) -> None:
        more.select(self._schema.names).write.mode("append").option("compression", CODEC).parquet(self._path)

    def table(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self._path)
