"""Tables in the folder that the cluster shares: they end a lineage and outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, as in tests, under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tripwire-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables in a new shared folder; leaving the ``with`` block deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.written = spark, shared_folder(spark), 0
        self.paths: dict[int, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.folder)

    def stored(self, df: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.folder}/{self.written}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        if path := self.paths.pop(id(df), None):
            delete(self.spark, path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder that stays, for what is returned."""
    return Scratch(df.sparkSession).stored(df)
