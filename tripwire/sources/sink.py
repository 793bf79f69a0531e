"""A sink whose micro-batches are visible whole and once, whatever fails between."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tripwire.sources import files

#: What a batch goes through, in order; a failure may come after each.
STEPS = ("begin", "staged", "committed")


class ManifestSink:
    """For ``foreachBatch``: a batch's rows are staged in a folder of their own, and a manifest with the batch's number then names it.

    Only rows that a manifest names are read. A batch that is repeated because its query died before it was staged or named
    is staged anew, and the old folder is never read; one that died after its manifest is left as it is. ``on_step`` is
    called with a step and the batch's number after each step, for tests and drills.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, on_step: Callable[[str, int], None] | None = None):
        self.spark, self.folder, self.schema, self.on_step = spark, folder, schema, on_step or (lambda step, batch: None)

    def _manifest(self, batch_id: int) -> str:
        return f"{self.folder}/manifest/{batch_id:012d}.json"

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self.on_step("begin", batch_id)
        if files.exists(self.spark, self._manifest(batch_id)):
            batch.write.format("noop").mode("overwrite").save()  # stateful operators still have to commit their state
            return
        staged = f"data/{batch_id:012d}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.folder}/{staged}")
        self.on_step("staged", batch_id)
        files.write_json(self.spark, self._manifest(batch_id), {"batch": batch_id, "path": staged}, overwrite=False)
        self.on_step("committed", batch_id)

    def rows(self) -> DataFrame:
        """The rows of all batches that have a manifest."""
        found = [files.read_json(self.spark, f"{self.folder}/manifest/{x}")["path"] for x in files.names(self.spark, f"{self.folder}/manifest")]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{x}" for x in found))

    def discard(self) -> int:
        """Deletes staged folders that no manifest names, beside no running query; returns how many."""
        from tripwire.sources.storage import delete

        named = {files.read_json(self.spark, f"{self.folder}/manifest/{x}")["path"] for x in files.names(self.spark, f"{self.folder}/manifest")}
        left = [x for x in files.names(self.spark, f"{self.folder}/data") if f"data/{x}" not in named]
        for x in left:
            delete(self.spark, f"{self.folder}/data/{x}")
        return len(left)
