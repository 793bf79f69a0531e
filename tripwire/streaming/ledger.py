"""A ledger of micro-batches: what each read, dropped and took, kept as files beside the checkpoint.

A query's own list of recent progress is cut at its last hundred reports, and is gone with the driver. The ledger listens to
the queries instead and writes a line for every micro-batch as it ends, named by the query and the batch: a restarted
query carries on in it, and a batch that is run again after a failure replaces its line. A batch that was committed in
the instant before a driver died may lack its line, since the report comes after the commit.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from tripwire.sources import files
from tripwire.sources.storage import delete

#: late: rows beyond the watermark; repeats: rows that a deduplication dropped; at: when the line was written (ms).
LINE = "query string, label string, run string, batch long, rows long, seconds double, late long, repeats long, at long"


class Ledger(StreamingQueryListener):
    """Writes a line for each micro-batch of the queries that it starts, for as long as its ``with`` block lasts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.prefix = spark, folder, uuid.uuid4().hex
        self.lock, self.ended, self.started = threading.Condition(), set(), 0
        self.written: dict[str, int] = {}  # the last batch of each run

    def __enter__(self) -> Ledger:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def start(self, writer: DataStreamWriter, label: str = "") -> StreamingQuery:
        """Starts a query under a name by which the ledger knows it and its label."""
        self.started += 1
        return writer.queryName(f"{self.prefix}-{self.started}-{label}").start()

    def finish(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Waits for the query to end, and for its last line to be written."""
        try:
            query.awaitTermination()
        finally:
            with self.lock:
                told = self.lock.wait_for(lambda: str(query.runId) in self.ended, seconds)
        if not told:
            raise TimeoutError(f"no report that query {query.id} has ended")

    def settle(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Waits for the lines of the micro-batches that a running query has ended so far."""
        last = max((p.batchId for p in query.recentProgress if "addBatch" in p.durationMs), default=-1)
        with self.lock:
            if not self.lock.wait_for(lambda: self.written.get(str(query.runId), -1) >= last, seconds):
                raise TimeoutError(f"no report of batch {last} of query {query.id}")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if not (p.name or "").startswith(self.prefix) or "addBatch" not in p.durationMs:
            return  # of another query, or a report that there was nothing to do
        line = {
            "query": str(p.id), "label": p.name.split("-", 2)[2], "run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "seconds": p.durationMs.get("triggerExecution", 0) / 1000,
            "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators), "repeats": sum(s.customMetrics.get("numDroppedDuplicateRows", 0) for s in p.stateOperators), "at": self.spark._jvm.System.currentTimeMillis(),
        }
        files.write_json(self.spark, f"{self.folder}/lines/{p.id}-{p.batchId:012d}.json", line)
        with self.lock:
            self.written[str(p.runId)] = max(p.batchId, self.written.get(str(p.runId), -1))
            self.lock.notify_all()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.lock:
            self.ended.add(str(event.runId))
            self.lock.notify_all()


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each micro-batch of each query, the last that was written of it."""
    try:
        written = spark.read.schema(LINE).json(f"{folder}/lines")
    except AnalysisException:  # nothing was written so far
        written = spark.createDataFrame([], LINE)
    try:
        written = written.unionByName(spark.read.schema(LINE).option("recursiveFileLookup", "true").parquet(f"{folder}/packed"))
    except AnalysisException:
        pass
    last = F.max_by(F.struct(*(c.split()[0] for c in LINE.split(", ") if not c.startswith(("query", "batch")))), "at")
    return written.groupBy("query", "batch").agg(last.alias("last")).select("query", "batch", "last.*")


def pack(spark: SparkSession, folder: str) -> None:
    """Puts the lines so far into one table in place of a file each; not beside a running query of this ledger.

    The table is in its place before anything else goes, so after a failure between, lines are there twice, and ``lines`` takes one.
    """
    path, new = spark._jvm.org.apache.hadoop.fs.Path, uuid.uuid4().hex
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    lines(spark, folder).coalesce(1).write.parquet(f"{folder}/packing/{new}")  # a line per micro-batch
    fs.mkdirs(path(f"{folder}/packed"))
    fs.rename(path(f"{folder}/packing/{new}"), path(f"{folder}/packed/{new}"))
    for old in fs.listStatus(path(f"{folder}/packed")):
        if old.getPath().getName() != new:
            fs.delete(old.getPath(), True)
    delete(spark, f"{folder}/lines")


def totals(of: DataFrame) -> DataFrame:
    """Micro-batches, rows, seconds, late rows and repeats of ledger lines, as one row."""
    return of.agg(F.count("*").alias("batches"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "seconds", "late", "repeats")))
