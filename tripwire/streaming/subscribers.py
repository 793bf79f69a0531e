"""Groups that follow one log at the same time, each at its own speed, with its own progress and its own sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripwire.sources.sink import ManifestSink
from tripwire.streaming.ledger import Ledger, lines


@dataclass
class Group:
    """What a group makes of the log, as a function so that each start reads it anew; and, while it runs, its query."""

    stream: Callable[[], DataFrame]
    on_step: Callable[[str, int], None] | None = None
    query: StreamingQuery | None = None
    restarts: int = 0
    errors: list[str] = field(default_factory=list)


class Subscribers:
    """Runs groups as concurrent queries; a group that failed is started again from its checkpoint, ``retries`` times at most."""

    def __init__(self, spark: SparkSession, folder: str, retries: int = 3):
        self.spark, self.folder, self.retries, self.groups = spark, folder, retries, {}
        self.ledger = Ledger(spark, f"{folder}/ledger")

    def __enter__(self) -> Subscribers:
        self.ledger.__enter__()
        return self

    def __exit__(self, *_) -> None:
        for name in self.groups:
            self.stop(name)
        self.ledger.__exit__()

    def add(self, name: str, stream: Callable[[], DataFrame], on_step: Callable[[str, int], None] | None = None) -> None:
        self.groups[name] = Group(stream, on_step)
        self.start(name)

    def start(self, name: str) -> None:
        """Starts a group, or starts it again where it was."""
        group = self.groups[name]
        rows = group.stream()
        sink = ManifestSink(self.spark, f"{self.folder}/{name}", rows.schema, group.on_step)
        writer = rows.writeStream.foreachBatch(sink.write).option("checkpointLocation", f"{self.folder}/{name}/checkpoint")
        group.query = self.ledger.start(writer, name)

    def stop(self, name: str) -> None:
        query = self.groups[name].query
        if query is not None:
            query.stop()
            try:
                self.ledger.finish(query)
            except StreamingQueryException as e:
                self.groups[name].errors.append(str(e))
            self.groups[name].query = None

    def catch_up(self) -> None:
        """Waits until every running group has processed what is in the log now; groups that fail meanwhile are started again."""
        waiting = [name for name, g in self.groups.items() if g.query is not None]
        while waiting:
            name, group = waiting[0], self.groups[waiting[0]]
            try:
                group.query.processAllAvailable()
                self.ledger.settle(group.query)
                waiting.pop(0)
            except StreamingQueryException as e:
                group.errors.append(str(e))
                if group.restarts == self.retries:
                    group.query = None
                    raise
                group.restarts += 1
                self.start(name)

    def rows(self, name: str) -> DataFrame:
        """What a group has made visible so far."""
        return ManifestSink(self.spark, f"{self.folder}/{name}", self.groups[name].stream().schema).rows()

    def lag(self, log: DataFrame) -> DataFrame:
        """Per group: rows in the log, rows that its micro-batches have read, and the backlog, from the ledger as it is now."""
        appended = log.agg(F.count("*").alias("appended"))
        known = self.spark.createDataFrame([(x,) for x in self.groups], "grp string")
        read = lines(self.spark, self.ledger.folder).groupBy(F.col("label").alias("grp")).agg(F.sum("rows").alias("processed"))
        counted = known.join(read, "grp", "left").join(F.broadcast(appended))
        return counted.select("grp", "appended", F.coalesce("processed", F.lit(0)).alias("processed"), (F.col("appended") - F.coalesce("processed", F.lit(0))).alias("backlog"))
