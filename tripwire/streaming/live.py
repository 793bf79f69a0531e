"""The live path: stateful features, decisions, anomaly detection, drift, deduplication and delivery as streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tripwire.functions import conformal, logs
from tripwire.functions import constants as C
from tripwire.operators import decision, drift, metrics, models
from tripwire.operators.features import OUT, windowed
from tripwire.operators.ranks import with_rank
from tripwire.operators.registry import Registry, serve
from tripwire.sources.sink import ManifestSink
from tripwire.sources.storage import Scratch, delete, shared_folder
from tripwire.streaming.ledger import Ledger, lines, totals
from tripwire.streaming.subscribers import Subscribers


def rocks(spark: SparkSession) -> None:
    """Stateful operators need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Second 0 of a stream, in milliseconds of event time: a day after the epoch, where the watermark starts.
_START_MS = 86_400_000


def on_time(events: DataFrame, late_s: float) -> DataFrame:
    """Events with an event time and a watermark: rows later than it are dropped by stateful operators.

    The event time of second 0 is ``_START_MS``.
    """
    return events.withColumn("event_time", F.timestamp_seconds(F.col("ts") + _START_MS // 1000)).withWatermark("event_time", f"{late_s} seconds")


def deduplicated(events: DataFrame, late_s: float = 3600.0) -> DataFrame:
    """Each offset once, however often it is delivered within the watermark."""
    return on_time(events, late_s).dropDuplicatesWithinWatermark(["seq"]).drop("event_time")


#: What a row has beside its features when it is decided on.
CARRIED = ("log", "incident_type", "label")
_METRICS = ["ts", "latency_ms", "cpu_pct", "mem_pct", "rps"]


class Features(StatefulProcessor):
    """The batch operator's windows over a service's rows of a micro-batch and those it remembers, in (ts, seq) order.

    The store holds a list of the rows of the last window, to which each micro-batch appends; it is written anew only when
    most of it has become too old. A service's rows of a micro-batch are held at once, so logs are read in bounded ones (``replayed``).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", ", ".join(f"{m} double" for m in _METRICS))
        self.known = handle.getValueState("known", "version string, deployed double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable", ignore_index=True)
        remembered = pd.DataFrame(list(self.rows.get()), columns=_METRICS, dtype=float)
        version, deployed = self.known.get() if self.known.exists() else (None, None)
        both = pd.concat([remembered, new], ignore_index=True)
        own = np.arange(len(both)) >= len(remembered)
        out, version, deployed = windowed(both, own, version, deployed)
        self.known.update((version, deployed))
        young = both["ts"].to_numpy() >= both["ts"].max() - C.BASELINE_S
        if 2 * young.sum() < len(both):
            self.rows.put([tuple(x) for x in both.loc[young, _METRICS].itertuples(index=False)])
        else:
            self.rows.appendList([tuple(x) for x in new[_METRICS].itertuples(index=False)])
        yield out.assign(**{c: new[c].to_numpy(object) for c in CARRIED})

    def close(self) -> None:
        pass


def features(events: DataFrame, late_s: float | None = None) -> DataFrame:
    """The eight features of a stream, the same as the batch operator's, and the columns ``CARRIED``.

    With ``late_s``, rows that are older than the newest of the batches before by more than that are dropped; the
    progress of the query counts them (``dropped_late``).
    """
    schema = OUT + ", log string, incident_type string, label int"
    if late_s is None:
        return events.groupBy("service").transformWithStateInPandas(Features(), schema, "append", "none")
    return on_time(events, late_s).groupBy("service").transformWithStateInPandas(Features(), schema, "append", "eventTime")


def score(features_: DataFrame, fitted: models.Fitted) -> DataFrame:
    """Decisions on rows of features: prediction, set, action and reason."""
    classes = models.classes_of(fitted.classifier)
    scored = models.classify(fitted.classifier, features_)
    sets = scored.withColumn("set", conformal.prediction_set(fitted.q, classes))
    return sets.withColumn("action", conformal.action()).withColumn("reason", conformal.reason())


def escalated() -> Column:
    """Whether a scored row's log is read: its set is not of one class, or its class is one that is often misread."""
    return (F.col("action") == "escalate") | F.col("prediction").isin(C.ESCALATED_CLASSES)


def decide(scored: DataFrame, fitted: models.Fitted) -> DataFrame:
    """Decisions with what reading the log of escalated rows makes of them, and the remediation that pays most.

    The remediation comes from the outcome models on the features; reading the log changes the class only.
    """
    rows = models.effects(fitted.outcomes, scored).withColumn("escalated", escalated())
    read = rows.withColumn("resolved", F.when(F.col("escalated"), logs.read_incident(F.col("log"))).otherwise(F.col("prediction")))
    return read.withColumn("remediation", decision.best_action(F.col("effects"))["action"]).drop("effects", "p")


def decisions(features_: DataFrame, fitted: models.Fitted) -> DataFrame:
    """A stream of features as a stream of decisions."""
    return decide(score(features_, fitted), fitted)


def anomalies(features_: DataFrame, fitted: models.Fitted) -> DataFrame:
    """The detector over a stream of features, a query of its own beside the decisions: strangeness and flag."""
    return models.strangeness(fitted.forest, features_.select("seq", "ts", "service", "incident_type", *C.FEATURES))


def run_to_end(stream: DataFrame, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote."""
    return run_with_progress(stream, checkpoint, out)[0]


def run_with_progress(stream: DataFrame, checkpoint: str | None = None, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what the stream wrote, the ledger's lines of this run); the ledger is in the checkpoint's folder and goes on when the query does."""
    spark = stream.sparkSession
    out, checkpoint = out or shared_folder(spark), checkpoint or shared_folder(spark)
    with Ledger(spark, ledger_of(checkpoint)) as ledger:
        query = ledger.start(stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True))
        ledger.finish(query)
    return spark.read.schema(stream.schema).parquet(out), lines(spark, ledger_of(checkpoint)).filter(F.col("run") == str(query.runId))


#: Rows, about, that ``replayed`` hands on at a time.
STEP_ROWS = 2_000_000


def replayed(rows: DataFrame, folder: str, stream_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Appends rows to the log of a folder in order of (ts, seq), ``STEP_ROWS`` at a time, and runs the stream that is made of the log
    to its end after each; returns all that it wrote, there or called again for more rows.

    A micro-batch is an append, so what an operator holds of it doesn't follow the length of the log, and its state comes from the checkpoint.
    """
    spark = rows.sparkSession

    def append(some: DataFrame) -> DataFrame:
        some.write.mode("append").parquet(f"{folder}/log")
        log = spark.readStream.schema(rows.schema).parquet(f"{folder}/log")
        return run_to_end(stream_of(log), f"{folder}/checkpoint", f"{folder}/features")

    total = rows.count()
    if total <= STEP_ROWS:
        return append(rows)
    with Scratch(spark) as tmp:
        # stored with its place, so that an append reads the files that hold its rows
        placed = tmp.stored(with_rank(rows, "ts", "seq", name="place_", tmp=tmp))
        for begin in range(0, total, STEP_ROWS):
            written = append(placed.filter((F.col("place_") >= begin) & (F.col("place_") < begin + STEP_ROWS)).drop("place_"))
    return written


def ledger_of(checkpoint: str) -> str:
    return f"{checkpoint}/ledger"


def run_profile(progress: DataFrame) -> DataFrame:
    """Latency of micro-batches and rows a second over all lines of a ledger, or a run's, and how many rows came too late."""
    sums = totals(progress).select("rows", F.try_divide("rows", "seconds").alias("rows_per_second"), F.col("late").alias("dropped_late"))
    return metrics.latency_profile(progress, "seconds").join(F.broadcast(sums))


def deduplicated_counts(delivered: DataFrame, unique: DataFrame, progress: DataFrame) -> DataFrame:
    """How many rows were delivered and are left, and how many of the others were repeats, and how many came too late."""
    left = unique.agg(F.count("*").alias("processed"))
    dropped = totals(progress).select(F.col("repeats").alias("duplicates"), F.col("late").alias("dropped_late"))
    return delivered.agg(F.count("*").alias("delivered")).join(F.broadcast(left)).join(F.broadcast(dropped))


#: Seconds of event time whose offsets are remembered together, and offsets of a page.
SLICE_S, PAGE = 300.0, 8192


class Deliveries(StatefulProcessor):
    """What becomes of each delivery of a row: ``new``, ``repeat``, or ``late``, which is at or before the watermark.

    The key is a service and a slice of event time. The state is a map from pages of offsets to bits of those seen, so a
    micro-batch reads the pages of its own rows only; once the watermark has passed a slice, all that may come for it is late,
    and its timer clears it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getMapState("seen", "page long", "bits binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            late, seq = pdf["at_ms"].to_numpy() <= mark, pdf["seq"].to_numpy()
            repeat = pdf["seq"].where(~late).duplicated().to_numpy() & ~late
            page, fresh = seq // PAGE, ~late & ~repeat
            for p in np.unique(page[fresh]).tolist():
                own = np.flatnonzero(fresh & (page == p))
                known = self.seen.getValue((p,))[0] if self.seen.containsKey((p,)) else bytes(PAGE // 8)
                bits = np.unpackbits(np.frombuffer(known, np.uint8))
                repeat[own] = bits[seq[own] % PAGE] > 0
                bits[seq[own] % PAGE] = 1
                self.seen.updateValue((p,), (np.packbits(bits).tobytes(),))
            yield pdf.drop(columns=["at_ms", "slice"]).assign(fate=np.where(late, "late", np.where(repeat, "repeat", "new")))
        end = int((key[1] + 1) * SLICE_S * 1000) + _START_MS
        if end > mark:
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def deliveries(events: DataFrame, late_s: float = 3600.0) -> DataFrame:
    """All rows of a stream of events, each with its ``fate``; the rows that are ``new`` are those that ``deduplicated`` leaves.

    A row is late if it is older than the newest row of the micro-batches before by ``late_s`` or more. The operator
    sees late rows because their event time is not handed to it as such.
    """
    timed = on_time(events, late_s).withColumn("at_ms", F.unix_millis("event_time")).drop("event_time")
    keyed = timed.withColumn("slice", F.floor(F.col("ts") / SLICE_S))
    schema = T.StructType([*events.schema.fields, T.StructField("fate", T.StringType())])
    return keyed.groupBy("service", "slice").transformWithStateInPandas(Deliveries(), schema, "append", "eventTime")


def fates(delivered: DataFrame) -> DataFrame:
    """Of rows with a fate: how many were delivered, processed, repeats and late."""
    count = lambda fate: F.count_if(F.col("fate") == fate)
    return delivered.agg(F.count("*").alias("delivered"), count("new").alias("processed"), count("repeat").alias("repeats"), count("late").alias("late"))


class DriftMonitor:
    """Judges each block of ``window`` rows in the order of their arrival as soon as it is full: for ``foreachBatch``.

    Rows are numbered as they arrive: within a micro-batch by seq, with ranks from sums over partitions, and after the rows of
    those before, whose number is carried. So rows that never come shift the blocks and leave none open. The rows of the
    one open block are carried with their numbers in a table of the batch, and tables before the last are deleted. A batch
    that is repeated after a failure starts from the same carried rows and overwrites its own tables. Rows come
    once each (``deduplicated``).
    """

    def __init__(self, reference: DataFrame, folder: str, metric: str = "latency_ms", window: int = C.DRIFT_WINDOW):
        self.judge, self.folder, self.metric, self.window = drift.Judge(reference, metric), folder, metric, window

    def observe(self, batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, f"seq long, {self.metric} double, place long"
        carried = spark.read.schema(schema).parquet(self._open(batch_id - 1)) if batch_id else spark.createDataFrame([], schema)
        with Scratch(spark) as tmp:
            # a row without a seq stands for how many came before
            before = carried.filter("seq is null").agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
            ranked = with_rank(batch.select("seq", F.col(self.metric).cast("double")), "seq", name="place", tmp=tmp)
            total = before + ranked.count()
            rows = carried.filter("seq is not null").unionByName(ranked.withColumn("place", F.col("place") + before))
            blocks, full = rows.withColumn("window_id", F.floor(F.col("place") / self.window)), total // self.window
            self.judge.windows(blocks.filter(F.col("window_id") < full), self.window, order="place").write.mode("overwrite").parquet(f"{self.folder}/judged/batch={batch_id}")
            count = spark.createDataFrame([(None, None, total)], schema)
            blocks.filter(F.col("window_id") >= full).drop("window_id").unionByName(count).write.mode("overwrite").parquet(self._open(batch_id))
        if batch_id > 1:
            delete(spark, self._open(batch_id - 2))

    def _open(self, batch_id: int) -> str:
        return f"{self.folder}/open/batch={batch_id}"

    def windows(self, spark: SparkSession) -> DataFrame:
        """The blocks judged so far."""
        return spark.read.schema(drift.JUDGED).option("recursiveFileLookup", "true").parquet(f"{self.folder}/judged")


def monitor(events: DataFrame, reference: DataFrame, folder: str, window: int = C.DRIFT_WINDOW) -> DataFrame:
    """Runs a drift monitor over a stream to its end and returns the blocks that it judged; called again, it goes on."""
    watch = DriftMonitor(reference, f"{folder}/blocks", window=window)
    events.writeStream.foreachBatch(watch.observe).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    try:
        return watch.windows(events.sparkSession)
    except AnalysisException:  # there was no batch
        return events.sparkSession.createDataFrame([], drift.JUDGED)


def subscribe(events: DataFrame, folder: str, groups: list[str]) -> dict[str, DataFrame]:
    """Independent subscribers of one stream, at the same time: each has its own checkpoint and sees all rows; returns when all have caught up."""
    with Subscribers(events.sparkSession, folder) as running:
        for name in groups:
            running.add(name, lambda: events)
        running.catch_up()
        return {name: running.rows(name) for name in groups}


def serve_decisions(features_: DataFrame, registry: Registry, folder: str, on_step: Callable[[str, int], None] | None = None) -> DataFrame:
    """Runs the decisions on a stream of features to its end, each micro-batch with the version that is live then; returns all rows decided so far.

    Called again, it goes on from its checkpoint with what the registry has, and trains nothing.
    """
    spark = features_.sparkSession
    version = registry.live()
    schema = decisions(features_, registry.load(version)).withColumn("version", F.lit(version)).schema
    sink = ManifestSink(spark, f"{folder}/decided", schema, on_step)
    writer = features_.writeStream.foreachBatch(serve(registry, decisions, sink.write)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    with Ledger(spark, ledger_of(f"{folder}/checkpoint")) as ledger:
        ledger.finish(ledger.start(writer))
    return sink.rows()
