"""Ledger, manifest sink, deliveries, drift by arrival, subscribers and the registry: restarts, failures and repeats."""

import dataclasses

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tripwire.functions import constants as C
from tripwire.operators import boosting, drift, models, reading, registry, splits
from tripwire.plans import fixtures, queries
from tripwire.sources import files
from tripwire.sources.sink import STEPS, ManifestSink
from tripwire.sources.storage import shared_folder
from tripwire.streaming import ledger, live

SMALL = "/root/testdata/sf0.001"


def log_of(spark, rows, folder, **options):
    rows.write.mode("append").parquet(f"{folder}/log")
    return spark.readStream.schema(rows.schema).options(**options).parquet(f"{folder}/log")


def numbers(spark, begin, end, parts=1):
    return spark.range(begin, end, 1, parts).withColumnRenamed("id", "seq")


def test_ledger_has_every_micro_batch_over_a_restart_and_packed(spark):
    folder = shared_folder(spark)
    at = live.ledger_of(f"{folder}/checkpoint")
    for begin, end, batches in ((0, 105, 105), (105, 120, 15)):  # a query itself remembers a hundred reports
        stream = log_of(spark, numbers(spark, begin, end, end - begin), folder, maxFilesPerTrigger="1")
        rows, own = live.run_with_progress(stream, f"{folder}/checkpoint", f"{folder}/rows")
        assert own.count() == batches and rows.count() == end
    for _ in range(2):
        told = ledger.lines(spark, at)
        assert told.count() == 120 and told.agg(F.sum("rows"), F.count_distinct("batch")).first()[:] == (120, 120)
        ledger.pack(spark, at)
    assert files.names(spark, f"{at}/lines") == [] and len(files.names(spark, f"{at}/packed")) == 1
    assert live.run_profile(ledger.lines(spark, at)).first()["n"] == 120
    assert ledger.totals(ledger.lines(spark, f"{folder}/none")).first()[:] == (0, 0, 0, 0, 0)


def test_a_batch_that_is_written_again_has_one_line(spark):
    folder = shared_folder(spark)
    for at, rows in ((5, 10), (9, 12)):
        files.write_json(spark, f"{folder}/lines/q-000000000003.json", {"query": "q", "label": "", "run": str(at), "batch": 3, "rows": rows, "seconds": 1.0, "late": 0, "repeats": 0, "at": at})
        ledger.pack(spark, folder)
    files.write_json(spark, f"{folder}/lines/q-000000000003.json", {"query": "q", "label": "", "run": "x", "batch": 3, "rows": 7, "seconds": 1.0, "late": 0, "repeats": 0, "at": 7})
    assert [r["rows"] for r in ledger.lines(spark, folder).collect()] == [12]  # the last that was written


@pytest.mark.parametrize("step", STEPS)
def test_sink_after_a_death_at_each_step(spark, step):
    folder = shared_folder(spark)
    stream = lambda: log_of(spark, numbers(spark, 0, 0), folder)
    numbers(spark, 0, 50).write.parquet(f"{folder}/log")
    deaths = [step]

    def die(at, batch):
        if deaths == [at]:
            deaths.clear()
            raise RuntimeError("killed")

    sink = ManifestSink(spark, f"{folder}/out", stream().schema, die)
    run = lambda: stream().writeStream.foreachBatch(sink.write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(StreamingQueryException):
        run()
    assert sink.rows().count() == (50 if step == "committed" else 0)
    run()
    assert sink.rows().count() == 50 and sink.rows().distinct().count() == 50
    assert sink.discard() == (1 if step == "staged" else 0) and sink.rows().count() == 50
    sink.write(numbers(spark, 0, 9), 0)  # a batch with a manifest is left as it is
    assert sink.rows().count() == 50


def test_sink_without_a_batch_is_empty(spark):
    assert ManifestSink(spark, shared_folder(spark), numbers(spark, 0, 1).schema).rows().count() == 0


def test_files_are_written_once_or_replaced(spark):
    at = f"{shared_folder(spark)}/a/b.json"
    assert files.write_json(spark, at, {"n": 1}, overwrite=False) and not files.write_json(spark, at, {"n": 2}, overwrite=False)
    assert files.read_json(spark, at) == {"n": 1} and files.write_json(spark, at, {"n": 3}) and files.read_json(spark, at) == {"n": 3}
    assert files.names(spark, at.rsplit("/", 1)[0]) == ["b.json"]


def test_deliveries_are_new_repeated_or_late(spark):
    live.rocks(spark)
    folder = shared_folder(spark)
    row = lambda seq, ts, service="a": (seq, float(ts), service, "v1", 1.0, 0.0, 1.0, 1.0, 1.0, "", None, 0)
    runs = [[row(1, 0), row(1, 0), row(2, 700), row(20_000, 710, "b")], [row(2, 700), row(3, 100), row(4, 650), row(20_000, 710, "b")], [row(5, 2000), row(1, 0)], [row(4, 650), row(6, 2001), row(5, 2000)]]
    expected = [{(1, "new"): 1, (1, "repeat"): 1, (2, "new"): 1, (20_000, "new"): 1}, {(2, "repeat"): 1, (3, "late"): 1, (4, "new"): 1, (20_000, "repeat"): 1}, {(5, "new"): 1, (1, "late"): 1}, {(4, "late"): 1, (6, "new"): 1, (5, "repeat"): 1}]
    total = {}
    for rows, more in zip(runs, expected, strict=True):
        told = live.run_to_end(live.deliveries(log_of(spark, spark.createDataFrame(rows, C.TELEMETRY), folder), late_s=300.0), f"{folder}/checkpoint", f"{folder}/rows")
        for key, n in more.items():
            total[key] = total.get(key, 0) + n
        assert {(r.seq, r.fate): r["count"] for r in told.groupBy("seq", "fate").count().collect()} == total
    counts = live.fates(told).first()
    assert counts.delivered == sum(map(len, runs)) == counts.processed + counts.repeats + counts.late


def test_blocks_are_of_the_rows_that_arrive(spark):
    t = fixtures.telemetry(spark, SMALL)
    rows, folder = t.filter("seq % 7 <> 3"), shared_folder(spark)
    watch = live.DriftMonitor(splits.healthy(t), folder, window=100)
    for k in range(5):
        watch.observe(rows.filter(f"seq div 200 = {k}"), k)
        if k in (0, 3):
            watch.observe(rows.filter(f"seq div 200 = {k}"), k)  # a batch that is repeated
    from pyspark.sql import Window

    dense = rows.withColumn("seq", F.row_number().over(Window.orderBy("seq")).cast("long") - 1)
    expected = drift.drift_windows(splits.healthy(t), dense, window=100).orderBy("window_id").collect()
    assert watch.windows(spark).orderBy("window_id").collect() == expected and len(expected) == rows.count() // 100


def test_registry_serves_what_is_live_without_training(spark, monkeypatch):
    t, folder = fixtures.telemetry(spark, SMALL), shared_folder(spark)
    fitted = dataclasses.replace(models.fit_all(t, trees=3, forest_trees=5), q=0.6)
    store = lambda: registry.Registry(spark, f"{folder}/registry")
    with pytest.raises(ValueError, match="no version"):
        store().promote("a")
    store().save(fitted, "a")
    boosted = boosting.train(splits.build_dataset(t), rounds=3)
    store().save(dataclasses.replace(fitted, classifier=boosted, q=1.0), "b")  # sets of all classes: every row is escalated
    with pytest.raises(ValueError, match="there already"):
        store().save(fitted, "a")
    with pytest.raises(ValueError, match="without an earlier"):
        store().rollback()
    monkeypatch.setattr(models, "fit_all", None)
    monkeypatch.setattr(models, "train_classifier", None)
    from tripwire.operators import features

    rows = features.features(t, keep=live.CARRIED).cache()
    for k, act in enumerate((lambda: store().promote("a"), lambda: store().promote("b"), lambda: store().rollback())):
        act()
        out = live.serve_decisions(log_of(spark, rows.filter(F.col("seq") % 3 == k), folder), store(), folder)
    assert {(r.version, r["count"]) for r in out.groupBy("version").count().collect()} == {("a", rows.filter("seq % 3 <> 1").count()), ("b", rows.filter("seq % 3 = 1").count())}
    assert out.filter("version = 'b' and action <> 'escalate'").isEmpty() and not out.filter("version = 'a' and action = 'act'").isEmpty()
    expected = live.decide(live.score(rows.filter("seq % 3 <> 1"), fitted), fitted).select("seq", "prediction", "action", "remediation")
    assert out.filter("version = 'a'").select(*expected.columns).exceptAll(expected).isEmpty()
    again = store().load("a")
    assert models.strangeness(again.forest, rows).select("seq", "flag").exceptAll(models.strangeness(fitted.forest, rows).select("seq", "flag")).isEmpty()
    assert store().audit().first()[:] == ("a", "b") and store().versions() == ["a", "b"]


def test_prompts_are_asked_once(spark, tmp_path):
    def reader(text):
        if text is None or "bad" in text:
            raise ConnectionError(text)
        return '{"incident": "memory_leak", "evidence": "", "explanation": ""}'

    asked = spark.createDataFrame([(k, f"question {k % 7}") for k in range(40)] + [(90, "bad one"), (91, None), (92, None)], "seq long, prompt string")
    rows = fixtures.telemetry(spark, SMALL).join(F.broadcast(asked), "seq")
    store = reading.VerdictStore(spark, shared_folder(spark))
    assert store.ask(rows.limit(0), reader) == 0 and store.rows().count() == 0
    assert store.ask(rows, reader, attempts=2, wait_s=0.0, block=1) == 9
    assert store.ask(rows, reader) == 0
    assert {r.calls for r in store.rows().filter("reader_error is null").collect()} == {1} and store.rows().agg(F.sum("calls")).first()[0] == 7 + 2 * 2
    verdicts = store.verdicts(rows, "stub")
    assert verdicts.count() == 43 and {r.seq for r in verdicts.filter("failed").collect()} == {90, 91, 92}
    assert store.ask(rows, lambda x: "{}", wait_s=0.0, again=True) == 2  # only those that failed
    assert store.verdicts(rows, "stub").filter("reader_error is not null").count() == 0 and store.last().count() == 9


def test_exactly_once_over_a_log_longer_than_its_watermark(spark, tmp_path):
    from tripwire.plans.queries import QUERIES

    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("event_id", F.col("event_id") * 60)  # a row each ten seconds
    events.write.parquet(f"{tmp_path}/events.parquet")
    n = events.count()
    told = QUERIES["stream_exactly_once"](spark, str(tmp_path)).first().asDict()
    assert told == {"processed": n, "distinct_offsets": n, "duplicates": 0, "lost": 0, "restarts": len(STEPS)}


def test_rounds_of_prompts_compute_them_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def costly(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    prompts = spark.range(90).select(F.concat(F.lit("p"), "id").alias("prompt")).mapInPandas(costly, "prompt string")
    store = reading.VerdictStore(spark, shared_folder(spark))
    assert store.ask(prompts, lambda x: x, block=4) == 90 and seen.value == 90
    assert store.rows().agg(F.count_distinct("reply")).first()[0] == 90 and store.ask(prompts, lambda x: x, block=4) == 0


@pytest.mark.parametrize("name", ["stream_features", "stream_late"])
def test_features_of_a_log_in_bounded_micro_batches(spark, monkeypatch, name):
    """What a long log gives in many appends is what it gives in one, and no micro-batch is larger than an append."""
    folders = []
    monkeypatch.setattr(queries, "shared_folder", lambda session: folders.append(shared_folder(session)) or folders[-1])
    whole = sorted(queries.QUERIES[name](spark, SMALL).collect())
    folders.clear()
    monkeypatch.setattr(live, "STEP_ROWS", 300, raising=False)
    assert sorted(queries.QUERIES[name](spark, SMALL).collect()) == whole
    told = ledger.lines(spark, live.ledger_of(f"{folders[0]}/checkpoint")).agg(F.max("rows"), F.sum("rows")).first()
    assert told[:] == (300, fixtures.telemetry(spark, SMALL).count())
