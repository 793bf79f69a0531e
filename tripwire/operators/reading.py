"""Readings of an external reader that are kept: each prompt is asked once, however often a job runs.

Verdicts are stored by a hash of their prompt. A run asks what is not stored yet, different prompts once each, in rounds; a round
asks at most ``block`` prompts a task, several at a time, and its replies are a table of the store before the next begins. So a
task that is lost costs the calls of one round at most, and a run that died goes on where its last round ended. A call that fails
is tried again after a wait that doubles; what failed to the end is stored as such and not asked again unless wanted.

Edge cases: a null prompt is asked like any other, once; rows keep all their columns, with the reply's beside; without rows nothing
is asked.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.functions import logs
from tripwire.sources import files
from tripwire.sources.storage import Scratch

STORED = "prompt_hash string, reply string, reader_error string, calls int"


def prompt_hash(prompt: str = "prompt") -> Column:
    return F.sha2(F.coalesce(F.concat(F.lit("p"), F.col(prompt)), F.lit("")), 256)


def _ask(reader: Callable[[str], str], text: str | None, attempts: int, wait_s: float) -> tuple[str, str | None, int]:
    """(reply, error, calls)."""
    error = None
    for call in range(1, attempts + 1):
        try:
            return reader(text), None, call
        except Exception as e:  # a reader may fail in any way
            error = type(e).__name__
            if call < attempts:
                time.sleep(wait_s * 2 ** (call - 1))
    return "", error, attempts


class VerdictStore:
    """Replies of a reader by prompt, in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(f"{self.folder}/replies")
        except AnalysisException:  # nothing was asked so far
            return self.spark.createDataFrame([], STORED)

    def ask(self, prompts: DataFrame, reader: Callable[[str], str], attempts: int = 3, wait_s: float = 0.5, at_once: int = 8, block: int = 2_000, again: bool = False) -> int:
        """Asks the prompts that are not stored, or with ``again`` also those that failed; returns how many it asked."""
        known = self.rows().filter("reader_error is null") if again else self.rows()
        wanted = prompts.select(prompt_hash().alias("prompt_hash"), "prompt").dropDuplicates(["prompt_hash"])
        tasks, asked = int(self.spark.conf.get("spark.sql.shuffle.partitions")), 0

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(at_once) as pool:
                for pdf in batches:
                    texts = [None if x is None or x != x else x for x in pdf["prompt"].to_numpy(object)]
                    done = list(pool.map(lambda x: _ask(reader, x, attempts, wait_s), texts))
                    yield pd.DataFrame({"prompt_hash": pdf["prompt_hash"].to_numpy(object), **{c: [x[k] for x in done] for k, c in enumerate(("reply", "reader_error", "calls"))}})

        first = len(files.names(self.spark, f"{self.folder}/replies"))
        with Scratch(self.spark) as tmp:
            left = tmp.stored(wanted.join(known.select("prompt_hash"), "prompt_hash", "left_anti").withColumn("round", F.pmod(F.xxhash64("prompt_hash"), F.lit(1 << 30))))
            rounds = -(-left.count() // (tasks * block))
            if rounds:  # rounds are shares of the hashes; they are dealt once, so a round reads its own prompts only
                left.withColumn("round", F.col("round") % rounds).repartition("round").write.partitionBy("round").parquet(f"{tmp.folder}/rounds")
            for k in range(rounds):
                dealt = self.spark.read.schema("prompt_hash string, prompt string, round long").parquet(f"{tmp.folder}/rounds")
                part = dealt.filter(F.col("round") == k).drop("round").repartition(tasks, "prompt_hash")
                path = f"{self.folder}/replies/{first + k:06d}"
                part.mapInPandas(run, STORED).write.mode("overwrite").parquet(path)
                asked += self.spark.read.schema(STORED).parquet(path).count()
        return asked

    def last(self) -> DataFrame:
        """One row for each prompt: a reply if any was had, else the failure; with the calls that it took in all."""
        best = F.max_by(F.struct("reply", "reader_error"), F.col("reader_error").isNull())
        return self.rows().groupBy("prompt_hash").agg(best.alias("best"), F.sum("calls").alias("calls")).select("prompt_hash", "best.*", "calls")

    def verdicts(self, events: DataFrame, source: str) -> DataFrame:
        """Verdicts on the rows whose prompts are stored."""
        joined = events.withColumn("prompt_hash", prompt_hash()).join(self.last().drop("calls"), "prompt_hash")
        return logs.verdicts(joined.drop("prompt_hash"), source)
