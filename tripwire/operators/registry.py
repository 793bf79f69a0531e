"""Versions of everything that the live pipeline needs, and which of them is live.

A version is a folder: Spark ML models, the forest's trees and the reference as tables, and a file of numbers that is written
last, so a version without it doesn't count. Which version is live is told by a log of releases, a file for each promotion or
rollback; whoever writes first takes a number of the log. A stream asks before each micro-batch, so a release
takes effect from the next one on, and a restart trains nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.operators import boosting, drift
from tripwire.operators.models import Fitted, IsolationForest
from tripwire.sources import files

_TREES = "tree int, feature array<bigint>, value array<double>, depth array<double>"


class Registry:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.loaded: tuple[str, Fitted] | None = None

    def save(self, fitted: Fitted, version: str) -> None:
        """Saves a version under a name that isn't taken."""
        if version in self.versions():
            raise ValueError(f"version {version} is there already")
        at = f"{self.folder}/versions/{version}"
        boosted = isinstance(fitted.classifier, boosting.Boosted)
        if boosted:
            boosting.save(self.spark, fitted.classifier, f"{at}/boosted")
        else:
            fitted.classifier.write().overwrite().save(f"{at}/classifier")
        for action, model in fitted.outcomes.items():
            model.write().overwrite().save(f"{at}/outcomes/{action}")
        trees = [(k, *(x.tolist() for x in tree)) for k, tree in enumerate(fitted.forest.trees)]
        self.spark.createDataFrame(trees, _TREES).coalesce(1).write.mode("overwrite").parquet(f"{at}/forest")
        fitted.reference.write.mode("overwrite").parquet(f"{at}/reference")
        numbers = {"boosted": boosted, "q": float(fitted.q), "sample": int(fitted.forest.sample), "cut": float(fitted.forest.cut), "actions": [*fitted.outcomes], "reference": fitted.reference.schema.json()}
        files.write_json(self.spark, f"{at}/version.json", numbers)

    def versions(self) -> list[str]:
        at = f"{self.folder}/versions"
        return [x for x in files.names(self.spark, at) if files.exists(self.spark, f"{at}/{x}/version.json")]

    def load(self, version: str) -> Fitted:
        if self.loaded and self.loaded[0] == version:
            return self.loaded[1]
        at = f"{self.folder}/versions/{version}"
        numbers = files.read_json(self.spark, f"{at}/version.json")
        trees = self.spark.read.schema(_TREES).parquet(f"{at}/forest").orderBy("tree").collect()
        forest = IsolationForest([(np.array(r["feature"]), np.array(r["value"]), np.array(r["depth"])) for r in trees], numbers["sample"], numbers["cut"])
        outcomes = {a: PipelineModel.load(f"{at}/outcomes/{a}") for a in numbers["actions"]}
        classifier = boosting.load(self.spark, f"{at}/boosted") if numbers.get("boosted") else PipelineModel.load(f"{at}/classifier")
        fitted = Fitted(classifier, forest, numbers["q"], outcomes, self.spark.read.parquet(f"{at}/reference"))
        self.loaded = (version, fitted)
        return fitted

    def promote(self, version: str) -> None:
        """Puts a saved version live; the one that was live can be rolled back to."""
        if version not in self.versions():
            raise ValueError(f"there is no version {version}")
        self._release({"action": "promote", "model": version})

    def rollback(self) -> None:
        """Puts the version before live again; an error if there is none."""
        if self._state()["previous"] is None:
            raise ValueError("rollback without an earlier model")
        self._release({"action": "rollback", "model": None})

    def live(self) -> str | None:
        """The name of the live version."""
        return self._state()["live"]

    def _release(self, entry: dict) -> None:
        while True:
            n = len(files.names(self.spark, f"{self.folder}/releases"))
            if files.write_json(self.spark, f"{self.folder}/releases/{n:09d}.json", {"n": n, **entry}, overwrite=False):
                return

    def _state(self) -> dict[str, str | None]:
        """live and previous after all releases."""
        state: dict[str, str | None] = {"live": None, "previous": None}
        for x in files.names(self.spark, f"{self.folder}/releases"):  # a release is a person's act: there are few
            entry = files.read_json(self.spark, f"{self.folder}/releases/{x}")
            state = {"live": entry["model"] if entry["action"] == "promote" else state["previous"], "previous": state["live"]}
        return state

    def log(self) -> DataFrame:
        """The releases as a table, for ``drift.releases``."""
        return self.spark.read.schema("n long, action string, model string").json(f"{self.folder}/releases")

    def audit(self) -> DataFrame:
        """(live, previous) as the release log gives them."""
        return drift.releases(self.log())


def serve(registry: Registry, decide: Callable[[DataFrame, Fitted], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: decides on a batch with the version that is live as it begins, and writes the rows with its name."""

    def run(batch: DataFrame, batch_id: int) -> None:
        version = registry.live()
        if version is None:
            raise ValueError("no version is live")
        write(decide(batch, registry.load(version)).withColumn("version", F.lit(version)), batch_id)

    return run
