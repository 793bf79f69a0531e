"""Models: the incident classifier, an isolation forest, per-action outcome models, and training them all."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.functions import conformal
from tripwire.functions import constants as C
from tripwire.operators import boosting, decision, metrics, splits
from tripwire.operators.boosting import Boosted
from tripwire.operators.ranks import linear_quantiles
from tripwire.sources.storage import Scratch, stored


#: Rows of a partition of training rows, about: a fit runs hundreds of short jobs, and small partitions cost more than their rows.
_PART_ROWS = 25_000


def _settled(rows: DataFrame, n: int) -> DataFrame:
    """About ``n`` rows laid out the same way each time: bagging depends on it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(parts, -(-n // _PART_ROWS))), "seq").sortWithinPartitions("seq")


def train_classifier(rows: DataFrame, trees: int = 60, depth: int = 8, seed: int = 0) -> PipelineModel:
    """A random forest over the eight features, classes weighted to balance.

    A fit passes over its rows several times, so what they are computed from is computed once before.
    """
    with Scratch(rows.sparkSession) as tmp:
        own = tmp.stored(rows.select("seq", "y", *C.FEATURES))
        weighted = _settled(own.join(F.broadcast(metrics.class_weights(own)), "y"), own.count())
        return Pipeline(stages=[
            StringIndexer(inputCol="y", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="keep"),
            VectorAssembler(inputCols=C.FEATURES, outputCol="vector"),
            RandomForestClassifier(featuresCol="vector", labelCol="target", weightCol="weight", predictionCol="index", numTrees=trees, maxDepth=depth, seed=seed),
        ]).fit(weighted)


def classes_of(model: PipelineModel | Boosted) -> list[str]:
    return model.classes if isinstance(model, Boosted) else list(model.stages[0].labels)


def classify(model: PipelineModel | Boosted, rows: DataFrame) -> DataFrame:
    """``rows`` with p (in the order of the model's classes) and prediction."""
    if isinstance(model, Boosted):
        return boosting.classify(model, rows)
    classes = classes_of(model)
    named = rows if "y" in rows.columns else rows.withColumn("y", F.lit(None).cast("string"))
    scored = model.transform(named).withColumn("p", F.slice(vector_to_array("probability"), 1, len(classes)))
    return scored.withColumn("prediction", conformal.argmax_class(classes)).drop("target", "vector", "rawPrediction", "probability", "index", *(["y"] if "y" not in rows.columns else []))


def importances(model: PipelineModel | Boosted, rows: DataFrame) -> DataFrame:
    """Each feature's share of what the splits gained, largest first."""
    values = boosting.importances(model) if isinstance(model, Boosted) else list(zip(C.FEATURES, model.stages[-1].featureImportances.toArray().tolist(), strict=True))
    return rows.sparkSession.createDataFrame(values, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@dataclass
class IsolationForest:
    """Small random trees; rows that they isolate early are strange (Liu, Ting and Zhou, 2008)."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by node: split feature or -1, split value, depth plus what is left below
    sample: int
    cut: float = 1.0

    @staticmethod
    def _rest(n: int) -> float:
        """Mean depth of an unsuccessful search among n rows."""
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @classmethod
    def grow(cls, x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A tree as a heap: the children of node i are 2i + 1 and 2i + 2."""
        rng, limit = np.random.default_rng(seed), int(np.ceil(np.log2(max(len(x), 2))))
        size = 2 ** (limit + 1) - 1
        feature, value, depth = np.full(size, -1), np.zeros(size), np.zeros(size)
        todo = [(0, x, 0)]
        while todo:
            node, rows, d = todo.pop()
            wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
            if d >= limit or not len(wide):
                depth[node] = d + cls._rest(len(rows))
                continue
            f = int(rng.choice(wide))
            v = rng.uniform(rows[:, f].min(), rows[:, f].max())
            feature[node], value[node] = f, v
            left = rows[:, f] < v
            todo += [(2 * node + 1, rows[left], d + 1), (2 * node + 2, rows[~left], d + 1)]
        return feature, value, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher for stranger rows."""
        total = np.zeros(len(x))
        filled = [self._filled(*tree) for tree in self.trees]
        for lo in range(0, len(x), _BLOCK):  # so many rows that what a level works on stays in the cache
            block = np.ascontiguousarray(x[lo : lo + _BLOCK]).ravel()
            row = np.arange(0, len(block), x.shape[1])
            for levels, feature, value, depth in filled:
                node = np.zeros(len(row), np.int64)
                for _ in range(levels):
                    node += node + 1 + (block.take(row + feature.take(node)) >= value.take(node))
                total[lo : lo + len(row)] += depth.take(node)
        return 2.0 ** (-total / max(len(self.trees), 1) / max(self._rest(self.sample), 1e-9))

    @staticmethod
    def _filled(feature: np.ndarray, value: np.ndarray, depth: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(levels, feature, value, depth) of a tree whose paths all end at the lowest level, with the same depth for every row."""
        levels, feature, depth = len(feature).bit_length() - 1, feature.copy(), depth.copy()
        for node in range(len(feature) // 2):
            if feature[node] < 0:  # a leaf: both ways lead to its depth
                feature[node], depth[2 * node + 1], depth[2 * node + 2] = 0, depth[node], depth[node]
                feature[2 * node + 1] = feature[2 * node + 2] = -1
        return levels, feature, value, depth


#: Rows that are scored together.
_BLOCK = 4096


def fit_forest(rows: DataFrame, trees: int = 200, sample: int = 256, contamination: float = 0.02, seed: int = 0, columns: list[str] | None = None) -> IsolationForest:
    """Trees grown on the executors, each from about ``sample`` rows that a hash picks for it; only the trees come to the driver."""
    columns = columns or C.ANOMALY_FEATURES
    with Scratch(rows.sparkSession) as tmp:
        own = tmp.stored(rows.select("seq", *columns))
        forest = grow_forest(own, trees, sample, seed, columns)
        forest.cut = linear_quantiles(strangeness(forest, own, columns), "strangeness", [1 - contamination])[0]
    return forest


def grow_forest(rows: DataFrame, trees: int, sample: int, seed: int, columns: list[str]) -> IsolationForest:
    """A forest without its cut; its rows are read twice."""
    n = rows.count()
    if not n:
        raise ValueError("a detector needs rows without an incident")
    # a row is in tree t with probability sample / n: it draws how many trees, then which, by hashes
    share = min(1.0, sample / n)
    drawn = rows.select("seq", *columns, F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, "seq"), F.lit(1 << 30)) < int(share * (1 << 30)))).alias("tree"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        f, v, d = IsolationForest.grow(pdf[columns].to_numpy(float), seed * 100_003 + int(key[0]))
        return pd.DataFrame({"tree": [int(key[0])], "feature": [f.tolist()], "value": [v.tolist()], "depth": [d.tolist()]})

    grown = drawn.groupBy("tree").applyInPandas(run, "tree int, feature array<long>, value array<double>, depth array<double>").orderBy("tree").collect()
    return IsolationForest([(np.array(r["feature"]), np.array(r["value"]), np.array(r["depth"])) for r in grown], min(sample, n))


def detect(rows: DataFrame, normal: Column, trees: int = 200, sample: int = 256, contamination: float = 0.02, seed: int = 0) -> DataFrame:
    """``rows`` with the strangeness and flag of a forest fitted on those of them that are ``normal``; each row is computed and scored once.

    The scored rows are a table that stays.
    """
    with Scratch(rows.sparkSession) as tmp:
        own = tmp.stored(rows)
        forest = grow_forest(own.filter(normal), trees, sample, seed, C.ANOMALY_FEATURES)
        scored = stored(strangeness(forest, own).drop("flag"))
    cut = linear_quantiles(scored.filter(normal), "strangeness", [1 - contamination])[0]
    return scored.withColumn("flag", F.col("strangeness") > cut)


def strangeness(forest: IsolationForest, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``rows`` with strangeness and flag."""
    columns, shared = columns or C.ANOMALY_FEATURES, rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = shared.value.score(pdf[columns].to_numpy(float))
            yield pdf.assign(strangeness=score, flag=score > shared.value.cut)

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("strangeness", T.DoubleType()), T.StructField("flag", T.BooleanType())]))


def fit_outcomes(rows: DataFrame, least: int = 20, trees: int = 20, seed: int = 0) -> dict[str, PipelineModel]:
    """One regression of the outcome per action (rows: seq, features, action, outcome); small arms have none."""
    with Scratch(rows.sparkSession) as tmp:
        own = tmp.stored(rows.select("seq", *C.FEATURES, "action", "outcome"))
        arms = {r["action"]: r["n"] for r in own.groupBy("action").agg(F.count("*").alias("n")).collect()}
        if arms.get("none", 0) < least:
            raise ValueError("outcome models need rows with the action none")
        wanted = [action for action in C.ACTIONS if arms.get(action, 0) >= least]

        def fit(action: str) -> PipelineModel:
            stages = [VectorAssembler(inputCols=C.FEATURES, outputCol="vector"), GBTRegressor(featuresCol="vector", labelCol="outcome", predictionCol=f"outcome_{action}", maxIter=trees, maxDepth=4, seed=seed)]
            return Pipeline(stages=stages).fit(_settled(own.filter(F.col("action") == action), arms[action]))

        with ThreadPoolExecutor(len(wanted)) as pool:  # arms are fitted side by side
            return dict(zip(wanted, pool.map(inheritable_thread_target(own.sparkSession)(fit), wanted), strict=True))


def effects(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """``rows`` with effects: per action, the outcome expected without it less the one with it."""
    scored = rows
    for model in models.values():
        scored = model.transform(scored).drop("vector")
    base = F.col("outcome_none")
    own = {a: (base - F.col(f"outcome_{a}") if a != "none" else F.lit(0.0)) for a in models}
    return scored.withColumn("effects", decision.effects_array(own)).drop(*(f"outcome_{a}" for a in models))


@dataclass
class Fitted:
    classifier: PipelineModel | Boosted
    forest: IsolationForest
    q: float
    outcomes: dict[str, PipelineModel]
    reference: DataFrame


def fit_all(events: DataFrame, alpha: float = C.ALPHA, seed: int = 0, trees: int = 60, forest_trees: int = 200, boosted: bool = False) -> Fitted:
    """Everything that the live pipeline needs, from one stream of events; with ``boosted``, ``trees`` is the number of rounds."""
    with Scratch(events.sparkSession) as tmp:
        rows = tmp.stored(splits.build_dataset(events))
        train, calibration = splits.random_split(rows, 0.3, seed)
        splits.require_classes(calibration, train, "calibration", "training")
        classifier = boosting.train(train, trees, seed=seed) if boosted else train_classifier(train, trees, seed=seed)
        q = conformal.qhat(_padded(classify(classifier, calibration), classes_of(classifier)), alpha)
        healthy = splits.healthy(events)
        forest = fit_forest(rows.join(healthy.select("seq"), "seq"), forest_trees, seed=seed)
        logged = decision.experiment(events, seed=seed).select("seq", "action", "outcome")
        outcomes = fit_outcomes(rows.join(logged, "seq"), seed=seed)
    return Fitted(classifier, forest, q, outcomes, healthy.select("seq", "latency_ms"))


def _padded(scored: DataFrame, classes: list[str]) -> DataFrame:
    """p in the order of all classes, 0 for those the model doesn't know."""
    return scored.withColumn("p", F.array(*(F.element_at("p", classes.index(c) + 1) if c in classes else F.lit(0.0) for c in C.CLASSES)))

