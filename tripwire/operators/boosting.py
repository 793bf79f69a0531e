"""Gradient-boosted trees for several classes, grown on histograms by all tasks (Friedman, 2001; softmax loss, leaves by second order).

Features are cut into bins at quantiles of a draw of about ``DRAWN`` rows. The binned rows are written once. One pass over
them grows one level of a round's trees, of all classes together: a task adds up slopes, curvatures and rows by (class,
node, feature, bin), Spark adds up the tasks' cells, and the driver, which gets those cells only (their number depends on
classes, depth, features and bins), picks the splits. Slopes are added as integers, so trees are the same however
rows are dealt. Every ``REFRESH`` rounds the rows are written with their scores, so a pass replays few trees, and a
lost executor costs its tasks of one pass.

Edge cases: rows without a class are left out; a null or NaN feature counts as larger than every number; a class that has
no rows isn't known to the model; with one class p is 1; no rows at all are an error. Repeated rows count as often as they
come. Of columns ``p`` and ``prediction`` that are there before, the model's stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.functions import conformal
from tripwire.functions import constants as C
from tripwire.operators import metrics
from tripwire.sources.storage import Scratch

#: Rows that bins are cut by, on average; bins of a feature; rounds after which scores are written.
DRAWN, BINS, REFRESH = 100_000, 64, 5
#: Slopes and curvatures are added in units of 1 / _UNIT.
_UNIT = float(1 << 20)
_BINNED = "target int, weight double, bins binary, scores binary"
_CELLS = "cell long, slope long, curve long, n long"


@dataclass
class Round:
    """A tree for each class, as heaps: the children of node i are 2i + 1 and 2i + 2; feature -1 ends a path."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, classes: int, depth: int) -> Round:
        size = (classes, 2 ** (depth + 1) - 1)
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))

    def nodes(self, k: int, bins: np.ndarray) -> np.ndarray:
        """Where each row ends in the tree of class k, as far as it has grown."""
        node, every, feature, cut = np.zeros(len(bins), np.int64), np.arange(len(bins)), self.feature[k], self.cut[k]
        while (inner := feature[node] >= 0).any():
            node = np.where(inner, 2 * node + 1 + (bins[every, np.maximum(feature[node], 0)] > cut[node]), node)
        return node

    def add(self, scores: np.ndarray, bins: np.ndarray) -> None:
        """Adds to the scores what the grown trees give; their paths are led to the lowest level, so all rows take as many steps."""
        flat, row, levels = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1], self.feature.shape[1].bit_length() - 1
        for k in range(scores.shape[1]):
            feature, cut, value = self.feature[k].copy(), self.cut[k], self.value[k].copy()
            for i in range(len(feature) // 2):
                if feature[i] < 0:
                    feature[i], value[2 * i + 1], value[2 * i + 2] = 0, value[i], value[i]
                    feature[2 * i + 1] = feature[2 * i + 2] = -1
            node = np.zeros(len(bins), np.int64)
            for _ in range(levels):
                node += node + 1 + (flat.take(row + feature.take(node)) > cut.take(node))
            scores[:, k] += value.take(node)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Boosted:
    classes: list[str]
    columns: list[str]
    edges: list[np.ndarray]
    rounds: list[Round] = field(default_factory=list)
    gain: np.ndarray | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The number of edges under each value."""
        return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins, scores = self.bins(x), np.zeros((len(x), len(self.classes)))
        for trees in self.rounds:
            trees.add(scores, bins)
        return softmax(scores)


def _numbers(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A column of byte strings that each hold ``width`` numbers."""
    if not len(column):
        return np.zeros((0, width), kind)
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    begin = int(np.frombuffer(offsets, np.int64, 1, column.offset * 8)[0])
    return np.frombuffer(data, kind, len(column) * width, begin).reshape(-1, width)


def _bytes(matrix: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in matrix], pa.binary())


def edges_of(rows: DataFrame, columns: list[str], key: str = "seq", seed: int = 0, drawn: int = DRAWN, bins: int = BINS) -> list[np.ndarray]:
    """Where to cut each feature: between bins of about equally many rows, of the rows that a hash of the key draws."""
    n = rows.count()
    share = int(min(1.0, drawn / max(n, 1)) * (1 << 30))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < share).select(*(F.col(c).cast("double").alias(c) for c in columns)).toArrow()
    out = []
    for c in columns:
        values = sample[c].to_numpy()
        values = np.sort(values[np.isfinite(values)])
        at = values[(np.arange(1, bins) * len(values)) // bins] if len(values) else values
        out.append(np.unique(at))
    return out


def _level(table: DataFrame, since: list[Round], trees: Round, level: int, shape: tuple[int, ...]) -> np.ndarray:
    """Slopes, curvatures and rows by class, node of the level, feature and bin."""
    classes, nodes, features, bins = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, int(np.prod(shape))), np.int64)
        for batch in batches:
            target, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            binned, scores = _matrix(batch.column(2), "u1", features), _matrix(batch.column(3), "<f8", classes).copy()
            for earlier in since:
                earlier.add(scores, binned)
            p = softmax(scores) if len(scores) else scores
            for k in range(classes):
                node = trees.nodes(k, binned) - (2**level - 1)
                here = node >= 0
                first, own = (k * nodes + node[here]) * features * bins, binned[here]
                slope = np.rint((p[here, k] - (target[here] == k)) * weight[here] * _UNIT)
                curve = np.rint(p[here, k] * (1 - p[here, k]) * weight[here] * _UNIT)
                for f in range(features):
                    cell = first + (f * bins + own[:, f].astype(np.int64))
                    for total, x in zip(sums, (slope, curve, None), strict=True):  # whole numbers under 2^53: exact
                        total += np.bincount(cell, x, sums.shape[1]).astype(np.int64)
        at = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in sums)], names=["cell", "slope", "curve", "n"])

    cells = table.mapInArrow(run, _CELLS).groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("slope", "curve", "n"))).toArrow()
    out = np.zeros((3, int(np.prod(shape))), np.int64)
    for total, c in zip(out, ("slope", "curve", "n"), strict=True):
        total[cells["cell"].to_numpy()] = cells[c].to_numpy()
    return out.reshape(3, *shape)


def _split(trees: Round, sums: np.ndarray, level: int, rate: float, least: int, ridge: float, gain: np.ndarray) -> bool:
    """Splits the nodes of a level where it pays; whether any was."""
    units = (_UNIT, _UNIT, 1)
    running = sums.cumsum(4)  # in integers, so every feature has the same totals
    left = [x[..., :-1] / u for x, u in zip(running, units, strict=True)]
    right = [(x[..., -1:] - x[..., :-1]) / u for x, u in zip(running, units, strict=True)]
    own = (running[0][..., -1:] / _UNIT) ** 2 / (running[1][..., -1:] / _UNIT + ridge)
    better = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - own
    better[(left[2] < least) | (right[2] < least)] = -np.inf
    classes, nodes, _, cuts = better.shape
    best = better.reshape(classes, nodes, -1).argmax(2)
    grew = False
    for k in range(classes):
        for i in range(nodes):
            f, b = divmod(int(best[k, i]), cuts)
            if better[k, i, f, b] > 1e-9:
                node, grew = 2**level - 1 + i, True
                trees.feature[k, node], trees.cut[k, node] = f, b
                gain[f] += better[k, i, f, b]
                for child, side in ((2 * node + 1, left), (2 * node + 2, right)):
                    trees.value[k, child] = -rate * side[0][k, i, f, b] / (side[1][k, i, f, b] + ridge)
    return grew


def train(rows: DataFrame, rounds: int = 40, depth: int = 3, rate: float = 0.1, least: int = 20, ridge: float = 5.0, columns: list[str] | None = None, target: str = "y", key: str = "seq", seed: int = 0) -> Boosted:
    """Trees over ``columns`` for the classes of ``target``, weighted to balance; ``least`` rows on each side of a cut."""
    spark, columns = rows.sparkSession, columns or C.FEATURES
    with Scratch(spark) as tmp:
        known = tmp.stored(rows.filter(F.col(target).isNotNull()).select(F.col(target).alias("_class"), F.col(key).alias("_key"), *columns))
        return _train(known, rounds, depth, rate, least, ridge, columns, seed)


def _train(known: DataFrame, rounds: int, depth: int, rate: float, least: int, ridge: float, columns: list[str], seed: int) -> Boosted:
    spark = known.sparkSession
    weights = {r["_class"]: r["weight"] for r in metrics.class_weights(known, "_class").collect()}
    if not weights:
        raise ValueError("trees need rows with a class")
    classes = sorted(weights)
    model = Boosted(classes, columns, edges_of(known, columns, "_key", seed), gain=np.zeros(len(columns)))
    number, balance = {c: k for k, c in enumerate(classes)}, np.array([weights[c] for c in classes])
    features, bins = len(columns), max(len(e) for e in model.edges) + 1

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([number[c] for c in batch.column("_class").to_pylist()], np.int32)
            scores = pa.array([bytes(8 * len(classes))] * len(which), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(balance[which]), _bytes(model.bins(_numbers(batch, columns))), scores], names=["target", "weight", "bins", "scores"])

    def scored(since: list[Round]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, scores = _matrix(batch.column(2), "u1", features), _matrix(batch.column(3), "<f8", len(classes)).copy()
                for trees in since:
                    trees.add(scores, own)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _bytes(scores)], names=batch.schema.names)

        return run

    with Scratch(spark) as scratch:
        table, since = scratch.stored(known.mapInArrow(binned, _BINNED)), []
        for _ in range(rounds):
            trees = Round.empty(len(classes), depth)
            for level in range(depth):
                if not _split(trees, _level(table, since, trees, level, (len(classes), 2**level, features, bins)), level, rate, least, ridge, model.gain):
                    break
            if not (trees.feature >= 0).any():
                break
            model.rounds.append(trees)
            since.append(trees)
            if len(since) == REFRESH and len(model.rounds) < rounds:
                before, table = table, scratch.stored(table.mapInArrow(scored(since), _BINNED))
                scratch.drop(before)
                since = []
    return model


def classify(model: Boosted, rows: DataFrame) -> DataFrame:
    """``rows`` with p (in the order of the model's classes) and prediction."""
    rows = rows.drop("p", "prediction")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities(_numbers(batch, shared.value.columns)) if batch.num_rows else np.zeros((0, len(shared.value.classes)))
            offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], names=[*batch.schema.names, "p"])

    scored = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))]))
    return scored.withColumn("prediction", conformal.argmax_class(model.classes))


def importances(model: Boosted) -> list[tuple[str, float]]:
    """Each feature's share of what the splits gained."""
    total = model.gain.sum()
    return [(c, float(g / total) if total else 0.0) for c, g in zip(model.columns, model.gain, strict=True)]


_TREES = "round int, class int, feature array<bigint>, cut array<bigint>, value array<double>"
_SHAPE = "number int, column string, edges array<double>, gain double, classes array<string>"


def save(spark: SparkSession, model: Boosted, folder: str) -> None:
    """The trees and the bins as two small tables."""
    trees = [(r, k, t.feature[k].tolist(), t.cut[k].tolist(), t.value[k].tolist()) for r, t in enumerate(model.rounds) for k in range(len(model.classes))]
    shape = [(k, c, e.tolist(), float(g), model.classes) for k, (c, e, g) in enumerate(zip(model.columns, model.edges, model.gain, strict=True))]
    spark.createDataFrame(trees, _TREES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/trees")
    spark.createDataFrame(shape, _SHAPE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/shape")


def load(spark: SparkSession, folder: str) -> Boosted:
    shape = spark.read.schema(_SHAPE).parquet(f"{folder}/shape").orderBy("number").collect()
    model = Boosted(list(shape[0]["classes"]), [r["column"] for r in shape], [np.array(r["edges"], float) for r in shape], gain=np.array([r["gain"] for r in shape]))
    by_round: dict[int, list] = {}
    for r in spark.read.schema(_TREES).parquet(f"{folder}/trees").orderBy("round", "class").collect():
        by_round.setdefault(r["round"], []).append(r)
    model.rounds = [Round(*(np.array([t[c] for t in trees]) for c in ("feature", "cut", "value"))) for trees in by_round.values()]
    return model
