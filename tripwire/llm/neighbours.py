"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

Nearness is the inner product. Centroids and residual codebooks are k-means fits on a sample of at most about
``SAMPLE`` vectors, chosen by a hash of the id; the number of lists to probe is the least that finds
``TARGET`` of the true neighbours among the sample itself. Every vector is in the index. A list is cut into blocks, and
the queries that probe it too, so a task holds a bounded number of each, whatever the size of a list. In a block the
asymmetric tables rank the codes; the best ``RERANK``, and all that come as near to the last of these as codes err, are
scored exactly, in double precision on the original vectors, and a query's blocks are merged by (score, smaller id).
So of many near copies, whose codes say little about their order, none is left out.

Work: a query meets the vectors of the lists that it probes. Where vectors have no clusters, recall needs a fixed share of the
lists, so with a fixed share of vectors as queries, comparisons grow with the square of the table. What is shuffled is
that divided by the block: a vector is sent once per ``BLOCK_QUERIES`` queries of its list, a query once per ``BLOCK_VECTORS``
vectors.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, as queries or candidates; equal vectors are ranked by id; with no more than ``k`` candidates all are returned,
since lists are probed until they hold enough; rows that repeat a vec_id are candidates of their own, but not of
the query with that id; null ids take no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwire.llm.batches import release
from tripwire.sources.storage import Scratch, stored

SAMPLE, TARGET = 20_000, 0.97
#: Subspaces and codes of each, vectors of the sample, drawn by a fixed shuffle, that the codes are fitted on, and codes reranked.
SUBSPACES, CODES, CODED, RERANK = 16, 256, 8192, 100
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 32_768
#: How far below the last reranked code another may be, in standard deviations of what codes err by.
MARGIN = 2.0
#: Exact scores that are worked out at once.
_PAIRS = 100_000


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the closest centre (least squares) of each row."""
    norms = (centres**2).sum(1)
    return np.concatenate([np.argmin(norms - 2 * part @ centres.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """At most k centres."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    """Centroids, the codebook of each subspace, how many lists a query probes, and what codes err by in a component."""

    centres: np.ndarray
    codebooks: list[np.ndarray]
    cuts: np.ndarray
    probes: int
    error: float

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, k: int, target: float = TARGET) -> Index:
        centres = k_means(sample, lists)
        residuals = sample - centres[_nearest(sample, centres)]
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        drawn = np.random.default_rng(8).permutation(len(residuals))[:CODED]
        codebooks = [k_means(residuals[drawn, a:b], CODES, 6) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        queries = sample[:: max(1, len(sample) // 200)]
        near = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, : k + 1]
        home = _nearest(sample, centres)
        rank = np.argsort(np.argsort(-(queries @ centres.T), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(rank, home[near], 1).ravel()) + 1
        probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))])
        wrong = [part - book[_nearest(part, book)] for part, book in ((residuals[:, a:b], book) for a, b, book in zip(cuts[:-1], cuts[1:], codebooks, strict=True))]
        return cls(centres, codebooks, cuts, probes, float(np.sqrt(np.mean(np.concatenate(wrong, axis=1) ** 2))))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each vector."""
        home = _nearest(x, self.centres)
        rest = x - self.centres[home]
        codes = [_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.codebooks, strict=True)]
        return home, np.stack(codes, 1).astype(np.uint8)

    def probed(self, queries: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
        """The lists that each query probes: ``probes`` of them, or as many as it takes to hold k others."""
        order = np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")
        enough = (np.cumsum(sizes[order], axis=1) < k + 1).sum(1) + 1
        return [row[: max(self.probes, n)] for row, n in zip(order, enough, strict=True)]

    def best(self, queries: np.ndarray, home: int, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) pairs of the n best codes of one list by asymmetric tables, and of those too near to tell."""
        scores = np.repeat((queries @ self.centres[home])[:, None], len(codes), axis=1).astype(np.float32)
        for m, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            scores += (queries[:, a:b] @ self.codebooks[m].T).astype(np.float32)[:, codes[:, m]]
        if n >= len(codes):
            return np.nonzero(np.ones(scores.shape, bool))
        least = np.partition(scores, len(codes) - n, axis=1)[:, len(codes) - n]
        return np.nonzero(scores >= (least - MARGIN * self.error * np.sqrt((queries**2).sum(1)))[:, None])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    doubles = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", doubles.alias("embedding")).filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    return rows.filter(F.size("embedding") == (common[0]["length"] if common else 0))


FOUND = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which the column ``is_query`` holds."""
    spark, rows = vectors.sparkSession, usable(vectors)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = 1 << 30
    share = F.pmod(F.xxhash64(F.lit(13), "vec_id"), F.lit(parts)) < max(1, int(min(1.0, SAMPLE / total) * parts))
    picked = rows.filter(share).select("embedding").toArrow()["embedding"].combine_chunks()
    sample = np.array(picked.flatten()).reshape(len(picked), -1) if len(picked) else np.array([rows.first()["embedding"]])
    index = spark.sparkContext.broadcast(Index.fit(sample, int(np.clip(np.sqrt(total) / 2, 1, 4096)), k))
    lists = len(index.value.centres)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column("embedding")
        return np.array(column.flatten(), np.float64).reshape(len(column), -1)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            if len(batch):
                x = matrix(batch)
                home, codes = index.value.encode(x)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["list", "vec_id", "codes", "vector"])

    with Scratch(spark) as tmp:
        indexed = tmp.stored(rows.mapInArrow(assigned, "list int, vec_id long, codes binary, vector binary"))
        sizes = np.zeros(lists, np.int64)
        for r in indexed.groupBy("list").count().collect():
            sizes[r["list"]] = r["count"]

        def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in release(batches):
                if not len(batch):
                    continue
                x = matrix(batch)
                which = index.value.probed(x, sizes, k)
                of = np.repeat(np.arange(len(x)), [len(w) for w in which])
                packed = pa.array([v.tobytes() for v in x], pa.binary())
                for lo in range(0, len(of), 20_000):
                    some = pa.array(of[lo : lo + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which)[lo : lo + 20_000].astype(np.int32)), batch.column("vec_id").take(some), packed.take(some)], names=["list", "query_id", "query"])

        queries = rows.filter(is_query).mapInArrow(probing, "list int, query_id long, query binary")
        asked = {r["list"]: r["count"] for r in queries.groupBy("list").count().collect()}
        dealt = [(n, -(-max(int(sizes[n]), 1) // BLOCK_VECTORS), -(-max(asked.get(n, 0), 1) // BLOCK_QUERIES)) for n in range(lists)]
        # numbers of blocks by list: at most 4096 rows
        blocks = F.broadcast(spark.createDataFrame(dealt, "list int, blocks int, rounds int"))
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        own = lambda name, count: F.pmod(F.xxhash64(F.col(name)), F.col(count)).cast("int")
        left = indexed.join(blocks, "list").withColumn("block", own("vec_id", "blocks")).withColumn("round", every("rounds")).drop("blocks", "rounds")
        right = queries.join(blocks, "list").withColumn("round", own("query_id", "rounds")).withColumn("block", every("blocks")).drop("blocks", "rounds")

        def scored(vectors_: pd.DataFrame, queries_: pd.DataFrame) -> pd.DataFrame:
            if not len(vectors_) or not len(queries_):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
            out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
            ids, home = vectors_["vec_id"].to_numpy(), int(vectors_["list"].iloc[0])
            codes = np.frombuffer(b"".join(vectors_["codes"]), np.uint8).reshape(len(ids), -1)
            x = np.frombuffer(b"".join(vectors_["vector"])).reshape(len(ids), -1)
            asking = queries_["query_id"].to_numpy()
            q = np.frombuffer(b"".join(queries_["query"])).reshape(len(asking), -1)
            for lo in range(0, len(asking), 128):
                part, who = q[lo : lo + 128], asking[lo : lo + 128]
                row, near = index.value.best(part, home, codes, RERANK + 1)
                exact = np.concatenate([np.einsum("nd,nd->n", part[row[a : a + _PAIRS]], x[near[a : a + _PAIRS]]) for a in range(0, len(row), _PAIRS)])
                other = ids[near] != who[row]
                row, near, exact = row[other], near[other], exact[other]
                order = np.lexsort((ids[near], -exact, row))
                row, near, exact = row[order], near[order], exact[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(pd.DataFrame({"query_id": who[row[first]], "vec_id": ids[near[first]], "score": exact[first]}))
            return pd.concat(out)

        keys = ["list", "block", "round"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scored, FOUND)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return stored(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
