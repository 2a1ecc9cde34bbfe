"""Centroid clustering of integer vectors by partial-distance search.

Components become integers: the floor of `scale` times the component, taken as double. Each round every vector goes
to its nearest centroid by squared Euclidean distance, of equally near ones to that with the smaller number, and each
centroid that has vectors becomes the floor of their mean by component. All of it is exact integer arithmetic.

The search takes the dimensions in order of falling variance, a few at a time, for all (vector, centroid) pairs of a
block at once. After the first few, the centroid that looks nearest is finished, which gives the vector its current
best; then each step adds some dimensions to the pairs that are left and abandons those strictly above the best. Pairs
as far as the best stay, so ties are decided on full distances; survivors finish all dimensions.

A round is one scan. Each task sends a row of sums and a count for each cluster, so what reaches the driver is
clusters x dimensions numbers, whatever the input.

Edge cases: vectors that are null, have another number of components, or hold a null or a component that isn't finite
are left out. Repeated rows stay, and weigh as often as they stand there. A vector without an id is clustered but is
no first centroid; of equal ids with different vectors the smaller vector comes first. With fewer vectors than
clusters there are fewer clusters; with none, or an empty table, the result is empty. A component beyond 2**27 after
scaling ends the job with an error, as distances would leave 64 bits. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 1 << 27
STEP = 8  # dimensions added before pairs are abandoned again
BLOCK = 4096  # vectors whose distances are worked out at once


@dataclass(frozen=True)
class Model:
    """centroids: a row of whole numbers for each; order: dimensions by falling variance."""

    centroids: np.ndarray
    order: np.ndarray

    def digests(self) -> list[str]:
        """Lowercase hex SHA-256 of each centroid's components, as decimal numbers joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def nearest(v: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance to it for each row of whole numbers."""
    rows, dims = v.shape
    v, c = v[:, model.order], model.centroids[:, model.order]
    part = np.zeros((rows, len(c)), np.int64)
    at = min(STEP, dims)
    for d in range(at):
        part += (v[:, d, None] - c[None, :, d]) ** 2
    guess = part.argmin(1)
    best = part[np.arange(rows), guess] + ((v[:, at:] - c[guess, at:]) ** 2).sum(1)
    row, centroid = np.nonzero(part <= best[:, None])
    distance = part[row, centroid]
    while at < dims:
        part = v[row, at : at + STEP] - c[centroid, at : at + STEP]
        distance += (part * part).sum(1)
        stay = distance <= best[row]
        row, centroid, distance = row[stay], centroid[stay], distance[stay]
        at += STEP
    first = np.searchsorted(row, np.arange(rows))  # every row's guess has stayed, and pairs are in order of (row, centroid)
    least = np.minimum.reduceat(distance, first) if rows else distance
    ties = np.flatnonzero(distance == least[row])
    return centroid[ties[np.searchsorted(row[ties], np.arange(rows))]], least


def whole(vectors: DataFrame, dims: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, v) of the usable vectors as whole numbers, written to the shared folder."""
    common.ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("x")), dims), False))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null: not a number
            usable = np.isfinite(x).all(1)
            ids = batch.column("vec_id").filter(pa.array(usable))
            v = np.floor(x[usable] * scale)
            if (np.abs(v) > LIMIT).any():
                at = int(np.flatnonzero((np.abs(v) > LIMIT).any(1))[0])
                raise ValueError(f"vector {ids[at]} has a component beyond {LIMIT} after scaling")
            flat = pa.array(v.astype(np.int32).reshape(-1), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([ids, lists], ["vec_id", "v"])

    return common.staged(rows.mapInArrow(run, f"vec_id {kind}, v array<int>"), "whole-vectors")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            block = batch.slice(begin, BLOCK)
            yield block, block.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _by_variance(vectors: DataFrame, dims: int) -> np.ndarray:
    """Dimensions in order of falling variance. It steers the search only; results don't depend on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for _, v in _blocks(batches, dims):
            n, s, q = n + len(v), s + v.sum(0), q + (v.astype(np.float64) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(np.full(dims, n), pa.int64()), pa.array(s), pa.array(q)], ["d", "n", "s", "q"])

    sums = vectors.select("v").mapInArrow(run, "d int, n long, s double, q double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = np.zeros(dims)
    for r in sums.where("n > 0").collect():  # a row for each dimension
        variance[r["d"]] = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2
    return np.argsort(-variance, kind="stable")


def _means(vectors: DataFrame, model: Model) -> np.ndarray:
    """The centroids after one more round."""
    k, dims = model.centroids.shape
    names = [f"s{d}" for d in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, v in _blocks(batches, dims):
            cluster, _ = nearest(v, model)
            order = np.argsort(cluster, kind="stable")
            there, first = np.unique(cluster[order], return_index=True)
            sums[there] += np.add.reduceat(v[order], first, axis=0)
            count += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), *(pa.array(sums[used, d]) for d in range(dims))], ["cluster", "n", *names])

    schema = "cluster int, n long, " + ", ".join(f"{s} long" for s in names)
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)]
    out = model.centroids.copy()
    for r in vectors.select("v").mapInArrow(run, schema).groupBy("cluster").agg(*exact).collect():  # a row for each cluster
        out[r["cluster"]] = [int(r[s]) // int(r["n"]) for s in names]
    return out


def fit(vectors: DataFrame, clusters: int = 16, rounds: int = 3, seed: str = "1:", dims: int = 64) -> Model:
    """vectors: (vec_id, v) as `whole` gives them. The first centroids are the vectors whose digest of seed and id is smallest."""
    named = vectors.where("vec_id is not null").withColumn("digest", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    first = named.orderBy("digest", "v").limit(clusters).select("v").collect()
    model = Model(np.array([r["v"] for r in first], np.int64).reshape(-1, dims), _by_variance(vectors, dims))
    for _ in range(rounds if len(first) else 0):
        model = Model(_means(vectors, model), model.order)
    return model


def assign(vectors: DataFrame, model: Model) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector."""
    spark, dims = vectors.sparkSession, model.centroids.shape[1]
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, v in _blocks(batches, dims) if len(model.centroids) else ():
            cluster, distance = nearest(v, model)
            yield pa.RecordBatch.from_arrays([block.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = common.staged(vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each cluster
    told = [(c, s, sum(sums.values()), model.digests()[c]) for c, s in sums.items()]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, seed: str = "1:", dims: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fits the centroids on all vectors and assigns every vector to one."""
    rows = whole(vectors, dims, scale, id_col, vector_col)
    return assign(rows, fit(rows, clusters, rounds, seed, dims))
