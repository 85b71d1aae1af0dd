"""Centroid clustering over a VA-file.

Vectors become whole numbers, floor(scale * x). The VA-file holds for each vector its cell in every
dimension (`bits` bits, in a byte) and its squared length, beside the full vector. Cells are finer where
values are dense: their edges are normal quantiles around each dimension's mean, within its range.

In a pass, a table with one entry per dimension, cell and centroid gives the least and greatest
of c * c - 2 * c * x over the cell's values. Summed over the dimensions, and with the squared length added,
that is the interval in which the squared distance lies. A vector whose smallest upper end lies
below all other lower ends is settled by its cells; the full vector is fetched only where
intervals overlap, and compared there only with the centroids whose intervals do. A fetch by key would
shuffle all vectors in every round, so a vector lies in the same row as its cells; its bytes go through Arrow
undecoded.

A pass that moves the centroids adds up each task's vectors per cluster, which takes all vectors (they are added, not
compared), and what is shuffled is one row per task, cluster and dimension. Centroids are the only thing that
is collected: `k` rows. All arithmetic is on whole numbers and exact, so reruns agree.

Kept are vectors of exactly `dims` components, none null, NaN or infinite; a null vector is not kept.
Components beyond 2 ** 27 in size (after scaling) are set to that bound, so that squared distances fit a long.
Centroids start as the k kept vectors whose hash of the id comes first, ids that are null last, equal hashes by
vector. Fewer kept vectors make fewer centroids; none make an empty result. Rows that repeat
an id or a vector are vectors of their own. Equal distances go to the smaller centroid number, and a centroid
without vectors stays. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.plans.workdir import written

BITS = 6
#: How much wider than a normal distribution the cells are spread.
SPREAD = 1.7
LIMIT = 1 << 27
#: Vectors whose intervals are in memory at once.
BLOCK = 4096


def whole_vectors(table: DataFrame, vector: str, dims: int, scale: float) -> DataFrame:
    """The kept rows, with *vector* as an array of whole numbers."""
    x = F.col(vector)
    scaled = F.transform(x, lambda v: F.floor(F.least(F.greatest(F.lit(float(scale)) * v.cast("double"), F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return table.filter((F.size(x) == dims) & ~odd).withColumn(vector, scaled)


def _edges(vectors: DataFrame, dims: int, bits: int) -> list[np.ndarray]:
    """For each dimension the least value of every cell, and one more than its greatest value at the end."""
    spread = [NormalDist().inv_cdf(i / (1 << bits)) * SPREAD for i in range(1, 1 << bits)]
    found = vectors.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")
    ).collect()  # one row per dimension
    edges: list[np.ndarray] = [np.array([0, 1])] * dims
    for r in found:
        inner = np.ceil(r["mean"] + r["std"] * np.array(spread)).astype(np.int64)
        inner = inner[(inner > r["low"]) & (inner <= r["high"])]
        edges[r["dim"]] = np.concatenate([[r["low"]], np.unique(inner), [r["high"] + 1]]).astype(np.int64)
    return edges


def _matrix(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def va_file(vectors: DataFrame, dims: int, bits: int = BITS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows of id, length2, cells and full for rows of id and vector, written, and the edges of the cells."""
    edges = _edges(vectors, dims, bits)
    kind = vectors.schema["id"].dataType.simpleString()

    def encoded(batches):
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy().reshape(-1, dims)
            cells = np.stack([np.searchsorted(e, x[:, d], side="right") - 1 for d, e in enumerate(edges)], axis=1)
            lengths = (x.astype(np.int64) ** 2).sum(axis=1)
            columns = [batch.column("id"), pa.array(lengths), _binary(cells.astype(np.uint8)), _binary(x.astype("<i4"))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "length2", "cells", "full"])

    schema = f"id {kind}, length2 bigint, cells binary, full binary"
    return written(vectors.select("id", "vector").mapInArrow(encoded, schema)), edges


def _tables(centroids: np.ndarray, edges: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension, least and greatest c * c - 2 * c * x by cell and centroid."""
    out = []
    for d, e in enumerate(edges):
        c = centroids[:, d][None, :]
        ends = [c * c - 2 * c * x[:, None] for x in (e[:-1], e[1:] - 1)]
        out.append((np.minimum(*ends), np.maximum(*ends)))
    return out


def nearest(
    length2: np.ndarray, cells: np.ndarray, full: np.ndarray, centroids: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster of every vector, its squared distance where it was computed (else -1), and how many vectors were fetched."""
    low, high = (np.repeat(length2[:, None], len(centroids), axis=1) for _ in range(2))
    for d, (least, greatest) in enumerate(tables):
        low += least[cells[:, d]]
        high += greatest[cells[:, d]]
    overlap = low <= high.min(axis=1)[:, None]
    cluster, distance = overlap.argmax(axis=1), np.full(len(cells), -1, np.int64)
    open_ = np.flatnonzero(overlap.sum(axis=1) > 1)
    if len(open_):
        row, which = np.nonzero(overlap[open_])
        exact = np.full((len(open_), len(centroids)), np.iinfo(np.int64).max)
        exact[row, which] = ((full[open_][row].astype(np.int64) - centroids[which]) ** 2).sum(axis=1)
        cluster[open_], distance[open_] = exact.argmin(axis=1), exact.min(axis=1)
    return cluster, distance, len(open_)


def _blocks(batches, dims: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column("length2").to_numpy(), _matrix(part.column("cells"), "u1", dims), _matrix(part.column("full"), "<i4", dims)


def moved(file: DataFrame, edges: list[np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def sums(batches):
        tables, total = _tables(centroids, edges), np.zeros((k, dims + 1), np.int64)
        for _, length2, cells, full in _blocks(batches, dims):
            cluster, _, _ = nearest(length2, cells, full, centroids, tables)
            order = np.argsort(cluster, kind="stable")
            present, first = np.unique(cluster[order], return_index=True)
            total[present, :dims] += np.add.reduceat(full[order].astype(np.int64), first, axis=0)
            total[:, dims] += np.bincount(cluster, minlength=k)
        at = np.arange(k * (dims + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1))], names=["at", "x"])

    found = np.zeros(k * (dims + 1), dtype=object)
    for r in file.mapInArrow(sums, "at bigint, x bigint").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        found[r["at"]] = int(r["x"])  # k * (dims + 1) rows
    found = found.reshape(k, dims + 1)
    return np.array([[x // r[dims] for x in r[:dims]] if r[dims] else list(old) for r, old in zip(found, centroids)], dtype=np.int64)


def assigned(file: DataFrame, edges: list[np.ndarray], centroids: np.ndarray) -> DataFrame:
    """id, cluster and distance (squared) of every vector, and whether it was fetched to find the cluster."""
    dims = centroids.shape[1]
    kind = file.schema["id"].dataType.simpleString()

    def rows(batches):
        tables = _tables(centroids, edges)
        for part, length2, cells, full in _blocks(batches, dims):
            cluster, distance, _ = nearest(length2, cells, full, centroids, tables)
            fetched = distance >= 0
            own = ((full[~fetched].astype(np.int64) - centroids[cluster[~fetched]]) ** 2).sum(axis=1)
            distance[~fetched] = own
            columns = [part.column("id"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(fetched)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance", "fetched"])

    return file.mapInArrow(rows, f"id {kind}, cluster int, distance bigint, fetched boolean")


def first_by_hash(vectors: DataFrame, hash_of: Column, k: int) -> np.ndarray:
    """The k vectors whose hash comes first, in that order."""
    chosen = vectors.select(hash_of.alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect()
    return np.array([r["vector"] for r in chosen], dtype=np.int64)


def clustered(
    table: DataFrame, id_: str, vector: str, dims: int = 64, k: int = 40, rounds: int = 5, seed: str = "2:", scale: float = 256, bits: int = BITS
) -> DataFrame:
    """One row per kept vector: id, cluster, distance, fetched, cluster_inertia, inertia, centroid_sha256."""
    vectors = whole_vectors(table.select(F.col(id_).alias("id"), F.col(vector).alias("vector")), "vector", dims, scale)
    centroids = first_by_hash(vectors, F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256), k)
    kind = vectors.schema["id"].dataType.simpleString()
    if not len(centroids):
        schema = f"id {kind}, cluster int, distance bigint, fetched boolean, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return table.sparkSession.createDataFrame([], schema)
    file, edges = va_file(vectors, dims, bits)
    for _ in range(rounds):
        centroids = moved(file, edges, centroids)
    rows = written(assigned(file, edges, centroids))
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return rows.select(
        "*", of([sums.get(i, 0) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"), of(hashes, "string").alias("centroid_sha256"),
    )
