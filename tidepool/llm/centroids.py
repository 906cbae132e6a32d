"""Centroid clustering in whole numbers: k-means whose every step is exact.

Vectors become integers and are packed into blocks, which are checkpointed
once. Squared distances of a block to all centroids come from one matrix
product, |x|^2 - 2 x.c + |c|^2, in float64: as long as the dimensions times the
square of the greatest component of both together stay below 2^53, every
partial sum is a whole number that float64 holds, so the order of additions
doesn't matter and the result is exact. A block beyond that bound falls back to
differences in 64-bit integers, and beyond 2^63 to Python's integers. Sums by
cluster are a product with the matrix of memberships under the same bounds.
A round is one ``treeAggregate`` over the blocks, whose result has k rows
whatever the data; a lost executor's blocks are read again from the checkpoint.

Defined results: vectors that are null, have another number of components, or
hold a null, a component that isn't finite or whose product with ``scale``
isn't, take no part; with fewer vectors than k there are so many centroids;
rows without an id take part, their hash is that of the empty text, and ids
stay null; repeated rows count each; equal hashes go by vector; distances and
inertias that a long can't hold are null; an empty table gives an empty one;
other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import cut

#: Vectors of a block; bounds below which float64 and 64-bit integers are exact.
BLOCK, FLOAT, LONG = 4096, 1 << 53, 1 << 63
_PACKED = "n int, kind string, ids binary, none binary, data binary"
_RESULT = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _greatest(x: np.ndarray) -> int:
    """The greatest magnitude, as a Python integer."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in the least type that holds it; Python's integers where none does."""
    y = np.floor(np.asarray(x, np.float64) * scale)
    most = float(np.abs(y).max()) if y.size else 0.0
    for kind, least in ((np.int16, 2**15), (np.int32, 2**31), (np.int64, 2**63)):
        if most < least:
            return y.astype(kind)
    return np.array([int(v) for v in y.ravel()], object).reshape(y.shape)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids (Python's integers), exact, in the fastest type that holds them."""
    bound = x.shape[1] * (_greatest(x) + _greatest(centroids)) ** 2
    if bound < FLOAT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ c.T) + np.einsum("ij,ij->i", c, c)).astype(np.int64)
    kind = np.int64 if bound < LONG else object
    a, c = x.astype(kind), centroids.astype(kind)
    return np.stack([((a - one) ** 2).sum(axis=1) for one in c], axis=1)


def sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of the rows of each cluster, as Python's integers."""
    bound = len(x) * _greatest(x)
    if bound < FLOAT:
        member = np.zeros((k, len(x)))
        member[cluster, np.arange(len(x))] = 1
        return (member @ x.astype(np.float64)).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), np.int64 if bound < LONG else object)
    np.add.at(out, cluster, x.astype(out.dtype))
    return out.astype(object)


def _pack(dims: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = part.column("id")
                x = whole(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims), scale)
                kind = "whole" if x.dtype == object else x.dtype.str
                data = json.dumps([str(v) for v in x.ravel()]).encode() if x.dtype == object else x.tobytes()
                none = ids.is_null().to_numpy(zero_copy_only=False)
                row = (part.num_rows, kind, ids.fill_null(0).to_numpy().tobytes(), none.tobytes(), data)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), *[pa.binary()] * 3))], names=["n", "kind", "ids", "none", "data"])

    return run


def _vectors(n: int, kind: str, data: bytes) -> np.ndarray:
    flat = np.array([int(v) for v in json.loads(bytes(data))], object) if kind == "whole" else np.frombuffer(data, kind)
    return flat.reshape(n, -1)


def packed(vectors: DataFrame, dims: int, scale: float, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """The vectors that take part (id, x), and those as blocks."""
    x = F.col(vector_col).cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where((F.size("x") == dims) & fit)
    return rows, cut(rows.mapInArrow(_pack(dims, scale), _PACKED))


def first_centroids(rows: DataFrame, k: int, scale: float, seed: int) -> np.ndarray:
    """The k vectors with the least hashes of their ids: k rows come to the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([[int(v) for v in whole(np.array(r.x), scale)] for r in found], object)


@dataclass(frozen=True)
class Round:
    """What one pass over the blocks gathers by cluster: rows, sums, and summed distances."""

    counts: np.ndarray
    sums: np.ndarray
    inertia: np.ndarray

    def __add__(self, other: Round) -> Round:
        return Round(self.counts + other.counts, self.sums + other.sums, self.inertia + other.inertia)


def assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of each row; ties go to the smaller number."""
    far = distances(x, centroids)
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(x)), cluster]


def one_round(blocks: DataFrame, centroids: np.ndarray) -> Round:
    k, dims = centroids.shape

    def add(so_far: Round, row) -> Round:
        x = _vectors(row.n, row.kind, row.data)
        cluster, far = assigned(x, centroids)
        return so_far + Round(np.bincount(cluster, minlength=k), sums(x, cluster, k), sums(far[:, None], cluster, k)[:, 0])

    none = Round(np.zeros(k, np.int64), np.zeros((k, dims), object), np.zeros(k, object))
    return blocks.select("n", "kind", "data").rdd.treeAggregate(none, add, lambda a, b: a + b)


def fit(rows: DataFrame, blocks: DataFrame, k: int, rounds: int, scale: float, seed: int) -> np.ndarray:
    """Centroids after that many rounds, as Python's integers."""
    centroids = first_centroids(rows, k, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        found = one_round(blocks, centroids)
        centroids = np.array([[v // int(n) for v in s] if n else c for c, s, n in zip(centroids.tolist(), found.sums.tolist(), found.counts)], object)
    return centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in centroid).encode()).hexdigest()


def _long(v: int) -> int | None:
    return int(v) if -LONG <= v < LONG else None


def cluster_vectors(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    rows, blocks = packed(vectors, dims, scale, id_col, vector_col)
    centroids = fit(rows, blocks, k, rounds, scale, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], _RESULT).withColumnRenamed("id", id_col)
    within = one_round(blocks, centroids).inertia
    shares, whole_, names = [_long(v) for v in within], _long(sum(within)), [digest(c) for c in centroids]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                cluster, far = assigned(_vectors(n, row["kind"], row["data"]), centroids)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), pa.int64(), mask=np.frombuffer(row["none"], bool))
                far_ = pa.array(far, pa.int64()) if far.dtype != object else pa.array([_long(v) for v in far], pa.int64())
                by = pa.array(cluster, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids, by, far_, pa.array(shares, pa.int64()).take(by), pa.array([whole_] * n, pa.int64()), pa.array(names, pa.string()).take(by)],
                    names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(label, _RESULT).withColumnRenamed("id", id_col)
