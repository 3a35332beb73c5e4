"""Centroid clustering by sort-means: k-means in exact integers, in which most centroids aren't looked at.

In each round the driver orders, for each centroid, the others by their distance from it (k x k numbers). A vector is first
measured against the centroid it was assigned to before; the others are scanned in that order, and the scan stops at the
first that is strictly farther from the previous centroid than twice the vector's own distance: by the triangle inequality
neither it nor any later one can be nearer, or as near. Rounds read the vectors with their assignments from a table in the
shared folder and write the next one; only sums for each centroid and task, added up by Spark, reach the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import dropped, stored_at

#: Vectors that a task works on at a time.
_ROWS = 1 << 13


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of integers as binary values, 32 bits a component."""
    data = np.ascontiguousarray(x, "<i4")
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * 4 * x.shape[1]), pa.py_buffer(data)]).cast(pa.binary())


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


def gaps_of(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all of them by ascending distance from it (itself first), and those squared distances."""
    gaps = np.stack([_squared(centres, c) for c in centres])
    gaps[np.arange(len(gaps)), np.arange(len(gaps))] = -1  # before any copy of it
    order = np.argsort(gaps, axis=1, kind="stable")
    return order, np.maximum(np.take_along_axis(gaps, order, 1), 0)


def nearest(x: np.ndarray, at: np.ndarray, centres: np.ndarray, order: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (of equally near ones the smallest) and its squared distance, scanning from `at`."""
    own = _squared(x, centres[at])
    to, best, live = at.copy(), own.copy(), np.arange(len(x))
    for k in range(1, len(centres)):
        live = live[gaps[at[live], k] <= 4 * own[live]]
        if not len(live):
            break
        c = order[at[live], k]
        d = _squared(x[live], centres[c])
        nearer = (d < best[live]) | (d == best[live]) & (c < to[live])
        to[live[nearer]], best[live[nearer]] = c[nearer], d[nearer]
    return to, best


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v, at) of the vectors with exactly `dims` components, none null or not finite: floor(scale x component), packed, and centroid 0.

    Integers are held within +-sqrt(2^61 / dims) / 2 (92,681 x 1024 at 64 components), within which all distances are exact.
    """
    most = min(math.isqrt((1 << 61) // dims) // 2, (1 << 31) - 1)

    def convert(batches):
        for batch in batches:
            vectors = batch.column(1)
            fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
            flat = vectors.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null: NaN
            finite = np.isfinite(flat).all(1)
            x = np.clip(np.floor(scale * flat[finite]), -most, most)
            ids = batch.column(0).filter(fits).filter(pa.array(finite))
            yield pa.RecordBatch.from_arrays([ids, _packed(x), pa.array(np.zeros(len(x), np.int32))], ["id", "v", "at"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(convert, f"id {rows.schema['id'].dataType.simpleString()}, v binary, at int")


def _placed(rows: DataFrame, centres: np.ndarray, last: bool = False) -> DataFrame:
    """rows (id, v, at) -> the same with the nearest centroid in `at`; last: (id, at, distance)."""
    order, gaps = gaps_of(centres)
    dims = centres.shape[1]

    def place(batches):
        for batch in batches:
            at, distance = batch.column("at").to_numpy().copy(), np.zeros(batch.num_rows, np.int64)
            for k in range(0, batch.num_rows, _ROWS):
                part = slice(k, k + _ROWS)
                at[part], distance[part] = nearest(_matrix(batch.column("v").slice(k, _ROWS), dims), at[part], centres, order, gaps)
            more = ["distance", pa.array(distance)] if last else ["v", batch.column("v")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), more[1], pa.array(at)], ["id", more[0], "at"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(place, f"id {kind}, {'distance bigint' if last else 'v binary'}, at int")


def _means(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The floors of the means of each centroid's vectors; a centroid without vectors stays."""
    dims = centres.shape[1]

    def add(batches):
        sums, n = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                x, at = _matrix(batch.column("v").slice(k, _ROWS), dims), batch.column("at").slice(k, _ROWS).to_numpy()
                by = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[by], prepend=-1))
                sums[at[by[starts]]] += np.add.reduceat(x[by], starts, axis=0)
                n += np.bincount(at, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([[int(n[c]), *sums[c].tolist()] for c in used], pa.list_(pa.int64()))], ["at", "sums"])

    parts = rows.select("v", "at").mapInArrow(add, "at int, sums array<bigint>")
    totals: dict[int, dict[int, int]] = {}
    for r in parts.select("at", F.posexplode("sums").alias("k", "x")).groupBy("at", "k").agg(F.sum("x").alias("x")).collect():  # centroids x dims
        totals.setdefault(r.at, {})[r.k] = r.x
    new = centres.copy()
    for c, of in totals.items():
        new[c] = [of[k + 1] // of[0] for k in range(dims)]
    return new


def sort_means(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> DataFrame:
    """One row for each kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of its centroid's components, joined by commas).

    Kept are vectors with exactly `dims` components, none null or not finite, as whole numbers floor(scale x component); the rest have no row.
    Centroids start as the k kept vectors with the smallest sha256 of `seed:id` (a null id: of `seed:`; of equal ids the one whose
    32-bit little-endian bytes come first), in that order; fewer vectors, fewer centroids. Each of `rounds` rounds assigns every vector to its nearest centroid, the smaller
    number of equally near ones, and moves each to the floor of its vectors' mean; one without vectors stays. Then
    vectors are assigned once more. Rounds after one that moves nothing would change nothing and are left out. Rows that repeat count, each for itself.
    Other columns aren't returned. Empty input, or none kept, gives no rows. k x k distances and k centroids go to every task: k is meant
    to be some thousands at most. Of the tables of rounds only the last stays in the shared folder.
    """
    spark = df.sparkSession
    rows, path = stored_at(whole_vectors(df, id_col, vector_col, dims, scale))
    first = rows.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h")).orderBy("h", "v").limit(k).collect()
    centres = _matrix(pa.array([bytes(r.v) for r in first], pa.binary()), dims)
    if not len(centres):
        return spark.createDataFrame([], f"{id_col} {rows.schema['id'].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        before, (rows, new) = path, stored_at(_placed(rows, centres))
        dropped(spark, before)
        path, moved = new, _means(rows, centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    found, _ = stored_at(_placed(rows, centres, last=True))
    dropped(spark, path)
    inertia = {r["at"]: r["x"] for r in found.groupBy("at").agg(F.sum("distance").alias("x")).collect()}  # a row for each centroid
    named = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c in inertia]
    clusters = F.broadcast(spark.createDataFrame(named, "at int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))  # k rows at most
    return found.join(clusters, "at").select(F.col("id").alias(id_col), F.col("at").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
