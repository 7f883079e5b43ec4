"""Centroid clustering in exact integers, screened in float32.

A vector of finite floats becomes integers floor(1024 * x), and centroids are integers too, so distances are exact and
every run gives the same clusters.  Most vectors don't need exact distances: a float32 matrix product gives each vector's
distance to each centroid up to a bound on its rounding error (`intervals`).  Centroids whose interval reaches below the
least upper end are on the shortlist; where that is one centroid it is the nearest, and where intervals overlap the
shortlist is measured again in exact integers and the smallest number wins ties.

A round is one pass over the vectors.  A task adds up its vectors by cluster and sends one row per cluster and component,
which Spark sums; the driver gets clusters x dimensions numbers, the next centroids.  Vectors are read anew each round and
nothing but the centroids lives between rounds, so a lost executor costs the tasks it held.

Defined cases: vectors that are null, of another length, or hold a null, NaN or infinite component are left out; a null
vec_id is a vector like others, whose hash comes last; rows that repeat a vec_id are vectors of their own, and those that
compete as first centroids are taken in order of their components; fewer vectors than clusters start as many clusters as
there are vectors; an empty table gives an empty result; other columns, of whatever names, are not read.  Components may
have up to 2**52 in size (an error beyond); a distance or inertia that doesn't fit into a long is null.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLUSTERS = 8
DIMENSIONS = 64
ROUNDS = 10
SEED = 3
SCALE = 1024.0
#: Vectors in one matrix product.
SLICE = 8192
#: Integers below this in size have squared distances of up to 4,096 dimensions, and sums of 2**36 vectors, in 64 bits.
SMALL = 1 << 24
#: Integer components are below this in size, so int64 holds them.
LARGEST = 1 << 62
LONG = 2**63 - 1


# ---------------------------------------------------------------------------------------------
# Kernels.


def integer_vectors(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors [n, dimensions] of int64): the rows of whole finite vectors and their components as floor(1024 * x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    whole = (size == dimensions) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(whole)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    fine = np.isfinite(x).all(axis=1)
    x = np.floor(x[fine] * SCALE)
    if len(x) and not (np.abs(x) < LARGEST).all():
        raise ValueError("vector components of 2**52 or more in size can't be clustered exactly")
    return rows[fine], x.astype(np.int64)


def intervals(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) [n, k] around |c|**2 - 2 x.c, which orders a vector's distances, from a float32 matrix product.

    With u = 2**-24, converting x and c and adding d products in any order err by at most g = (d + 2) u / (1 - (d + 2) u)
    times sum |x_i c_i|, which is at most |x| |c|.  What float64 adds to that is below 2**-48 of the terms' sizes.
    """
    u, d = 2.0**-24, x.shape[1]
    g = (d + 2) * u / (1 - (d + 2) * u)
    dot = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    own = np.array([float(sum(int(v) ** 2 for v in c)) for c in centroids])
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    most = norm[:, None] * np.sqrt(own)[None] * (1 + 1e-9)
    score = own[None] - 2 * dot
    error = 2 * g * most + (own[None] + 2 * most + 1) * 2.0**-48
    known = np.isfinite(dot)  # products beyond float32's range say nothing
    return np.where(known, score - error, -np.inf), np.where(known, score + error, np.inf)


def exact_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of y; Python integers where 64 bits may not hold them."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) >= SMALL:
        x, y = x.astype(object), y.astype(object)
    return ((x - y) ** 2).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row of x; ties go to the smaller number."""
    low, high = intervals(x, centroids)
    listed = low <= high.min(axis=1)[:, None]
    out = listed.argmax(axis=1)
    unsure = np.flatnonzero(listed.sum(axis=1) > 1)
    if len(unsure):
        row, number = np.nonzero(listed[unsure])
        far = exact_distances(x[unsure][row], centroids[number])
        # Rows by distance, then by number; the first of each row is its nearest.
        order = np.lexsort((number, far, row)) if far.dtype != object else np.array(sorted(range(len(row)), key=lambda k: (row[k], far[k], number[k])))
        first = order[np.unique(row[order], return_index=True)[1]]
        out[unsure] = number[first]
    return out


# ---------------------------------------------------------------------------------------------
# Passes over the vectors.

_SUMS = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0))])


def _vectors(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            rows, x = integer_vectors(part.column("embedding"), dimensions)
            if len(rows):
                yield part, rows, x


def _total(values: np.ndarray) -> list[int]:
    """Exact sums over rows."""
    return [int(v) for v in (values if np.abs(values).max(initial=0) < SMALL else values.astype(object)).sum(axis=0)]


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, distances: bool) -> Iterator[pa.RecordBatch]:
    """A task's totals: by cluster and component, with the count at place -1; or with `distances` by cluster alone."""
    k, d = centroids.shape
    totals: dict[int, list[int]] = {}
    for _, _, x in _vectors(batches, d):
        found = nearest(x, centroids)
        for c in np.unique(found).tolist():
            mine = x[found == c]
            if distances:
                far = exact_distances(mine, centroids[c][None])
                row = [sum(far.tolist())]
            else:
                row = [len(mine), *_total(mine)]
            have = totals.get(c)
            totals[c] = row if have is None else [a + b for a, b in zip(have, row)]
    if totals:
        cells = [(c, place - 1, v) for c, row in sorted(totals.items()) for place, v in enumerate(row)]
        yield pa.record_batch([pa.array(column, kind.type) for column, kind in zip(zip(*cells), _SUMS)], _SUMS)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, rows, x in _vectors(batches, centroids.shape[1]):
        found = nearest(x, centroids)
        far = exact_distances(x, centroids[found])
        distance = pa.array(far if far.dtype != object else [v if v <= LONG else None for v in far.tolist()], pa.int64())
        yield pa.record_batch([part.column("vec_id").take(pa.array(rows)), pa.array(found.astype(np.int32)), distance], names=["vec_id", "cluster", "distance"])


def _vector_table(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def totals(vectors: DataFrame, centroids: np.ndarray, distances: bool = False) -> dict[int, dict[int, int]]:
    """Sums of the vectors of each cluster by component (-1: their number), or of their distances (at -1)."""
    run = functools.partial(_sums, centroids=centroids, distances=distances)
    parts = _vector_table(vectors).mapInArrow(run, "cluster int, place int, total decimal(38,0)")
    out: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():  # clusters x (dimensions + 1) rows
        out.setdefault(r["cluster"], {})[r["place"]] = int(r["total"])
    return out


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The kept vectors of the least sha256 of `seed:vec_id`, in that order."""
    fine = (F.size("embedding") == dimensions) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    some = _vector_table(vectors).where(fine).select("embedding", rank.alias("rank")).orderBy(F.asc_nulls_last("rank"), "embedding").limit(clusters).collect()
    x = np.floor(np.array([r["embedding"] for r in some], dtype=np.float64).reshape(-1, dimensions) * SCALE)
    if not (np.abs(x) < LARGEST).all():
        raise ValueError("vector components of 2**52 or more in size can't be clustered exactly")
    return x.astype(np.int64)


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The centroids [k, dimensions] after all rounds.  vectors: vec_id, embedding."""
    centroids = first_centroids(vectors, clusters, dimensions, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for c, row in totals(vectors, centroids).items():
            moved[c] = [row[place] // row[-1] for place in range(dimensions)]
        if np.array_equal(moved, centroids):
            break  # further rounds would repeat this one
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every kept vector."""
    kind = dict(vectors.dtypes)["vec_id"]
    run = functools.partial(_assigned, centroids=centroids)
    return _vector_table(vectors).mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    centroids = fit(vectors, clusters, rounds, dimensions, seed)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), dtype=np.int64)  # of an empty table; no row meets it
    spent = {c: row[-1] for c, row in totals(vectors, centroids, True).items()}
    whole = sum(spent.values())
    fits = lambda v: v if v <= LONG else None
    facts = [(c, fits(spent.get(c, 0)), fits(whole), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    table = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assign(vectors, centroids).join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a cluster
