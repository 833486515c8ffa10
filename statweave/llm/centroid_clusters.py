"""Centroid clustering of integer vectors with bounds that drift no more than they must.

Every vector carries the exact distance to its centroid and a lower bound on the
distance to any other.  When centroids move, lower bounds have to be loosened.
The full drift of the furthest-moved centroid would do; this loosens by less.
All vectors of cluster i lie in a sphere around the old centroid c_i with radius
r_i, the largest distance of a member.  For a centroid that moves from p to q,
let m be the middle of p and q and x a point:

    |x-p| - |x-q| = 2 (x-m).(q-p) / (|x-p| + |x-q|)  and  |x-p| + |x-q| >= 2 |x-m|,

so x comes closer by at most |q-p| cos(angle between x-m and q-p).  In the plane
of m, the direction of the move and c_i, the smallest such angle over the sphere
is the angle of c_i less arcsin(r_i / |c_i-m|).  The bounds of cluster i are
loosened by the largest value over the other centroids.

A vector whose own distance, measured again, is below its loosened bound keeps its
cluster; the others are ambiguous and scanned against all centroids in whole
numbers.  Bounds are floating point with a margin; they only decide what is scanned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm.common import forget, written

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
# Components beyond this could overflow a 64-bit squared distance.
LARGEST = 2**27
# Within this, dot products of 64 components are exact in double precision.
EXACT_IN_DOUBLE = 2**22
# Relative slack of floating-point bounds, far over their rounding errors.
SLACK = 1e-9


def kept_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that take part, in whole numbers."""
    value = F.col("embedding").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select("vec_id", value.alias("embedding")).where((F.size("embedding") == dimensions) & finite)
    whole = F.transform("embedding", lambda x: F.floor(x * scale))
    fits = F.forall("embedding", lambda x: F.abs(x * scale) < LARGEST)
    return rows.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of their ids; equal hashes by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT_IN_DOUBLE:
        dots = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
        return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * dots
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance, and a lower bound on the distance to the others."""
    squared = _squared(x, centroids)
    cluster = squared.argmin(1)
    rows = np.arange(len(x))
    best = squared[rows, cluster].copy()
    if len(centroids) == 1:
        return cluster, best, np.full(len(x), np.inf)
    squared[rows, cluster] = np.iinfo(np.int64).max
    return cluster, best, np.sqrt(squared.min(1).astype(np.float64)) * (1 - SLACK)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much any other centroid can have come closer to a vector in its sphere.

    ``radius`` holds the largest distance of a member to the old centroid, and is
    negative for a cluster without members.
    """
    before, after = old.astype(np.float64), new.astype(np.float64)
    out = np.zeros(len(old))
    for j in range(len(old)):
        move = after[j] - before[j]
        drift = float(np.sqrt(move @ move))
        if drift == 0.0:
            continue
        along = move / drift
        arm = before - (after[j] + before[j]) / 2
        reach = np.sqrt((arm * arm).sum(1))
        t = arm @ along
        off = np.sqrt(((arm - t[:, None] * along) ** 2).sum(1))
        r = np.maximum(radius, 0.0) * (1 + SLACK)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = r / reach
            cosine = (t / reach) * np.sqrt(np.maximum(0.0, 1 - s * s)) + (off / reach) * s
        # The middle of the move, or part of its forward axis, lies in the sphere.
        inside = (r >= reach * (1 - SLACK)) | ((t > 0) & (off <= r + SLACK * reach))
        factor = np.where(inside, 1.0, np.clip(np.nan_to_num(cosine, nan=1.0) + SLACK, 0.0, 1.0))
        step = drift * factor * (1 + SLACK)
        step[j] = 0.0
        out = np.maximum(out, step)
    return out


def _assign(rows: DataFrame, centroids: np.ndarray, loose: np.ndarray | None) -> DataFrame:
    """Nearest centroid of every row; with ``loose``, only ambiguous rows are scanned.  ``scanned`` marks them."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v")
            x = flat.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            if loose is None:
                cluster, squared, lower = scan(x, centroids)
                scanned = np.ones(len(x), dtype=bool)
            else:
                cluster = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                lower = batch.column("lower").to_numpy(zero_copy_only=False) - loose[cluster]
                squared = ((x - centroids[cluster]) ** 2).sum(1)
                scanned = ~(np.sqrt(squared.astype(np.float64)) * (1 + SLACK) < lower)
                if scanned.any():
                    cluster, lower = cluster.copy(), lower.copy()
                    cluster[scanned], squared[scanned], lower[scanned] = scan(x[scanned], centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), flat, pa.array(cluster.astype(np.int32)), pa.array(squared), pa.array(lower), pa.array(scanned)], ["vec_id", "v", "cluster", "distance", "lower", "scanned"])

    return rows.mapInArrow(run, f"vec_id {kind}, v array<long>, cluster int, distance long, lower double, scanned boolean")


def _sums(assigned: DataFrame, dimensions: int) -> list:
    """Per cluster: members, largest distance and the sum of each component; one row a cluster and task is shuffled."""
    parts = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dimensions)]
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.sum(F.col("scanned").cast("long")).alias("scanned"), *parts).collect()


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE, report: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of every kept vector, and the final centroids.

    Vectors that are null, of another length, or hold a null or non-finite
    component do not take part; a component of 2^27 or more after scaling is an
    error.  Repeated rows and null ids are vectors like any other; other columns are
    ignored.  Fewer vectors than clusters make fewer clusters; no vectors give no rows.
    ``report`` gets the number of scanned vectors of every round.
    """
    vectors = written(kept_vectors(embeddings, dimensions, scale))
    centroids = first_centroids(vectors, clusters, seed)
    state = written(_assign(vectors, centroids, None)) if len(centroids) else _assign(vectors, centroids, None)
    for _ in range(rounds if len(centroids) else 0):
        new, radius = centroids.copy(), np.full(len(centroids), -1.0)
        totals = _sums(state, dimensions)
        for row in totals:
            new[row.cluster] = [row[f"s{i}"] // row.n for i in range(dimensions)]
            radius[row.cluster] = float(np.sqrt(float(row.far)))
        if report is not None:
            report.append(sum(r.scanned for r in totals))
        before, state = state, written(_assign(state.drop("distance", "scanned"), new, loosening(centroids, new, radius)))
        forget(before)
        centroids = new
    if report is not None and len(centroids):
        report.append(state.where("scanned").count())
    return state.drop("lower", "scanned"), centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def summary(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    # At most one row a cluster.
    totals = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    by_cluster: list[Column] = [F.lit(k) for pair in totals.items() for k in pair]
    digests = [F.lit(k) for c in totals for k in (c, digest(centroids[c]))]
    empty = F.lit(None)
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        (F.create_map(*by_cluster)[F.col("cluster")] if totals else empty).cast("long").alias("cluster_inertia"),
        F.lit(sum(totals.values()) if totals else None).cast("long").alias("inertia"),
        (F.create_map(*digests)[F.col("cluster")] if totals else empty).cast("string").alias("centroid_sha256"),
    )
