"""Centroid clustering (operator 12): Lloyd's rounds with Elkan's bounds over integer vectors.

Vectors are turned into integers once and written to the shared folder with, after each round, their
cluster, an upper bound of the distance to its centroid and a lower bound of the distance to each of the
``k`` centroids. A round moves the bounds by how far centroids went and skips every distance that
they, or half the distance between two centroids, show to be larger. Bounds are rounded away from each
other and only strict inequalities skip, so ties still meet and go to the smaller number. Centroid
sums are exact: a round adds and takes away only vectors that changed their cluster, summed inside
tasks, then by cluster; ``k`` times the vectors' length numbers a round reach the driver. Vectors are never shuffled.

Rows: vectors that are null, have another number of components, or hold null or non-finite ones are
left out; those with the same id each have their row; a null id is kept and hashed like an empty one; equal
hashes go by components; with fewer vectors than ``k`` there are as many centroids as vectors; an empty
table gives an empty table; extra columns are ignored, whatever their names. A component beyond
LARGEST after scaling fails the job, as its distance doesn't fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, staged, written

#: Largest size of a scaled component: squared distances over 64 of them stay under 2**63.
LARGEST = 1 << 27
STATE = "vec_id long, vec binary, cluster int, was int, upper double, lower binary"


def _up(x: np.ndarray) -> np.ndarray:
    """A little more, by some units in the last place, than roots and sums of exact numbers can be off."""
    return np.nextafter(x * (1 + 1e-15), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x * (1 - 1e-15), -np.inf), 0)


def _down32(x: np.ndarray) -> np.ndarray:
    """The next smaller number in single precision."""
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def between(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each two centroids, rounded down."""
    return _down(np.sqrt(squared(centroids[:, None], centroids[None]).astype(float)) / 2)


def nearest(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, upper bound and lower bounds of each vector, and how many distances that took; the bounds given must hold for ``centroids``."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    k, taken = len(centroids), 0
    apart = half.copy()
    np.fill_diagonal(apart, np.inf)
    own = np.flatnonzero(upper >= apart.min(axis=1)[cluster]) if k > 1 else np.zeros(0, np.int64)
    tight = np.zeros(len(x), bool)  # whose exact distance is known
    exact = np.zeros(len(x), np.int64)
    for j in range(k):
        for again in (False, True):  # the second time with the exact distance to the own centroid in place of the bound
            a = cluster[own]
            meets = own[(a != j) & (upper[own] >= lower[own, j]) & (upper[own] >= half[a, j])]
            if again or not len(loose := meets[~tight[meets]]):
                break
            exact[loose] = squared(x[loose], centroids[cluster[loose]])
            d = np.sqrt(exact[loose].astype(float))
            upper[loose], lower[loose, cluster[loose]], tight[loose] = _up(d), _down32(d), True
            taken += len(loose)
        if not len(meets):
            continue
        found = squared(x[meets], centroids[j])
        taken += len(meets)
        d = np.sqrt(found.astype(float))
        lower[meets, j] = _down32(d)
        nearer = (found < exact[meets]) | ((found == exact[meets]) & (j < cluster[meets]))
        moved = meets[nearer]
        cluster[moved], exact[moved], upper[moved] = j, found[nearer], _up(d[nearer])
    return cluster, upper, lower, taken


def _vectors(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<i4").reshape(batch.num_rows, dimension).astype(np.int64)


def scaled(vectors: DataFrame, dimension: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vec: kept vectors as 32-bit integers floor(scale * x)."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where((F.size(v) == dimension) & finite)

    def run(batches):
        for batch in batches:
            x = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension) * scale)
            if x.size and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], names=["vec_id", "vec"])

    return kept.mapInArrow(run, "vec_id long, vec binary")


def _first(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """Vectors of the ``k`` smallest digests of seed and id, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    got = rows.select(digest.alias("digest"), "vec").orderBy("digest", "vec").limit(k).collect()
    return np.array([np.frombuffer(r["vec"], "<i4") for r in got], np.int64)


def _assigned(state: DataFrame, dimension: int, before: np.ndarray | None, centroids: np.ndarray) -> DataFrame:
    """STATE after a round: bounds that hold for the centroids ``before`` are moved to ``centroids``, and clusters found; without ``before`` from nothing."""
    k = len(centroids)
    went = None if before is None else _up(np.sqrt(squared(before, centroids).astype(float)))
    half = between(centroids)

    def run(batches):
        for batch in batches:
            x, n = _vectors(batch, dimension), batch.num_rows
            if before is None:
                was = np.full(n, -1, np.int32)
                cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k), np.float32)
            else:
                was = batch.column("cluster").to_numpy().astype(np.int32)
                cluster = was.copy()
                upper = _up(batch.column("upper").to_numpy() + went[cluster])
                lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), "<f4").reshape(n, k)
                lower = _down32(lower.astype(float) - went)
            cluster, upper, lower, _ = nearest(x, centroids, cluster, upper, lower, half)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array([r.tobytes() for r in lower.astype("<f4")], pa.binary())], names=["vec_id", "vec", "cluster", "was", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def _changes(state: DataFrame, dimension: int) -> list[tuple[int, int, int]]:
    """(cluster, 0, gain of its count) and (cluster, i, gain of its i-th sum), from the vectors that changed their cluster."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.concatenate([np.ones((batch.num_rows, 1), np.int64), _vectors(batch, dimension)], axis=1)
            for column, sign in (("cluster", 1), ("was", -1)):
                at = batch.column(column).to_numpy()
                for c in np.unique(at[at >= 0]):
                    sums[int(c)] = sums.get(int(c), np.zeros(dimension + 1, np.int64)) + sign * x[at == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = state.where("cluster <> was").select("vec", "cluster", "was").mapInArrow(run, "cluster int, sums array<long>")
    each = parts.select("cluster", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return [(r["cluster"], r["i"], int(r["s"])) for r in each.collect()]


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dimension: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: the last assignment after ``rounds`` rounds of assigning and moving centroids."""
    spark = vectors.sparkSession
    rows, place = written(scaled(vectors, dimension, scale, id_col, vector_col), "clusters-vectors")
    centroids = _first(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sums = [[0] * (1 + dimension) for _ in centroids]  # count and sums of each cluster
    before, state = None, rows
    for _ in range(rounds):
        state, new = written(_assigned(state, dimension, before, centroids), "clusters-state")
        removed(spark, place)  # the new table holds all that is still read
        place = new
        for c, i, gain in _changes(state, dimension):
            sums[c][i] += gain
        before, centroids = centroids, np.array([[s // own[0] for s in own[1:]] if own[0] else old.tolist() for own, old in zip(sums, centroids, strict=True)], np.int64)

    def distances(batches):
        for batch in batches:
            at = batch.column("cluster").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(squared(_vectors(batch, dimension), centroids[at]))], names=["vec_id", "cluster", "distance"])

    last = staged(_assigned(state, dimension, before, centroids).mapInArrow(distances, "vec_id long, cluster int, distance long"), "clusters-last")
    removed(spark, place)
    inertia = {r["cluster"]: r["inertia"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
