"""Centroid clustering with geometric drift tightening: exact k-means rounds that scan only ambiguous vectors.

Vectors are turned into integers once and written. Every round is one pass over Arrow batches that carries each vector's
cluster and a lower bound of its distance to all other centroids. Between rounds the members of cluster i lie in a sphere
around its old centroid with the largest member distance as its radius. A point of it can come closer to a moved centroid j
by at most the drift times the cosine of the angle at which the sphere is seen from the middle of the move, measured against
the direction of the move, in the plane through the sphere's centre and the move (:func:`loosening`): 0 where the sphere lies
behind, the full drift only where it lies ahead. The lower bound is loosened by the greatest of these over j. The distance
to a vector's own centroid is computed exactly; where it stays below the bound, no other centroid can be as near, ties
included, and all other vectors are scanned against all centroids. So the result is that of the plain rounds, bit for bit.

Distances are exact in 64-bit integers, bounds have a margin for floating point. A batch's sums go to the reducers as one row
for each cluster and component, so no cluster is anyone's group, however many vectors it has. The driver sees k centroids
and radii. Every round is a table in the shared folder; a lost executor repeats its tasks only.

Defined results: vectors of another length, or with a null or non-finite component, are left out. Components beyond +-2**27
after scaling are held there, so that distances fit. Repeated rows and ids are vectors of their own, null ids too; seeds are
chosen by the hash of the id, null ids last, ties by the vector. Equal distances go to the smaller number. With fewer vectors
than k there are as many clusters; an empty table gives an empty result. An inertia beyond 64 bits is null. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
LIMIT = 1 << 27
#: Vectors that meet all centroids at once.
ROWS = 1 << 12
#: Relative margin of the bounds; above what rounding can do, 1.5e-8 for an arc sine near 1.
MARGIN = 1e-7
STATE = "vec_id {id}, v array<int>, cluster int, distance long, lower double, scans int"


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of the vectors with exactly ``dims`` finite components."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.size("v") == dims)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten()
            x = v.to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become NaN
            ok = np.isfinite(x).all(axis=1)
            ints = np.clip(np.floor(x[ok] * scale), -LIMIT, LIMIT).astype(np.int32)
            yield pa.record_batch([b.column("vec_id").filter(pa.array(ok)), _lists(ints)], ["vec_id", "v"])

    return rows.mapInArrow(whole, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<int>")


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1), np.int64)


def seeds(table: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes of ``seed:vec_id``, in the order of their hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r["v"] for r in table.orderBy(F.asc_nulls_last(name), "v").limit(k).collect()], np.int64)


def loosening(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By cluster, how much closer any point of its sphere may have come to another centroid.

    With o in the middle of a move of length d, a point x at distance R from o and at the angle t to the direction of the move
    has |x - before| - |x - after| = 2 R d cos t / (|x - before| + |x - after|), and the sum below the line is at least 2 R:
    the point comes closer by d cos t at most. In the plane through o, the direction and the sphere's centre the sphere is a
    disc; its smallest angle is that of the tangent from o, or 0 where the disc holds o or cuts the axis.
    """
    before, after = before.astype(float), after.astype(float)
    k = len(before)
    out = np.zeros(k)
    for j in range(k):
        move = after[j] - before[j]
        drift = np.linalg.norm(move)
        if not drift:
            continue
        to = before - (before[j] + after[j]) / 2
        far = np.linalg.norm(to, axis=1)
        along = to @ move / drift
        angle = np.arctan2(np.linalg.norm(to - along[:, None] * (move / drift), axis=1), along)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.where(far > radius, np.arcsin(np.minimum(radius / far, 1)), np.pi)
        closer = drift * np.maximum(np.cos(np.maximum(angle - seen, 0)), 0)
        closer[j] = 0
        out = np.maximum(out, closer + MARGIN * (drift + far + radius))
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid (ties: the smaller number), and the distance to the second."""
    # 64-bit integers wrap in between, which cancels out as the distances fit
    apart = (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)
    own = apart.argmin(axis=1)
    best = apart[np.arange(len(x)), own]
    apart[np.arange(len(x)), own] = np.iinfo(np.int64).max
    return own, best, np.sqrt(apart.min(axis=1).astype(float))


def assigned(table: DataFrame, centroids: np.ndarray, loose: np.ndarray | None = None) -> DataFrame:
    """The table with cluster, distance, lower and scans (times that a vector met all centroids) of this round.

    ``loose``: by cluster what :func:`loosening` says of the last move; without it all vectors are scanned.
    """

    def one(x: np.ndarray, of: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, ...]:
        if loose is None:
            return (*nearest(x, centroids), np.ones(len(x), bool))
        distance = ((x - centroids[of]) ** 2).sum(axis=1)
        lower = lower - loose[of]
        scan = ~(np.sqrt(distance.astype(float)) * (1 + MARGIN) < lower)
        of = of.copy()
        if scan.any():
            of[scan], distance[scan], lower[scan] = nearest(x[scan], centroids)
        return of, distance, lower, scan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                b = whole.slice(a, ROWS)
                x = _matrix(b.column("v"))
                if loose is None:
                    of, distance, lower, scan = one(x, None, None)
                    before = 0
                else:
                    of, distance, lower, scan = one(x, b.column("cluster").to_numpy(), b.column("lower").to_numpy())
                    before = b.column("scans").to_numpy()
                data = [b.column("vec_id"), b.column("v"), pa.array(of.astype(np.int32)), pa.array(distance), pa.array(lower), pa.array((before + scan).astype(np.int32))]
                yield pa.record_batch(data, ["vec_id", "v", "cluster", "distance", "lower", "scans"])

    return table.mapInArrow(run, STATE.format(id=table.schema["vec_id"].dataType.simpleString()))


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the componentwise floor of its vectors' mean; those without vectors stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            of = b.column("cluster").to_numpy()
            x = _matrix(b.column("v"))
            for c in np.unique(of):
                total[c] += x[of == c].sum(axis=0)
            count += np.bincount(of, minlength=len(count))
        k, dims = total.shape
        there = np.repeat(count > 0, dims)
        data = [np.repeat(np.arange(k, dtype=np.int32), dims), np.tile(np.arange(dims, dtype=np.int32), k), total.ravel(), np.repeat(count, dims)]
        yield pa.record_batch([pa.array(c[there]) for c in data], ["cluster", "dim", "total", "n"])

    parts = state.select("cluster", "v").mapInArrow(sums, "cluster int, dim int, total long, n long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(wide("total"), wide("n")).collect():  # k x dims rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, v, cluster, distance, scans, cluster_inertia, inertia and centroid of every vector that is kept."""
    table = written(quantised(vectors, dims, scale))
    centroids, loose = seeds(table, k, seed), None
    if not len(centroids):  # no vectors
        centroids = np.zeros((1, dims), np.int64)
    state = written(assigned(table, centroids))
    for _ in range(rounds):
        new = moved(state, centroids)
        radius = np.zeros(len(centroids))
        for r in state.groupBy("cluster").agg(F.max("distance").alias("d")).collect():  # k rows
            radius[r["cluster"]] = np.sqrt(float(r["d"])) * (1 + MARGIN)
        loose, centroids = loosening(centroids, new, radius), new
        state = written(assigned(state, centroids, loose))
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows
    fits = lambda x: int(x) if x < 1 << 63 else None
    whole = fits(sum(r["own"] for r in sums))
    facts = [(r["cluster"], fits(r["own"]), whole, centroids[r["cluster"]].tolist()) for r in sums]
    facts = state.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "v", "cluster", "distance", "scans", "cluster_inertia", "inertia", "centroid")
