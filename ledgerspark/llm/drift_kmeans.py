"""Exact centroid clustering of whole-number vectors, with geometric drift tightening.

Every vector carries a lower bound of its distance to the nearest centroid but its own. When centroids move, the bound must be
loosened by how much nearer any other centroid can have come. The triangle inequality says: by its whole way. All members of a
cluster lie in a sphere about the old centroid, however, and ``loosening`` bounds the gain over that sphere in the plane through the
sphere's centre and the other centroid's way, which is mostly far less. A vector whose distance to its own centroid stays under
the loosened bound keeps its cluster; only ambiguous vectors are scanned, exactly, against all centroids.

Rows are staged in the shared folder between rounds (vector, cluster, bound), each round reads them once and writes them
once. What reaches the driver and goes back to the tasks is one row per centroid: k is the parameter that bounds it. Sums
of a cluster are combined in the map tasks, so a cluster, or a vector that repeats, may hold any share of the rows.

Defined results: vectors that are null, have another number of components, or hold null or non-finite ones take no part; a
component beyond +-2**26 after scaling counts as that bound, so that squared distances fit a long; rows that repeat an id are
clustered each; rows with a null id are clustered, and are seeds only after all others; equal hashes are ordered by the
vector; with fewer than k vectors each is a centroid; an empty table gives an empty one; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: Scaled components beyond it count as it.
MOST = 2**26
#: Relative slack of floating-point bounds: a vector within it of being ambiguous is scanned.
SLACK = 1e-9


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """id, v (array<int>): floor(scale * component) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int"))
    return df.where((F.size(vector_col) == dims) & fine).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def seed_order(seed: int) -> Column:
    """sha256("<seed>:<id>") in lowercase hex; null ids come last."""
    return F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), F.lit("~"))


def loosening(own: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """At most so much nearer has a centroid, moving from old to new, come to any point within radius of own.

    |x - old| - |x - new| is constant on hyperboloids whose foci are the two places. Points that gained f or more lie
    within the cone about the way whose apex is the way's middle and whose half angle is arccos(f / way). The sphere's
    smallest angle at the apex, in the plane of its centre and the way, thus bounds the gain by way * cos(angle).
    """
    way = new - old
    length = float(np.sqrt(way @ way))
    if not length:
        return 0.0
    reach = own - (old + new) / 2
    distance = float(np.sqrt(reach @ reach))
    if distance <= radius:
        return length
    angle = math.acos(max(-1.0, min(1.0, float(reach @ way) / (distance * length)))) - math.asin(radius / distance)
    return length * math.cos(angle) if 0 < angle < math.pi / 2 else length if angle <= 0 else 0.0


def loosenings(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Per cluster, how much the lower bound of its members is loosened."""
    a, b = old.astype(float), new.astype(float)
    k = len(a)
    return np.array([max((loosening(a[i], float(radius[i]), a[j], b[j]) for j in range(k) if j != i), default=0.0) for i in range(k)])


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of v to each row of c (or of rows to rows, where c has as many)."""
    return (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]


def _assign(dims: int, centroids: np.ndarray, loosen: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, v, cluster, bound) with the cluster, the squared distance, the bound and whether the row was scanned anew."""
    if len(centroids) > 1:
        apart = _squared(centroids, centroids).astype(float)
        np.fill_diagonal(apart, np.inf)
        half = np.sqrt(apart.min(1)) / 2
    else:
        half = np.full(len(centroids), np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            n = len(v)
            if loosen is None:
                cluster, bound, own = np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int64)
                scan = np.ones(n, bool)
            else:
                cluster = batch.column("cluster").to_numpy().copy()
                own = ((v - centroids[cluster]) ** 2).sum(1)
                bound = batch.column("bound").to_numpy() - loosen[cluster]
                scan = np.sqrt(own) * (1 + SLACK) + SLACK >= np.maximum(bound, half[cluster]) * (1 - SLACK)
            if scan.any():
                d = _squared(v[scan], centroids)
                nearest = d.argmin(1)  # the smaller number of equals
                at = np.arange(len(d))
                own[scan], cluster[scan] = d[at, nearest], nearest
                others = d.astype(float)
                others[at, nearest] = np.inf
                bound[scan] = np.sqrt(others.min(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(own, pa.int64()), pa.array(bound, pa.float64()), pa.array(scan, pa.bool_())],
                names=["id", "v", "cluster", "distance", "bound", "scanned"],
            )

    return run


CENTROIDS = "cluster int, centroid array<int>, size long, cluster_inertia long"
STATE = "id long, v array<int>, cluster int, distance long, bound double, scanned boolean"


def clusters(
    df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Assignments (id, cluster, distance) after ``rounds`` rounds and a last assignment; centroids (cluster, centroid,
    size, cluster_inertia), one row per centroid; and per assignment the number of rows, of scanned rows, the full drift and the mean loosening."""
    spark = df.sparkSession
    rows = whole_vectors(df, id_col, vector_col, dims, scale)
    seeds = rows.orderBy(seed_order(seed), "v").limit(k).collect()
    if not seeds:
        return rows.selectExpr("id", "0 AS cluster", "0L AS distance"), spark.createDataFrame([], CENTROIDS), []
    centroids, loosen, report = np.array([x["v"] for x in seeds], np.int64), None, []
    inertia = F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")
    state = rows
    for turn in range(rounds + 1):
        last = turn == rounds
        done = staged(state.mapInArrow(_assign(dims, centroids, loosen), STATE), "drift")
        if turn:
            discard(state)
        sums = [] if last else [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dims)]
        per = done.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), F.sum(F.col("scanned").cast("long")).alias("scanned"), inertia, *sums).collect()
        moved, radius = centroids.copy(), np.zeros(len(centroids))
        for x in per:
            radius[x["cluster"]] = math.sqrt(x["far"]) * (1 + SLACK)
            if not last:
                moved[x["cluster"]] = [x[f"s{i}"] // x["n"] for i in range(dims)]
        loosen = loosenings(centroids, moved, radius) * (1 + SLACK) + SLACK
        drift = np.sqrt(((moved - centroids).astype(float) ** 2).sum(1))
        report.append({"rows": sum(x["n"] for x in per), "scanned": sum(x["scanned"] for x in per), "drift": float(drift.max()), "loosened": float(loosen.mean())})
        centroids, state = moved, done
    got = {x["cluster"]: (x["n"], min(int(x["inertia"]), 2**63 - 1)) for x in per}
    kept = spark.createDataFrame([(i, c.tolist(), *got.get(i, (0, 0))) for i, c in enumerate(centroids)], CENTROIDS)
    return done.select("id", "cluster", "distance"), kept, report
