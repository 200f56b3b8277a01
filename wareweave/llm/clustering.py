"""Exact integer k-means of vectors, with a PCA-rotated filter before the distances.

A vector's components become integers floor(1024 * x). The vectors are rotated once onto
their principal axes, whose moments cover all vectors; a row holds its integers, its
``LEADING`` first rotated coordinates and the norm of the rest. The squared distance of the
leading coordinates plus the squared difference of the rest's norms is never above the
squared distance. So a vector's exact distance to the centroid of the least bound settles
every centroid whose bound is larger; the survivors' distances are computed in integers.
The filter's floating point is given ``SLACK`` times the vectors' squared norms, far above
its error, so it changes no result.

The rotated table is written once to the checkpoint folder. A round reads it once: each task
sums its vectors by nearest centroid and gives one row a centroid, which Spark adds up. The
driver holds the centroids, and a 64 x 64 matrix of moments, and nothing else.

Defined cases: vectors that are null, of another length, or with a null or non-finite
component are left out, as are those with a component beyond 131,072 either way, whose
squared distances a long can't hold; a null id sorts last among the first centroids;
repeated ids are vectors of their own, and their ties for a first centroid go by their
components; with fewer vectors than centroids each vector begins as one; equal
distances go to the smaller number; a centroid without vectors stays; an empty table gives an empty
result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareweave.llm.common import checkpoint, table

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
#: What the ids are hashed with, to choose the first centroids.
SEED = 3
#: Rotated coordinates that are kept one by one.
LEADING = 16
#: Largest component, so that a squared distance stays below 2^63.
LARGEST = 1 << 17
#: Share of the squared norms by which a bound may be too high.
SLACK = 1e-9
#: Groups in which the tasks' moments are added before they reach the driver.
LANES = 64


def integers(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """id and x of the vectors that are kept."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)
    kept = vectors.filter((F.size(vector) == dimensions) & F.forall(vector, fits))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return kept.select(F.col(id_).alias("id"), scaled.alias("x"))


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=kind).reshape(-1, width)


def moments(kept: DataFrame, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Count, sums and sums of products of (1, x), added up in tasks and in lanes."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dimensions + 1, dimensions + 1))
        lane = 0
        for batch in batches:
            x = _matrix(batch.column("x"), dimensions, np.float64)
            x = np.hstack([np.ones((len(x), 1)), x])
            out += x.T @ x
            lane = int(abs(x.sum())) % LANES
        yield pa.RecordBatch.from_pydict({"lane": [lane], "m": [out.tobytes()]})

    def add(group: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(b.as_py()) for chunk in group.column("m").chunks for b in chunk)
        return pa.table({"m": [out.tobytes()]})

    parts = kept.select("x").mapInArrow(total, "lane long, m binary").groupBy("lane").applyInArrow(add, "m binary")
    found = sum(np.frombuffer(r["m"]) for r in parts.collect())  # at most LANES rows
    return np.reshape(found, (dimensions + 1, dimensions + 1)) if np.ndim(found) else np.zeros((dimensions + 1, dimensions + 1))


def principal_axes(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the axes as columns, of the largest variance first."""
    n = max(sums[0, 0], 1.0)
    mean = sums[0, 1:] / n
    _, axes = np.linalg.eigh(sums[1:, 1:] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1].copy()


def rotate(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    turned = (x - mean) @ axes
    return np.ascontiguousarray(turned[:, :leading]), np.sqrt((turned[:, leading:] ** 2).sum(1))


def rotated(kept: DataFrame, mean: np.ndarray, axes: np.ndarray, leading: int = LEADING) -> DataFrame:
    """The vectors with their leading rotated coordinates and the norm of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotate(_matrix(batch.column("x"), len(mean), np.float64), mean, axes, leading)
            flat = pa.array(lead.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, lead.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(rest)], names=["id", "x", "lead", "rest"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, x array<int>, lead array<double>, rest double")


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's centroid and exact squared distance, and how many distances it took."""
    at_lead, at_rest = rotate(centroids.astype(np.float64), mean, axes, lead.shape[1])
    norms = (lead**2).sum(1) + rest**2
    bounds = np.empty((len(centroids), len(x)))
    for c in range(len(centroids)):
        apart = ((lead - at_lead[c]) ** 2).sum(1) + (rest - at_rest[c]) ** 2
        bounds[c] = apart - SLACK * (norms + (at_lead[c] ** 2).sum() + at_rest[c] ** 2)
    cluster = bounds.argmin(0)
    distance = ((x - centroids[cluster]) ** 2).sum(1)
    first, measured = cluster.copy(), len(x)
    for c in range(len(centroids)):
        left = np.flatnonzero((bounds[c] <= distance) & (first != c))
        exact = ((x[left] - centroids[c]) ** 2).sum(1)
        closer = (exact < distance[left]) | ((exact == distance[left]) & (c < cluster[left]))
        distance[left[closer]], cluster[left[closer]] = exact[closer], c
        measured += len(left)
    return cluster, distance, measured


def _arrays(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest = np.asarray(batch.column("rest"))
    lead = np.asarray(batch.column("lead").flatten()).reshape(len(rest), -1)
    return _matrix(batch.column("x"), dimensions, np.int64), lead, rest


def assigned(points: DataFrame, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """id, cluster and distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(*_arrays(batch, len(mean)), centroids, mean, axes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    kind = points.schema["id"].dataType.simpleString()
    return points.mapInArrow(run, f"id {kind}, cluster int, distance long")


def sums(points: DataFrame, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """One row for each centroid that has vectors: cluster, n, measured and the exact sums."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, added, took = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64), 0
        for batch in batches:
            x, lead, rest = _arrays(batch, width)
            cluster, _, measured = nearest(x, lead, rest, centroids, mean, axes)
            took += measured
            for c in range(len(centroids)):
                mine = x[cluster == c]
                n[c] += len(mine)
                added[c] += mine.sum(0)
        for c in np.flatnonzero(n).tolist():
            yield pa.RecordBatch.from_pylist([{"cluster": c, "n": int(n[c]), "measured": took, "s": added[c].tolist()}])
            took = 0  # counted once a task

    parts = points.drop("id").mapInArrow(run, "cluster long, n long, measured long, s array<long>")
    each = [F.sum(F.get("s", F.lit(i))) for i in range(width)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"), F.array(*each).alias("s"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.orderBy(digest.isNull(), digest, "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def cluster_vectors(
    vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, leading: int = LEADING
) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(id, cluster, distance) of every vector, the centroids, and each round's distances a vector."""
    kept = checkpoint(integers(vectors, id_, vector, dimensions))
    centroids = first_centroids(kept, clusters, seed).reshape(-1, dimensions)
    if not len(centroids):
        kind = kept.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long"), centroids, []
    mean, axes = principal_axes(moments(kept, dimensions))
    points = checkpoint(rotated(kept, mean, axes, leading))
    took = []
    for _ in range(rounds):
        found = sums(points, centroids, mean, axes).collect()  # a row a centroid
        for r in found:
            centroids[r["cluster"]] = [s // r["n"] for s in r["s"]]  # Python's floor of exact integers
        took.append(sum(r["measured"] for r in found) / sum(r["n"] for r in found))
    return assigned(points, centroids, mean, axes), centroids, took


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _chosen(cluster: Column, values: list) -> Column:
    """The cluster's value of a short list, as a constant array that tasks carry."""
    return F.get(F.array(*map(F.lit, values)), cluster)


def cluster_query(spark, sf_dir: str) -> DataFrame:
    found, centroids, _ = cluster_vectors(table(spark, sf_dir, "embeddings"))
    found = checkpoint(found)
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    each = [inertia.get(c, 0) for c in range(len(centroids))] or [0]
    cluster = F.col("cluster")
    return found.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        _chosen(cluster, each).cast("long").alias("cluster_inertia"),
        F.lit(sum(each)).cast("long").alias("inertia"),
        _chosen(cluster, [centroid_digest(c) for c in centroids] or [""]).alias("centroid_sha256"),
    )


def _oracle(rounds: int = ROUNDS) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT row, vec_id, v, best.c AS c, best.d AS d FROM (
    SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (
      SELECT k.row, k.vec_id, k.v, c{i}.c, list_sum(list_transform(list_zip(k.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k CROSS JOIN c{i})
    GROUP BY row))""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list(floored ORDER BY i) AS v FROM (
      SELECT c, i, ((s - ((s % n + n) % n)) // n)::BIGINT AS floored FROM (
        SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM a{i}) GROUP BY c, i))
    GROUP BY c) m ON m.c = c{i}.c)""")
    return f"""WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) <= {LARGEST})) = {DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM k) WHERE c < {CLUSTERS}
), {', '.join(steps)}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c{rounds}) USING (c)"""


CLUSTER_SQL = _oracle()
