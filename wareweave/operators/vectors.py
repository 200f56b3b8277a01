"""Nearest vectors by cosine: exact over all pairs in blocks, or through an index of centroids.

Both compare blocks of queries with blocks of vectors by one matrix product in a task. The
exact search brings every block of queries to every block of vectors. The index deals the
vectors to the nearest of a set of centroids, which are fitted on a bounded sample, covers
every vector, and brings a query only to the lists that lie nearest to it. How many lists
that are is measured: a bounded number of queries is searched exactly, and so many lists
are taken as hold ``recall`` of their nearest vectors. Cosines of what is met are exact.

Vectors that are null, of another length, hold a null or non-finite component, or are all
zero have no cosine and are left out; ties go by id; a vector is not its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareweave.operators.tiles import tiled
from wareweave.session import checkpoint

#: Rows of a block of queries and of a block of vectors.
QUERY_ROWS, BLOCK_ROWS = 1024, 8192
#: Vectors that the centroids are fitted on, centroids at most, and rounds of fitting.
SAMPLE_ROWS, CENTROIDS, ROUNDS = 8192, 1024, 8
#: Queries that are searched exactly to choose how many lists to search, and the share to find.
TRIAL_ROWS, RECALL = 256, 0.95
FOUND = "query_id long, vec_id long, cosine double"


def unit(vectors: DataFrame, dimensions: int = 64, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x) of the vectors that have a cosine, scaled to length one."""
    x = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = vectors.filter((F.size(vector) == dimensions) & sound).select(F.col(id_).cast("long").alias("id"), x.alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    kept = kept.withColumn("length", length).filter("length > 0 AND id IS NOT NULL")
    return kept.select("id", F.transform("x", lambda c: c / F.col("length")).alias("x"))


def _rows(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(n, -1) if n else np.empty((0, 0))


def _product(k: int | None, least: float | None):
    """Compare a group's queries with its vectors; the k best of each query, or all from ``least`` on."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        vec_ids = np.asarray(vectors.column("id"))
        v = _rows(vectors.column("x"), len(vec_ids))
        for start in range(0, queries.num_rows if len(vec_ids) else 0, QUERY_ROWS):
            part = queries.slice(start, QUERY_ROWS)
            ids = np.asarray(part.column("id"))
            cosine = _rows(part.column("x"), len(ids)) @ v.T
            cosine[ids[:, None] == vec_ids[None, :]] = -np.inf
            if k is not None and k < len(vec_ids):
                # everything as good as the k-th stays, so that ties are settled where all parts meet
                bar = np.partition(cosine, len(vec_ids) - k, axis=1)[:, len(vec_ids) - k] - 1e-12
            else:
                bar = np.full(len(ids), -2.0)
            i, j = np.nonzero(cosine >= np.maximum(bar, -2.0 if least is None else least)[:, None])
            out.append((ids[i], vec_ids[j], cosine[i, j]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "cosine"), map(pa.array, columns), strict=True)))

    return run


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def all_pairs(vectors: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """(query_id, vec_id, cosine): every query with all other vectors, in blocks.

    A block of either side is copied once for each block of the other.
    """
    mine, theirs = _blocks(queries, QUERY_ROWS), _blocks(vectors, BLOCK_ROWS)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    q = queries.withColumn("qb", deal(mine)).withColumn("vb", every(theirs)).groupBy("qb", "vb")
    v = vectors.withColumn("vb", deal(theirs)).withColumn("qb", every(mine)).groupBy("qb", "vb")
    return q.cogroup(v).applyInArrow(_product(k, least), FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, dimensions: int = 64) -> DataFrame:
    """The k nearest of all other vectors for each query: query_id, vec_id, cosine, rank."""
    return best(all_pairs(unit(vectors, dimensions), unit(queries, dimensions), k), k)


def cosine_above(vectors: DataFrame, queries: DataFrame, least: float, dimensions: int = 64) -> DataFrame:
    """(query_id, vec_id, cosine) of each query with all other vectors of at least that cosine."""
    return all_pairs(unit(vectors, dimensions), unit(queries, dimensions), None, least).filter(F.col("cosine") >= least)


def fit_centroids(units: DataFrame, seed: int = 0) -> np.ndarray:
    """Spherical k-means over the sample of the smallest id hashes: at most SAMPLE_ROWS vectors."""
    rows = units.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE_ROWS).collect()
    sample = np.array([r["x"] for r in rows])
    n = units.count()
    count = int(min(CENTROIDS, max(1, round(n**0.5)), max(1, len(sample) // 8)))
    centroids = sample[:count].copy()
    for _ in range(ROUNDS if len(sample) else 0):
        of = (sample @ centroids.T).argmax(1)
        for c in range(count):
            total = sample[of == c].sum(0)
            if (length := np.linalg.norm(total)) > 0:
                centroids[c] = total / length
    return centroids


def _order(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids by falling product, ties by number."""
    return np.argsort(-(x @ centroids.T), axis=1, kind="stable")


def listed(units: DataFrame, centroids: np.ndarray, lists: int) -> DataFrame:
    """(id, x, list): each vector once for each of its ``lists`` nearest centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _order(_rows(batch.column("x"), batch.num_rows), centroids)[:, :lists] if batch.num_rows else np.empty((0, lists), int)
            many = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(many), batch.column("x").take(many), pa.array(near.ravel().astype(np.int32))], names=["id", "x", "list"])

    return units.mapInArrow(run, "id long, x array<double>, list int")


def lists_needed(units: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, recall: float = RECALL) -> int:
    """How many lists hold that share of the nearest vectors of the trial queries."""
    trial = checkpoint(queries.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIAL_ROWS))
    truth = best(all_pairs(units, trial, k), k).select("query_id", "vec_id")
    of = truth.join(units.select(F.col("id").alias("vec_id"), F.col("x").alias("v")), "vec_id")
    rows = of.join(trial.select(F.col("id").alias("query_id"), F.col("x").alias("q")), "query_id").select("q", "v").collect()  # TRIAL_ROWS * k at most
    if not rows:
        return 1
    at = _order(np.array([r["v"] for r in rows]), centroids)[:, 0]
    order = _order(np.array([r["q"] for r in rows]), centroids)
    rank = np.sort((order == at[:, None]).argmax(1))
    return int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) + 1


def index_topk(vectors: DataFrame, queries: DataFrame, k: int, dimensions: int = 64, recall: float = RECALL) -> DataFrame:
    """query_id, vec_id, cosine, rank: the k nearest that the searched lists hold, near ``recall`` of the true ones.

    A list that holds very many vectors, or is searched by very many queries, is cut into tiles.
    """
    units, asked = checkpoint(unit(vectors, dimensions)), checkpoint(unit(queries, dimensions))
    centroids = fit_centroids(units)
    if not len(centroids):
        return best(all_pairs(units, asked, k), k)
    lists = lists_needed(units, asked, centroids, k, recall)
    q, v, keys = tiled(listed(asked, centroids, lists), listed(units, centroids, 1), ["list"], [F.col("id")], [F.col("id")], BLOCK_ROWS)
    return best(q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(_product(k, None), FOUND), k)
