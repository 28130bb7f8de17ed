"""Exact top-k inner products over a pivot-distance index.

A search for large inner products becomes one for near neighbours by one more
coordinate: with ``M`` the greatest norm, ``x' = (x, sqrt(M^2 - |x|^2))`` and
``q' = (q, 0)`` give ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``.  Every ``x'`` is keyed
by its nearest pivot and its distance to it, and the table is range-partitioned
by that key, so each task holds runs of thin annuli around a few pivots.  By
the triangle inequality an annulus ``[r, s]`` of pivot ``p`` is no nearer to ``q'``
than ``max(0, d - s, r - d)``, ``d = |q' - p|``.  A task expands the annuli of a
query from the smallest bound upwards and stops where the bound cannot reach
the query's k-th best score; a first value for that score comes from a sample,
so that all tasks prune from the start.

Pivots and first scores rest on a bounded sample; every vector is indexed and
the result is exact.  Scores are integers: products are taken in doubles where
the norms show that these are exact, else in 64-bit integers, else in integers of
any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name

#: Vectors of the sample that pivots and first scores come from.
SAMPLE = 8192
PIVOTS = 64
#: Queries that are broadcast at once; more queries go in further blocks.
QUERY_BLOCK = 8192
#: Vectors of one annulus.
ANNULUS = 256


def scaled(embedding: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as a double, or null if the vector, a component or a result is null, NaN or infinite."""
    whole = F.transform(embedding, lambda x: F.lit(float(scale)) * x.cast("double"))
    out = F.transform(whole, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))  # larger doubles are integers
    return F.when(embedding.isNotNull() & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), out)


def _kind(top: float) -> type:
    """What holds the products of vectors whose squared norms are at most ``top``."""
    return np.float64 if top < 2.0**52 else np.int64 if top < 2.0**62 else object


def _integers(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return x.astype(kind)
    out = np.empty(x.shape, dtype=object)
    out.ravel()[:] = [int(v) for v in x.ravel()]
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    sq = np.einsum("ij,ij->i", x, x)
    return np.hstack([x, np.sqrt(np.maximum(top - sq, 0.0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T, 0.0))


def _pivots(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Centres of the sample: spread seeds, then a few rounds of Lloyd's algorithm."""
    rng = np.random.default_rng(5)
    pivots = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = _distances(sample, pivots).argmin(1)
        for p in range(len(pivots)):
            if (own := sample[near == p]).size:
                pivots[p] = own.mean(0)
    return pivots


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", embedding: str = "embedding", scale: int = 64, sample_rows: int = SAMPLE, n_pivots: int = PIVOTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``is_query`` the ``k`` other rows of highest inner product.

    Ties go to the smaller key.  Vectors that are null, empty, or hold a null or non-finite component take no part,
    neither do null keys; nor do components that ``scale`` takes beyond doubles.  The remaining vectors must have one
    length, else a ``ValueError`` tells the lengths.  Rows of a query's own key are no candidates; rows that repeat a
    key are one query, the least of their vectors, but several candidates.  Scores beyond the range of long are
    ranked as they are and shown as its ends.  Fewer than ``k`` other rows give all of them; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    (ints,) = free_name(vectors, "_ints")
    good = vectors.withColumn(ints, scaled(F.col(embedding), scale)).where(F.col(ints).isNotNull() & (F.size(ints) > 0) & F.col(key).isNotNull())
    rows = good.select(F.col(key).cast("long").alias("id"), F.col(ints).alias("v"), is_query.alias("q"))
    top_dims = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.min(F.size("v")), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if top_dims[0] is None:
        return spark.createDataFrame([], schema)
    if top_dims[1] != top_dims[2]:
        raise ValueError(f"vectors of {top_dims[1]} and of {top_dims[2]} components")
    top, dims = float(top_dims[0]) * (1 + 1e-9), int(top_dims[2])

    # the sample: the rows of smallest key hash, a bounded number
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    known, known_ids = np.vstack(taken["v"].to_numpy()).astype(np.float64), taken["id"].to_numpy()
    # norms beyond doubles leave nothing to prune by: one pivot, and every annulus is searched
    bounded = top < 1e300
    pivots = spark.sparkContext.broadcast(_pivots(_lift(known, top), n_pivots) if bounded else np.zeros((1, dims + 1)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), dims)
                d = _distances(_lift(x, top), pivots.value) if bounded else np.zeros((len(x), 1))
                near = d.argmin(1)
                yield pa.record_batch([b.column("id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["id", "v", "pivot", "dist"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = scratch.keep(rows.select("id", "v").mapInArrow(keyed, "id long, v array<double>, pivot int, dist double").repartitionByRange(n, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id"), "index")

    queries = scratch.keep(rows.where("q").groupBy("id").agg(F.min("v").alias("v")), "queries")
    found, block = None, []
    parts = []

    def search(block: list) -> DataFrame:
        qids = np.array([r["id"] for r in block], dtype=np.int64)
        q = np.array([r["v"] for r in block], dtype=np.float64)
        least = np.full(len(q), -np.inf)
        for a in range(0, len(q), 512):
            s = q[a : a + 512] @ known.T
            s[qids[a : a + 512, None] == known_ids[None, :]] = -np.inf
            if s.shape[1] >= k and bounded:  # less what rounding may have added
                least[a : a + 512] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 1e-9 * top
        shared = spark.sparkContext.broadcast((qids, q, least))
        return index.mapInArrow(lambda it: _expand(it, shared.value, pivots.value, top, dims, k), "query_id long, vec_id long, score long, wide binary")

    for r in queries.toLocalIterator():
        block.append(r)
        if len(block) == query_block:
            parts.append(scratch.keep(search(block), f"found{len(parts)}"))
            block = []
    if block:
        parts.append(search(block))
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("wide"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _expand(batches: Iterator[pa.RecordBatch], queries: tuple, pivots: np.ndarray, top: float, dims: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k best of the annuli of one partition, as far as they reach its first score."""
    qids, q, least = queries
    kind, bounded = _kind(top), top < 1e300
    if bounded:
        q_sq = np.einsum("ij,ij->i", q, q)
        d_pivot = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
    least, exact = least.copy(), _integers(q, kind)
    best_s = [np.zeros(0, kind)] * len(q)
    best_i = [np.zeros(0, np.int64)] * len(q)
    for b in batches:
        ids, v = np.asarray(b.column("id")), _integers(_matrix(b.column("v"), dims), kind)
        pivot, dist = np.asarray(b.column("pivot")), np.asarray(b.column("dist"))
        edges = np.flatnonzero(np.diff(pivot)) + 1
        starts = [a for x, y in zip([0, *edges], [*edges, len(ids)]) for a in range(x, y, ANNULUS)]
        ends = [min(e, a + ANNULUS) for x, e in zip([0, *edges], [*edges, len(ids)]) for a in range(x, e, ANNULUS)]
        reach = np.full((len(q), len(starts)), np.inf)
        if bounded:
            p = pivot[starts]
            inner, outer = dist[starts], dist[np.array(ends) - 1]
            d = d_pivot[:, p]
            bound = np.maximum(0.0, np.maximum(d - outer[None, :], inner[None, :] - d))
            # the score that a vector at the bound would have; rounding is far below the margin
            reach = (q_sq[:, None] + top - bound**2) / 2 + 1e-6 * (1 + top)
        order = np.argsort(-reach.max(0), kind="stable")
        for c in order:  # annuli from the smallest bound of any query upwards
            live = np.flatnonzero(reach[:, c] >= least)
            if not live.size:
                continue
            s = exact[live] @ v[starts[c] : ends[c]].T
            own = ids[starts[c] : ends[c]]
            hit = (s >= least[live][:, None]) & (qids[live][:, None] != own[None, :])
            for j in np.flatnonzero(hit.any(1)):
                i, m = live[j], hit[j]
                scores = np.concatenate([best_s[i], s[j, m]])
                names = np.concatenate([best_i[i], own[m]])
                keep = _best(scores, names, k)
                best_s[i], best_i[i] = scores[keep], names[keep]
                if len(keep) == k:
                    least[i] = max(least[i], _below(best_s[i][-1]))
    n = [len(x) for x in best_s]
    if sum(n):
        scores = np.concatenate(best_s)
        if kind is object:  # as bytes in the order of the integers
            wide = pa.array([(int(x) + (1 << 2100)).to_bytes(264, "big") for x in scores], pa.binary())
            scores = np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in scores], dtype=np.int64)
        else:
            wide = pa.nulls(len(scores), pa.binary())
        yield pa.record_batch([pa.array(np.repeat(qids, n)), pa.array(np.concatenate(best_i)), pa.array(scores.astype(np.int64)), wide], names=["query_id", "vec_id", "score", "wide"])


def _below(score: object) -> float:
    """A double that is no more than the score."""
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return -np.inf if score < 0 else np.finfo(np.float64).max
