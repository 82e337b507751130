"""Approximate nearest neighbours by counting collisions of single projections.

Every block of vectors is projected on ``PROJECTIONS`` random lines, and the projections of each line are kept in a
sorted array. A query looks at a window around its own projection on every line. The radius grows step by step
(virtual rehashing: the same arrays, wider windows), and each vector counts on how many lines it is in the
window. A vector that reaches the collision threshold is verified by its true distance. The search ends once
the radius reaches the distance of the k-th best: every vector at most that far away collides on one line with
probability at least p, and the threshold lies ``SLACK`` standard deviations below the expected count.

No number of candidates is capped. Queries are a stated set; they are written to the shared folder in files of at
most ``QUERIES`` vectors, and every set of sorted arrays answers them file by file. The k best per query and set are
merged by rank. Candidates are read once and queries are never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttera.llm.common import opened
from uttera.session import scratch_path
from uttera.sources.files import list_files

PROJECTIONS = 32
#: Width of a window over the radius.
WIDTH = 2.0
SLACK = 3.0
#: By how much the radius grows in a step.
GROWTH = 1.5
#: Vectors in one set of sorted arrays, at most.
INDEX_ROWS = 1 << 15
QUERIES = 4096
EVERY = 100
SEED = 11


def usable(embedding: str) -> Column:
    """Not null, not zero, no null or non-finite component."""
    x = F.col(embedding)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(F.forall(x, finite) & F.exists(x, lambda v: v != 0), F.lit(False))


class SortedLines:
    """Sorted projections of a block of vectors of one dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, projections: int = PROJECTIONS):
        self.vectors, self.ids = vectors, ids
        self.lines = np.random.default_rng(SEED).normal(size=(vectors.shape[1], projections))
        # Kept within floats' range also for huge components; distances are taken on the vectors themselves.
        self.scale = max(float(np.abs(vectors).max()), 1e-300)
        projected = (vectors / self.scale) @ self.lines
        order = np.argsort(projected, axis=0, kind="stable").T
        line = np.take_along_axis(projected.T, order, axis=1)
        p = math.erf(WIDTH / 2 / math.sqrt(2))
        self.threshold = max(1, math.floor(projections * p - SLACK * math.sqrt(projections * p * (1 - p))))
        self.first = max(float(np.ptp(line, axis=1).mean()) * 1e-2, 1e-9)
        # All lines in one rising array, each shifted to a stretch of its own, so that one search serves all of them.
        self.limit = float(np.abs(line).max()) + 1.0
        self.shift = np.arange(projections) * (4 * self.limit)
        self.sorted = (line + self.shift[:, None]).ravel()
        self.order = order.ravel()

    def nearest(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, nearest first, ties to smaller ids; ``own`` is left out."""
        n = len(self.ids)
        counts = np.zeros(n, np.int64)
        checked = self.ids == own
        left = n - int(checked.sum())
        best_d, best_i = np.empty(0), np.empty(0, self.ids.dtype)
        at = (query / self.scale) @ self.lines
        edge = lambda x, side: np.searchsorted(self.sorted, np.clip(x, -self.limit, self.limit) + self.shift, side)
        low = edge(at, "left")
        high = low.copy()
        radius = self.first
        while left:
            half = WIDTH * radius / 2
            a, b = np.minimum(edge(at - half, "left"), low), np.maximum(edge(at + half, "right"), high)
            # What the windows gain on either side, as positions of the long array.
            start, size = np.concatenate([a, high]), np.concatenate([low - a, b - high])
            gained = np.arange(size.sum()) + np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size)
            counts += np.bincount(self.order[gained], minlength=n)
            low, high = a, b
            fresh = np.flatnonzero((counts >= self.threshold) & ~checked)
            if len(fresh):
                checked[fresh] = True
                left -= len(fresh)
                d = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1))
                d, i = np.concatenate([best_d, d]), np.concatenate([best_i, self.ids[fresh]])
                keep = np.lexsort((i, d))[:k]
                best_d, best_i = d[keep], i[keep]
            # Not to stop short of a tie, the radius has to pass the k-th distance.
            if len(best_d) == k and best_d[-1] / self.scale < radius:
                break
            radius *= GROWTH
        return best_i, best_d


def _by_dimension(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in vectors], np.int64)
    out = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out[int(d)] = (np.array([ids[r] for r in rows], np.int64), np.array([vectors[r] for r in rows], np.float64))
    return out


def _search(query_files: list[str], k: int, index_rows: int):
    def answer(ids: list, vectors: list) -> Iterator[pa.RecordBatch]:
        blocks = {d: SortedLines(rows, own) for d, (own, rows) in _by_dimension(ids, vectors).items()}
        for address in query_files:
            files, path = opened(address)
            asked = pq.read_table(path, filesystem=files)
            q_out, i_out, d_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            for q, x in zip(asked["vec_id"].to_pylist(), asked["embedding"].to_pylist(), strict=True):
                if len(x) in blocks:
                    i, dist = blocks[len(x)].nearest(np.array(x, np.float64), q, k)
                    q_out.append(np.full(len(i), q))
                    i_out.append(i)
                    d_out.append(dist)
            columns = [pa.array(np.concatenate(x)) for x in (q_out, i_out, d_out)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            values = batch.column(1)
            offsets = values.offsets.to_numpy()
            flat = values.values.to_numpy(zero_copy_only=False)
            ids += batch.column(0).to_pylist()
            vectors += [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            while len(ids) >= index_rows:
                yield from answer(ids[:index_rows], vectors[:index_rows])
                ids, vectors = ids[index_rows:], vectors[index_rows:]
        if ids:
            yield from answer(ids, vectors)

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
    index_rows: int = INDEX_ROWS, block: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, by Euclidean distance in doubles.

    Rows with a null id and vectors that are null, empty, zero or hold null or non-finite components take no part, on either
    side; a vector is compared with those of its own dimension. Rows with the query's id are not its
    neighbours; of a repeated id each row is a candidate, a repeated query row is asked once. With fewer than k
    candidates all are returned; with no query there are no rows.
    """
    usable_rows = lambda df: df.filter(usable(embedding) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")
    )
    spark = vectors.sparkSession
    path = scratch_path(spark, "queries")
    asked = usable_rows(queries).dropDuplicates(["vec_id"])
    asked.write.option("maxRecordsPerFile", block).parquet(path)
    found = [f for f in list_files(spark, path) if f.endswith(".parquet")]
    merged = usable_rows(vectors).mapInArrow(_search(found, k, index_rows), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = EVERY, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest of every vector whose id is divisible by ``every``."""
    return nearest(vectors, vectors.filter(F.col(vec_id) % every == 0), k, vec_id, embedding)
