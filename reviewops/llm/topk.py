"""Exact top-k search by inner product with pivot-table elimination.

Vectors are scaled to integers.  With one more coordinate that brings every
vector to the same length M, the largest inner product is the smallest
distance: d(q, x)**2 = |q|**2 + M**2 - 2 <q, x>.  A table stores the distances
of every vector to some pivots; |d(q, p) - d(x, p)| bounds d(q, x) from below
for each pivot, and the largest such bound gives an upper bound on the score.
A query looks at its candidates in the order of that bound and stops at the
first bound under its k-th best score, so the result is exact.

Pivots are chosen from a bounded sample (``SAMPLE`` rows, smallest hashes of
the id, farthest first); they serve speed only.  Queries go to the tasks in
blocks of about ``BLOCK`` rows.

Vectors that are null or hold null or non-finite components take no part.
Shorter vectors count as padded with zeros.  A query's own row is every row
with its id; repeated candidate rows count each; repeated query ids are one
query, the smallest vector.  Ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewops.llm.common import written

PIVOTS, SAMPLE, BLOCK = 32, 1024, 2048


def quantised(vectors: DataFrame, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array of long): floor(scale * x) of each usable vector."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.filter(e.isNotNull() & fine & F.col(vec_id).isNotNull())
            .select(F.col(vec_id).cast("long").alias("vec_id"),
                    F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")))


def _matrix(lists, dim: int) -> np.ndarray:
    """Rows of a ListArray as float64, padded with zeros; integers under 2**53 stay exact."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
    width = np.diff(offsets)
    if len(width) and (width == dim).all():
        return flat[offsets[0]:offsets[-1]].reshape(-1, dim)
    out = np.zeros((len(width), dim))
    for i, (a, n) in enumerate(zip(offsets[:-1], width, strict=True)):
        out[i, :n] = flat[a:a + n]
    return out


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice."""
    if not len(sample):
        return sample
    chosen, far = [int(np.argmax((sample ** 2).sum(1)))], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distances of the lengthened vectors to the pivots, which keep the last coordinate 0."""
    return np.sqrt(np.maximum(0.0, top + (pivots ** 2).sum(1)[None, :] - 2 * x @ pivots.T))


def _table(shared):
    def run(batches):
        import pyarrow as pa

        pivots, top, dim = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(_matrix(batch.column("v"), dim), pivots, top)
            ends = np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(pa.array(ends), pa.array(d.ravel()))],
                                             names=["vec_id", "v", "pd"])
    return run


class Search:
    """The best k rows of each query among the candidates seen so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, top: float, k: int):
        self.ids, self.q, self.top, self.k = ids, q, top, k
        self.norm = (q ** 2).sum(1)
        # the query keeps the last coordinate 0, so its distances to the pivots are plain
        self.qd = np.sqrt(np.maximum(0.0, self.norm[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * q @ pivots.T))
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.looked = 0

    def bounds(self, i: int, pd: np.ndarray) -> np.ndarray:
        """Upper bounds of query i's scores; a hair is added for rounding."""
        low = np.abs(pd - self.qd[i]).max(1) if pd.shape[1] else np.zeros(len(pd))
        return (self.norm[i] + self.top - low ** 2) / 2 + 1e-6 * (1 + self.top)

    def see(self, vec_ids: np.ndarray, x: np.ndarray, pd: np.ndarray, chunk: int = 256) -> None:
        for i, own in enumerate(self.ids):
            most = self.bounds(i, pd)
            order = np.argsort(-most, kind="stable")
            best = self.best[i]
            for a in range(0, len(order), chunk):
                at = order[a:a + chunk]
                if len(best) == self.k and most[at[0]] < -best[-1][0]:
                    break
                at = at[vec_ids[at] != own]
                self.looked += len(at)
                score = x[at] @ self.q[i]
                if len(best) == self.k:
                    good = score >= -best[-1][0]
                    at, score = at[good], score[good]
                if len(at):
                    best.extend(zip((-score).tolist(), vec_ids[at].tolist(), strict=True))
                    best.sort()
                    del best[self.k:]


def _search(shared):
    def run(batches):
        import pyarrow as pa

        ids, q, pivots, top, dim, k = shared.value
        search = Search(ids, q, pivots, top, k)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), dim)
                pd = batch.column("pd")
                pd = pd.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                search.see(batch.column("vec_id").to_numpy(), x, pd)
        rows = [(int(i), v, int(-s)) for i, best in zip(ids, search.best, strict=True) for s, v in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs are ``quantised`` frames."""
    spark = vectors.sparkSession
    v = written(vectors, "vectors")
    norm = F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top, dim = v.agg(F.max(norm), F.max(F.size("v"))).first()
    q = queries.groupBy(F.col("vec_id")).agg(F.min("v").alias("v"))
    wide, = q.agg(F.max(F.size("v"))).first()
    dim, top = max(dim or 0, wide or 0, 1), top or 0.0
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    chosen = pivots_of(np.array([list(r[0]) + [0] * (dim - len(r[0])) for r in sample], float).reshape(-1, dim), pivots)
    sc = spark.sparkContext
    stored = written(v.mapInArrow(_table(sc.broadcast((chosen, top, dim))), "vec_id long, v array<long>, pd array<double>"), "pivots")

    q = written(q, "queries")
    n = max(1, -(-q.count() // BLOCK))
    found = None
    for b in range(n):
        rows = q.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).collect()
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        asked = np.array([list(r["v"]) + [0] * (dim - len(r["v"])) for r in rows], float).reshape(-1, dim)
        part = stored.mapInArrow(_search(sc.broadcast((ids, asked, chosen, top, dim, k))), "query_id long, vec_id long, score long")
        found = part if found is None else found.union(part)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
