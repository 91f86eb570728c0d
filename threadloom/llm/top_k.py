r"""Exact top-k by inner product, with Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are made whole numbers, floor(scale * x), so scores are exact. Candidates are dealt into blocks of about BLOCK rows,
and each block keeps its vectors sorted along every dimension. For a query, the lists are read from their good ends (the
largest values where the query's component is positive, the smallest where it is negative), a stretch of each list at a time
and twice as deep each time; every vector that comes up is scored at once. The bound of what is still unseen is the score of
a vector made of the lists' values at that depth, and reading stops when the bound is below the k-th best score so far.
At equality it goes on, as an unseen vector of the same score may have a smaller id.

The queries are a stated set, compared with all rows block by block. A query first meets the block that it lies in; the k-th
score there is a floor for all other blocks, whose lists so may stop before they have k rows of their own. Then bundles of
BUNDLE queries meet the other blocks, one bundle and one block in a task. Each block passes on k rows for each query at most.

Defined results: vectors that are null, empty, or hold a null or a component that is not finite take no part, as query or as
candidate, nor do rows without an id. Vectors are compared only with vectors of their own length. Equal (id, vector) rows
count once; rows that share an id count as that id's own, of which the best score counts, and are not its candidates. Ties go
to the smaller id. Fewer candidates than k give fewer rows. Components and scores beyond 64 bits count as the greatest or
least number of 64 bits. Other columns take no part, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import parts, settled

K, EVERY, SCALE = 5, 50, 256
#: Candidates in a block, and queries in a bundle.
BLOCK, BUNDLE = 8192, 8192
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
#: Depth of the first stretch of each list.
FIRST = 32


def whole(column: str, scale: int = SCALE) -> F.Column:
    """The vector in whole numbers, or null where it takes no part."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(finite & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * scale)))


class Block:
    """Vectors sorted by id, and along every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors.T, self.lists, axis=1)
        self.exact = self.vectors.astype(np.float64)
        self.most = max(int(self.vectors.max(initial=0)), -int(self.vectors.min(initial=0)))
        #: where each id's rows begin, if some id has several
        starts = np.flatnonzero(np.r_[True, self.ids[1:] != self.ids[:-1]][: len(self.ids)])
        self.starts = starts if len(starts) < len(self.ids) else None

    def _scorer(self, q: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """Scores of some rows. In doubles where all sums are exact, else in 64 bits, else in whole numbers of any size."""
        most = sum(abs(x) for x in q.tolist()) * self.most
        if most < 1 << 53:
            real = q.astype(np.float64)
            return lambda rows: np.rint(self.exact[rows] @ real).astype(np.int64)
        if most <= GREATEST:
            return lambda rows: self.vectors[rows] @ q
        large = q.astype(object)
        return lambda rows: np.array([min(GREATEST, max(LEAST, x)) for x in (self.vectors[rows].astype(object) @ large).tolist()], np.int64)

    def top(self, query_id: int, q: np.ndarray, k: int, first: int = FIRST, floor: int = LEAST) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) of at least `floor`, one for each id, and how deep the lists were read."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        own = self.ids == query_id
        seen, scores, score = own.copy(), np.full(n, LEAST, np.int64), self._scorer(q)
        up = q[dims] > 0
        rows, weights, depth = self.lists[dims], q[dims].tolist(), 0
        while depth < n:
            until = min(n, max(first, 2 * depth)) if len(dims) else n
            mask = np.zeros(n, bool)
            if len(dims):
                mask[rows[up, n - until : n - depth].ravel()] = True
                mask[rows[~up, depth:until].ravel()] = True
            else:
                mask[:] = True
            new = np.flatnonzero(mask & ~seen)
            seen[new] = True
            scores[new] = score(new)
            depth = until
            if depth >= n:
                break
            frontier = np.where(up, self.values[dims, n - depth], self.values[dims, depth - 1]).tolist()
            among = scores[self._best_rows(seen & ~own, scores)]
            known = len(among)
            kth = max(floor, int(np.partition(among, known - k)[known - k]) if known >= k else LEAST)
            if max(LEAST, sum(w * f for w, f in zip(weights, frontier, strict=True))) < kth:
                break
        at = self._best_rows(seen & ~own, scores)
        if len(at) > k:  # all that may be among the best: those at or above the k-th score
            s = scores[at]
            at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
        best = at[np.lexsort((self.ids[at], ~scores[at]))][:k]
        return [(int(scores[i]), int(self.ids[i])) for i in best if scores[i] >= floor], depth

    def _best_rows(self, some: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The marked rows; where an id has several, its best one alone."""
        at = np.flatnonzero(some)
        if self.starts is None or not len(at):
            return at
        at = at[np.lexsort((scores[at], self.ids[at]))]
        return np.sort(at[np.r_[self.ids[at][1:] != self.ids[at][:-1], True]])


FOUND = "query_id long, vec_id long, score long"


def _matrix(table: pa.Table) -> np.ndarray:
    v = table.column("v").combine_chunks()
    return np.asarray(v.flatten(), np.int64).reshape(len(v), -1) if len(v) else np.zeros((0, 0), np.int64)


def _found(rows: list[tuple[int, int, int]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, bundle: int = BUNDLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best other rows."""
    taken = settled(
        vectors.select(F.col(id_col).cast("long").alias("id"), whole(vector_col, scale).alias("v"))
        .where("id is not null and v is not null").withColumn("dims", F.size("v")).dropDuplicates(["id", "v"]),
        "top-k-vectors",
    )
    blocks = parts(taken, block)
    dealt = taken.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))

    def own(key: tuple, table: pa.Table) -> pa.Table:
        b, size = Block(np.asarray(table.column("id"), np.int64), _matrix(table)), key[1].as_py()
        asked = np.flatnonzero(b.ids % every == 0)
        best = [b.top(int(b.ids[i]), b.vectors[i], k)[0] for i in asked.tolist()]
        ids, found = b.ids[asked], pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))
        cols = [ids, pa.array([b.vectors[i] for i in asked.tolist()], pa.list_(pa.int64())), np.full(len(asked), key[0].as_py(), np.int32), np.full(len(asked), size, np.int32)]
        floors = [x[-1][0] if len(x) == k else LEAST for x in best]
        return pa.table([*cols, pa.array(floors, pa.int64()), pa.array([[{"score": s, "vec_id": i} for s, i in x] for x in best], found)], names=["id", "v", "block", "dims", "floor", "best"])

    queries = settled(dealt.groupBy("block", "dims").applyInArrow(own, "id long, v array<long>, block int, dims int, floor long, best array<struct<score:long,vec_id:long>>"), "top-k-queries")
    near = queries.select(F.col("id").alias("query_id"), F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.score")
    # every bundle of queries meets every block but their own once: the stated set against all rows
    bundles = parts(queries, bundle)
    asked = queries.select("id", "v", "dims", "floor", F.pmod(F.xxhash64("id", "v"), F.lit(bundles)).cast("int").alias("bundle"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != F.col("block"))).alias("block"))
    others = dealt.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            b = Block(np.asarray(left.column("id"), np.int64), _matrix(left))
            for i, q, floor in zip(right.column("id").to_pylist(), _matrix(right), right.column("floor").to_pylist(), strict=True):
                out += [(i, j, s) for s, j in b.top(i, q, k, floor=floor)[0]]
        return _found(out)

    key = ["block", "bundle", "dims"]
    near = near.unionByName(others.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search, FOUND))
    # rows that share an id may have met a query more than once
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
