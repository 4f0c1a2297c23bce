"""Exact top-k search by no-random-access aggregation of sorted lists.

Each component is a list of candidates in the order of their values; a query reads the lists from the end that its sign
favours, all to the same depth. What it has read of a candidate counts as it is; a value not yet read lies between the
last one read from that list and the list's far end. So every candidate has a lower and an upper bound of its score; once
the k-th best score so far (or the k-th best lower bound, while there are no scores yet) is above the upper bounds of all but
a few candidates, nobody else can qualify, reading stops, and the scores of the few are resolved. Else reading goes on, at
the latest to the ends of the lists.

Candidates are dealt in blocks of rows, each with its own lists; a task holds one block of queries and reads the candidate
blocks of one group one after the other, with the k best of each query so far. Nothing is broadcast, and no task holds more
than two blocks; a window keeps the k best of all groups. The bounds of many queries at one depth are matrix products over
"the value if read, else the last one read". Sums are of integers and exact.

Defined cases: vectors that are null or hold null or non-finite components take no part, as rows without an id; vectors
are compared with those of their own length, empty ones with a score of 0; repeated rows (id and vector) count once; a
query is not compared with rows of its own id; with fewer candidates than k all are returned; ties go to the smaller id;
an empty table gives no rows; other columns play no part; a sum beyond 64 bits is shown as the largest or smallest long
(and ranked by its true value within a group of blocks).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = float(1 << 53)
#: Depths at which a query looks at its bounds, as shares of a list.
DEPTHS = (1 / 32, 1 / 8, 3 / 8)

_BLOCK = "dim int, block long, ids binary, cells binary, width int"


def _pack_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one block as two arrays: ids, and components as integers of the least width that holds them."""
    ids, cells = [], []
    for b in batches:
        ids.append(np.asarray(b.column("vec_id")))
        cells.append(np.asarray(b.column("cells").flatten()))
    all_cells = np.concatenate(cells).astype(np.int64)
    low, high = int(all_cells.min(initial=0)), int(all_cells.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
         pa.array([all_cells.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([width], pa.int32())], names=["dim", "block", "ids", "cells", "width"]
    )


class Search:
    """The k best candidates of each query over the blocks read so far (``add``); ``entries`` counts what was read."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, k: int):
        self.q, self.q_ids, self.k = q, q_ids, k
        self.of, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least: list = [None] * len(q)  # the k-th best score of a query that has k
        self.entries = self.stopped = 0

    def add(self, x: np.ndarray, x_ids: np.ndarray) -> None:
        n, dim = x.shape
        big = float(np.abs(self.q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, dim)
        kind = np.float64 if big < EXACT else (np.int64 if big < 2**62 else object)
        nothing = {np.float64: -np.inf, np.int64: np.iinfo(np.int64).min, object: -(1 << 200)}[kind]
        xs, q = x.astype(kind), self.q.astype(kind)
        up, down = np.maximum(q, 0).T, np.minimum(q, 0).T  # lists read from the top, lists read from the bottom
        lists = np.sort(xs, axis=0)
        own = x_ids[:, None] == self.q_ids[None, :]
        least = np.array([nothing if s is None else s for s in self.least], kind)
        alive = np.arange(len(q))
        depth = 0
        for share in DEPTHS if dim and n > 8 * self.k else ():
            if not len(alive):
                break
            depth = max(1, int(n * share))
            top, bottom = lists[n - depth], lists[depth - 1]  # the last values read
            high = np.maximum(xs, top) @ up[:, alive] + np.minimum(xs, bottom) @ down[:, alive]
            bound = least[alive]
            none = np.flatnonzero(bound == nothing)
            if len(none):  # no k scores yet: the k-th best lower bound
                low = np.where(xs >= top, xs, lists[0]) @ up[:, alive[none]] + np.where(xs <= bottom, xs, lists[-1]) @ down[:, alive[none]]
                low[own[:, alive[none]]] = nothing
                bound[none] = self._kth(low)
            inside = (high >= bound) & ~own[:, alive]
            few = inside.sum(axis=0) <= max(4 * self.k, n // 16)
            if few.any():
                at, of = np.nonzero(inside[:, few])
                of = alive[few][of]
                for i in range(0, len(at), 1 << 18):
                    a, o = at[i : i + (1 << 18)], of[i : i + (1 << 18)]
                    self._keep(o, x_ids[a], (xs[a] * q[o]).sum(axis=1))
                self.entries += int(few.sum()) * depth * dim
                self.stopped += int(few.sum())
                alive = alive[~few]
        if len(alive):  # to the ends of the lists
            score = xs @ q[alive].T if dim else np.zeros((n, len(alive)), kind)
            score[own[:, alive]] = nothing
            bound = np.maximum(self._kth(score), least[alive])
            at, of = np.nonzero((score >= bound) & ~own[:, alive])
            self.entries += len(alive) * n * dim
            self._keep(alive[of], x_ids[at], score[at, of])

    def _kth(self, score: np.ndarray) -> np.ndarray:
        """The k-th largest of every column (the least one of a shorter column)."""
        at = max(0, len(score) - self.k)
        return (np.sort(score, axis=0) if score.dtype == object else np.partition(score, at, axis=0))[at]

    def _keep(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take scores in, and keep the k best of each query."""
        exact = [int(s) for s in scores] if scores.dtype == object else scores.astype(np.int64)
        whole = object if object in (scores.dtype, self.scores.dtype) else np.int64
        of, ids, scores = np.r_[self.of, of], np.r_[self.ids, ids], np.concatenate([self.scores.astype(whole), np.array(exact, whole)])
        if whole is object:
            order = np.array(sorted(range(len(of)), key=lambda i: (of[i], -scores[i], ids[i])), np.int64)
        else:
            order = np.lexsort((ids, ~scores, of))  # ~s falls as s grows, without overflow
        of, ids, scores = of[order], ids[order], scores[order]
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        rank = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
        best = rank < self.k
        self.of, self.ids, self.scores = of[best], ids[best], scores[best]
        for i, s in zip(of[rank == self.k - 1].tolist(), scores[rank == self.k - 1].tolist()):
            self.least[i] = s

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, candidate id, score as a long)."""
        scores = np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in self.scores], np.int64) if self.scores.dtype == object else self.scores
        return self.q_ids[self.of], self.ids, scores


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["cells"], f"<i{row['width']}").reshape(len(ids), row["dim"]).astype(np.int64)


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        candidates = sorted((r for r in rows if not r["is_query"]), key=lambda r: r["block"])
        for r in rows:
            if r["is_query"] and candidates:
                q_ids, q = _arrays(r)
                search = Search(q, q_ids, k)
                for c in candidates:
                    x_ids, x = _arrays(c)
                    search.add(x, x_ids)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in search.result()], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, query_block: int = 512, block: int = 4096, group: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of every query row of ``vectors(vec_id, embedding)``.

    A task reads ``group`` blocks of candidates for one block of queries.
    """
    cells = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    good = vectors.where("vec_id is not null and embedding is not null").where(~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), cells.alias("cells"), F.size("embedding").alias("dim"), is_query.alias("is_query")
    )
    good = good.dropDuplicates(["vec_id", "cells"])
    counts = good.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).first()
    n_blocks, n_query_blocks = max(1, -(-counts.n // block)), max(1, -(-(counts.q or 0) // query_block))

    def blocks(rows: DataFrame, n: int) -> DataFrame:
        keyed = rows.select("vec_id", "cells", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"))
        return keyed.groupBy("dim", "block").applyInArrow(_pack_block, _BLOCK)

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    n_groups = -(-n_blocks // group)
    queries = blocks(good.where("is_query"), n_query_blocks).withColumn("query_block", F.col("block")).withColumn("part", each(n_groups))
    candidates = blocks(good, n_blocks).withColumn("query_block", each(n_query_blocks)).withColumn("part", F.pmod("block", F.lit(n_groups)))
    pairs = queries.withColumn("is_query", F.lit(True)).unionByName(candidates.withColumn("is_query", F.lit(False)))
    found = pairs.groupBy("dim", "query_block", "part").applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
