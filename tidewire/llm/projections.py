"""Approximate nearest neighbours by cosine: stable projections in a kd-tree, verified until a chi-square test holds.

Vectors of length 1 are projected to a few dimensions by random normal (2-stable) directions. The squared distance of two
projections, over the squared distance of the vectors, follows a chi-square distribution with as many degrees of freedom as
there are directions. So projected neighbours are verified in the order of their distance, and once the next one is at r
while the k-th best verified neighbour is at d, a neighbour better than that is still unseen with a probability of at most
1 - chi2(r^2 / d^2) only; where that is below 1 - ``certainty``, the query stops.

The kd-tree has two parts. Its top is fixed by the projections of a bounded sample (``sample`` rows in the order of a hash)
and has at most ``cells`` leaves; every row is sent to its cell, and a cell is dealt into blocks of about ``block`` rows, as
many as it needs. A block holds the rest of the tree over its rows, as arrays. A query first searches one block of its own
cell, which gives it a distance to beat; then it goes to the blocks of all cells whose bounding box its radius reaches. A
task holds one block and at most ``query_block`` queries. To the driver go the sample's projections and, for each cell,
its size and its box.

Equal vectors are one: with its k + 1 smallest ids every other query is answered, and equal queries are searched once. So a
vector that a third of all rows share costs as much as any other. The score is the cosine of the original vectors in double
precision, each scaled by a power of two first so that no square overflows.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components take no part, as rows without an
id; vectors are compared with those of their own length; repeated rows (id and vector) count once, an id with several
vectors is one query and one candidate (its best score counts); a query is not compared with rows of its own id; with fewer
candidates than k all found are returned; ties go to the smaller id; an empty table gives no rows; other columns play no
part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import cut

LEAF = 32
#: Rounding allowed for in squared distances.
SLACK = 1e-9


def chi2_cdf(x: float, m: int) -> float:
    """The chi-square distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, m) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, m) < p else (low, middle)
    return high


def directions(dim: int, m: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest component of each is between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


# --- the tree ------------------------------------------------------------------------------------------
class Top:
    """Splits of the top of the tree: node i has the children 2i and 2i + 1, cells are the nodes of the last level."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.at = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        members = {1: points}
        for node in range(1, 1 << levels):
            own = members.pop(node)
            if len(own):
                self.axis[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
                self.at[node] = np.median(own[:, self.axis[node]])
            right = own[:, self.axis[node]] > self.at[node]
            members[2 * node], members[2 * node + 1] = own[~right], own[right]

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - (1 << self.levels)


def reach(least: float, factor: float) -> float:
    """The squared radius within which a neighbour with a score above ``least`` is projected (-2: there is none to beat)."""
    return max(0.0, 2 - 2 * least) * factor + SLACK if least > -2 else math.inf


def gap(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    away = np.maximum(np.maximum(low - p, p - high), 0)
    return (away * away).sum(axis=-1)


class Block:
    """The rows of a block in the order of a kd-tree; ``search`` verifies projected neighbours until the test holds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, p: np.ndarray):
        n = len(ids)
        self.levels = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
        order = np.arange(n)
        for level in range(self.levels):
            at = self.bounds(level, n)
            for a, b in zip(at, at[1:]):
                if b - a > 1:
                    own = p[order[a:b]]
                    axis = np.argmax(own.max(axis=0) - own.min(axis=0))
                    order[a:b] = order[a:b][np.argsort(own[:, axis], kind="stable")]
        self.ids, self.x, self.p = ids[order], x[order], p[order]
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.boxes = []
        for level in range(self.levels + 1):
            at = self.bounds(level, n)
            full = np.diff(at) > 0
            low, high = np.full((len(full), p.shape[1]), np.inf), np.full((len(full), p.shape[1]), -np.inf)
            if n:
                low[full], high[full] = np.minimum.reduceat(self.p, at[:-1][full]), np.maximum.reduceat(self.p, at[:-1][full])
            self.boxes.append((low, high))
        self.verified = 0

    @staticmethod
    def bounds(level: int, n: int) -> np.ndarray:
        return np.arange((1 << level) + 1) * n >> level

    def reached(self, p: np.ndarray, radius: float) -> np.ndarray:
        """Rows of the leaves whose box a radius (squared) reaches."""
        nodes = np.zeros(1, np.int64)
        for level in range(self.levels + 1):
            low, high = self.boxes[level]
            nodes = nodes[gap(p, low[nodes], high[nodes]) <= radius]
            if level < self.levels:
                nodes = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel()
        at = self.bounds(self.levels, len(self.ids))
        size = at[nodes + 1] - at[nodes]
        return np.repeat(at[nodes] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))

    def search(self, q: np.ndarray, p: np.ndarray, k: int, least: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows) of the k best neighbours of ``q`` with scores of ``least`` or more.

        ``factor`` is the chi-square quantile: reading stops where the next projected neighbour is at more than ``factor``
        times the squared distance of the k-th best so far.
        """
        rows = self.reached(p, reach(least, factor))
        away = ((self.p[rows] - p) ** 2).sum(axis=1)
        near = away <= reach(least, factor)
        rows, away = rows[near], away[near]
        order = np.argsort(away)
        rows, away = rows[order], away[order]
        norm = math.sqrt(float(q @ q))
        best, of, done, step = np.zeros(0), np.zeros(0, np.int64), 0, 4 * k
        while done < len(rows):
            end = min(done + step, int(np.searchsorted(away, reach(least, factor), "right")))
            if end <= done:
                break  # the test holds
            part = rows[done:end]
            self.verified += len(part)
            score = np.einsum("ij,j->i", self.x[part], q) / (self.norm[part] * norm)
            good = score >= least
            best, of = np.r_[best, score[good]], np.r_[of, part[good]]
            if len(best) > k:
                order = np.lexsort((self.ids[of], -best))[:k]
                best, of = best[order], of[order]
            if len(best) == k:
                least = max(least, float(best.min()))
            done, step = end, 2 * step
        return best, of


# --- the tables ----------------------------------------------------------------------------------------
_POINT = "id long, dim int, cell int, x array<double>, p array<double>"
_BLOCK = "dim int, cell int, salt int, ids binary, x binary, p binary, low array<double>, high array<double>"
_ASKED = "id long, dim int, x array<double>, p array<double>, least double"
_FOUND = "q_id long, id long, score double"


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))


def _project(m: int, top: Top | None):
    """(id, x) to points: scaled components, projection of the unit vector, and the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("x")
            size = np.diff(np.asarray(column.offsets))
            for dim in np.unique(size).tolist():
                own = pa.array(np.flatnonzero(size == dim))
                x = scaled(np.asarray(column.take(own).flatten()).reshape(len(own), dim))
                p = unit(x) @ directions(dim, m)
                cell = top.cell(p) if top else np.zeros(len(p))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(own), pa.array(np.full(len(p), dim, np.int32)), pa.array(cell.astype(np.int32)), _lists(x), _lists(p)], names=["id", "dim", "cell", "x", "p"]
                )

    return run


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1)


def _build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(np.asarray(b.column("id")), _rows(b.column("x"), len(b)), _rows(b.column("p"), len(b))) for b in batches if len(b)]
    ids, x, p = (np.concatenate(a) for a in zip(*parts))
    yield pa.RecordBatch.from_arrays(
        [*(pa.array([k.as_py()], pa.int32()) for k in key), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, x, p)), _lists(p.min(axis=0)[None]), _lists(p.max(axis=0)[None])],
        names=["dim", "cell", "salt", "ids", "x", "p", "low", "high"],
    )


def _open(blocks: pa.Table, m: int) -> Block | None:
    if not len(blocks):
        return None
    b = blocks.to_pylist()[0]
    ids = np.frombuffer(b["ids"], np.int64)
    return Block(ids, np.frombuffer(b["x"], np.float64).reshape(len(ids), -1), np.frombuffer(b["p"], np.float64).reshape(-1, m))


def _seed(k: int, m: int, factor: float):
    """The queries, with the neighbours that one block of their own cell gives, and the score to beat (-2: none)."""

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        queries = queries.combine_chunks()
        block, least = _open(blocks, m), np.full(len(queries), -2.0)
        ids: list[list[int]] = [[] for _ in range(len(queries))]
        scores: list[list[float]] = [[] for _ in range(len(queries))]
        if block and len(queries):
            for i, (q, p) in enumerate(zip(_rows(queries.column("x").combine_chunks(), len(queries)), _rows(queries.column("p").combine_chunks(), len(queries)))):
                best, rows = block.search(q, p, k, -2.0, factor)
                ids[i], scores[i] = block.ids[rows].tolist(), best.tolist()
                least[i] = best.min() if len(best) == k else -2.0
        for name, values in (("least", pa.array(least)), ("ids", pa.array(ids, pa.list_(pa.int64()))), ("scores", pa.array(scores, pa.list_(pa.float64())))):
            queries = queries.append_column(name, values)
        return queries.select(["id", "dim", "x", "p", "least", "ids", "scores"])

    return run


def _route(low: np.ndarray, high: np.ndarray, salts: np.ndarray, chunks: int, factor: float):
    """One row for every block that a query must search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (p, least) in enumerate(zip(_rows(b.column("p"), len(b)) if len(b) else [], b.column("least").to_pylist())):
                cells = np.flatnonzero((salts > 0) & (gap(p, low, high) <= reach(least, factor)))
                cell = np.repeat(cells, salts[cells])
                salt = np.arange(len(cell)) - np.repeat(np.cumsum(salts[cells]) - salts[cells], salts[cells])
                rows = b.slice(i, 1).take(pa.array(np.zeros(len(cell), np.int64)))
                chunk = np.full(len(cell), b.column("id")[i].as_py() // 64 % chunks)
                for name, values in (("cell", cell), ("salt", salt), ("chunk", chunk)):
                    rows = rows.append_column(name, pa.array(values.astype(np.int32)))
                yield rows

    return run


def _verify(k: int, m: int, factor: float):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        block, ids, of, score = _open(blocks, m), [], [], []
        if block and len(queries):
            queries = queries.combine_chunks()
            x, p = (_rows(queries.column(c).combine_chunks(), len(queries)) for c in ("x", "p"))
            for q_id, least, q, at in zip(queries.column("id").to_pylist(), queries.column("least").to_pylist(), x, p):
                best, rows = block.search(q, at, k, least, factor)
                of += [q_id] * len(rows)
                ids += block.ids[rows].tolist()
                score += best.tolist()
        return pa.table({"q_id": pa.array(of, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def _best(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def neighbours(
    vectors: DataFrame, is_query: Column, k: int = 5, m: int = 8, certainty: float = 0.97, block: int = 8192, cells: int = 1024, sample: int = 16384, query_block: int = 4096
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row of ``vectors(vec_id, embedding)``, by cosine.

    ``m`` directions (an even number); ``certainty`` is the chi-square test's and about the recall that can be expected.
    """
    factor, more = chi2_quantile(certainty, m), k + 1
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    good = vectors.where("vec_id is not null and embedding is not null").where(~bad & F.exists("embedding", lambda v: v != 0))
    good = good.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda v: v + 0.0).alias("x"), is_query.alias("is_query")).groupBy("x", "id").agg(F.max("is_query").alias("is_query"))
    asked = good.where("is_query").select("id", "x")
    alike = Window.partitionBy("x").orderBy("id")
    members = cut(_best(good.withColumn("of", F.first("id").over(alike)), "x", [F.col("id")], more).select("of", "id", "rank", F.when(F.col("rank") == 1, F.col("x")).alias("x")))
    classes = members.where("rank = 1").select("id", "x")
    q_class = cut(asked.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    n, n_queries = classes.count(), q_class.count()
    spark = vectors.sparkSession
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    levels = min(int(math.log2(cells)), max(0, math.ceil(math.log2(n / block))))
    drawn = classes.orderBy(F.xxhash64("id")).limit(sample).mapInArrow(_project(m, None), _POINT).select("p")
    top = Top(np.array([r.p for r in drawn.collect()]).reshape(-1, m), levels) if levels else Top(np.zeros((0, m)), 0)
    points = cut(classes.mapInArrow(_project(m, top), _POINT))
    salts = np.zeros(1 << levels, np.int64)
    for r in points.groupBy("cell").count().collect():
        salts[r.cell] = -(-r["count"] // block)
    of_cell = F.array(*(F.lit(int(s)) for s in salts))

    def salted(rows: DataFrame) -> DataFrame:
        return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.greatest(F.get(of_cell, F.col("cell")), F.lit(1))).cast("int"))

    blocks = cut(salted(points).groupBy("dim", "cell", "salt").applyInArrow(_build, _BLOCK))
    low, high = np.full((1 << levels, m), np.inf), np.full((1 << levels, m), -np.inf)
    sides = [F.min(F.get("low", F.lit(i))) for i in range(m)] + [F.max(F.get("high", F.lit(i))) for i in range(m)]
    for r in blocks.groupBy("cell").agg(*sides).collect():
        low[r.cell], high[r.cell] = r[1 : m + 1], r[m + 1 :]

    key = ["dim", "cell", "salt"]
    homes = salted(q_class.mapInArrow(_project(m, top), _POINT)).groupBy(*key)
    seeds = cut(blocks.groupBy(*key).cogroup(homes).applyInArrow(_seed(more, m, factor), f"{_ASKED}, ids array<long>, scores array<double>"))
    chunks = max(1, -(-n_queries // query_block))
    sent = seeds.drop("ids", "scores").mapInArrow(_route(low, high, salts, chunks, factor), f"{_ASKED}, cell int, salt int, chunk int")
    copies = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    found = copies.groupBy(*key, "chunk").cogroup(sent.groupBy(*key, "chunk")).applyInArrow(_verify(more, m, factor), _FOUND)

    first = seeds.select(F.col("id").alias("q_id"), F.explode(F.arrays_zip("ids", "scores")).alias("s")).select("q_id", F.col("s.ids").alias("id"), F.col("s.scores").alias("score"))
    nearest = _best(found.unionByName(first).groupBy("q_id", "id").agg(F.max("score").alias("score")), "q_id", [F.desc("score"), F.col("id")], more).select("q_id", F.col("id").alias("of"), "score")
    nearest = nearest.join(members.select("of", "id"), "of")
    nearest = cut(_best(nearest, "q_id", [F.desc("score"), F.col("id")], more).select("q_id", F.col("id").alias("vec_id"), "score"))
    single = q_class.where("n = 1").select(F.col("id").alias("q_id"), F.col("id").alias("query_id"))
    shared = asked.join(q_class.where("n > 1").select("x", F.col("id").alias("q_id")), "x").select("q_id", F.col("id").alias("query_id"))
    pairs = single.unionByName(shared).join(nearest, "q_id").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _best(pairs, "query_id", [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
