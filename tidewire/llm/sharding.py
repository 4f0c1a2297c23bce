"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Units of placement ("bundles") are bounded in number: groups of equal texts that are small are gathered by hash
into ``n_shards * bundles_per_shard`` bundles, and groups beyond a share of a shard stand alone, cut into chunks by
doc_id, so that a group of copies that holds a third of all rows is spread. Only the bundles' three sums reach the
driver (at most some tens of thousands of rows, whatever the input); each bundle goes to the shard where the dot
product of its vector with the residual capacity is highest.

Defined cases: a null text has no bytes and no words and is a group of its own (all null texts); an empty table gives
no rows; repeated rows each get a slot; a null doc_id is placed as any other value; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import cut

#: A group of equal texts is cut where it exceeds this share of a shard in bytes, tokens or rows.
WHOLE_GROUP_SHARE = 1 / 8


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each row of ``vectors`` (bytes, tokens, rows), largest first, by dot product with what is left."""
    total = np.maximum(vectors.sum(axis=0), 1).astype(float)
    v = vectors / total * n_shards  # a shard's fair share is 1 in each dimension
    left = np.ones((n_shards, v.shape[1]))
    out = np.zeros(len(v), np.int64)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        fits = (left >= v[i] - 1e-12).all(axis=1)
        score = left @ v[i]
        if fits.any():
            score = np.where(fits, score, -np.inf)
        s = int(score.argmax())
        out[i] = s
        left[s] -= v[i]
    return _even(vectors, out, n_shards)


def _even(vectors: np.ndarray, shard: np.ndarray, n_shards: int) -> np.ndarray:
    """Move or swap single bundles between the heaviest and the lightest shard (in bytes) while that helps."""
    size = vectors[:, 0].astype(np.int64)
    load = np.bincount(shard, size, n_shards).astype(np.int64)
    for _ in range(40 * n_shards):
        a, b = int(load.argmax()), int(load.argmin())
        gap = int(load[a] - load[b])
        ia, ib = np.flatnonzero(shard == a), np.flatnonzero(shard == b)
        if gap < 2 or not len(ia):
            break
        other = np.sort(np.r_[0, size[ib]])  # 0: a plain move
        want = size[ia] - gap // 2
        near = np.clip(np.searchsorted(other, want), 1, len(other)) - 1
        near = np.where((near + 1 < len(other)) & (abs(other[np.minimum(near + 1, len(other) - 1)] - want) < abs(other[near] - want)), near + 1, near)
        shift = size[ia] - other[near]
        gain = np.where((shift > 0) & (shift < gap), np.minimum(shift, gap - shift), 0)
        k = int(gain.argmax())
        if gain[k] <= 0:
            break
        if other[near[k]] > 0:
            shard[ib[np.flatnonzero(size[ib] == other[near[k]])[0]]] = a
        shard[ia[k]] = b
        load[a] -= shift[k]
        load[b] += shift[k]
    return shard


def shard_documents(docs: DataFrame, n_shards: int = 24, bundles_per_shard: int = 256) -> DataFrame:
    """doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("tokens"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64("text").alias("grp"),
        )
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("toks"), F.count(F.lit(1)).alias("n")]
    total = digest.agg(*sums).first()
    if not total.n:
        total = spark.createDataFrame([(1, 1, 1)], "bytes long, toks long, n long").first()
    n_bundles = n_shards * bundles_per_shard
    share = F.greatest(*[F.col(c) / F.lit(max(1, total[c]) / n_shards) for c in ("bytes", "toks", "n")])
    groups = digest.groupBy("grp").agg(*sums).withColumn("share", share)
    # At most 3 * n_bundles groups can hold 1 / n_bundles of one of the three totals: a bounded broadcast.
    heavy = groups.where(F.col("share") > 1 / bundles_per_shard).select(
        "grp", F.least("n", F.ceil(F.col("share") / WHOLE_GROUP_SHARE)).alias("chunks")
    )
    unit = F.when(
        F.col("chunks").isNull(), F.pmod(F.col("grp"), F.lit(n_bundles))
    ).otherwise(F.xxhash64("grp", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))))
    placed = cut(digest.join(F.broadcast(heavy), "grp", "left").withColumn("bundle", unit).drop("grp", "chunks"))
    bundles = placed.groupBy("bundle").agg(*sums).orderBy("bundle").collect()
    vectors = np.array([[b.bytes, b.toks, b.n] for b in bundles], np.int64).reshape(-1, 3)
    shard = place(vectors, n_shards)
    filled, plan = [0] * n_shards, []
    for b, s in zip(bundles, shard.tolist()):
        plan.append((b.bundle, s, filled[s]))
        filled[s] += b.n
    where = spark.createDataFrame(plan, "bundle long, shard int, before long")
    rank = F.row_number().over(Window.partitionBy("bundle").orderBy("doc_id", "text_crc32"))
    return placed.join(F.broadcast(where), "bundle").select(
        "doc_id",
        "size",
        "tokens",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + rank - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
