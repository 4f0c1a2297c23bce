"""Exact Jaccard join of documents on 5-word shingles, by prefix trees.

Shingles are counted over all documents in hash buckets whose number grows with the corpus. A document's set is then ordered
globally: by how many documents hold a shingle (by powers of two, rare first), then by hash. Shingles that no other
document holds play no part in an overlap and stand in front of all others; only their number is kept. Two sets with a
Jaccard similarity of at least 0.8 share one of the first n - ceil(0.8 n) + 1 shingles of each (the prefix), and a set of
which more than n - ceil(0.8 n) shingles occur nowhere else has no partner at all; most documents end there.

Only connectivity is asked for, so pairs are not all tested. Equal sets are one set. Documents that share a prefix shingle
are first tested against one hub, the one with the least in front of that shingle; then every pair that shares a prefix
shingle, is of fitting length and not yet connected is tested, a shingle of many documents being cut into pairs of chunks.
No link between different components is lost.

Tests run over the candidates of one probe set in the order of their shingles, which is a walk through their prefix tree,
depth first: overlaps counted along the path that neighbours share are used again, and a subtree is left once the overlap
so far and the shorter rest cannot reach the bound.

Defined cases: A-Z are lower-cased, words are runs of bytes other than 0x20 and 0x09-0x0D; with under five words the
whole sequence is the one shingle; a null or blank text is an empty set that links with nothing; texts and words of any
length are read whole; rows that share a doc_id are one node, linked where any of their texts is; a row with a null doc_id
takes no part (component null); an empty table gives no rows; other columns play no part. Shingles are 48-bit hashes in a
bucket of their own, which an independent hash picks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import words as W
from tidewire.llm.common import connected_components, cut, edges, from_planes, pack_ids, planes, unpack_ids
from tidewire.operators.lineage import ensure_checkpoint_dir, remove_folder, shuffles_dropped

SHINGLE = 5
PERCENT = 80
BUCKET_BYTES = 6 << 20  # text behind one bucket of shingles: some million of them
SLICE_BYTES = 4 << 20
#: A shingle of more documents is cut: hubs by 2**HUB_CHUNK documents, pairs by 2**PAIR_CHUNK.
HUB_CHUNK, PAIR_CHUNK = 12, 9


def least_overlap(nx, ny):
    """The overlap o that 100 * o >= 80 * (nx + ny - o) asks for."""
    return -(-PERCENT * (nx + ny) // (100 + PERCENT))


def spare(n):
    """How many of n shingles a partner may lack."""
    return n - (PERCENT * n + 99) // 100


def shingles(part: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every row of a slice, sorted by row and hash."""
    h = part.hashes(lower=True)
    starts = W.gram_starts(part, SHINGLE)
    row, value = part.row_of_word[starts], W.grams(h, SHINGLE, salt=1)[starts] if len(starts) else np.zeros(0, np.uint64)
    counts = part.counts
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        own = []
        for k in range(1, SHINGLE):
            rows = short[counts[short] == k]
            own.append((rows, W.grams(h, k, salt=10 + k)[part.row_start[rows]] if len(rows) else np.zeros(0, np.uint64)))
        row = np.concatenate([row, *(r for r, _ in own)])
        value = np.concatenate([value, *(v for _, v in own)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])] if len(row) else np.zeros(0, bool)
    return row[new], value[new]


# --- counting shingles -----------------------------------------------------------------------------------
# Rows of many documents' numbers: ``ids`` and ``variants`` name documents, ``counts`` says how many entries each has.
SIZES, TOKENS, SHARED = 0, 1, 2
_SCHEMA = "bucket long, source long, ids binary, variants binary, counts binary, tokens binary, levels binary, kind int"
_BLOBS = ("ids", "variants", "counts", "tokens", "levels")
_ARROW = pa.schema([("bucket", pa.int64()), ("source", pa.int64()), *((n, pa.binary()) for n in _BLOBS), ("kind", pa.int32())])


def _six(x: np.ndarray) -> bytes:
    """The lower 48 bits of 64-bit numbers."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _block(who: np.ndarray, n_blocks: int) -> np.ndarray:
    return (W.mix((who[:, 0] ^ who[:, 1]).view(np.uint64)) >> np.uint64(33)).astype(np.int64) % n_blocks


def _pack(kind: int, bucket: np.ndarray, who: np.ndarray, tokens: np.ndarray, levels: np.ndarray | None = None, source: int | None = None) -> list[tuple]:
    """A row for each bucket, from entries in the order of bucket and document."""
    if not len(bucket):
        return []
    at = edges(bucket, who[:, 0], who[:, 1])
    count = np.diff(np.r_[at, len(bucket)])
    row = edges(bucket[at])
    out = []
    for i, j in zip(row.tolist(), [*row[1:].tolist(), len(at)]):
        a, b = int(at[i]), int(at[j]) if j < len(at) else len(bucket)
        out.append((int(bucket[a]), source, pack_ids(who[at[i:j], 0]), pack_ids(who[at[i:j], 1]), planes(count[i:j]), _six(tokens[a:b]), levels[a:b].tobytes() if levels is not None else None, kind))
    return out


def _owners(rows: list[dict], repeat: bool = True) -> np.ndarray:
    if not rows:
        return np.zeros((0, 2), np.int64)
    who = np.concatenate([np.stack([unpack_ids(r["ids"]), unpack_ids(r["variants"])], 1) for r in rows])
    return np.repeat(who, np.concatenate([from_planes(r["counts"]) for r in rows]), axis=0) if repeat else who


def _token_rows(n_buckets: int, n_blocks: int):
    """The size of every document's set, to its block, and its shingles, to theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.stack([np.asarray(b.column("doc_id")), np.asarray(b.column("variant"))], 1)
            for part in W.slices(b.column("text"), SLICE_BYTES):
                own = ids[part.first : part.last]
                row, value = shingles(part)
                block, n = _block(own, n_blocks), np.bincount(row, minlength=len(own))
                order = np.argsort(block, kind="stable")
                at = edges(block[order])
                rows = []
                for o in np.split(order, at[1:]):  # one entry a row of the table, whatever repeats
                    rows.append((int(block[o[0]]), None, pack_ids(own[o, 0]), pack_ids(own[o, 1]), planes(n[o]), None, None, SIZES))
                bucket = (W.mix(value) >> np.uint64(33)).astype(np.int64) % n_buckets
                order = np.argsort(bucket, kind="stable")  # by document within a bucket, as they come
                rows += _pack(TOKENS, bucket[order], own[row[order]], value[order])
                yield _batch(rows)

    return run


def _count(n_blocks: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket: shingles of several documents, with how many hold them, to the documents' blocks."""
        rows = []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == SIZES:
                    yield _batch([tuple(r[n] for n in _ARROW.names)])
                else:
                    rows.append(r)
        token = _from_six(b"".join(r["tokens"] for r in rows))
        who = _owners(rows)
        rows.clear()
        order = np.argsort(token)
        at = edges(token[order])
        size = np.diff(np.r_[at, len(order)])
        several = order[np.repeat(size > 1, size)]
        level = np.repeat(np.log2(np.maximum(size, 1)).astype(np.uint8), size)[np.repeat(size > 1, size)]
        who, token = who[several], token[several]
        block = _block(who, n_blocks)
        order = np.lexsort((who[:, 1], who[:, 0], block))
        out = _pack(SHARED, block[order], who[order], token[order], level[order], key[0].as_py())
        if out:
            yield _batch(out)

    return run


_SETS = "sid long, doc_id long, n long, alone long, twin long, tokens binary"
_SETS_ARROW = pa.schema([(n, pa.int64()) for n in ("sid", "doc_id", "n", "alone", "twin")] + [("tokens", pa.binary())])


def _sets(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block: the sets that may have a partner, their shared shingles in the global order (big-endian, so that bytes
    sort as numbers do); ``twin`` is a hash of the whole set where all of it is shared."""
    rows = [r for b in batches for r in b.to_pylist()]
    sizes, shared = [r for r in rows if r["kind"] == SIZES], [r for r in rows if r["kind"] == SHARED]
    if not shared:
        return
    docs, n = _owners(sizes, False), np.concatenate([from_planes(r["counts"]) for r in sizes]).astype(np.int64)
    who = _owners(shared)
    source = np.repeat(np.array([r["source"] for r in shared], np.uint64), [len(r["levels"]) for r in shared])
    level = np.concatenate([np.frombuffer(r["levels"], np.uint8) for r in shared]).astype(np.uint64)
    token = W.mix(_from_six(b"".join(r["tokens"] for r in shared)) + source * np.uint64(0x9E3779B97F4A7C15))
    token = (level << np.uint64(58)) | (token >> np.uint64(6))
    del rows, shared
    order = np.lexsort((token, who[:, 1], who[:, 0]))
    who, token = who[order], token[order]
    once = edges(who[:, 0], who[:, 1], token)  # a row of the table may be repeated
    who, token = who[once], token[once]
    at = edges(who[:, 0], who[:, 1])
    first = docs[order := np.lexsort((docs[:, 1], docs[:, 0]))]
    size_of = dict(zip(map(tuple, first.tolist()), n[order].tolist()))
    out = []
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(token)]):
        doc, variant = who[i].tolist()
        whole = size_of[doc, variant]
        alone = whole - (j - i)
        if alone <= spare(whole):
            sid = doc if not variant else int.from_bytes(hashlib.blake2b(who[i].tobytes(), digest_size=8).digest(), "little", signed=True)
            blob = token[i:j].astype(">u8").tobytes()
            twin = int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little", signed=True) if not alone else None
            out.append((sid, doc, whole, alone, twin, blob))
    for i in range(0, len(out), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 1024]), _SETS_ARROW)], schema=_SETS_ARROW)


def _size_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(unpack_ids(r["ids"])), pa.array(from_planes(r["counts"]).astype(np.int64))], names=["doc_id", "n_shingles"])


def _sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in W.slices(b.column("text"), SLICE_BYTES):
            n = np.bincount(shingles(part)[0], minlength=part.last - part.first)
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64))], names=["n_shingles"])


def _with_variant(texts: DataFrame) -> DataFrame:
    """Texts told apart where a doc_id has several: a column that is 0 everywhere else."""
    several = texts.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")).where("low <> high")
    several = cut(several.select("doc_id", F.lit(True).alias("several")))
    if several.isEmpty():
        return texts.withColumn("variant", F.lit(0).cast("long"))
    return texts.join(several, "doc_id", "left").select("doc_id", "text", F.when(F.col("several"), F.xxhash64("text")).otherwise(0).alias("variant"))


# --- candidates --------------------------------------------------------------------------------------------
def _postings(extra: tuple[str, ...] = ()):
    """A row for each prefix shingle that another document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, n, alone = (np.asarray(b.column(c)) for c in ("sid", "n", "alone"))
            more = [np.asarray(b.column(c)) for c in extra]
            out = [np.frombuffer(t.as_buffer(), ">i8")[: spare(int(m)) + 1 - int(k)] for t, m, k in zip(b.column("tokens"), n, alone)]
            count = np.array([len(o) for o in out], np.int64)
            if not count.sum():
                continue
            r = np.repeat(np.arange(len(out)), count)
            pos = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count) + alone[r]
            arrays = [np.concatenate(out).astype(np.int64), sid[r], n[r], pos, *(m[r] for m in more)]
            for s in range(0, len(r), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(a[s : s + (1 << 17)], pa.int64()) for a in arrays], names=["token", "sid", "n", "pos", *extra])

    return run


_POSTING = "token long, sid long, n long, pos long"


class Walk:
    """A walk through the prefix tree of sets that come in order, against one ordered set of ``nx`` shingles.

    Sets are their shared shingles only; n counts the others too.
    """

    def __init__(self, x: np.ndarray, nx: int):
        self.x, self.nx = x, nx
        self.before, self.path = np.zeros(0, np.uint64), np.zeros(1, np.int64)  # path[d]: overlap of the first d shingles

    def reaches(self, y: np.ndarray, ny: int) -> bool:
        """Whether the next set has the similarity."""
        x, need = self.x, least_overlap(self.nx, ny)
        m = min(len(self.before), len(y), len(self.path) - 1)
        apart = np.flatnonzero(self.before[:m] != y[:m])
        depth = int(apart[0]) if len(apart) else m
        path = self.path[: depth + 1]
        found = False
        while True:
            passed = int(np.searchsorted(x, y[depth - 1], "right")) if depth else 0
            if path[depth] + min(len(y) - depth, len(x) - passed) < need:
                break
            if depth == len(y):
                found = True
                break
            step = y[depth : depth + 256]
            at = np.minimum(np.searchsorted(x, step), len(x) - 1)
            path = np.concatenate([path, path[-1] + np.cumsum(x[at] == step)])
            depth += len(step)
        self.before, self.path = y, path
        return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by probe, and by the candidates' shingles within it."""
    walk, now = None, None
    for batch in batches:
        a, b, nx, ny = (np.asarray(batch.column(c)) for c in ("a", "b", "nx", "ny"))
        x, y = batch.column("x"), batch.column("y")
        keep = np.zeros(len(a), bool)
        for i in range(len(a)):
            if walk is None or a[i] != now:
                walk, now = Walk(np.frombuffer(x[i].as_buffer(), ">u8").astype(np.uint64), int(nx[i])), a[i]
            keep[i] = walk.reaches(np.frombuffer(y[i].as_buffer(), ">u8").astype(np.uint64), int(ny[i]))
        yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` (of sids) whose sets reach the similarity."""
    x = sets.select(F.col("sid").alias("a"), F.col("n").alias("nx"), F.col("tokens").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("n").alias("ny"), F.col("tokens").alias("y"))
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "nx", "ny", "x", "y")
    return both.sortWithinPartitions("a", "y").mapInArrow(_verify, "a long, b long")


def _chunks(size: int) -> Column:
    """Into how many chunks of some 2**size documents a shingle is cut; its own level says it."""
    return F.expr(f"cast(shiftleft(1L, cast(greatest(0L, shiftrightunsigned(token, 58) + 1 - {size}) as int)) as int)")


def _own_chunk(size: int) -> Column:
    return F.pmod(F.xxhash64("sid"), _chunks(size)).cast("int")


def _fits(nx: Column, ny: Column) -> Column:
    return (F.lit(100) * nx >= F.lit(PERCENT) * ny) & (F.lit(100) * ny >= F.lit(PERCENT) * nx)


def _reaches(nx: Column, px: Column, ny: Column, py: Column) -> Column:
    """At the first shingle that a pair shares, all its overlap lies from there on; a link passes there at the latest."""
    return F.lit(100 + PERCENT) * F.least(nx - px, ny - py) >= F.lit(PERCENT) * (nx + ny)


def _hub_pairs(posted: DataFrame) -> DataFrame:
    """Each set with the hub of each of its prefix shingles: the set with the least in front of it."""
    hubs = posted.groupBy("token").agg(F.min(F.struct("pos", "sid", "n")).alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    hubs = hubs.select("token", "hub", F.explode(F.sequence(F.lit(0), _chunks(HUB_CHUNK) - 1)).alias("chunk"))
    tested = posted.withColumn("chunk", _own_chunk(HUB_CHUNK)).join(hubs, ["token", "chunk"]).where(
        (F.col("hub.sid") != F.col("sid")) & _fits(F.col("hub.n"), F.col("n")) & _reaches(F.col("hub.n"), F.col("hub.pos"), F.col("n"), F.col("pos"))
    )
    return tested.select(F.col("hub.sid").alias("a"), F.col("sid").alias("b")).distinct()


def _open_pairs(posted: DataFrame) -> DataFrame:
    """Pairs that share a prefix shingle, fit in length and are not connected; ``posted`` holds each one's component."""
    open_tokens = posted.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    rows = cut(posted.join(open_tokens, "token", "left_semi").withColumn("own", _own_chunk(PAIR_CHUNK)))
    a = rows.withColumn("low", F.col("own")).withColumn("high", F.explode(F.sequence(F.col("own"), _chunks(PAIR_CHUNK) - 1))).alias("a")
    b = rows.withColumn("high", F.col("own")).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("own")))).alias("b")
    first = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.sid") < F.col("b.sid")))
    pairs = a.join(
        b,
        (F.col("a.token") == F.col("b.token")) & (F.col("a.low") == F.col("b.low")) & (F.col("a.high") == F.col("b.high"))
        & (F.col("a.component") != F.col("b.component")) & ((F.col("a.low") < F.col("a.high")) | first)
        & _fits(F.col("a.n"), F.col("b.n")) & _reaches(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos")),
    )
    return pairs.select(F.when(first, F.col("a.sid")).otherwise(F.col("b.sid")).alias("a"), F.when(first, F.col("b.sid")).otherwise(F.col("a.sid")).alias("b")).distinct()


def _components(texts: DataFrame, n_bytes: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, component_id) of linked documents, (doc_id, n_shingles) of every row)."""
    spark = texts.sparkSession
    n_buckets = max(8, -(-n_bytes // BUCKET_BYTES))
    n_blocks = max(4, n_buckets // 2)
    counted = _with_variant(texts).mapInArrow(_token_rows(n_buckets, n_blocks), _SCHEMA).groupBy("bucket").applyInArrow(_count(n_blocks), _SCHEMA)
    with shuffles_dropped(spark):
        counted.write.partitionBy("kind").option("compression", "zstd").parquet(folder)
    counted = spark.read.schema(_SCHEMA).parquet(folder)
    sizes = cut(counted.where(F.col("kind") == SIZES).mapInArrow(_size_rows, "doc_id long, n_shingles long"))
    live = cut(counted.groupBy("bucket").applyInArrow(_sets, _SETS))
    remove_folder(spark, folder)
    # Equal sets are one: the rest of each group hangs on its smallest sid.
    twins = live.where("twin is not null").groupBy("twin", "n").agg(F.min(F.struct("sid", "doc_id")).alias("first"))
    with_first = live.join(twins, ["twin", "n"], "left")
    sets = cut(with_first.where("first is null or first.sid = sid").select("sid", "doc_id", "n", "alone", "tokens"))
    equal = with_first.where("first.sid <> sid").select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b"))

    tested = cut(_hub_pairs(sets.mapInArrow(_postings(), _POSTING)))
    stars = connected_components(_linked(tested, sets))
    known = sets.join(stars.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    pairs = _open_pairs(known.mapInArrow(_postings(("component",)), _POSTING + ", component long"))
    either = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = _linked(pairs.join(either, ["a", "b"], "left_anti"), sets)
    links = stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)
    doc_of = sets.select("sid", "doc_id")
    links = links.join(doc_of.select(F.col("sid").alias("a"), F.col("doc_id").alias("doc_a")), "a").join(doc_of.select(F.col("sid").alias("b"), F.col("doc_id").alias("doc_b")), "b")
    found = connected_components(links.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).unionByName(equal))
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), sizes


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = texts.where("doc_id is not null")
    n_bytes = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found, sizes = _components(known, n_bytes, f"{ensure_checkpoint_dir(spark)}/shingles-{uuid.uuid4().hex}")
    rows = sizes.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = texts.where("doc_id is null").select("text").mapInArrow(_sizes_of, "n_shingles long")
    return rows.unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))
