"""Substring deduplication over 13-word windows with a log-structured fingerprint index.

The index is a folder of immutable runs, each a Parquet table. A run holds, by hash bucket, the sorted fingerprints of the
windows that a batch of documents brought in; a window's fingerprint is a hash of 64 bits and a check of 16 bits made from
other word hashes. A new batch is scanned once; its windows are merge-joined, bucket by bucket, with all runs and with each
other, and a match must agree in hash and check. What is new becomes a run of its own; once there are ``fanout`` runs they
are compacted into one. Every window is stored, whatever later batches may hold, so an index that stays in its folder can
be opened again and fed with more documents. Batches enter in the order of doc_id: what a run holds is from a smaller one.

The bucket of a window comes from the smallest of its nine 5-word hashes, which neighbouring windows mostly share: so
stretches of neighbours travel together and name their document once. Of windows that a slice of documents holds more than
once only the first is sent; those of larger doc_ids are repeated for certain, and those of the same text follow the first
one's fate. So a window that is everywhere costs a row a slice.

Defined cases: a word is a run of bytes other than 0x20 and 0x09-0x0D; a null text has no words; a text of under 13
words has no windows and keeps all its words; texts and words of any length are read whole; windows repeated within one
document remove nothing; repeated rows with one doc_id and text are one document and are treated alike, rows with one
doc_id but different texts never remove each other's words; rows with a null doc_id neither remove nor lose words; an
empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import words as W
from tidewire.llm.common import cut, edges, from_planes, pack_ids, planes, unpack_ids, unused
from tidewire.operators.lineage import ensure_checkpoint_dir, folders_in, remove_folder, shuffles_dropped

WINDOW = 13
SEED = 5  # words of a minimizer
BUCKET_BYTES = 6 << 20  # text behind one bucket of the index: some million windows
SLICE_BYTES = 6 << 20

#: Rows of windows: ``ids``/``keys``/``starts``/``counts`` tell of each stretch its document, first window and length.
_SCHEMA = "bucket long, ids binary, keys binary, starts binary, counts binary, hashes binary, checks binary, firsts binary, kind int"
_BLOBS = ("ids", "keys", "starts", "counts", "hashes", "checks", "firsts")
_ARROW = pa.schema([("bucket", pa.int64()), *((n, pa.binary()) for n in _BLOBS), ("kind", pa.int32())])
_FOUND = "doc_id long, text_key long, stretches binary"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("stretches", pa.binary())])
#: Windows to look up; windows known to be repeated; windows that follow an earlier one of their text; sorted fingerprints.
CANDIDATES, KNOWN, FOLLOW, RUN = 0, 1, 2, 3


def _minimizers(h: np.ndarray) -> np.ndarray:
    """The smallest of the nine 5-word hashes in each 13-word window (by window start)."""
    g = W.grams(h, SEED, salt=5)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    two = np.minimum(g[:-1], g[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    return np.minimum(eight[:n], g[8 : 8 + n])


# --- rows of windows -----------------------------------------------------------------------------------
def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _pack(kind: int, bucket: np.ndarray, who: np.ndarray, pos: np.ndarray, hashes=None, checks=None, firsts=None) -> list[tuple]:
    """One row for each bucket from windows in the order of bucket, document and position."""
    if not len(bucket):
        return []
    step = np.arange(len(pos)) if firsts is not None else pos - np.arange(len(pos))  # followers are told one by one
    at = edges(bucket, who[:, 0], who[:, 1], step)
    count = np.diff(np.r_[at, len(pos)])
    doc, key, start = who[at, 0], who[at, 1], pos[at]
    row = edges(bucket[at])
    out = []
    for i, j in zip(row.tolist(), [*row[1:].tolist(), len(at)]):
        a, b = int(at[i]), int(at[j]) if j < len(at) else len(pos)
        more = [c[a:b].tobytes() if c is not None else None for c in (hashes, checks)]
        out.append((int(bucket[a]), pack_ids(doc[i:j]), key[i:j].tobytes(), planes(start[i:j]), planes(count[i:j]), *more, planes(firsts[a:b]) if firsts is not None else None, kind))
    return out


def _windows(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(document: doc_id and text key, position) of every window of the rows."""
    if not rows:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    doc = np.concatenate([unpack_ids(r["ids"]) for r in rows])
    key = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
    start = np.concatenate([from_planes(r["starts"]) for r in rows]).astype(np.int64)
    count = np.concatenate([from_planes(r["counts"]) for r in rows]).astype(np.int64)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.stack([doc, key], 1), count, axis=0), np.repeat(start, count) + inside


def _column(rows: list[dict], name: str, kind) -> np.ndarray:
    own = [np.frombuffer(r[name], kind) for r in rows]
    return np.concatenate(own) if own else np.zeros(0, kind)


def _by_block(who: np.ndarray, pos: np.ndarray, n_blocks: int, kind: int = KNOWN, firsts: np.ndarray | None = None) -> list[tuple]:
    """Windows as rows of whole blocks of documents, each once, so that rows do not grow with the documents of a bucket."""
    block = (W.mix((who[:, 0] ^ who[:, 1]).view(np.uint64)) >> np.uint64(33)).astype(np.int64) % n_blocks
    order = np.lexsort((pos, who[:, 1], who[:, 0], block))
    who, pos, block = who[order], pos[order], block[order]
    once = edges(who[:, 0], who[:, 1], pos)
    return _pack(kind, block[once], who[once], pos[once], firsts=firsts[order][once] if firsts is not None else None)


# --- runs ----------------------------------------------------------------------------------------------
def _run_row(bucket: int, h: np.ndarray, c: np.ndarray) -> tuple:
    """A sorted run: the steps between neighbouring hashes, whose upper bytes are zero, and the checks."""
    return (bucket, None, None, None, None, planes(np.diff(h, prepend=np.uint64(0)), 8), c.tobytes(), None, RUN)


def _run_arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(from_planes(row["hashes"], 8), dtype=np.uint64), np.frombuffer(row["checks"], np.uint16)


def _in_run(run_h: np.ndarray, run_c: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which (h, c) occur in a run sorted by (h, c)."""
    found = np.zeros(len(h), bool)
    if not len(run_h):
        return found
    at = np.searchsorted(run_h, h)
    live = np.arange(len(h))
    while len(live):  # equal hashes with unequal checks stand side by side
        i = at[live]
        live = live[(i < len(run_h)) & (run_h[np.minimum(i, len(run_h) - 1)] == h[live])]
        found[live[run_c[at[live]] == c[live]]] = True
        live = live[~found[live]]
        at[live] += 1
    return found


def _order(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Order by (h, c): by h alone unless equal hashes differ in their checks."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], c[order]
    return np.lexsort((c, h)) if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else order


def _candidates(n_buckets: int):
    """Rows of the windows of a batch: to be looked up, known to be repeated, or following another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.stack([np.asarray(b.column("doc_id")), np.asarray(b.column("text_key"))], 1)
            for part in W.slices(b.column("text"), SLICE_BYTES):
                starts = W.gram_starts(part, WINDOW)
                if not len(starts):
                    continue
                h = part.hashes()
                bucket = (_minimizers(h)[starts] >> np.uint64(20)).astype(np.int64) % n_buckets
                full = W.grams(h, WINDOW)[starts]
                check = (W.grams(part.hashes(seed=1), WINDOW, salt=9)[starts] >> np.uint64(48)).astype(np.uint16)
                row = part.row_of_word[starts]
                who, pos = ids[part.first : part.last][row], starts - part.row_start[row]
                # groups of equal windows, in the order of the slice; the first is that of the smallest doc_id
                order = _order(full, check)
                at = edges(full[order], check[order])
                size = np.diff(np.r_[at, len(order)])
                sent = np.ones(len(order), bool)
                rows: list[tuple] = []
                if (size > 1).any():
                    several = order[np.repeat(size > 1, size)]
                    group = np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
                    several = several[np.lexsort((pos[several], who[several, 1], who[several, 0], group))]
                    first = several[edges(group)][group]
                    later = who[several, 0] > who[first, 0]
                    same = (several != first) & (who[several] == who[first]).all(axis=1)
                    sent[several[later | same]] = False
                    rows += _by_block(who[several[later]], pos[several[later]], n_buckets)
                    rows += _by_block(who[several[same]], pos[several[same]], n_buckets, FOLLOW, pos[first[same]])
                kept = np.flatnonzero(sent)
                kept = kept[np.argsort(bucket[kept], kind="stable")]
                rows += _pack(CANDIDATES, bucket[kept], who[kept], pos[kept], full[kept], check[kept])
                if rows:
                    yield _batch(rows)

    return run


def _merge_join(n_blocks: int):
    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket: the batch's windows against every run and against each other; what repeats, and the new run."""
        new, runs = [], []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] in (KNOWN, FOLLOW):  # decided in the scan: on to the documents
                    yield _batch([tuple(r[n] for n in _ARROW.names)])
                else:
                    (runs if r["kind"] == RUN else new).append(r)
        h, c = _column(new, "hashes", np.uint64), _column(new, "checks", np.uint16)
        who, pos = _windows(new)
        new.clear()
        order = _order(h, c)
        h, c, who, pos = h[order], c[order], who[order], pos[order]
        at = edges(h, c)
        size = np.diff(np.r_[at, len(h)])
        old = np.zeros(len(at), bool)
        while runs:
            old |= _in_run(*_run_arrays(runs.pop()), h[at], c[at])
        if len(at):
            again = np.repeat(old, size) | (who[:, 0] > np.repeat(np.minimum.reduceat(who[:, 0], at), size))
            found = _by_block(who[again], pos[again], n_blocks)
            if found:
                yield _batch(found)
        yield _batch([_run_row(key[0].as_py(), h[at[~old]], c[at[~old]])])

    return join


def _compact(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = [_run_arrays(r) for b in batches for r in b.to_pylist()]
    h, c = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    order = _order(h, c)
    yield _batch([_run_row(key[0].as_py(), h[order], c[order])])


def _by_document(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of documents: a row for each, with (start, count) of its stretches of repeated windows."""
    rows = [r for b in batches for r in b.to_pylist()]
    who, pos = _windows([r for r in rows if r["kind"] == KNOWN])
    follow = [r for r in rows if r["kind"] == FOLLOW]
    if follow and len(pos):
        f_who, f_pos = _windows(follow)
        firsts = np.concatenate([from_planes(r["firsts"]) for r in follow]).astype(np.int64)
        # what follows a repeated window is repeated: look (document, first) up among the repeated ones
        order = np.lexsort((np.r_[np.zeros(len(pos), np.int8), np.ones(len(firsts), np.int8)], np.r_[pos, firsts], np.r_[who[:, 1], f_who[:, 1]], np.r_[who[:, 0], f_who[:, 0]]))
        all_who, all_pos = np.concatenate([who, f_who])[order], np.r_[pos, firsts][order]
        at = edges(all_who[:, 0], all_who[:, 1], all_pos)
        hit = np.repeat(order[at] < len(pos), np.diff(np.r_[at, len(order)]))
        also = order[hit & (order >= len(pos))] - len(pos)
        who, pos = np.concatenate([who, f_who[also]]), np.r_[pos, f_pos[also]]
    if not len(pos):
        return
    packed = _by_block(who, pos, 1)[0]
    r = dict(zip(_ARROW.names, packed))
    doc = unpack_ids(r["ids"])
    own = np.frombuffer(r["keys"], np.int64)
    pairs = np.stack([from_planes(r["starts"]), from_planes(r["counts"])], 1)
    at = edges(doc, own)
    parts = [pairs[i:j].tobytes() for i, j in zip(at.tolist(), [*at[1:].tolist(), len(doc)])]
    yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(own[at]), pa.array(parts, pa.binary())], schema=_FOUND_ARROW)


class FingerprintIndex:
    """Sorted runs of window fingerprints in ``folder``; ``add`` joins a batch with them and returns its repeated windows.

    A folder that holds runs is gone on with (its number of buckets stays). A run named ``run-a-b`` covers batches a to b
    and replaces every run inside that span, so an index whose compaction was broken off reads right.
    """

    def __init__(self, spark: SparkSession, folder: str, n_buckets: int = 64, fanout: int = 3):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        known = [n for n in folders_in(spark, folder) if n.startswith("buckets-")]
        self.n_buckets = int(known[0].split("-")[1]) if known else n_buckets
        self.at = f"{folder}/buckets-{self.n_buckets}"

    def runs(self) -> list[tuple[int, int]]:
        """(first batch, last batch) of every live run, oldest first."""
        spans = []
        for n in folders_in(self.spark, self.at):
            if n.startswith("run-") and "_SUCCESS" in (inside := folders_in(self.spark, f"{self.at}/{n}")) and f"kind={RUN}" in inside:
                spans.append(tuple(map(int, n.split("-")[1:])))
        return sorted(s for s in spans if not any(t != s and t[0] <= s[0] and s[1] <= t[1] for t in spans))

    def _folder(self, span: tuple[int, int]) -> str:
        return f"{self.at}/run-{span[0]:06d}-{span[1]:06d}"

    def _write(self, rows: DataFrame, span: tuple[int, int]) -> None:
        with shuffles_dropped(self.spark):
            rows.write.mode("overwrite").partitionBy("kind").option("compression", "zstd").parquet(self._folder(span))

    def _read(self, span: tuple[int, int], kind: int) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self._folder(span)).where(F.col("kind") == kind)

    def compact(self) -> None:
        """Merge all runs into one."""
        spans = self.runs()
        if len(spans) > 1:
            runs = reduce(DataFrame.unionByName, [self._read(s, RUN) for s in spans])
            self._write(runs.groupBy("bucket").applyInArrow(_compact, _SCHEMA), (spans[0][0], spans[-1][1]))
            for s in spans:
                remove_folder(self.spark, f"{self._folder(s)}/kind={RUN}")

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Windows of ``docs(doc_id, text_key, text)`` seen in an earlier document, packed by blocks of documents.

        Without ``keep`` the batch is looked up but its run is not written (nothing will be added after it).
        """
        if len(self.runs()) >= self.fanout:
            self.compact()
        spans = self.runs()
        last = max((s[1] for s in spans), default=-1) + 1
        rows = docs.mapInArrow(_candidates(self.n_buckets), _SCHEMA)
        for s in spans:
            rows = rows.unionByName(self._read(s, RUN))
        joined = rows.groupBy("bucket").applyInArrow(_merge_join(self.n_buckets), _SCHEMA)
        self._write(joined if keep else joined.where(F.col("kind") != RUN), (last, last))
        return self._read((last, last), KNOWN).unionByName(self._read((last, last), FOLLOW))

    def remove(self) -> None:
        remove_folder(self.spark, self.folder)


def repeated_windows(docs: DataFrame, n_batches: int = 4, fanout: int = 2, folder: str | None = None) -> DataFrame:
    """(doc_id, text_key, stretches) of the documents that repeat windows of smaller doc_ids: uint32 (start, count) pairs.

    With ``folder`` the index stays there, with the windows of every document: a later call with the same folder and documents
    of larger doc_ids finds what they repeat of these. Without it the index goes when the call ends, and the windows of the
    last batch, which nothing would look up, are not written.
    """
    spark = docs.sparkSession
    known = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    )
    stat = known.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if stat.low is None:
        return spark.createDataFrame([], _FOUND)
    stays, folder = folder is not None, folder or f"{ensure_checkpoint_dir(spark)}/substring-index-{uuid.uuid4().hex}"
    index = FingerprintIndex(spark, folder, max(32, -(-stat.bytes // BUCKET_BYTES)), fanout)
    bounds = [stat.low + (stat.high + 1 - stat.low) * i // n_batches for i in range(n_batches + 1)]
    ranges = [(a, b) for a, b in zip(bounds, bounds[1:]) if a < b]
    parts = [index.add(known.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)), keep=stays or (a, b) != ranges[-1]) for a, b in ranges]
    found = cut(reduce(DataFrame.unionByName, parts).groupBy("bucket").applyInArrow(_by_document, _FOUND))
    if not stays:
        index.remove()
    return found


def keep_words(text: bytes, stretches: bytes | None) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by a space)."""
    words = text.split()
    if not stretches:
        return len(words), 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int32)
    start, count = np.frombuffer(stretches, np.uint32).astype(np.int64).reshape(-1, 2).T  # no two stretches touch
    np.add.at(cover, start, 1)
    np.add.at(cover, start + count - 1 + WINDOW, -1)
    left = np.cumsum(cover[:-1]) == 0
    return len(words), len(words) - int(left.sum()), b" ".join(compress(words, left.tolist()))


def _with_stretches(docs: DataFrame, n_batches: int, folder: str | None = None) -> DataFrame:
    """``docs`` and, as the last column, the stretches of repeated windows of each row."""
    own = {n: unused(docs.columns, f"_{n}") for n in ("doc_id", "text_key", "stretches")}
    found = repeated_windows(docs, n_batches, folder=folder).withColumnsRenamed(own)
    return docs.join(found, (F.col("doc_id") == F.col(own["doc_id"])) & (F.xxhash64("text") == F.col(own["text_key"])), "left").drop(own["doc_id"], own["text_key"])


def removal_digest(docs: DataFrame, n_batches: int = 4, folder: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs(doc_id, text)`` (``folder`` as in ``repeated_windows``)."""

    def run(batches):
        for b in batches:
            got = [keep_words((t or "").encode(), p) for t, p in zip(b.column("text").to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                 pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return _with_stretches(docs.select("doc_id", "text"), n_batches, folder).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeated(docs: DataFrame, n_batches: int = 4, folder: str | None = None) -> DataFrame:
    """The rows and columns of ``docs``; a text that loses words becomes its kept words joined by one space."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            found, text = b.column(b.num_columns - 1).to_pylist(), b.column(at).to_pylist()
            new = [t if not p else keep_words(t.encode(), p)[2].decode() for t, p in zip(text, found)]
            arrays = [pa.array(new, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return _with_stretches(docs, n_batches, folder).mapInArrow(run, docs.schema)
