"""Quality rules: plain counts, and a hashed n-gram logistic regression trained on labelled rows.

``train`` fits word 1- and 2-grams and character 3- and 4-grams, hashed into a fixed number of weights, on a bounded
sample of labelled rows (``sample_per_class`` rows of each class, by hash of doc_id; the one bounded thing here), and
calibrates the probability on a fifth of them that it did not see; what it returns is the same for the same rows. ``score`` reads every whole text in Arrow batches
and holds it against fixed thresholds; nothing is shuffled.

Defined cases: a null or blank text has zero counts and fails the base rule (under ten words); labels that are null
are left out, and where a doc_id is labelled more than once the lowest label counts, where it has several texts the smallest
one is learnt from; texts and words of any length are read whole; a probability at the threshold is kept; without labels of both classes
there is no classifier and the base rule decides alone; repeated rows are scored alike; an empty table gives no rows;
other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import words as W

BITS = 18
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_PROBABILITY = 0.2


@dataclass
class Model:
    weights: np.ndarray  # 2 * 2**BITS: word n-grams, then character n-grams
    bias: float
    slope: float
    offset: float

    def probability(self, word_mean: np.ndarray, char_mean: np.ndarray) -> np.ndarray:
        z = self.slope * (word_mean + char_mean + self.bias) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def features(part: W.Words) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Word and character features of a slice, each as (slot of every n-gram, bounds of the rows)."""
    h = part.hashes()
    word = [(_slots(h), part.row_start)]
    starts = W.gram_starts(part, 2)
    word.append((_slots(W.grams(h, 2, salt=7))[starts], np.searchsorted(starts, part.row_start)))
    # characters: code points of the slice, and where each row begins among them
    lead = (part.data & 0xC0) != 0x80
    row_at = np.r_[0, np.cumsum(lead)][part.text_start]
    points = np.frombuffer(part.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    char = []
    for k in (3, 4):
        n = len(points) - k + 1
        if n <= 0:
            char.append((np.zeros(0, np.int32), np.zeros(len(row_at), np.int64)))
            continue
        x = points[:n].copy()
        for j in range(1, k):
            x *= np.uint64(0x100000001B3)
            x += points[j : j + n]
        slots = _slots((x + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15))
        # n-grams over the end of a row are left out by the bounds below
        char.append((slots, np.stack([np.minimum(row_at[:-1], n), np.clip(row_at[1:] - k + 1, np.minimum(row_at[:-1], n), n)])))
    return word, char


def _mean(weights: np.ndarray, parts: list, rows: int) -> np.ndarray:
    total, count = np.zeros(rows), np.zeros(rows)
    for slots, bounds in parts:
        lo, hi = (bounds[:-1], bounds[1:]) if bounds.ndim == 1 else bounds
        sums = np.zeros(len(slots) + 1)
        np.cumsum(weights[slots], out=sums[1:])
        total += sums[hi] - sums[lo]
        count += hi - lo
    return total / np.maximum(count, 1)


def base_counts(part: W.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row of a slice."""
    rows = part.last - part.first
    data, at = part.data, part.text_start
    out = {"n_words": part.counts.astype(np.int64)}
    out["word_chars"] = _row_sums((~W.SPACE[data] & ((data & 0xC0) != 0x80)).astype(np.int8), at)
    out["n_symbols"] = _row_sums(SYMBOLS[data].astype(np.int8), at)
    # lines: from a row's start or after \n, up to the next \n or the row's end
    cut = np.flatnonzero(data == 10)
    start = np.r_[at[:-1], cut + 1]
    end_at = np.r_[cut, at[1:]]
    row = np.r_[np.arange(rows), np.searchsorted(at, cut, "right") - 1]
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = end_at[np.lexsort((end_at, np.r_[np.searchsorted(at, cut, "right") - 1, np.arange(rows)]))]
    has = np.searchsorted(part.start, end) > np.searchsorted(part.start, start)
    start, end, row = start[has], end[has], row[has]
    key = W.mix(W.span_hashes(data, start, end) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)
    # words in repeated 5-word windows
    starts = W.gram_starts(part, 5)
    g = W.grams(part.hashes(), 5, salt=3)[starts] if len(starts) else np.zeros(0, np.uint64)
    g = W.mix(g + part.row_of_word[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inv, n = np.unique(g, return_inverse=True, return_counts=True)
    twice = starts[n[inv] > 1] if len(starts) else starts
    cover = np.zeros(len(part.start) + 6, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    out["n_repeat_words"] = _row_sums((np.cumsum(cover)[: len(part.start)] > 0).astype(np.int8), part.row_start)
    return out


def score_column(text: pa.Array, model: Model | None) -> dict[str, np.ndarray]:
    """Counts and verdicts of every text of a column."""
    found: dict[str, list[np.ndarray]] = {}
    for part in W.slices(text):
        got = base_counts(part)
        rows = part.last - part.first
        got["base_failed"] = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
        if model is None:
            got["p_quality"] = np.ones(rows)
        else:
            word, char = features(part)
            size = 1 << BITS
            got["p_quality"] = model.probability(_mean(model.weights[:size], word, rows), _mean(model.weights[size:], char, rows))
        got["kept"] = ~got["base_failed"] & (got["p_quality"] >= MIN_PROBABILITY)
        for k, v in got.items():
            found.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in found.items()}


# --- training ----------------------------------------------------------------------------------------


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(quality, slots, values) of labelled rows: n-gram shares, word slots before character slots."""
    for b in batches:
        quality, rows = b.column("quality").to_pylist(), []
        for part in W.slices(b.column("text")):
            word, char = features(part)
            for i in range(part.last - part.first):
                slots, values = [], []
                for base, group in ((0, word), (1 << BITS, char)):
                    own = [s[lo[i] : hi[i]] for s, bounds in group for lo, hi in [(bounds[:-1], bounds[1:]) if bounds.ndim == 1 else bounds]]
                    k, n = np.unique(np.concatenate(own), return_counts=True)
                    slots.append(k + base)
                    values.append(n / max(1, n.sum()))
                rows.append((quality[part.first + i], np.concatenate(slots).astype(np.int32).tobytes(), np.concatenate(values).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
            names=["quality", "slots", "values"],
        )


def fit(rows: list[tuple[int, bytes, bytes]], class_weight: dict[int, float], epochs: int = 60) -> Model:
    """Logistic regression by full-batch Adagrad, then Platt scaling on the rows left out (every fifth).

    ``rows`` are (quality, slots as int32, shares as float32); they are used up, and read in blocks, to spare memory.
    """
    held = np.arange(len(rows)) % 5 == 4
    if len({r[0] for i, r in enumerate(rows) if not held[i]}) < 2 or len({r[0] for i, r in enumerate(rows) if held[i]}) < 2:
        held[:] = False
    order = np.argsort(held, kind="stable")  # training rows first
    n_train = int((~held).sum())
    y = np.array([rows[i][0] for i in order], float)
    sample = np.array([class_weight[int(v)] for v in y])
    bounds = np.r_[0, np.cumsum([len(rows[i][1]) // 4 for i in order])]
    slot = np.frombuffer(b"".join([rows[i][1] for i in order]), np.int32)
    value = np.frombuffer(b"".join([rows[i][2] for i in order]), np.float32)
    rows.clear()
    blocks = [(i, min(i + 128, n_train)) for i in range(0, n_train, 128)]

    def scores(i: int, j: int) -> np.ndarray:
        lo, hi = bounds[i], bounds[j]
        if lo == hi:
            return np.full(j - i, bias)
        total = np.r_[0, np.cumsum(w[slot[lo:hi]] * value[lo:hi])]
        return total[bounds[i + 1 : j + 1] - lo] - total[bounds[i:j] - lo] + bias

    w, bias = np.zeros(2 << BITS), 0.0
    g2, b2 = np.full(2 << BITS, 1e-10), 1e-10
    share = sample[:n_train] / max(sample[:n_train].sum(), 1e-9)
    for _ in range(epochs):
        grad, push = 1e-9 * w, 0.0
        for i, j in blocks:
            lo, hi = bounds[i], bounds[j]
            err = share[i:j] * (1 / (1 + np.exp(-np.clip(scores(i, j), -50, 50))) - y[i:j])
            grad += np.bincount(slot[lo:hi], np.repeat(err, np.diff(bounds[i : j + 1])) * value[lo:hi], 2 << BITS)
            push += err.sum()
        g2 += grad * grad
        b2 += push**2
        w -= 1.0 * grad / np.sqrt(g2)
        bias -= 0.3 * push / np.sqrt(b2)
    i, j = (n_train, len(y)) if n_train < len(y) else (0, n_train)
    return Model(w.astype(np.float32), bias, *platt(scores(i, j), y[i:j], sample[i:j]))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid that maps scores to probabilities (Newton steps, smoothed targets)."""
    pos, neg = weight[y > 0].sum(), weight[y < 1].sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        e, q = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(q * z * z).sum() + 1e-6, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, [(e * z).sum(), e.sum()])
        step *= min(1, 2 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = 1000) -> Model | None:
    """Fit on at most ``sample_per_class`` labelled rows of each class; None without rows of both classes."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class) for q in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample_per_class rows
    rows = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.mapInArrow(_sparse, "quality int, slots binary, values binary").collect()  # at most 2 * sample_per_class
    rows = sorted((r.quality, bytes(r.slots), bytes(r["values"])) for r in rows)
    got = {q: sum(r[0] == q for r in rows) for q in (0, 1)}
    if not all(got.values()):
        return None
    scale = {q: counts[q] / got[q] for q in (0, 1)}
    mean = sum(scale[r[0]] for r in rows) / len(rows)
    return fit(rows, {q: s / mean for q, s in scale.items()})


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, the five counts, base_failed, p_quality and kept for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = score_column(b.column("text"), shared.value) if b.num_rows else {}
            if got:
                arrays = [b.column("doc_id"), *(pa.array(got[k], pa.int64()) for k in COUNTS), pa.array(got["base_failed"]), pa.array(got["p_quality"], pa.float64()), pa.array(got["kept"])]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COUNTS, "base_failed", "p_quality", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, p_quality double, kept boolean"
    )


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(score_column(b.column(at), shared.value)["kept"]))

    return docs.mapInArrow(run, docs.schema)
