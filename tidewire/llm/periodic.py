"""Periodic runs of words, by branching tandem repeats over an enhanced suffix array.

Texts are taken in slices, all texts of a slice at once. The words of a slice are sorted as suffixes (groups of equal
prefixes are refined by doubling, only the groups that are still open), the longest common prefixes of neighbours come
out of the same refinement, and every LCP interval is cut in two at each of its boundaries. For the suffixes i of the
smaller half, the inverse suffix array tells whether i + depth or i - depth lies in the other half: if so, a square of
that depth begins there that the next word does not continue. Such squares are rotated to the left as far as they go and
merged into the run that they end. There is no suffix tree.

Words that can be in no run are left out of the sorting: in a run of at least twelve words and two periods, every word
lies under six words that occur again one period away, so only words under a 6-gram that its text repeats are sorted.
This is exact. Words are compared by 64-bit hashes first; the runs found are then held against the bytes of their words,
and should hashes have collided, the slice is done again with true word numbers.

Memory is proportional to a slice of about 2 MB, or to the longest text: some 150 bytes a word that lies under a repeated
6-gram, and 60 a word of the rest. Nothing is shuffled, so no key, source or group of copies can be hot.

Defined cases: a null or blank text has no words, no runs and an empty collapsed text; rows with a null doc_id and
repeated rows are treated like any other, one row each; an empty table gives no rows; columns other than doc_id and text
play no part, whatever their names; runs of one text are sorted by start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import edges
from tidewire.llm.words import Words, gram_starts, grams, mix, slices

#: A run has at least so many words.
LEAST = 12
FAR = np.iinfo(np.int64).max

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Minima:
    """A segment tree of minima over an array, asked for many ranges or places at once."""

    def __init__(self, values: np.ndarray, beyond: int):
        self.size = 1 << max(0, len(values) - 1).bit_length()
        self.tree = np.full(2 * self.size, beyond, np.int64)
        self.tree[self.size : self.size + len(values)] = values
        level = self.size
        while level > 1:
            self.tree[level // 2 : level] = self.tree[level : 2 * level].reshape(-1, 2).min(axis=1)
            level //= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum of first..last of each pair (first <= last)."""
        a, b, out = first + self.size, last + self.size + 1, np.full(len(first), FAR)
        live = np.arange(len(first))
        while len(live):
            x, y = a[live], b[live]
            odd = (x & 1) == 1
            out[live[odd]] = np.minimum(out[live[odd]], self.tree[x[odd]])
            odd = (y & 1) == 1
            out[live[odd]] = np.minimum(out[live[odd]], self.tree[y[odd] - 1])
            a[live], b[live] = (x + 1) >> 1, y >> 1
            live = live[a[live] < b[live]]
        return out

    def next_to(self, at: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """The nearest place before (step -1) or after (step 1) each ``at`` whose value is at most ``most``; there must be one."""
        node = at + self.size
        live = np.arange(len(at))
        while len(live):  # up, until the neighbour's subtree holds such a value
            x = node[live]
            inner = (x & 1) == (1 if step < 0 else 0)
            found = inner.copy()
            found[inner] = self.tree[x[inner] + step] <= most[live[inner]]
            node[live] = np.where(found, x + step, x >> 1)
            live = live[~found]
        while len(node) and (deep := node < self.size).any():  # down, to the near end
            x = node[deep] * 2
            near = x + 1 if step < 0 else x
            node[deep] = np.where(self.tree[near] <= most[deep], near, near ^ 1)
        return node - self.size


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, place of each suffix, common prefix with the suffix before) of an array of integers."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[order[1:]] != symbols[order[:-1]]
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    common = np.where(new, 0, FAR)
    slots = np.flatnonzero(~(new & np.r_[new[1:], True]))
    h = 1
    while len(slots):
        i = order[slots]
        ahead = np.where(i + h < n, place[np.minimum(i + h, n - 1)] + 1, 0)
        key = place[i] * (n + 1) + ahead
        by = np.argsort(key)
        i, key = i[by], key[by]
        order[slots] = i
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        fresh = slots[new & (common[slots] == FAR)]
        a, b = order[fresh - 1] + h, order[fresh] + h  # they agree in h words; then they are in different groups
        inside = np.flatnonzero((a < n) & (b < n))
        common_to = np.full(len(fresh), h)
        if len(inside):
            common_to[inside] += Minima(common, FAR).least(place[a[inside]] + 1, place[b[inside]])
        common[fresh] = common_to
        place[i] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.r_[new[1:], True])]
        h *= 2
    return order, place, common


def branching_squares(symbols: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square whose next symbol, if there is one, differs from the one a period before."""
    order, place, common = suffix_array(symbols)
    n = len(symbols)
    cuts = np.flatnonzero((common > 0) & (common < FAR))
    depth = common[cuts]
    near = Minima(np.r_[common, -1], -1)
    left, right = near.next_to(cuts, depth - 1, -1), near.next_to(cuts, depth, 1)
    small_left = cuts - left <= right - cuts
    first, count = np.where(small_left, left, cuts), np.minimum(cuts - left, right - cuts)
    low, high = np.where(small_left, cuts, left), np.where(small_left, right, cuts)
    total = np.cumsum(count)
    starts, periods, a = [], [], 0
    while a < len(cuts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        c = count[a:b]
        of = np.repeat(np.arange(a, b), c)
        i = order[first[of] + np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)]
        d = depth[of]
        for j, begin in ((i + d, i), (i - d, i - d)):
            ok = (j >= 0) & (j < n)
            at = place[j[ok]]
            hit = (at >= low[of[ok]]) & (at < high[of[ok]])
            starts.append(begin[ok][hit])
            periods.append(d[ok][hit])
        a = b
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def rotate_left(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The first place to which each square can be rotated word by word."""
    start, live, width = start.copy(), np.arange(len(start)), 8
    while len(live):
        at = start[live, None] - 1 - np.arange(width)
        same = (at >= 0) & (symbols[np.maximum(at, 0)] == symbols[np.maximum(at, 0) + period[live, None]])
        steps = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        start[live] -= steps
        live = live[steps == width]
        width = min(2 * width, max(8, (1 << 20) // max(1, len(live))))
    return start


def maximal_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of every maximal repetition of at least two periods."""
    start, period = branching_squares(symbols)
    end = start + 2 * period
    order = np.lexsort((period, end))
    start, period, end = start[order], period[order], end[order]
    found = []
    while len(end):
        head = edges(end)  # the shortest square that ends at a place has no shorter period
        first = rotate_left(symbols, start[head], period[head])
        found.append((first, end[head] - first, period[head]))
        of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(end)]))
        rest = (period % period[head][of] != 0) | (start < first[of])  # the others are not powers of it
        start, period, end = start[rest], period[rest], end[rest]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _under_repeats(part: Words, h: np.ndarray, row: np.ndarray, k: int = LEAST // 2) -> np.ndarray:
    """The words under k consecutive words that occur more than once in their text."""
    at = gram_starts(part, k)
    key = mix(grams(h, k)[at] ^ mix(row[at].astype(np.uint64)))
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    twice = np.zeros(len(at), bool)
    twice[order[same]] = twice[order[same + 1]] = True
    mark = np.zeros(len(h) + 1, np.int64)
    mark[at[twice]] += 1
    mark[at[twice] + k] -= 1
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def _same_words(part: Words, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the words a[i] and b[i] have the same bytes for every i."""
    size = part.end[a] - part.start[a]
    if (size != part.end[b] - part.start[b]).any():
        return False
    for i in range(0, len(a), 1 << 18):
        s = slice(i, i + (1 << 18))
        if (part.data[_spread(part.start[a[s]], size[s])] != part.data[_spread(part.start[b[s]], size[s])]).any():
            return False
    return True


def runs_of(part: Words, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of the runs of all texts of a slice, words numbered through the slice, in order."""
    h = part.hashes() if hashes is None else hashes
    row = part.row_of_word
    at = _under_repeats(part, h, row)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    gap = np.zeros(len(at), np.int64)  # a symbol of its own stands where words are left out and where a text ends
    gap[1:] = (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])
    slot = np.arange(len(at)) + np.cumsum(gap)
    ids = np.unique(mix(h[at] ^ mix(row[at].astype(np.uint64))), return_inverse=True)[1]
    symbols = -np.arange(1, slot[-1] + 2)
    symbols[slot] = ids
    word = np.full(slot[-1] + 1, -1)
    word[slot] = at
    start, length, period = maximal_runs(symbols)
    long = (length >= LEAST) & (length >= 2 * period)
    start, length, period = word[start[long]], length[long], period[long]
    first = _spread(start, length - period)
    if not _same_words(part, first, first + np.repeat(period, length - period)):
        numbers: dict[bytes, int] = {}
        spans = (part.data[a:b].tobytes() for a, b in zip(part.start.tolist(), part.end.tolist()))
        return runs_of(part, np.array([numbers.setdefault(s, len(numbers)) for s in spans], np.uint64))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _joined(part: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of every row, joined by one space."""
    w = np.flatnonzero(keep)
    row = part.row_of_word[w]
    closing = np.ones(len(w), bool)
    closing[:-1] = row[1:] != row[:-1]
    size = part.end[w] - part.start[w] + ~closing
    at = np.cumsum(size)
    data = part.data[_spread(part.start[w], size)]
    data[at[~closing] - 1] = 32
    offsets = np.concatenate([[0], at])[np.searchsorted(row, np.arange(part.last - part.first + 1))]
    return pa.Array.from_buffers(pa.large_utf8(), part.last - part.first, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.utf8())


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id").cast(pa.int64())
        for part in slices(b.column("text")):
            start, length, period = runs_of(part)
            row = part.row_of_word[start]
            gone = np.zeros(len(part.start) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            runs = pa.StructArray.from_arrays([pa.array(start - part.row_start[row]), pa.array(length), pa.array(period)], fields=list(_RUN))
            bounds = pa.array(np.searchsorted(row, np.arange(part.last - part.first + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(part.first, part.last - part.first), pa.array(part.counts.astype(np.int64)), pa.ListArray.from_arrays(bounds, runs), _joined(part, np.cumsum(gone[:-1]) == 0)],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def detect_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, collapsed for every row of ``docs(doc_id, text)``.

    A run is a stretch of at least twelve words and two (smallest) periods that no neighbouring word extends; ``runs`` holds
    start (number of the first word), length and period of each. ``collapsed`` is the text's words joined by one space,
    without those that lie in a run after its first period.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_detect, _SCHEMA)


def repeat_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of a tenth of the documents repeat from some word on.

    With h the CRC-32 of the decimal doc_id and g = floor(h / 10), a document of n > 0 words with h % 10 = 0 has its words
    i >= a replaced by word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A row without a
    doc_id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words):
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " ")

    all_words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    new = F.get(F.transform(F.array(all_words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when((h % 10 == 0) & F.col("text").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def run_digest(docs: DataFrame) -> DataFrame:
    """One row a document: number of runs, the longest one (ties: smallest start, then period), digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    found = detect_runs(docs).withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
