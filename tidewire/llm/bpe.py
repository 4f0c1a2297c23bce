"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

Every distinct word of a batch is encoded once: its symbols are the leaves of a segment tree whose values are the ranks
of the pairs that begin there; the root yields the lowest rank and, among equals, the leftmost pair. A merge changes
three leaves, each a logarithmic update, until no pair has a rank. The trees of many words of one size class lie side by
side in arrays, so a step is done for all of them at once. A word of over LONG_WORD bytes has a tree of its own, whose root
yields all pairs of the lowest rank together; they are merged in one step unless a pair that arises meanwhile would come
before the rest. Results are kept by word in a bounded cache of the worker.

The vocabulary file's path is a parameter. Words come from the file's own rules: NFC, lower case by single characters,
white space dropped, then contractions, runs of letters, single digits and runs of other characters; special tokens in
a text are taken before that. Defined cases: a null or blank text has no ids and decodes to the empty text; texts and
words of any length are encoded whole; repeated rows are encoded alike; other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = np.int64(1) << 40  # a leaf without a mergeable pair
#: Words kept in the cache of a worker; beyond that it is emptied.
CACHE_WORDS = 400_000
LONG_WORD = 1024


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def _unassigned() -> str:
    """Ranges of the code points that have no category, for a character class."""
    none = np.array([unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)])
    edge = np.flatnonzero(np.diff(np.r_[False, none, False].astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))


def _latin_class(category: str) -> str:
    """The Latin-1 characters of a category, for a character class."""
    return "".join(c for c in map(chr, range(256)) if unicodedata.category(c).startswith(category))


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Tokenizer:
    """Encoder for one vocabulary file of word-end BPE; ``names`` keeps the words' token strings too, for decoding."""

    def __init__(self, path: str, names: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.tokens = [""] * size
        for t, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = t
        keys, rank, new = [], [], []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[a] * size + vocab[b])
            rank.append(r)
            new.append(vocab[a + b])
        self._hash_pairs(np.array(keys, np.int64), np.array(rank, np.int64))
        self.merged = np.array(new, np.int32)  # by rank
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int32)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # \s of the vocabulary's library is Unicode white space only
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        for name, own in ((r"\p{L}", _latin_class("L")), (r"\p{N}", _latin_class("N")), (r"\s", "\t-\r \x85\xa0")):
            split = split.replace(name, own)
        self.latin_words = re.compile(split)  # the same words for texts of Latin-1, by the faster library
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.marks = {t[:2] for t in self.special}
        self.ids: dict[str, bytes] = {}  # word -> ids as little-endian uint32
        self.names: dict[str, str] | None = {} if names else None  # word -> tokens joined by a space
        self.path, self.library = path, None
        self.unknown = regex.compile(f"[{_unassigned()}]")

    # --- words of a text -------------------------------------------------------------------------------
    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens included."""
        if any(m in text for m in self.marks):
            out: list[str] = []
            for i, piece in enumerate(self.specials.split(text)):
                if i % 2:
                    out.append(piece)
                elif piece:
                    out += self._words(piece)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if _latin(text):  # NFC as it stands
            return self.latin_words.findall(text.lower())
        if self.unknown.search(text):
            return self._library_words(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: single characters
        return self.words.findall(text.lower())

    def _library_words(self, text: str) -> list[str]:
        """Words of a text with characters that Python's Unicode tables lack: by the rules of the vocabulary's library."""
        if self.library is None:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_file(self.path)
        byte_of = {s: i for i, s in enumerate(byte_symbols())}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([byte_of[c] for c in word]).decode() for word, _ in pieces]

    # --- segment trees -----------------------------------------------------------------------------------
    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probes; the table has at least sixteen places a pair."""
        self.table_bits = int(max(10, np.ceil(np.log2(len(keys) * 16 + 1))))
        self.table_key = np.full(1 << self.table_bits, -1, np.int64)
        self.table_rank = np.full(1 << self.table_bits, NONE, np.int64)
        at = self._place(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.table_key[at[left]] < 0]
            free = free[np.unique(at[free], return_index=True)[1]]
            self.table_key[at[free]] = keys[free]
            self.table_rank[at[free]] = ranks[free]
            left = left[self.table_key[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.table_bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it has none or one side is missing (-1)."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = self._place(key)
        out = self.table_rank[at]
        found = self.table_key[at]
        again = np.flatnonzero((found != key) & (found >= 0))
        out[found != key] = NONE
        while len(again):
            at[again] = (at[again] + 1) & ((1 << self.table_bits) - 1)
            found = self.table_key[at[again]]
            hit = again[found == key[again]]
            out[hit] = self.table_rank[at[hit]]
            again = again[(found != key[again]) & (found >= 0)]
        return out

    def _merge_class(self, words: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many of each), for words of at most ``leaves`` bytes (a power of two).

        One tree a word, all trees in one array; so are the symbols (ids) and their neighbours (before, after).
        """
        n, wide = len(words), leaves + 1
        length = np.array([len(w) for w in words])
        stop = np.cumsum(length)
        data = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), length)
        at = row * wide + np.arange(len(data)) - np.repeat(stop - length, length)
        ids = np.full(n * wide, -1, np.int32)
        ids[at] = self.inner[data]
        ids[at[stop - 1]] = self.last[data[stop - 1]]
        before = np.tile(np.arange(-1, leaves, dtype=np.int32), n)
        after = np.tile(np.arange(1, leaves + 2, dtype=np.int32), n)
        after[at[stop - 1]] = leaves  # the place past the end; its id stays -1
        # A node holds rank * leaves + position: the minimum is the leftmost pair of the lowest rank.
        tree = np.full((n, 2 * leaves), NONE * leaves, np.int64)
        inside = np.setdiff1d(np.arange(len(at)), stop - 1, assume_unique=True)
        leaf = tree.reshape(-1)
        place = at[inside] - row[inside] * wide
        leaf[row[inside] * 2 * leaves + leaves + place] = self._ranks(ids[at[inside]], ids[at[inside] + 1]) * leaves + place
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NONE * leaves)
        while len(live):
            base, root = live * wide, live * (2 * leaves)
            top = leaf[root + 1]
            here = top & (leaves - 1)
            gone = after[base + here].astype(np.int64)
            nxt = after[base + gone].astype(np.int64)
            prev = before[base + here].astype(np.int64)
            ids[base + here] = self.merged[top // leaves]
            ids[base + gone] = -1
            after[base + here] = nxt
            more = nxt < leaves
            before[(base + nxt)[more]] = here[more]
            leaf[root + leaves + gone] = NONE * leaves
            leaf[root + leaves + here] = self._ranks(ids[base + here], ids[base + nxt]) * leaves + here
            has = prev >= 0
            b, r, p = base[has], root[has], prev[has]
            leaf[r + leaves + p] = self._ranks(ids[b + p], ids[b + here[has]]) * leaves + p
            tops = np.concatenate([root, root, r])
            node = np.concatenate([here, gone, p]) + leaves
            while node[0] > 1:
                node >>= 1
                x = tops + 2 * node
                leaf[tops + node] = np.minimum(leaf[x], leaf[x + 1])
            live = live[leaf[root + 1] < NONE * leaves]
        kept = ids >= 0
        return ids[kept], kept.reshape(n, wide).sum(axis=1)

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word."""
        n = len(word)
        leaves = 1 << (n - 1).bit_length()
        ids = np.full(leaves + 1, -1, np.int32)  # the place past the end stays -1
        data = np.frombuffer(word, np.uint8)
        ids[:n] = self.inner[data]
        ids[n - 1] = self.last[data[-1]]
        before, after = np.arange(-1, leaves), np.arange(1, leaves + 2)
        after[n - 1] = before[0] = leaves
        tree = np.full(2 * leaves, NONE, np.int64)  # ranks; leaf k is that of the pair that begins at symbol k
        tree[leaves : leaves + n - 1] = self._ranks(ids[: n - 1], ids[1:n])
        level = leaves
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        while tree[1] < NONE:
            rank = tree[1]
            node = np.ones(1, np.int64)
            while node[0] < leaves:  # down to all leaves of that rank, left to right
                node = np.stack([2 * node, 2 * node + 1], 1).ravel()
                node = node[tree[node] == rank]
            here = node - leaves
            if len(here) > 1:  # of pairs that overlap, every other one from the left
                joined = np.r_[False, after[here[:-1]] == here[1:]]
                first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(here))))
                here = here[(np.arange(len(here)) - first) % 2 == 0]
            new = self.merged[rank]
            left = ids[before[here]].copy()
            if len(here) > 1:
                left[1:][after[after[here[:-1]]] == here[1:]] = new  # the symbol to the left was merged just before
            met = np.stack([self._ranks(left, np.full(len(here), new)), self._ranks(np.full(len(here), new), ids[after[after[here]]])])
            if (met < rank).any():
                here = here[:1]
            gone = after[here]
            nxt = after[gone]
            ids[here], ids[gone] = new, -1
            after[here] = nxt
            inside = nxt < leaves
            before[nxt[inside]] = here[inside]
            prev = before[here]
            prev = prev[prev < leaves]
            tree[leaves + gone] = NONE
            changed = np.unique(np.r_[here, prev])
            tree[leaves + changed] = self._ranks(ids[changed], ids[after[changed]])
            node = np.unique(np.r_[changed, gone]) + leaves
            while node[0] > 1:
                node = node >> 1
                node = node[np.r_[True, node[1:] != node[:-1]]]
                tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
        return ids[ids >= 0]

    def _learn(self, words: list[str]) -> None:
        """Put words into the cache."""
        tokens = self.tokens
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            if w in self.special:
                self.ids[w] = np.array([self.special[w]], "<u4").tobytes()
                if self.names is not None:
                    self.names[w] = w
            else:
                b = w.encode()
                classes.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((w, b))
        for leaves, own in classes.items():
            step = max(1, (1 << 19) // leaves)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                if leaves > LONG_WORD:
                    each = [self._merge_long(b) for _, b in part]
                    ids, n = np.concatenate(each), np.array([len(e) for e in each])
                else:
                    ids, n = self._merge_class([b for _, b in part], leaves)
                raw, names = ids.astype("<u4").tobytes(), [tokens[k] for k in ids.tolist()] if self.names is not None else None
                start = 0
                for (w, _), end in zip(part, np.cumsum(n).tolist()):
                    self.ids[w] = raw[4 * start : 4 * end]
                    if names:
                        self.names[w] = " ".join(names[start:end])
                    start = end

    def encode_texts(self, texts: list[str | None]) -> Iterator[tuple[bytes, str | None]]:
        """For each text its ids as little-endian uint32, and (with names) what they decode to."""
        i = 0
        while i < len(texts):  # a few megabytes at a time, so that new words are learnt together
            split, size = [], 0
            while i < len(texts) and size < 2_000_000:
                split.append(self.split(texts[i] or ""))
                size += len(texts[i] or "")
                i += 1
            words = set(chain.from_iterable(split))
            missing = words.difference(self.ids)
            if len(self.ids) + len(missing) > CACHE_WORDS:
                self.ids.clear()
                if self.names is not None:
                    self.names.clear()
                missing = words
            if missing:
                self._learn(list(missing))
            ids, name = self.ids.__getitem__, self.names.__getitem__ if self.names is not None else None
            for s in split:
                yield b"".join(map(ids, s)), " ".join(map(name, s)) if name else None

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(next(self.encode_texts([text]))[0], "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=4)
def tokenizer(path: str, names: bool = True) -> Tokenizer:
    """One tokenizer a worker and path."""
    return Tokenizer(path, names)


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs(doc_id, text)``."""

    def run(batches):
        tok = tokenizer(path)
        for b in batches:
            n, ids, decoded = [], [], []
            for raw, back in tok.encode_texts(b.column("text").to_pylist()):
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded: the ids of every whole text and what they decode to."""

    def run(batches):
        tok = tokenizer(path)
        for b in batches:
            ids, decoded = [], []
            for raw, back in tok.encode_texts(b.column("text").to_pylist()):
                ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                decoded.append(back)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
