"""Packing of token sequences by cost.

Each task tokenizes its own documents and packs them block by block (about two million tokens), without a shuffle. The
cost of a document is a linear term plus a quadratic one for attention within it; documents are taken in descending
cost, and each goes to the sequence of the lowest cost that still has room for it. A document that fits nowhere is cut
over the cheapest sequences that have room. A block of n tokens gets n // 4096 sequences of 4096 and, for the rest of
the division, one sequence for each power of two in it; so every sequence is full and nothing is padded.

Defined cases: a null or empty text is the closing id alone; documents longer than a sequence fill whole sequences and
only their rest is placed by cost; repeated rows are packed as often as they occur; an empty table gives no rows; other
columns play no part. A task that is run again packs the same rows the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewire.llm.bpe import tokenizer

SEQUENCE = 4096
BLOCK_TOKENS = 512 * SEQUENCE
QUADRATIC = 1 / 1024  # cost of a piece of n tokens: n + QUADRATIC * n * n
END_ID = 2


def assign(lengths: list[int], sequence: int = SEQUENCE) -> tuple[list[list[tuple[int, int, int, int]]], list[int]]:
    """For each document its pieces as (start, length, sequence, offset), and the sizes of the sequences.

    All sequences are full: their sizes add up to the documents' tokens.
    """
    total = sum(lengths)
    sizes = [sequence] * (total // sequence) + [1 << k for k in range(sequence.bit_length() - 1, -1, -1) if (total % sequence) >> k & 1]
    size = np.array(sizes, np.int64)
    left = size.copy()
    cost = np.zeros(len(size))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]

    def put(doc: int, start: int, n: int, s: int) -> None:
        out[doc].append((start, n, s, int(size[s] - left[s])))
        left[s] -= n
        cost[s] += n + QUADRATIC * n * n

    rest, full = [], 0
    for doc, n in enumerate(lengths):
        for k in range(n // sequence):
            put(doc, k * sequence, sequence, full)
            full += 1
        if n % sequence:
            rest.append((n % sequence, doc))
    for n, doc in sorted(rest, key=lambda r: (-r[0], r[1])):
        start = lengths[doc] - n
        while n:
            room = left >= n
            if not room.any():
                room = left > 0
            s = int(np.where(room, cost, np.inf).argmin())
            take = min(n, int(left[s]))
            put(doc, start, take, s)
            start, n = start + take, n - take
    return out, sizes


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
        tok, end = tokenizer(path, names=False), np.array([END_ID], "<u4").tobytes()
        ids, texts, tokens = [], [], 0
        for b in batches:
            for doc_id, (raw, _) in zip(b.column("doc_id").to_pylist(), tok.encode_texts(b.column("text").to_pylist())):
                raw += end
                ids.append(doc_id)
                texts.append(raw)
                tokens += len(raw) // 4
                if tokens >= BLOCK_TOKENS:
                    yield ids, texts
                    ids, texts, tokens = [], [], 0
        if ids:
            yield ids, texts

    def run(batches):
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 40
        for ids, texts in blocks(batches):
            lengths = [len(t) // 4 for t in texts]
            placed, sizes = assign(lengths)
            rows = [
                (i, start, n, zlib.crc32(t[4 * start : 4 * (start + n)]), total, next_id + s, offset)
                for i, t, total, pieces in zip(ids, texts, lengths, placed)
                for start, n, s, offset in pieces
            ]
            next_id += len(sizes)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c) if c_i else pa.array(c, arrow_kind) for c_i, c in enumerate(zip(*rows))], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
