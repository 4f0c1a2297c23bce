"""Scanning values for the rows of a table that are too many for one expression.

The rows (patterns, rules) are made into a machine, and the machine is run over the values in Arrow batches, in time that
grows with the values and with what is found. Up to ``most`` units of weight the rows go to every task as they are (their
weight is checked first) and the values stay where they stand. Beyond that both sides are dealt: rows into shards of about
``most``, values into slices of about ``slice_bytes``; a task holds one shard and one slice. Where both sides have a bucket
(the host of a URL), a value meets only the shards of its bucket. What the driver sees is one count a bucket, and there are
as many buckets as shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Machine(Protocol):
    def find(self, value) -> list[int] | np.ndarray:
        """The numbers of the table's rows that belong to a value."""


_machines: dict[str, Machine] = {}


def _machine(token: str, rows: pa.Table, build: Callable[[pa.Table], Machine]) -> Machine:
    """One machine for a Python worker, however many tasks it runs."""
    if token not in _machines:
        _machines.clear()
        _machines[token] = build(rows)
    return _machines[token]


def _found(machine: Machine, keys: pa.Array, values: list, rows: pa.Table, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The keys and rows found, in batches of little more than ``most``."""
    columns = [rows.column(n).combine_chunks() for n in rows.column_names]
    at: list[int] = []
    hits: list[np.ndarray] = []
    held = 0
    for i, value in enumerate(values):
        found = machine.find(value) if value is not None else ()
        if len(found):
            at.append(i)
            hits.append(np.asarray(found, np.int64))
            held += len(found)
        if held and (held >= most or i + 1 == len(values)):
            of, key = pa.array(np.concatenate(hits)), pa.array(np.repeat(at, [len(h) for h in hits]))
            yield pa.RecordBatch.from_arrays([keys.take(key), *(c.take(of) for c in columns)], names=["_key", *rows.column_names])
            at, hits, held = [], [], 0


def scan_table(
    values: DataFrame, table: DataFrame, weight: Column, build: Callable[[pa.Table], Machine], keep: list[str], buckets: tuple[Column, Column] | None = None,
    size: Column | None = None, most: int = 2 << 20, slice_bytes: int = 64 << 20,
) -> DataFrame:
    """``_key`` and the columns ``keep`` of ``table``, for every row of ``values(_key, _value)`` and each row that its machine finds.

    ``weight`` is what a row of the table weighs, ``size`` the bytes of a value; ``buckets`` are columns of the values and of the
    table that are equal where a value may find a row.
    """
    kind = values.schema["_key"].dataType
    out = [f"_key {kind.simpleString()}"] + [f"{n} {table.schema[n].dataType.simpleString()}" for n in keep]
    total = table.agg(F.sum(weight)).first()[0] or 0
    if total <= most:
        rows, token = table.toArrow(), uuid.uuid4().hex  # no more than ``most``
        shared = values.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, kept = _machine(token, shared.value, build), shared.value.select(keep)
            for b in batches:
                for i in range(0, len(b), 2000):
                    part = b.slice(i, 2000)
                    yield from _found(machine, part.column(0), part.column(1).to_pylist(), kept)

        return values.select("_key", "_value").mapInArrow(run, ", ".join(out))

    n = -(-total // most) if buckets else 1
    of_value, of_row = ((F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c in buckets) if buckets else (F.lit(0), F.lit(0)))
    dealt = values.select("_key", "_value", of_value.alias("_bucket"))
    shards, slices = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in table.groupBy(of_row.alias("b")).agg(F.sum(weight).alias("w")).collect():
        shards[r.b] = -(-r.w // most)
    for r in values.groupBy(of_value.alias("b")).agg(F.sum(size if size is not None else F.octet_length("_value")).alias("w")).collect():
        slices[r.b] = max(1, -(-(r.w or 0) // slice_bytes))

    def of(counts: np.ndarray) -> Column:
        return F.get(F.array(*(F.lit(int(c)) for c in counts)), F.col("_bucket"))

    def copies(count: Column, name: str) -> Column:
        return F.explode(F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))).alias(name)

    left = dealt.withColumn("_slice", F.pmod(F.xxhash64("_key"), F.greatest(of(slices), F.lit(1))).cast("int")).select("*", copies(of(shards), "_shard"))
    right = table.withColumn("_bucket", of_row).withColumn("_shard", F.pmod(F.xxhash64(*table.columns), F.greatest(of(shards), F.lit(1))).cast("int")).select("*", copies(of(slices), "_slice"))

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        nothing = pa.table({"_key": a.column("_key").slice(0, 0), **{n: b.column(n).slice(0, 0) for n in keep}})
        if not len(a) or not len(b):
            return nothing
        found = list(_found(build(b), a.column("_key").combine_chunks(), a.column("_value").to_pylist(), b.select(keep)))
        return pa.Table.from_batches(found) if found else nothing

    by = ["_bucket", "_shard", "_slice"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(join, ", ".join(out))
