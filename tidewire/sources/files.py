"""Sources: IP range tables, properties files, capture files, rule tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.binary import inflate_col
from tidewire.functions.text import ip_number
from tidewire.functions.wire import pcap_records


def read_ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """start_ip, end_ip, province, city, county of a tab-separated file (# comments; rows that lack columns are left out)."""
    names = ["start", "end", "continent", "country", "province", "city", "county"]
    rows = spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"{n} string" for n in names))
    out = rows.select(ip_number(F.col("start")).alias("start_ip"), ip_number(F.col("end")).alias("end_ip"), *[F.col(c).try_cast("long").alias(c) for c in names[4:]])
    return out.dropna()


def read_properties(path: str, seen: tuple[str, ...] = ()) -> dict[str, str]:
    """``name value`` or ``name = value`` lines, # comments, ``@include file``; the last of a name wins."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            if line.startswith("@include"):
                other = os.path.join(os.path.dirname(path), line.split(None, 1)[1])
                if other not in seen:
                    out.update(read_properties(other, (*seen, path)))
                continue
            name, _, value = line.replace("=", " ", 1).partition(" ") if " = " in line or "=" in line.split()[0] else line.partition(" ")
            out[name] = value.strip().lstrip("=").strip()
    return out


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """ts, caplen, len, data of all records of the capture files under a path."""
    return split_captures(spark.read.format("binaryFile").load(path).select("content"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of text files that are gzip or plain by their first bytes, whatever their names. A file is one task's
    work and under 2 GB unpacked; a file that is empty, or unpacks to nothing, has no line, one that is broken gives one null line."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    content = F.when(F.hex(F.substring("content", 1, 2)) == "1F8B", inflate_col("content", F.lit("gzip"))).otherwise(F.col("content"))
    unpacked = files.select("path", content.alias("content")).where("content is null or length(content) > 0")
    lines = F.split(F.regexp_replace(F.decode("content", "UTF-8"), r"\r?\n\z", ""), r"\r?\n", -1)
    return unpacked.select("path", F.explode_outer(lines).alias("line"))


def captures(records: DataFrame, key: str, slice_bits: int = 16) -> DataFrame:
    """Capture files (key, content) of the hex column ``record``: one a key, or several where a key has more than 2**slice_bits records.

    A file of such a hot key takes its records from one run of 2**slice_bits rows of a partition, so the key is dealt to many tasks.
    """
    head = "D4C3B2A1020004000000000000000000FFFF000001000000"
    most = 1 << slice_bits
    sizes = records.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) > most:
        cut = records.withColumn("_run", F.shiftright(F.monotonically_increasing_id(), slice_bits))
        hot = sizes.where(F.col("_n") > most)
        sliced = cut.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left").select(key, "record", F.when(F.col("_n").isNotNull(), F.col("_run")).alias("_slice"))
    else:
        sliced = records.select(key, "record", F.lit(None).cast("long").alias("_slice"))
    content = F.unhex(F.concat(F.lit(head), F.array_join(F.collect_list("record"), "")))
    return sliced.groupBy(key, "_slice").agg(content.alias("content")).drop("_slice")


def _packets(rows: list[tuple]) -> pa.RecordBatch:
    sec, part, caplen, length, data = zip(*rows)
    us = [s * 1_000_000 + p for s, p in zip(sec, part)]
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(caplen, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())], names=["us", "caplen", "len", "data"])


def packet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of the files in ``content``, in batches that go on from file to file: a small file costs no batch of its own."""
    rows, held = [], 0
    for b in batches:
        for content in b.column("content"):
            for r in pcap_records(content.as_py()):
                rows.append(r)
                held += r[2]
                if len(rows) == 4096 or held > 1 << 23:
                    yield _packets(rows)
                    rows, held = [], 0
    if rows:
        yield _packets(rows)


def split_captures(files: DataFrame) -> DataFrame:
    """The records of whole capture files in a column ``content``."""
    found = files.select("content").mapInArrow(packet_batches, "us long, caplen long, len long, data binary")
    return found.select(F.timestamp_micros("us").alias("ts"), "caplen", "len", "data")


def capture_stats(packets: DataFrame) -> DataFrame:
    return packets.agg(F.count(F.lit(1)).alias("received"), F.sum("caplen").alias("bytes"))
