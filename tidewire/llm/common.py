"""Helpers shared by the corpus operators: tables, connected components, packed rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.lineage import cut

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """``name``, or the first longer one that is no column (Spark does not tell capitals from small letters)."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node in ``edges(a long, b long)``; component = smallest node reachable.

    Alternates large-star and small-star steps until the edge set is a forest of stars. Every step is a
    partially aggregated minimum and an equi-join, so no node's neighbours meet in one task.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")
        )
        e = cut(small.select("s.u", "s.v").where("u <> v").distinct())
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


# --- packed rows ---------------------------------------------------------------------------------------
def planes(x: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers, their lowest bytes first, then the next ones: the upper ones are mostly zero and compress well."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(raw: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def pack_ids(ids: np.ndarray) -> bytes:
    """64-bit numbers as planes of what they are above the smallest, which stands in front."""
    low = ids.min()
    return low.tobytes() + planes((ids - low).view(np.uint64), 8)


def unpack_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64, 1) + from_planes(raw[8:], 8).view(np.int64)


def edges(*columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal neighbours begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)
