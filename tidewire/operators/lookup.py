"""Lookups of records in dictionaries, value lists, ranges and ordered neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dictionary_lookup(records: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left equi-join with a dictionary; Spark broadcasts the dictionary only where its measured size allows."""
    return records.join(table, key, "left")


def list_match(records: DataFrame, field: str, values: DataFrame, value: str, keep: bool = True) -> DataFrame:
    """White list (keep rows whose field is listed) or black list (keep the others, null fields included)."""
    listed = values.select(F.col(value).alias("_listed")).where("_listed is not null").distinct()
    return records.join(listed, F.col(field) == F.col("_listed"), "left_semi" if keep else "left_anti")


BUCKET = 1 << 16


def check_ranges(ranges: DataFrame) -> None:
    """Raise if two ranges overlap (a lookup would be ambiguous) or a range ends before it starts."""
    spread = ranges.withColumn("bucket", F.explode(_buckets()))
    order = Window.partitionBy("bucket").orderBy("start_ip", "end_ip")
    bad = spread.withColumn("before", F.max("end_ip").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("before >= start_ip")
    if not bad.isEmpty() or not ranges.where("end_ip < start_ip").isEmpty():
        raise ValueError("ranges overlap or are reversed")


def _buckets() -> Column:
    return F.sequence(F.floor(F.col("start_ip") / BUCKET), F.floor(F.col("end_ip") / BUCKET))


def range_lookup(records: DataFrame, ip: str, ranges: DataFrame, how: str = "inner", wide: int = 4096) -> DataFrame:
    """Join each address with the range (start_ip..end_ip, inclusive) that holds it.

    Ranges are cut at /16 boundaries and joined by that bucket, so no nested loop is needed. Ranges of more than
    ``wide`` buckets are joined by their /8 instead of being exploded further.
    """
    size = F.floor(F.col("end_ip") / BUCKET) - F.floor(F.col("start_ip") / BUCKET) + 1
    narrow = ranges.where(size <= wide).withColumn("_b", F.explode(_buckets())).withColumn("_w", F.lit(BUCKET))
    broad = ranges.where(size > wide).withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_ip") / (BUCKET * 256)), F.floor(F.col("end_ip") / (BUCKET * 256))))).withColumn(
        "_w", F.lit(BUCKET * 256)
    )
    keys = F.array(*[F.struct(F.lit(w).alias("_w"), F.floor(F.col("_ip") / w).alias("_b")) for w in (BUCKET, BUCKET * 256)])
    probed = records.where(F.col(ip).isNotNull()).select(F.col(ip).alias("_ip")).distinct().withColumn("_k", F.explode(keys)).select("_ip", "_k.*")
    hits = probed.join(narrow.unionByName(broad), ["_w", "_b"]).where((F.col("_ip") >= F.col("start_ip")) & (F.col("_ip") <= F.col("end_ip"))).drop("_w", "_b")
    return records.join(hits, F.col(ip) == F.col("_ip"), how).drop("_ip")


def neighbours(df: DataFrame, key: str, order: list[str], value: Column, bucket: Column) -> DataFrame:
    """prev_value and next_value: the nearest non-null value strictly before and after each row of its key.

    ``bucket`` (say, the day) must not fall as ``order`` rises. Windows run within a key's bucket; what lies in other
    buckets is carried over by a table of one row a key and bucket, so a key with very many rows is not one task.
    """
    rows = df.withColumn("_v", value).withColumn("_b", bucket)
    place = F.struct(*order)
    ends = rows.groupBy(key, "_b").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), place)).alias("_last"), F.min_by("_v", F.when(F.col("_v").isNotNull(), place)).alias("_first")
    )
    over = Window.partitionBy(key).orderBy("_b")
    carried = ends.select(
        key, "_b",
        F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    w = Window.partitionBy(key, "_b").orderBy(*order)
    return (
        rows.join(carried, [key, "_b"], "left")
        .withColumn("prev_value", F.coalesce(F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_before"))
        .withColumn("next_value", F.coalesce(F.first("_v", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), "_after"))
        .drop("_v", "_b", "_before", "_after")
    )
