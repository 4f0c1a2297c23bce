"""Named counters: totals, snapshots, rates and resets over a table or stream of increments (grp, name, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(increments: DataFrame) -> DataFrame:
    return increments.groupBy("grp", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def stored(increments: DataFrame, tie: str) -> DataFrame:
    """The last stored value of each counter (by ts, then ``tie``)."""
    return increments.groupBy("grp", "name").agg(F.max_by("value", F.struct("ts", tie)).alias("stored"))


def snapshots(increments: DataFrame, width: str) -> DataFrame:
    """At the end of each interval with increments: the running total, and the total of the snapshot before."""
    per = increments.groupBy("grp", "name", F.window("ts", width)["end"].alias("at")).agg(F.sum("value").alias("delta"))
    w = Window.partitionBy("grp", "name").orderBy("at")
    total = per.withColumn("snapshot", F.sum("delta").over(w)).drop("delta")
    return total.withColumn("last", F.coalesce(F.lag("snapshot").over(w), F.lit(0).cast("long"))).withColumn("last_at", F.lag("at").over(w)).withColumn(
        "first_at", F.min("at").over(Window.partitionBy("grp", "name"))
    )


def rates(snaps: DataFrame) -> DataFrame:
    """Average rate since the first snapshot and rate since the last one, a second, in whole numbers; zero counters go."""
    seconds = lambda a, b: F.greatest(F.lit(1).cast("long"), F.unix_timestamp(a) - F.unix_timestamp(b))
    return snaps.where("snapshot <> 0").select(
        "grp", "name", "at", "snapshot",
        F.expr("snapshot").alias("total"),
        F.floor(F.col("snapshot") / seconds("at", "first_at")).cast("long").alias("avg_rate"),
        F.floor((F.col("snapshot") - F.col("last")) / seconds("at", F.coalesce("last_at", "first_at"))).cast("long").alias("rate"),
    ).drop("total")


def with_resets(increments: DataFrame, reset: str, tie: str, bucket: Column) -> DataFrame:
    """Running total of each counter since its last reset (rows where ``reset`` is true start anew).

    There are few counters and many rows, so windows run within a counter's ``bucket`` (which must not fall as ts rises);
    what the buckets before leave behind is carried over by a table of one row a counter and bucket.
    """
    keys = ["grp", "name"]
    rows = increments.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy("ts", tie)
    rows = rows.withColumn("_seg", F.sum(F.col(reset).cast("long")).over(w))
    part = rows.groupBy(*keys, "_b", "_seg").agg(F.sum("value").alias("_sum"))
    left = part.groupBy(*keys, "_b").agg(F.max("_seg").alias("_resets"), F.max_by("_sum", "_seg").alias("_tail"))
    over = Window.partitionBy(*keys).orderBy("_b")
    left = left.withColumn("_run", F.sum((F.col("_resets") > 0).cast("long")).over(over))
    left = left.withColumn("_total", F.sum("_tail").over(Window.partitionBy(*keys, "_run").orderBy("_b")))
    carried = left.select(*keys, "_b", F.coalesce(F.lag("_total").over(over), F.lit(0)).alias("_before"))
    within = F.sum("value").over(Window.partitionBy(*keys, "_b", "_seg").orderBy("ts", tie))
    joined = rows.join(carried, [*keys, "_b"])
    return joined.withColumn("since_reset", within + F.when(F.col("_seg") == 0, F.col("_before")).otherwise(0)).drop("_b", "_seg", "_before")


TOTAL_ONLY, NO_PRINT, NO_RESET = 1, 2, 4


def with_options(rows: DataFrame, options: DataFrame) -> DataFrame:
    """The rows with ``opt``, the options of their counter in ``options(grp, name, opt)`` (0 without any)."""
    known = options.groupBy("grp", "name").agg(F.max("opt").alias("opt"))
    return rows.join(known, ["grp", "name"], "left").withColumn("opt", F.coalesce("opt", F.lit(0)))


def heeded_resets(rows: DataFrame, reset: str) -> DataFrame:
    """``reset`` without effect on counters that are not reset (rows as of ``with_options``)."""
    return rows.withColumn(reset, F.col(reset) & (F.col("opt").bitwiseAND(F.lit(NO_RESET)) == 0))


def report(rated: DataFrame) -> DataFrame:
    """A line for each rate row (``rates`` with ``opt``): total, average and last rate; the total alone; or none."""
    numbers = F.concat_ws("\t", "snapshot", F.when(F.col("opt").bitwiseAND(F.lit(TOTAL_ONLY)) == 0, F.concat_ws("\t", "avg_rate", "rate")))
    return rated.where(F.col("opt").bitwiseAND(F.lit(NO_PRINT)) == 0).select("grp", "name", "at", F.concat(F.col("name"), F.lit(":\t"), numbers).alias("line"))


def client_deltas(polls: DataFrame) -> DataFrame:
    """(client, name, at, total): what each counter gained since the same client's poll before."""
    w = Window.partitionBy("client", "name").orderBy("at")
    return polls.withColumn("delta", F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0)))


def day_sketches(rows: DataFrame, keys: list[str], ts: str, item: str, size: int = 14) -> DataFrame:
    """(keys, day, sketch): a sketch of the different items of each day, of 2**size registers, that later days can be united with."""
    return rows.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(item, size).alias("sketch"))


def rolling_distinct(sketches: DataFrame, keys: list[str], days: int) -> DataFrame:
    """(keys, day, estimate): different items of each day with a sketch and the days before it, ``days`` in all.

    The standard error is 1.04 / sqrt(registers). Every sketch is sent to the windows it belongs to, and united before it is.
    """
    ends = F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day")
    united = sketches.select(*keys, ends, "sketch").groupBy(*keys, "day").agg(F.hll_union_agg("sketch").alias("sketch"))
    known = sketches.select(*keys, "day").distinct()
    return united.join(known, [*keys, "day"], "left_semi").select(*keys, "day", F.hll_sketch_estimate("sketch").alias("estimate"))


def streaming_totals(increments: DataFrame, width: str, late: str) -> DataFrame:
    """The same totals by event-time interval, for a streaming table of increments."""
    return increments.withWatermark("ts", late).groupBy(F.window("ts", width).alias("interval"), "grp", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
