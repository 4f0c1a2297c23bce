"""URL filters by a temporal list join.

A list is a log of dated entries (key, action, at). By key, an ``add`` holds from its time until the next entry of the
key; these validity intervals are equi-joined with the keys of each capture (its host, its parent domains, its host with
the first path segment) and compared with the capture's fetch time, which is an as-of join against the list as it stood
then. Captures of one host are salted, so a host that holds a third of all captures is dealt to many tasks.

Defined cases: at one time a ``remove`` wins over an ``add``; entries with a null key or time are left out, and so are
actions other than the two; a capture without a URL, host or fetch time matches nothing and is kept; repeated rows are
decided alike, one result row each; an empty list keeps everything; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host, without user, port and final dot; null if there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.regexp_replace(authority, r"\.$", "")
    return F.when(host != "", host)


def keys_of(url: Column) -> Column:
    """What list entries may name: host, parent domains of two labels or more, host and first path segment."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(labels) - 2)), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
    )
    segment = F.regexp_extract(url, r"^[^:]+://[^/?#]*/([^/?#]+)", 1)
    prefix = F.when(segment != "", F.array(F.concat(host_of(url), F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url).isNotNull(), F.array_distinct(F.concat(suffixes, prefix)))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, since, until): when each key is on the list; until is exclusive and null while it still is."""
    good = entries.where("key is not null and at is not null and action in ('add', 'remove')")
    last = good.groupBy("key", "at").agg(F.max("action").alias("action"))  # 'remove' sorts after 'add'
    order = Window.partitionBy("key").orderBy("at")
    return last.select("key", "action", F.col("at").alias("since"), F.lead("at").over(order).alias("until")).where("action = 'add'").drop("action")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, matched_key (the longest active one) and kept for ``captures(page_id, url, fetched)``."""
    held = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = captures.select("page_id", "url", "fetched")
    asked = rows.select("page_id", "url", "fetched", F.explode(keys_of(F.col("url"))).alias("key")).withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    )
    active = asked.join(held, ["key", "salt"]).where((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = active.groupBy("page_id", "url", "fetched").agg(F.max(F.struct(F.length("key").alias("size"), "key")).alias("best"))
    joined = rows.alias("r").join(
        best.alias("b"),
        (F.col("r.page_id").eqNullSafe(F.col("b.page_id"))) & (F.col("r.url") == F.col("b.url")) & (F.col("r.fetched") == F.col("b.fetched")),
        "left",
    )
    return joined.select("r.page_id", "r.url", "r.fetched", F.col("b.best.key").alias("matched_key"), F.col("b.best").isNull().alias("kept"))
