"""Ordered structures as queries: due items, upserted ordered sets, first-seen filters, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.lineage import cut


def smallest(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k smallest rows (a top-k by heap in every task, not a sort of the table)."""
    return df.orderBy(*keys).limit(k)


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in range partitions (column ``_p``), written, as they are read twice and the parts must stay."""
    return cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def _offsets(ranged: DataFrame) -> DataFrame:
    """(_p, _n, _off): rows in a partition and before it; a row a partition."""
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))


def without_nth(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """All rows but the n-th smallest (from 0) by keys that are unique and not null; all rows if there are no more than n.

    Rows are ranked only in the range partition that holds the n-th."""
    ranged = _ranged(df.select(*keys), keys)
    place = _offsets(ranged).where((F.col("_off") <= n) & (F.col("_off") + F.col("_n") > n))
    w = Window.partitionBy("_p").orderBy(*keys)
    one = ranged.join(F.broadcast(place), "_p").withColumn("_at", F.col("_off") + F.row_number().over(w) - 1).where(F.col("_at") == n)
    return df.join(F.broadcast(one.select(*keys)), keys, "left_anti")  # a single row


def within_keys(df: DataFrame, key: str, order: list[str], value: str, rank: str = "rank", previous: str = "previous", amount: str | None = None, before: str = "before") -> DataFrame:
    """Each row with its rank in its key (from 0) and the ``value`` of the row before it (null for the first); with an
    ``amount``, a column of whole numbers, also with its sum over the rows before (null amounts are 0).

    No key's rows meet in one task: they lie in range partitions by key and order, and what a partition must know of those
    before it is at most two rows a partition (its first and last key's counts and last values). ``order`` tells a key's rows
    apart; a null key is a key. An empty table gives no rows.
    """
    size = F.coalesce(F.col(amount).cast("long"), F.lit(0)) if amount else F.lit(0).cast("long")
    packed = df.select(F.struct(key).alias("_key"), F.struct(*order).alias("_order"), F.struct(value).alias("_value"), F.struct(*df.columns).alias("_row"), size.alias("_size"))
    ranged = _ranged(packed, ["_key", "_order"])  # a struct is never null
    own = Window.partitionBy("_p", "_key").orderBy("_order")
    edges = ranged.groupBy("_p").agg(F.array_distinct(F.array(F.min("_key"), F.max("_key"))).alias("_keys")).select("_p", F.explode("_keys").alias("_key"))
    sums = ranged.join(F.broadcast(edges), ["_p", "_key"], "left_semi").groupBy("_p", "_key").agg(F.count(F.lit(1)).alias("_n"), F.max_by("_value", "_order").alias("_last"), F.sum("_size").alias("_sum"))
    over = Window.partitionBy("_key").orderBy("_p")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_p", "_key", F.sum("_n").over(earlier).alias("_off"), F.lag("_last").over(over).alias("_last"), F.sum("_sum").over(earlier).alias("_carry"))
    rows = ranged.withColumn("_i", F.row_number().over(own) - 1).withColumn("_before", F.lag("_value").over(own))
    if amount:
        rows = rows.withColumn("_sum", F.sum("_size").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(F.broadcast(carried), ["_p", "_key"], "left")
    found = F.when(F.col("_i") > 0, F.col("_before")).otherwise(F.col("_last"))
    total = [(F.coalesce("_carry", F.lit(0)) + F.coalesce("_sum", F.lit(0))).alias(before)] if amount else []
    return rows.select("_row.*", (F.coalesce("_off", F.lit(0)) + F.col("_i")).alias(rank), found[value].alias(previous), *total)


def latest_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Upsert: of rows with one key the last stays (a maximum, aggregated before the shuffle)."""
    last = df.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_last"))
    return last.select("_last.*")


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by a partially aggregated minimum over the whole row."""
    rest = [c for c in df.columns if c != key and c not in order]
    low = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return low.select(key, "_first.*").select(*df.columns)


def bloom_semi(df: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose key is a member. The filter in front of the shuffle is Spark's own: it is built at run time where the
    members' side is small and the other one large (spark.sql.optimizer.runtime.bloomFilter.*)."""
    return df.join(members.select(F.col(member).alias("_member")), F.col(key) == F.col("_member"), "left_semi")


def numbered(df: DataFrame, order: list[str], n: int, out: str) -> DataFrame:
    """Round-robin split 0..n-1 in an order, without one task for all rows: ranks within range partitions plus offsets."""
    ranged = _ranged(df, order)
    w = Window.partitionBy("_p").orderBy(*order)
    return ranged.join(F.broadcast(_offsets(ranged).drop("_n")), "_p").withColumn(out, (F.col("_off") + F.row_number().over(w) - 1) % n).drop("_p", "_off")
