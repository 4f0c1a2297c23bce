"""Line deduplication over overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a document (lines end at ``\\n``) are hashed to 128 bits. A window that also starts
earlier, in an earlier document (smaller doc_id) or at an earlier line, is a later occurrence; the lines that later
occurrences cover are removed, overlapping occurrences being merged.

Defined cases: a text of under three lines (null, empty) has no windows and is left as it is; a null text stays null;
rows with a null doc_id take no part and are kept unchanged; rows that repeat doc_id and text are one document, of
which every row is treated alike; rows that share a doc_id but not the text are told apart by a hash of the text; all
other columns are passed on, whatever their names (one named n_removed_lines is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import unused

WINDOW = 3


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, removed array<int>): the positions (from 0) that later occurrences cover."""
    known = docs.where("doc_id is not null and text is not null").select("doc_id", _key(F.col("text")).alias("text_key"), F.split("text", "\n", -1).alias("lines"))

    def window(i: Column) -> Column:
        cells = [F.get(F.col("lines"), i + k) for k in range(WINDOW)]
        return F.struct(i.alias("pos"), F.xxhash64(*cells).alias("h1"), F.xxhash64(F.lit(17), *cells).alias("h2"))

    # Hashed before they are exploded, so that no row drags the text along.
    starts = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    windows = known.where(F.size("lines") >= WINDOW).select("doc_id", "text_key", F.explode(F.transform(starts, window)).alias("w"))
    windows = windows.select("doc_id", "text_key", "w.*")
    # The first of each repeated window, found with partial aggregation; then an equi-join that can be split by AQE.
    first = windows.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "pos", "text_key")).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where(F.struct("doc_id", "pos", "text_key") > F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("starts")).select(
        "doc_id",
        "text_key",
        F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (WINDOW - 1))))).alias("removed"),
    )


def drop_repeated_lines(docs: DataFrame, count: str | None = "n_removed_lines") -> DataFrame:
    """The rows and columns of ``docs`` with later repeated lines taken out of ``text``, and a column ``count`` (none if None)."""
    own = {n: unused(docs.columns, f"_{n}") for n in ("doc_id", "text_key", "removed")}
    gone = removed_lines(docs).withColumnsRenamed(own)
    joined = docs.join(gone, (F.col("doc_id") == F.col(own["doc_id"])) & (_key(F.col("text")) == F.col(own["text_key"])), "left")
    removed, lines = F.col(own["removed"]), F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    text = F.when(removed.isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_sort(left), lambda i: lines[i]), "\n"))
    out = joined.withColumn("text", text)
    if count:
        return out.select(*[c for c in docs.columns if c != count], F.coalesce(F.size(removed), F.lit(0)).cast("long").alias(count))
    return out.select(*docs.columns)
