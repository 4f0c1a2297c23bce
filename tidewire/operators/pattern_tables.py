"""Pattern tables: pattern sets too large for one expression are rows, made into machines that scan the values.

String patterns become one automaton (a trie with failure links): every contained pattern, and every prefix, suffix and whole
value with a mark for the value's ends, is found in one pass over the value, however many patterns share a prefix. Patterns
that fix both ends are found by their head, then by a lookup of their tail. URL patterns become tries of segments, one for each
host and number of segments, walked level by level over exact, ``*`` and part-wild edges. ``scan`` deals patterns and values.

Null values match nothing; null and repeated patterns count as absent and once; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.matchers import url_segments
from tidewire.operators.scan import scan_table

#: Marks that stand before and after a value; places are checked, so a value or pattern may hold them.
BEGIN, END = "\x02", "\x03"


def parsed_patterns(patterns: DataFrame, pattern: str) -> DataFrame:
    """(pattern, kind, text, tail) by the rules of ``matchers.parse_pattern``; a ``*`` inside a prefix or suffix pattern
    gives kind ``bad``, which matches nothing. Patterns under two bytes are left out."""
    rows = patterns.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL").distinct()
    raw = F.col("pattern")
    starts, ends = raw.startswith("^"), raw.endswith("$") & (F.length(raw) > 1)
    body = F.substr(raw, starts.cast("int") + 1, F.length(raw) - starts.cast("int") - ends.cast("int"))
    body = (
        F.when(starts & ~ends, F.regexp_replace(body, r"\*\z", ""))
        .when(ends & ~starts, F.regexp_replace(body, r"\A\*", ""))
        .when(~starts & ~ends, F.btrim(body, F.lit("*")))
        .otherwise(body)
    )
    star = F.col("_body").contains("*")
    kind = (
        F.when(starts & ends & star, "infix").when((starts | ends) & star, "bad").when(starts & ends, "full")
        .when(starts, "prefix").when(ends, "suffix").otherwise("contains")
    )
    infix = F.col("kind") == "infix"
    rows = rows.withColumn("_body", body).where("octet_length(_body) >= 2").withColumn("kind", kind)
    return rows.select(
        "pattern", "kind", F.when(infix, F.substring_index("_body", "*", 1)).otherwise(F.col("_body")).alias("text"),
        F.when(infix, F.regexp_extract("_body", r"(?s)\A[^*]*\*(.*)\z", 1)).otherwise("").alias("tail"),
    )


class Automaton:
    """Finds all patterns (rows of kind, text, tail) in a value in one pass."""

    def __init__(self, rows: pa.Table):
        words: dict[str, tuple[bool, bool, list[int], dict]] = {}
        for i, (kind, text, tail) in enumerate(zip(*(rows.column(n).to_pylist() for n in ("kind", "text", "tail")))):
            starts, ends = kind in ("prefix", "full", "infix"), kind in ("suffix", "full")
            word = BEGIN * starts + text + END * ends
            entry = words.setdefault(word + "|" + str(starts) + str(ends), (starts, ends, [], {}))
            if kind == "infix":
                entry[3].setdefault(len(tail), {}).setdefault(tail, []).append(i)
            else:
                entry[2].append(i)
        by_word = defaultdict(list)
        for name, entry in words.items():
            by_word[name.rpartition("|")[0]].append(entry)
        self.automaton = ahocorasick.Automaton()
        for word, entries in by_word.items():
            self.automaton.add_word(word, (len(word), entries))
        self.any = bool(by_word)
        if self.any:
            self.automaton.make_automaton()

    def find(self, value: str) -> list[int]:
        if not self.any:
            return []
        out: set[int] = set()
        last = len(value) + 1
        for end, (size, entries) in self.automaton.iter(BEGIN + value + END):
            start = end - size + 1
            for starts, ends, whole, tails in entries:
                if starts != (start == 0) or ends != (end == last):
                    continue
                out.update(whole)
                slash = value.find("/", end) if tails else -1
                for n, known in tails.items():  # the head is value[:end]; the middle holds a character at least, and no slash
                    if len(value) > end + n and not 0 <= slash < len(value) - n:
                        out.update(known.get(value[len(value) - n :], ()))
        return sorted(out)


def match_table(df: DataFrame, key: str, field: str, patterns: DataFrame, pattern: str, most: int = 2 << 20) -> DataFrame:
    """(key, pattern) for every value of ``field`` and every pattern that matches it; ``key`` is unique in ``df``.

    An automaton holds patterns of up to ``most`` characters in all (some 70 bytes a character).
    """
    known = parsed_patterns(patterns, pattern).where("kind <> 'bad'")
    values = df.select(F.col(key).alias("_key"), F.col(field).alias("_value"))
    return scan_table(values, known, F.length("text") + F.length("tail") + 2, Automaton, ["pattern"], most=most).withColumnRenamed("_key", key)


class Node:
    __slots__ = ("exact", "star", "parts", "rows")

    def __init__(self) -> None:
        self.exact: dict[str, Node] = {}
        self.star: Node | None = None
        self.parts: dict[tuple[int, int], dict[tuple[str, str], Node]] = {}  # by the lengths of what stands before and after *
        self.rows: list[int] = []


class SegmentTries:
    """Finds all URL patterns (rows of segments ``_parts``) that fit the segments of a URL."""

    def __init__(self, rows: pa.Table):
        self.roots: dict[tuple[str, int], Node] = defaultdict(Node)
        for i, parts in enumerate(rows.column("_parts").to_pylist()):
            node = self.roots[parts[0], len(parts)]
            for part in parts[1:]:
                if part == "*":
                    node.star = node.star or Node()
                    node = node.star
                elif "*" in part:
                    head, _, tail = part.partition("*")
                    node = node.parts.setdefault((len(head), len(tail)), {}).setdefault((head, tail), Node())
                else:
                    node = node.exact.setdefault(part, Node())
            node.rows.append(i)

    def find(self, segments: list[str]) -> list[int]:
        level = [self.roots[segments[0], len(segments)]] if (segments[0], len(segments)) in self.roots else []
        for cell in segments[1:]:
            after = []
            for node in level:
                if cell in node.exact:
                    after.append(node.exact[cell])
                if node.star:
                    after.append(node.star)
                for (a, b), known in node.parts.items():
                    if len(cell) >= max(a, b) and (child := known.get((cell[:a], cell[len(cell) - b :]))):
                        after.append(child)
            level = after
        return [i for node in level for i in node.rows]


def _url_hits(df: DataFrame, key: str, field: str, patterns: DataFrame, keep: list[str], most: int) -> DataFrame:
    values = df.select(F.col(key).alias("_key"), url_segments(F.col(field)).alias("_value")).where("_value IS NOT NULL")
    known = patterns.withColumn("_parts", url_segments(F.col("pattern")))
    hosts = F.get("_value", F.lit(0)), F.get("_parts", F.lit(0))
    size = F.aggregate("_value", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s) + 8)
    found = scan_table(values, known, F.length("pattern") + 8, SegmentTries, keep, buckets=hosts, size=size, most=most)
    return found.withColumnRenamed("_key", key)


def match_url_table(df: DataFrame, key: str, field: str, patterns: DataFrame, pattern: str, most: int = 2 << 20) -> DataFrame:
    """(key, pattern) for every URL and every URL pattern that matches it, by the rules of ``matchers.url_condition``."""
    known = patterns.where(F.col(pattern).isNotNull()).select(F.col(pattern).alias("pattern")).distinct()
    return _url_hits(df, key, field, known, ["pattern"], most)


def first_url_match(df: DataFrame, key: str, field: str, patterns: DataFrame, pattern: str, order: str, most: int = 2 << 20) -> DataFrame:
    """(key, pattern): of the URL patterns that match a URL the one that comes first by ``order`` (ties: the smaller pattern)."""
    place = F.col(order).cast("long")
    known = patterns.where(F.col(pattern).isNotNull()).groupBy(F.col(pattern).alias("pattern")).agg(F.min(place).alias("_place"))
    hits = _url_hits(df, key, field, known, ["pattern", "_place"], most)
    return hits.groupBy(key).agg(F.min(F.struct(F.col("_place").isNull(), "_place", "pattern")).alias("_best")).select(key, F.col("_best.pattern").alias("pattern"))
