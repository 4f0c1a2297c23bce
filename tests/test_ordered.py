import random

from pyspark.sql import functions as F

from tidewire.operators import ordered
from tidewire.streaming import flows


def test_within_keys_of_a_hot_key(spark):
    """A third of the rows have one key, some none; keys span partitions, and partitions hold one key alone."""
    r = random.Random(5)
    rows = [(i, r.choice(["hot", "hot", "a", "b", None, "c", f"k{i % 40}"]), r.choice([None, r.random()])) for i in range(900)]
    df = spark.createDataFrame(rows, "at long, name string, v double").withColumns({c: F.lit(1) for c in ("_n", "_p", "_key")})
    want, last, seen = set(), {}, {}
    for at, name, v in rows:
        want.add((at, name, v, seen.get(name, 0), last.get(name)))
        seen[name], last[name] = seen.get(name, 0) + 1, v
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = ordered.within_keys(df.repartition(5), "name", ["at"], "v").drop("_n", "_p", "_key").collect()
        assert {tuple(x) for x in got} == want and len(got) == 900
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ordered.within_keys(df.limit(0), "name", ["at"], "v").count() == 0


def test_chunks_have_places(spark):
    """One long message over many partitions, one with a gap, one with repeats, nulls and binary data."""
    rows = [("long", i, bytearray(b"x" * (i % 50))) for i in range(2000)] + [("gap", 0, bytearray(b"ab")), ("gap", 2, bytearray(b"cd")), ("gap", 3, bytearray(b"e"))]
    rows += [(None, 1, bytearray(b"\xff")), (None, 0, bytearray(b"zz")), (None, 0, bytearray(b"zz")), (None, None, bytearray(b"q")), ("none", 0, None)]
    chunks = spark.createDataFrame(rows, "flow string, seq int, chunk binary").repartition(9)
    got = {(r.flow, r.seq): (r.offset, bytes(r.chunk), r.in_order) for r in flows.placed(chunks, ["flow"], "seq", "chunk").collect()}
    at = 0
    for _, i, c in rows[:2000]:
        assert got.pop(("long", i)) == (at, bytes(c), True)
        at += len(c)
    assert got == {("gap", 0): (0, b"ab", True), ("gap", 2): (2, b"cd", False), ("gap", 3): (4, b"e", False), (None, 0): (0, b"zz", True), (None, 1): (2, b"\xff", True)}


def test_latest_and_without_nth(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "a", 1, None), (3, None, 5, "y"), (4, None, 4, "z"), (5, "b", None, "w")], "id long, k string, t int, s string")
    assert {tuple(r) for r in ordered.latest_by_key(df, "k", ["t"]).collect()} == {(2, "a", 1, None), (3, None, 5, "y"), (5, "b", None, "w")}
    numbers = spark.range(100).repartition(7)
    for n in (0, 50, 99, 100):
        assert sorted(r.id for r in ordered.without_nth(numbers, ["id"], n).collect()) == [i for i in range(100) if i != n]
    assert ordered.without_nth(numbers.limit(0), ["id"], 3).count() == 0
