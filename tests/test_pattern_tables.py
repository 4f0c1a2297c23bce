import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.operators import matchers, pattern_tables

VALUES = [None, "", "a", "ab", "abc/", "www.a.com", "www.b.com", "www.a/b.com", "x" * 300 + "needle of a long value" + "y" * 300, "é", "aéb", "ab*cd", "^ab$", "a\nb"]
PATTERNS = [
    None, "", "a", "^", "$", "^$", "*", "ab", "ab", "*ab*", "^ab", "^ab*", "ab$", "*ab$", "^ab$", "^www.*.com$", "^a*$", "^*b$", "^a*b*c", "é", "^é$", "needle of a long value", "xneedle of a long valuey",
    "x" * 40, "x" * 301, "^" + "x" * 200, "y" * 100 + "$", "\x02a", "b\x03", "^\x02", "\nb", "www.", "^^ab$$", "b*c", "*.com$",
]


def brute(value, pattern):
    try:
        p = matchers.parse_pattern(pattern)
    except ValueError:
        return False
    if p is None or value is None:
        return False
    if p.kind == "infix":
        middle = value[len(p.text) : len(value) - len(p.tail)]
        return len(value) > len(p.text) + len(p.tail) and value.startswith(p.text) and value.endswith(p.tail) and "/" not in middle
    return {"full": value == p.text, "prefix": value.startswith(p.text), "suffix": value.endswith(p.text), "contains": p.text in value}[p.kind]


def table(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"id int, v {kind}")


@pytest.mark.parametrize("most", [2 << 20, 200])
def test_match_table_equals_brute_force(spark, most):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab/.é") for _ in range(n))
    values = VALUES + [word(rng.randrange(0, 60)) for _ in range(60)]
    patterns = PATTERNS + [rng.choice(["", "^", "*"]) + word(rng.randrange(1, 9)) + rng.choice(["", "$", "*"]) for _ in range(150)]
    got = pattern_tables.match_table(table(spark, values), "id", "v", table(spark, patterns).select("v"), "v", most).collect()
    want = {(i, p) for i, v in enumerate(values) for p in patterns if p is not None and brute(v, p)}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("most", [2 << 20, 300])
def test_match_url_table_equals_columns(spark, most):
    rng = random.Random(6)
    hosts, cells = ["a.com", "b.com"], ["", "x", "xy", "xyz", "y"]
    urls = [None, "", "a.com", "a.com/", "a.com?q/x"] + ["/".join([rng.choice(hosts), *[rng.choice(cells) for _ in range(rng.randrange(4))]]) + rng.choice(["", "?q=/", "#f"]) for _ in range(80)]
    wild = cells + ["*", "x*", "*y", "x*z", "xy*yz"]
    patterns = [None, "", "*/x"] + ["/".join([rng.choice(hosts), *[rng.choice(wild) for _ in range(rng.randrange(4))]]) for _ in range(80)]
    df = table(spark, urls)
    got = pattern_tables.match_url_table(df, "id", "v", table(spark, patterns).select("v"), "v", most).collect()
    distinct = [p for p in dict.fromkeys(patterns) if p is not None]
    held = df.select("id", F.array(*[matchers.url_condition(F.col("v"), p) for p in distinct]).alias("m")).collect()
    want = {(r.id, p) for r in held for p, ok in zip(distinct, r.m) if ok}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and want
    listed = spark.createDataFrame(list(enumerate(patterns)), "n int, v string")
    first = {r.id: r.pattern for r in pattern_tables.first_url_match(df, "id", "v", listed, "v", "n", most).collect()}
    assert first == {i: next(p for p in patterns if (i, p) in want) for i, _ in want}


def seconds(work):
    began = time.process_time()
    work()
    return time.process_time() - began


def test_time_does_not_grow_with_shared_prefixes():
    """100,000 patterns with one prefix of 32 characters, of every kind: linear in the values."""
    rows = [(k, "x" * 32 + f"{i}q" if k != "infix" else "x" * 32, f"{i}" if k == "infix" else "") for i in range(20_000) for k in ("contains", "prefix", "suffix", "full", "infix")]
    machine = pattern_tables.Automaton(pa.table({n: [r[j] for r in rows] for j, n in enumerate(("kind", "text", "tail"))}))
    assert [rows[i] for i in machine.find("x" * 32 + "77q")] == [(k, "x" * 32 + "77q", "") for k in ("contains", "prefix", "suffix", "full")]
    assert [rows[i] for i in machine.find("x" * 32 + "y77")] == [("infix", "x" * 32, "7"), ("infix", "x" * 32, "77")]
    short, long = "x" * 40 + "5q " * 3000, "x" * 40 + "5q " * 48_000
    machine.find(long)
    assert seconds(lambda: machine.find(long)) < 0.1 + 24 * max(0.01, seconds(lambda: machine.find(short)))


def test_100_000_url_patterns_of_one_host():
    parts = [["a.com", f"s{i}", c] for i in range(25_000) for c in ("*", "x*", "*y", f"z*{i}")]
    machine = pattern_tables.SegmentTries(pa.table({"_parts": parts}))
    assert [parts[i][2] for i in machine.find(["a.com", "s77", "xy"])] == ["*", "x*", "*y"] and machine.find(["a.com", "s77"]) == machine.find(["b.com", "s1", "x"]) == []
    assert seconds(lambda: [machine.find(["a.com", f"s{i}", "z.77"]) for i in range(20_000)]) < 2


@pytest.mark.parametrize("match", [pattern_tables.match_table, pattern_tables.match_url_table])
def test_empty_tables(spark, match):
    some, none = table(spark, ["a.com/x"]), table(spark, [])
    assert match(some, "id", "v", none.select("v"), "v").count() == 0
    assert match(none, "id", "v", some.select("v"), "v").count() == 0
    assert match(some.withColumn("pattern", F.lit(1)).withColumn("_value", F.lit(2)), "id", "v", some.select("v"), "v").count() == 1
