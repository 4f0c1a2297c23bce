import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.plans import rule_tables
from tidewire.plans.rules import RuleError, RuleSet, compile_tree, parse_expression


def random_rules(rng, n=60):
    groups = {f"$e{i}": rng.sample(["a.com", "b.com", "c.com", "x"], rng.randrange(1, 4)) for i in range(4)}
    groups |= {f"$w{i}": rng.sample(["^a", "com$", "b.", "^a*m$", "in", "^/x$", "/y"], rng.randrange(1, 4)) for i in range(5)}
    groups |= {f"$u{i}": rng.sample(["a.com/*", "a.com/x", "b.com/y*", "c.com/*/z"], rng.randrange(1, 3)) for i in range(3)}
    groups |= {"$r0": ["^a.*m$", "[[:digit:]]"], "$g0": ["*x?", "b.*"], "$none": [], "$null": [None]}
    matcher = {"e": "equals", "w": "wumanber", "u": "urlmatch", "r": "regex", "g": "wildcard", "n": "equals"}

    def leaf():
        field = rng.choice(["host", "uri", "url", "missing"])
        if rng.random() < 0.2:
            return f"{field} exists"
        g = rng.choice(list(groups))
        return f"{field} {matcher[g[1]]} {g}"

    def tree(depth):
        r = rng.random()
        if depth == 0 or r < 0.25:
            return leaf()
        return f"not ({tree(depth - 1)})" if r < 0.45 else f"({tree(depth - 1)}) {rng.choice(['and', 'or'])} ({tree(depth - 1)})"

    return [(i, tree(3)) for i in range(n)], groups


def records_of(spark, rng, n=70):
    hosts, uris = ["a.com", "b.com", "c.com", "x", None, "xin", ""], ["/x", "/y", "/yx", None, "/7", "x1"]
    rows = [(f"k{i}", rng.choice(hosts), rng.choice(uris)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, host string, uri string").withColumn("url", F.concat("host", "uri"))


@pytest.mark.parametrize("most", [2 << 20, 40])
def test_exceptions_equal_columns(spark, most):
    rng = random.Random(most)
    rules, groups = random_rules(rng)
    records = records_of(spark, rng).cache()
    values = [(g, v) for g, own in groups.items() for v in own]
    made = rule_tables.RuleTables(spark.createDataFrame(rules, "rule_id int, expression string"), spark.createDataFrame(values, "group string, value string"), most)
    plain = {g: [v for v in own if v is not None] for g, own in groups.items()}
    columns = {i: compile_tree(parse_expression(e), plain, {c: F.col(c) for c in ("host", "uri", "url")}) for i, e in rules}
    held = {r.k: r for r in records.select("k", *[c.alias(f"r{i}") for i, c in columns.items()]).collect()}
    odd = {(r.k, r.rule_id): r.matched for r in made.exceptions(records, "k").collect()}
    default = {r.rule_id: r.default for r in made.rules.collect()}
    for k, row in held.items():
        for i, _ in rules:
            assert row[f"r{i}"] == odd.get((k, i), default[i]), (k, rules[i])
    assert all(m != default[i] for (_, i), m in odd.items())
    assert {r.rule_id: r.n_records for r in made.rule_counts(records, "k").collect()} == {i: sum(r[f"r{i}"] for r in held.values()) for i, _ in rules}
    assert {r.k: r.n_rules for r in made.record_counts(records, "k").collect()} == {k: sum(r[f"r{i}"] for i, _ in rules) for k, r in held.items()}
    assert made.exceptions(records.limit(0), "k").count() == 0


def test_witnesses_are_needed():
    rng = random.Random(3)
    for _, text in random_rules(rng, 300)[0]:
        tokens, leaves = rule_tables.postfix(parse_expression(text))
        watched, default = rule_tables.witnesses(tokens, {n: rng.randrange(9) for n in leaves}), rule_tables.evaluate(tokens, set())
        for _ in range(40):
            hits = {n for n in leaves if rng.random() < 0.5}
            assert rule_tables.evaluate(tokens, hits) == default or hits & watched


def test_a_common_leaf_does_not_lead_to_all_rules():
    rows = []
    for i in range(50_000):
        tokens, leaves = rule_tables.postfix(parse_expression(f"host exists and uri equals $g{i} and not (query exists or not host exists)"))
        rows.append({"tokens": tokens, "default": rule_tables.evaluate(tokens, set()), "costs": [{"leaf": n, "hits": 1_000_000 if x.matcher == "exists" else 1} for n, x in leaves.items()]})
    machine = rule_tables.RuleMachine(pa.Table.from_pylist(rows))
    exists, some = (rule_tables.leaf_id(parse_expression(t)) for t in ("host exists", "uri equals $g7"))
    assert [list(machine.find(x)) for x in ([exists, some], [exists], [some])] == [[7], [], []]
    began = time.process_time()
    for _ in range(2000):
        machine.find([exists, some])
    assert time.process_time() - began < 1


def test_bad_rules(spark):
    values = spark.createDataFrame([], "group string, value string")
    for bad in ("host equals", "host nothing $x", None):
        with pytest.raises(Exception, match="RuleError"):
            rule_tables.RuleTables(spark.createDataFrame([(1, bad)], "rule_id int, expression string"), values)


def test_rule_set_as_tables(spark):
    rng = random.Random(8)
    records = records_of(spark, rng)
    rules = RuleSet()
    rules.add("string:$h\n  a.com\n  b.com\n@not host equals $h\nuri wumanber\n  ^/x*", "OR")
    rules.add("string:host exists\nuri wumanber\n  y", "AND")
    rules.compile()
    fields = {c: F.col(c) for c in ("host", "uri", "url")}
    want = {r.k: len(r.ids) for r in records.select("k", rules.matched_ids(fields).alias("ids")).collect()}
    assert {r.k: r.n_rules for r in rule_tables.RuleTables(*rule_tables.tables_of(spark, rules)).record_counts(records, "k").collect()} == want


def test_four_tables(spark):
    hm = spark.createDataFrame([(1, "l1 and not ( l2 || l3 )"), (2, "! l1"), (3, "l1 or gone"), (4, "l4"), (5, "l2")], "id int, expression string")
    logic = spark.createDataFrame([("l1", "f1", "equals"), ("l2", "f2", "wumanber"), ("l3", "f1", "exists"), ("l4", "nofield", "equals")], "id string, field_id string, match_type string")
    item = spark.createDataFrame([("l1", "a.com"), ("l1", "b.com"), ("l2", "^/x"), ("l1", "line\nbreak")], "logic_id string, item string")
    field = spark.createDataFrame([("f1", "host"), ("f2", "uri")], "id string, name string")
    rules, values, problems = rule_tables.four_tables(hm, logic, item, field)
    assert {r.rule_id: r.expression for r in rules.collect()} == {1: "host equals $l1 and not ( uri wumanber $l2 || host exists )", 2: "! host equals $l1", 5: "uri wumanber $l2"}
    assert {tuple(r) for r in problems.collect()} == {(3, "gone"), (4, "l4")}
    records = spark.createDataFrame([(1, "a.com", "/x1"), (2, None, None), (3, "line\nbreak", "/y")], "k int, host string, uri string")
    odd = {(r.k, r.rule_id): r.matched for r in rule_tables.RuleTables(rules, values).exceptions(records, "k").collect()}
    assert odd == {(1, 2): False, (1, 5): True, (3, 2): False}


def test_change_stamp(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 5)], "x string, d int")
    one = rule_tables.change_stamp((rows, "d"), (rows.limit(0), F.col("d") + 1))
    assert one == "2@5;0@None" and rule_tables.change_stamp((rows.where("d < 5"), "d")) == "1@1"


def test_unknown_matcher(spark):
    from tidewire.operators.matchers import MATCHERS, register_matcher

    register_matcher("longer", lambda f, v: F.length(f) > 1)
    try:
        records = spark.createDataFrame([(1, "a")], "k int, host string")
        made = rule_tables.RuleTables(spark.createDataFrame([(1, "host equals $g")], "rule_id int, expression string"), spark.createDataFrame([("$g", "a")], "group string, value string"))
        made.leaves = made.leaves.withColumn("matcher", F.lit("longer"))
        with pytest.raises(RuleError):
            made.hits(records, "k")
    finally:
        MATCHERS.pop("longer")


def test_rules_of_one_expression_are_tested_once(spark):
    """200,000 rules of three expressions make one row a record and expression, and every rule gets its count."""
    n = 200_000
    text = F.element_at(F.array(*map(F.lit, ("host equals $a", "not host equals $a", "uri exists and host equals $a"))), (F.col("id") % 3 + 1).cast("int"))
    rules = spark.range(n).select(F.col("id").alias("rule_id"), text.alias("expression"))
    records = spark.createDataFrame([(1, "a.com", "/x"), (2, "a.com", None), (3, None, "/y"), (4, "b.com", None)], "k int, host string, uri string")
    made = rule_tables.RuleTables(rules, spark.createDataFrame([("$a", "a.com")], "group string, value string"))
    assert made.odd(records, "k").count() == 5
    counts = made.rule_counts(records, "k").groupBy((F.col("rule_id") % 3).alias("r"), "n_records").count().collect()
    of = [len(range(i, n, 3)) for i in range(3)]
    assert sorted(map(tuple, counts)) == [(0, 2, of[0]), (1, 2, of[1]), (2, 1, of[2])]
    assert {r.k: r.n_rules for r in made.record_counts(records, "k").collect()} == {1: of[0] + of[2], 2: of[0], 3: of[1], 4: of[1]}
    assert made.exceptions(records, "k").count() == 2 * of[0] + 2 * of[1] + of[2]


def test_counts_by_record_write_no_row_a_rule(spark, monkeypatch):
    """What is written on the way to counts by record is by expression, leaf or record: 5,000 rules of one expression write no 5,000 rows."""
    written = []

    def cut(df):
        written.append(df.count())
        return df

    monkeypatch.setattr(rule_tables, "cut", cut)
    rules = spark.range(5000).select(F.col("id").alias("rule_id"), F.lit("not host equals $a").alias("expression"))
    records = spark.createDataFrame([(1, "a.com"), (2, None)], "k int, host string")
    made = rule_tables.RuleTables(rules, spark.createDataFrame([("$a", "a.com")], "group string, value string"))
    assert {r.k: r.n_rules for r in made.record_counts(records, "k").collect()} == {1: 0, 2: 5000}
    assert max(written) == 1
    assert {r.n_records for r in made.rule_counts(records, "k").collect()} == {1} and max(written) == 5000
