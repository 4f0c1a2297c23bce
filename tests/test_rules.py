import pytest
from pyspark.sql import functions as F

from tidewire.operators.matchers import parse_pattern, posix
from tidewire.plans.rules import Leaf, Node, RuleError, RuleSet, parse_expression, parse_source, source_text_of_rows

TEXT = """
$exact
  one.example.com
$wild
  *.shop.example
@ host equals $exact and host wumanber $wild
host equals
  a.example.net
host equals
  b.example.net
"""


def test_equal_precedence_from_the_left():
    tree = parse_expression("a exists or b exists and not c exists")
    assert tree == Node("and", (Node("or", (Leaf("a", "exists", None), Leaf("b", "exists", None))), Node("not", (Leaf("c", "exists", None),))))


@pytest.mark.parametrize("bad", ["a exists and", "(a exists", "a equals", "a nothing $x", "a exists b exists", ") a exists"])
def test_malformed_expressions(bad):
    with pytest.raises(RuleError):
        parse_expression(bad)


def test_source_text():
    rules = parse_source(TEXT)
    assert rules.groups["$__host_equals__"] == ["a.example.net", "b.example.net"]
    assert len(rules.expressions) == 2 and rules.n_values == 4
    for bad in ("  value", "$a\n$a", "@a equals $missing", "@a exists\n  value", "what is this"):
        with pytest.raises(RuleError):
            parse_source(bad)


def test_patterns():
    kinds = {p: parse_pattern(p) for p in ("^ab$", "^ab", "^ab*", "ab$", "*ab$", "ab", "*ab*", "^ab*cd$", "a", "^")}
    assert [k.kind if k else None for k in kinds.values()] == ["full", "prefix", "prefix", "suffix", "suffix", "contains", "contains", "infix", None, None]
    with pytest.raises(ValueError):
        parse_pattern("^ab*cd")
    assert posix("^[[:alpha:]]+$") == r"^[\p{Alpha}]+$"


def test_records(spark):
    rows = spark.createDataFrame(
        [(1, "c.example.net", "/index.html", "html"), (2, None, None, None), (3, "b.example.net", "/abXcd", None)], "id int, host string, uri string, extension string"
    )
    rules = RuleSet()
    one = rules.add("string:host equals\n  a.example.net\n  b.example.net", user="one")
    rules.add("string:extension exists", user="two")
    rules.add("string:$h\n  c.example.net\n@not host equals $h", user="three")
    rules.add("string:uri wumanber\n  ^/ab*cd$\n@uri exists", "AND", user="four")
    assert rules.compile() == 1 and not rules.check()
    f = {c: F.col(c) for c in ("host", "uri", "extension")}
    got = {r.id: (r.ids, r.users) for r in rows.select("id", rules.matched_ids(f).alias("ids"), rules.matched_users(f).alias("users")).collect()}
    assert got == {1: ([2], ["two"]), 2: ([3], ["three"]), 3: ([1, 3, 4], ["one", "three", "four"])}
    assert rules.remove(one) and not rules.remove(99) and rules.check() and rules.version == 2
    rules.add("string:nonsense here")
    with pytest.raises(RuleError):
        rules.compile()
    assert rows.where(rules.matches(f)).count() == 3  # the live rules are still in use
    with pytest.raises(RuleError):
        rules.add("string:", "XOR")


def test_files(spark, tmp_path):
    (tmp_path / "a.rules").write_text("host equals a.list\n")
    (tmp_path / "a.list").write_text("# list\nx.com\n\n y.com \n")
    rules = RuleSet(str(tmp_path))
    rules.add("file:a.rules")
    rules.compile()
    rows = spark.createDataFrame([("x.com",), ("z.com",), ("y.com",)], "host string")
    assert sorted(r.host for r in rows.where(rules.matches({"host": F.col("host")})).collect()) == ["x.com", "y.com"]


def test_encrypted_file(tmp_path):
    from tidewire.functions.binary import ZipCipher

    (tmp_path / "c.rules").write_bytes(b"VimCrypt~01!" + ZipCipher(b"pw").encrypt(b"host equals\n  x.com\n"))
    rules = RuleSet(str(tmp_path))
    rules.add("cfile:pw@c.rules")
    assert rules.compile() == 1 and not rules.check()
    rules.add("cfile:wrong@c.rules")
    with pytest.raises((RuleError, UnicodeDecodeError)):
        rules.compile()


def test_values_of_rows_are_lines(spark):
    rows = spark.createDataFrame([("equals", "host", ["a.com", None])], "match_type string, field string, items array<string>")
    assert source_text_of_rows(rows) == "host equals\n  a.com"
    with pytest.raises(RuleError):
        source_text_of_rows(spark.createDataFrame([("equals", "host", ["a\n@not host exists"])], rows.schema))


def test_rules_change_between_batches_of_a_stream(spark, tmp_path):
    """A rule file that changes is compiled anew before the next batch; one that breaks leaves the rules as they were."""
    import os

    from tidewire.operators.matchers import MATCHERS, register_matcher, sure
    from tidewire.streaming.flows import match_batches

    register_matcher("longer", lambda field, values: sure(F.length(field) > int(values[0])))
    texts = ["host equals\n  a\n", "host equals\n  b\nhost longer\n  3\n", "host nonsense\n  a\n"]
    path, source = tmp_path / "live.rules", str(tmp_path / "in")
    path.write_text(texts[0])
    rules = RuleSet(str(tmp_path))
    one = rules.add("file:live.rules")
    rules.compile()
    seen = []

    def write(batch, batch_id):
        seen.append([(r.host, list(r.sources)) for r in batch.collect()])

    step = match_batches(rules, lambda df: {"host": F.col("host")}, write)
    for n, text in enumerate(texts):
        path.write_text(text)
        os.utime(path, (n + 1, n + 1))
        spark.createDataFrame([("a",), ("b",), ("long",), (None,)], "host string").coalesce(1).write.mode("append").json(source)
        q = spark.readStream.schema("host string").json(source).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    del MATCHERS["longer"]
    hits = [{h for h, s in batch if one in s} for batch in seen]
    assert hits == [{"a"}, {"b", "long"}, {"b", "long"}]
