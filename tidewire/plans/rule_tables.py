"""Rule sets as tables: any number of rules and values, without a column or a plan node for each.

``rules(rule_id, expression)`` holds expressions as in ``tidewire.plans.rules``; ``values(group, value)`` holds the values of
their groups. A leaf (field, matcher, group) is named by a 63-bit hash. First the hits are found, rows of record and leaf:
``equals`` by a join, ``wumanber`` and ``urlmatch`` by pattern tables, ``exists`` from the column. The hits of a record become one
set, and the expressions, in postfix form, are evaluated over the sets.

Not every rule meets every record. With no hit at all a rule has a value of its own (its default: true for one that only
negates). A rule can differ from it only where one of its witnesses is hit, leaves of which the other value needs at least
one: of an ``and`` it is enough to watch the part that is hit least, of an ``or`` all parts are watched. So a record meets the rules
that its rarest leaves lead to (all rules that watch a leaf, where no rarer part of them could tell), and what is returned are the exceptions, rules that do not have their default on a record;
a rule with a true default is answered from their complement (``rule_counts``, ``record_counts``).

Rules with the same expression are one rule with a number: expressions are parsed, tested and counted once, and their results
are joined to their rules at the end, so the work grows with the different expressions and the rules are only read.

Defined cases: a null field is absent, so its leaves are false and their negations true; null and repeated values count as
absent and once; a group without values is never hit; a rule that cannot be parsed, or names a matcher that has no table
(``regex`` and ``wildcard`` are tested one by one against the different values of their field), is an error; records need a unique
key; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.lineage import cut
from tidewire.operators.pattern_tables import match_table, match_url_table
from tidewire.operators.scan import scan_table
from tidewire.plans.rules import Leaf, Node, RuleError, RuleSet, parse_expression

AND, OR, NOT = -1, -2, -3
_LEAF = pa.struct([("leaf", pa.int64()), ("field", pa.string()), ("matcher", pa.string()), ("group", pa.string())])
_PARSED = "expression_id long, expression string, n long, tokens array<long>, default boolean, leaves array<struct<leaf:long,field:string,matcher:string,group:string>>"


def leaf_id(leaf: Leaf) -> int:
    """A number from 0 to 2**63 - 1 that stands for a leaf."""
    name = "\x00".join((leaf.field, leaf.matcher, leaf.group or ""))
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") >> 1


def postfix(tree) -> tuple[list[int], dict[int, Leaf]]:
    """The tokens of an expression in postfix order (leaves by number, AND, OR, NOT), and its leaves."""
    if isinstance(tree, Leaf):
        return [leaf_id(tree)], {leaf_id(tree): tree}
    parts = [postfix(p) for p in tree.parts]
    return [t for p, _ in parts for t in p] + [{"and": AND, "or": OR, "not": NOT}[tree.op]], {k: v for _, known in parts for k, v in known.items()}


def evaluate(tokens: list[int], hits: set[int]) -> bool:
    stack: list[bool] = []
    for t in tokens:
        if t >= 0:
            stack.append(t in hits)
        elif t == NOT:
            stack.append(not stack.pop())
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a and b if t == AND else a or b)
    return stack[0]


def witnesses(tokens: list[int], cost: dict[int, int]) -> set[int]:
    """Leaves of which at least one is hit wherever the expression differs from its value without hits; few hits, if there is a choice."""

    def price(leaves: frozenset[int]) -> int:
        return sum(cost.get(n, 0) for n in leaves)

    stack: list[tuple] = []  # what being true needs, what being false needs; None: nothing
    for t in tokens:
        if t >= 0:
            stack.append((frozenset([t]), None))
        elif t == NOT:
            stack.append(stack.pop()[::-1])
        else:
            b, a = stack.pop(), stack.pop()
            same, other = (0, 1) if t == AND else (1, 0)  # one part is enough for ``same``, all are needed for ``other``
            either = [x[same] for x in (a, b) if x[same] is not None]
            made = {same: min(either, key=price) if either else None, other: a[other] | b[other] if None not in (a[other], b[other]) else None}
            stack.append((made[0], made[1]))
    true, false = stack[0]
    return set(true if true is not None else false)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens, defaults, leaves = [], [], []
        for text in b.column("expression").to_pylist():
            if text is None:
                raise RuleError("a rule without an expression")
            own, known = postfix(parse_expression(text))
            tokens.append(own)
            defaults.append(evaluate(own, set()))
            leaves.append([{"leaf": n, "field": x.field, "matcher": x.matcher, "group": x.group} for n, x in known.items()])
        yield pa.RecordBatch.from_arrays(
            [b.column("expression_id"), b.column("expression"), b.column("n"), pa.array(tokens, pa.list_(pa.int64())), pa.array(defaults, pa.bool_()), pa.array(leaves, pa.list_(_LEAF))],
            names=["expression_id", "expression", "n", "tokens", "default", "leaves"],
        )


class RuleMachine:
    """Finds the rules (rows of tokens, leaves, costs, default) that differ from their default on a set of hits.

    Rules with the same expression are evaluated once."""

    def __init__(self, rows: pa.Table):
        number: dict[tuple[int, ...], int] = {}
        same: list[list[int]] = []
        self.tokens: list[tuple[int, ...]] = []
        self.default: list[bool] = []
        self.watched: dict[int, list[int]] = defaultdict(list)
        for i, (tokens, default, costs) in enumerate(zip(*(rows.column(n).to_pylist() for n in ("tokens", "default", "costs")))):
            at = number.setdefault(tuple(tokens), len(same))
            if at == len(same):
                same.append([])
                self.tokens.append(tuple(tokens))
                self.default.append(default)
                for leaf in witnesses(tokens, {c["leaf"]: c["hits"] for c in costs}):
                    self.watched[leaf].append(at)
            same[at].append(i)
        self.rows = [np.array(x, np.int64) for x in same]

    def find(self, leaves: list[int]) -> np.ndarray | list[int]:
        hits = set(leaves)
        near = {i for n in leaves for i in self.watched.get(n, ())}
        odd = [self.rows[i] for i in sorted(near) if evaluate(self.tokens[i], hits) != self.default[i]]
        return np.concatenate(odd) if odd else []


class Expressions:
    """Finds the regular expressions or globs (rows of pattern) that match a value, one by one."""

    def __init__(self, rows: pa.Table, glob: bool):
        raw = rows.column("pattern").to_pylist()
        self.made = [regex.compile("(?s)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + r"\Z" if glob else p) for p in raw]
        self.test = "match" if glob else "search"

    def find(self, value: str) -> list[int]:
        return [i for i, p in enumerate(self.made) if getattr(p, self.test)(value)]


class RuleTables:
    """The exceptions of rules on records. ``most`` bounds what a task holds of patterns (characters) and rules (tokens)."""

    def __init__(self, rules: DataFrame, values: DataFrame, most: int = 2 << 20):
        self.most = most
        given = self.given = rules.select(F.col("rule_id").cast("long").alias("rule_id"), "expression")
        different = given.groupBy("expression").agg(F.count(F.lit(1)).alias("n")).select(F.monotonically_increasing_id().alias("expression_id"), "expression", "n")
        self.expressions = cut(different.mapInArrow(_parse, _PARSED))
        weight = self.expressions.agg(F.sum(F.octet_length("expression") + 16)).first()[0] or 0
        self.few = weight <= most  # then what is known of each expression is sent to the rules, else both are dealt
        self.leaves = self.expressions.select(F.explode("leaves").alias("x")).select("x.*").distinct()
        known = values.where("value is not null").select(F.col("group").alias("g"), "value").distinct()
        self.values = cut(self.leaves.join(known, F.col("group") == F.col("g")).select("leaf", "field", "matcher", "value"))

    @cached_property
    def rules(self) -> DataFrame:
        """(rule_id, expression_id, default) of every rule; made where results by rule are asked for, as counts by record need none of it."""
        known = self._sent(self.expressions.select("expression", "expression_id", "default"))
        return cut(self.given.join(known, "expression").select("rule_id", "expression_id", "default"))

    def _sent(self, by_expression: DataFrame) -> DataFrame:
        return F.broadcast(by_expression) if self.few else by_expression

    def hits(self, records: DataFrame, key: str) -> DataFrame:
        """(key, leaf) for every leaf that is true on a record."""
        known = {c.lower(): c for c in records.columns}
        kinds = [(r.field, r.matcher) for r in self.leaves.select("field", "matcher").distinct().where(F.col("field").isin(*known)).collect()]  # a pair a column and matcher
        parts = []
        for field, matcher in sorted(kinds):
            column = known[field]
            own = self.values.where((F.col("field") == field) & (F.col("matcher") == matcher)).select("leaf", F.col("value").alias("pattern"))
            rows = records.select(F.col(key).alias("_key"), F.col(column).cast("string").alias("_value")).where("_value is not null")
            if matcher == "exists":
                leaf = leaf_id(Leaf(field, "exists", None))
                parts.append(rows.select("_key", F.lit(leaf).alias("leaf")))
                continue
            if matcher == "equals":
                pairs = rows.join(own, F.col("_value") == F.col("pattern"))
            elif matcher in ("wumanber", "urlmatch"):
                match = match_table if matcher == "wumanber" else match_url_table
                pairs = match(rows, "_key", "_value", own, "pattern", self.most).join(own, "pattern")
            elif matcher in ("regex", "wildcard"):
                different = rows.select(F.col("_value").alias("_key"), "_value").distinct()
                glob = matcher == "wildcard"
                found = scan_table(different, own.select("pattern").distinct(), F.length("pattern"), lambda t, glob=glob: Expressions(t, glob), ["pattern"], most=self.most)
                pairs = rows.join(found.toDF("_same", "pattern"), F.col("_value") == F.col("_same")).join(own, "pattern")
            else:
                raise RuleError(f"no table for the matcher {matcher!r}")
            parts.append(pairs.select("_key", "leaf"))
        if not parts:
            return records.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("leaf")).where("false")
        return reduce(DataFrame.unionByName, parts).distinct()

    def odd(self, records: DataFrame, key: str) -> DataFrame:
        """(_key, expression_id, n, matched) where an expression, that of n rules, does not have its default on a record."""
        hits = cut(self.hits(records, key))
        cost = hits.groupBy("leaf").agg(F.count(F.lit(1)).alias("hits"))
        used = self.expressions.select("expression_id", F.explode("leaves.leaf").alias("leaf")).join(cost, "leaf").groupBy("expression_id").agg(F.collect_list(F.struct("leaf", "hits")).alias("costs"))
        machine = self.expressions.select("expression_id", "n", "tokens", "default").join(used, "expression_id").withColumn("matched", ~F.col("default"))  # one without hits has no exceptions
        parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small sets with much work are not put together
        sets = hits.repartition(parts, "_key").groupBy("_key").agg(F.collect_set("leaf").alias("_value"))
        weight = 8 * F.size("tokens") + 16
        return scan_table(sets, machine, weight, RuleMachine, ["expression_id", "n", "matched"], size=8 * F.size("_value"), most=16 * self.most)

    def exceptions(self, records: DataFrame, key: str) -> DataFrame:
        """(key, rule_id, matched) where a rule does not have its default on a record."""
        found = self.odd(records, key).join(self.rules.select("rule_id", "expression_id"), "expression_id")
        return found.select(F.col("_key").alias(key), "rule_id", "matched")

    def rule_counts(self, records: DataFrame, key: str) -> DataFrame:
        """(rule_id, n_records): on how many records each rule is true."""
        total = records.count()
        odd = self.odd(records, key).groupBy("expression_id").agg(F.count(F.lit(1)).alias("n"))
        n = F.coalesce("n", F.lit(0))
        return self.rules.join(self._sent(odd), "expression_id", "left").select("rule_id", F.when(F.col("default"), F.lit(total) - n).otherwise(n).alias("n_records"))

    def record_counts(self, records: DataFrame, key: str) -> DataFrame:
        """(key, n_rules): how many rules are true on each record."""
        always = self.expressions.where("default").agg(F.sum("n")).first()[0] or 0
        odd = self.odd(records, key).groupBy("_key").agg(F.sum(F.when(F.col("matched"), F.col("n")).otherwise(-F.col("n"))).alias("n"))
        return records.select(key).join(odd, F.col(key) == F.col("_key"), "left").select(key, (F.lit(always) + F.coalesce("n", F.lit(0))).cast("long").alias("n_rules"))


# --- sources of rule tables ------------------------------------------------------------------------------
def _written(tree, prefix: str) -> str:
    if isinstance(tree, Leaf):
        return f"{tree.field} {tree.matcher}" + (f" {prefix}{tree.group[1:]}" if tree.group else "")
    parts = [_written(p, prefix) for p in tree.parts]
    return f"not ({parts[0]})" if tree.op == "not" else f"({parts[0]}) {tree.op} ({parts[1]})"


def tables_of(spark: SparkSession, rule_set: RuleSet) -> tuple[DataFrame, DataFrame]:
    """(rules, values) of the compiled sources of a rule set, a rule for each source."""
    rules, values = [], []
    for i, s in rule_set._live.items():
        prefix = f"$s{i}_"
        if s.rules.expressions:
            rules.append((i, _written(reduce(lambda a, b, op=s.logic.lower(): Node(op, (a, b)), s.rules.expressions), prefix)))
        values += [(prefix + g[1:], v) for g, own in s.rules.groups.items() for v in own]
    return spark.createDataFrame(rules, "rule_id long, expression string"), spark.createDataFrame(values, "group string, value string")


SIGNS = ("and", "or", "not", "&&", "||", "!", "(", ")")


def four_tables(hm: DataFrame, logic: DataFrame, item: DataFrame, field: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, values, problems) of a store that keeps rules in four tables.

    ``hm(id, expression)`` names logic ids between the signs ``and or not && || ! ( )``, apart by blanks; ``logic(id, field_id,
    match_type)`` is a leaf, ``item(logic_id, item)`` its values, ``field(id, name)`` its field. Ids are strings, rule ids numbers.
    A rule that names an unknown logic or a logic with an unknown field is left out and listed in problems(rule_id, unknown).
    """
    words = hm.select(F.col("id").cast("long").alias("rule_id"), F.posexplode(F.filter(F.split("expression", " +"), lambda w: w != "")).alias("at", "word"))
    sign = F.lower("word").isin(*SIGNS)
    leaves = logic.join(field.select(F.col("id").alias("field_id"), "name"), "field_id", "left").select(
        F.col("id").alias("logic_id"), F.when(F.col("name").isNotNull(), F.concat_ws(" ", "name", "match_type", F.when(F.col("match_type") != "exists", F.concat(F.lit("$"), F.col("id"))))).alias("text")
    )
    placed = words.join(leaves, ~sign & (F.col("word") == F.col("logic_id")), "left").select("rule_id", "at", "word", F.when(sign, F.col("word")).otherwise(F.col("text")).alias("text"))
    made = cut(placed.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("at", "word", "text"))).alias("words")))
    unknown = F.transform(F.filter("words", lambda w: w["text"].isNull()), lambda w: w["word"])
    rules = made.where(F.size(unknown) == 0).select("rule_id", F.array_join("words.text", " ").alias("expression"))
    problems = made.where(F.size(unknown) > 0).select("rule_id", F.explode(F.array_distinct(unknown)).alias("unknown"))
    return rules, item.select(F.concat(F.lit("$"), F.col("logic_id")).alias("group"), F.col("item").alias("value")), problems


def change_stamp(*tables: tuple[DataFrame, Column | str]) -> str:
    """Number of rows and newest date of each table, as one text: it differs where a table was changed."""
    parts = []
    for rows, date in tables:
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.col(date) if isinstance(date, str) else date).cast("string").alias("newest")).first()
        parts.append(f"{r.n}@{r.newest}")
    return ";".join(parts)
