"""Rule sets: text sources with value groups and boolean expressions, compiled to columns.

A source's lines: ``$name [list file]`` starts a group of values, indented lines are its values, ``@expression`` adds an
expression, ``field matcher [list file]`` with indented values is short for both. Expressions know ``and or not`` (also
``& && | || !``) and parentheses; and/or have equal precedence and bind from the left, not binds to the next operand.
Each source combines its expressions with its own logic (AND or OR). ``RuleSet`` keeps sources, compiles them to one
boolean column a source, and reloads those that changed.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.binary import ENCRYPTED, ZipCipher
from tidewire.operators.matchers import MATCHERS


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Leaf:
    field: str
    matcher: str
    group: str | None


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not
    parts: tuple


@dataclass
class SourceRules:
    groups: dict[str, list[str]] = field(default_factory=dict)
    expressions: list = field(default_factory=list)
    n_values: int = 0


WORDS = {"and": "and", "&&": "and", "&": "and", "or": "or", "||": "or", "|": "or", "not": "not", "!": "not"}


def parse_expression(text: str):
    """The tree of an expression; raises RuleError where it is malformed."""
    for mark in "()!":
        text = text.replace(mark, f" {mark} ")
    tokens = text.replace("@", " ").split()
    tree, at = _chain(tokens, 0)
    if at != len(tokens):
        raise RuleError(f"unexpected {tokens[at]!r} in {text!r}")
    return tree


def _chain(tokens: list[str], at: int):
    left, at = _operand(tokens, at)
    while at < len(tokens) and WORDS.get(tokens[at].lower()) in ("and", "or"):
        op = WORDS[tokens[at].lower()]
        right, at = _operand(tokens, at + 1)
        left = Node(op, (left, right))
    return left, at


def _operand(tokens: list[str], at: int):
    if at >= len(tokens):
        raise RuleError("expression ends early")
    token = tokens[at]
    if WORDS.get(token.lower()) == "not":
        inner, at = _operand(tokens, at + 1)
        return Node("not", (inner,)), at
    if token == "(":
        inner, at = _chain(tokens, at + 1)
        if at >= len(tokens) or tokens[at] != ")":
            raise RuleError("missing )")
        return inner, at + 1
    if at + 1 >= len(tokens) or tokens[at + 1] not in MATCHERS:
        raise RuleError(f"no matcher after {token!r}")
    name, matcher = token.lower(), MATCHERS[tokens[at + 1]]
    if not matcher.takes_values:
        return Leaf(name, matcher.name, None), at + 2
    if at + 2 >= len(tokens) or not tokens[at + 2].startswith("$"):
        raise RuleError(f"{matcher.name} needs a $group")
    return Leaf(name, matcher.name, tokens[at + 2]), at + 3


def read_values(path: str, base: str = "") -> list[str]:
    with open(os.path.join(base, path), encoding="utf-8") as f:
        return [line.strip() for line in f if line.strip() and not line.startswith("#")]


def parse_source(text: str, base: str = "") -> SourceRules:
    """Groups and expressions of a source's text."""
    out, current = SourceRules(), None
    seen: set[str] = set()

    def add(expression: str) -> None:
        if expression not in seen:
            seen.add(expression)
            out.expressions.append(parse_expression(expression))

    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        if line[0] in " \t":
            if current is None:
                raise RuleError(f"value {line.strip()!r} outside of a group")
            out.groups[current].append(line.strip())
            out.n_values += 1
            continue
        words = line.split()
        if line[0] == "@":
            add(line[1:].strip())
            current = None
        elif line[0] == "$":
            if words[0] in out.groups:
                raise RuleError(f"group {words[0]} is defined twice")
            current = words[0]
            out.groups[current] = read_values(words[1], base) if len(words) > 1 else []
            out.n_values += len(out.groups[current])
        else:
            if len(words) < 2 or words[1] not in MATCHERS:
                raise RuleError(f"unknown line {line!r}")
            if not MATCHERS[words[1]].takes_values:
                add(f"{words[0]} {words[1]}")
                out.n_values += 1
                current = None
                continue
            current = f"$__{words[0].lower()}_{words[1]}__"
            values = out.groups.setdefault(current, [])
            if len(words) > 2:
                more = read_values(words[2], base)
                values += more
                out.n_values += len(more)
            add(f"{words[0]} {words[1]} {current}")
    for leaf in leaves_of(out.expressions):
        if leaf.group and leaf.group not in out.groups:
            raise RuleError(f"group {leaf.group} is not defined")
    return out


def leaves_of(trees: list) -> list[Leaf]:
    found: dict[Leaf, None] = {}

    def walk(t) -> None:
        if isinstance(t, Leaf):
            found.setdefault(t)
        else:
            for p in t.parts:
                walk(p)

    for t in trees:
        walk(t)
    return list(found)


def compile_tree(tree, groups: dict[str, list[str]], fields: dict[str, Column]) -> Column:
    """A boolean column that is never null; a field that the record lacks is absent."""
    if isinstance(tree, Leaf):
        column = fields.get(tree.field, F.lit(None).cast("string"))
        return MATCHERS[tree.matcher].predicate(column, groups.get(tree.group, []))
    parts = [compile_tree(p, groups, fields) for p in tree.parts]
    return ~parts[0] if tree.op == "not" else parts[0] & parts[1] if tree.op == "and" else parts[0] | parts[1]


# --- loaders ---------------------------------------------------------------------------------------------
LOADERS: dict[str, Callable[[str, str], str]] = {}


def register_loader(scheme: str, load: Callable[[str, str], str]) -> None:
    """``load(rest of the uri, base path)`` gives a source's text."""
    LOADERS[scheme] = load


def _load_file(path: str, base: str) -> str:
    with open(os.path.join(base, path), encoding="utf-8") as f:
        return f.read()


def _load_encrypted(rest: str, base: str) -> str:
    """``cfile:password@path``: a file of the magic ``VimCrypt~01!`` and zip-cipher text."""
    password, _, path = rest.partition("@")
    with open(os.path.join(base, path), "rb") as f:
        data = f.read()
    if not data.startswith(ENCRYPTED):
        raise RuleError(f"{path} is not an encrypted source")
    return ZipCipher(password.encode()).decrypt(data[len(ENCRYPTED) :]).decode("utf-8")


register_loader("cfile", _load_encrypted)
register_loader("string", lambda text, base: text)
register_loader("file", _load_file)


def source_text_of_rows(rows: DataFrame) -> str:
    """The text of a rule table ``(match_type, field, items array)``: a short block for each row. Rule tables are driver
    metadata (a few rows a rule); long value lists belong in a joined table (``tidewire.operators.lookup.list_match``)."""
    lines = []
    for r in rows.select("match_type", "field", "items").orderBy("field", "match_type").toLocalIterator():
        own = [v for v in r["items"] or [] if v is not None]
        if any(len(v.splitlines()) > 1 for v in own):
            raise RuleError(f"a value of {r.field} {r.match_type} has a line break; rule tables take it")
        lines.append(f"{r.field} {r.match_type}")
        lines += [f"  {v}" for v in own]
    return "\n".join(lines)


@dataclass
class Source:
    uri: str
    logic: str
    user: str | None
    stamp: object = None
    rules: SourceRules | None = None


class RuleSet:
    """Rule sources by id, compiled together; the compiled version stays in use when a reload fails."""

    def __init__(self, base: str = ""):
        self.base = base
        self.sources: dict[int, Source] = {}
        self.version = 0
        self._live: dict[int, Source] = {}
        self._next = 1

    def add(self, uri: str, logic: str = "OR", user: str | None = None, source_id: int | None = None) -> int:
        if logic not in ("AND", "OR"):
            raise RuleError(f"logic {logic!r}")
        source_id = source_id or self._next
        self._next = max(self._next, source_id + 1)
        self.sources[source_id] = Source(uri, logic, user)
        return source_id

    def remove(self, source_id: int) -> bool:
        return self.sources.pop(source_id, None) is not None

    def _stamp(self, source: Source) -> object:
        scheme, _, rest = source.uri.partition(":")
        path = {"file": rest, "cfile": rest.partition("@")[2]}.get(scheme)
        return os.stat(os.path.join(self.base, path)).st_mtime_ns if path is not None else rest

    def compile(self) -> int:
        """Load all sources and put them to use; one bad source leaves the live rules as they were."""
        fresh = {}
        for i, s in self.sources.items():
            scheme, _, rest = s.uri.partition(":")
            if scheme not in LOADERS:
                raise RuleError(f"no loader for {scheme!r}")
            fresh[i] = Source(s.uri, s.logic, s.user, self._stamp(s), parse_source(LOADERS[scheme](rest, self.base), self.base))
        self._live = fresh
        self.version += 1
        return self.version

    def check(self) -> bool:
        """Compile again if a source was added, removed or changed."""
        same = self.sources.keys() == self._live.keys() and all(
            s.uri == self._live[i].uri and self._stamp(s) == self._live[i].stamp for i, s in self.sources.items()
        )
        if not same:
            self.compile()
        return not same

    # --- columns ---
    def source_columns(self, fields: dict[str, Column]) -> dict[int, Column]:
        """source id -> does it match."""
        out = {}
        for i, s in self._live.items():
            parts = [compile_tree(t, s.rules.groups, fields) for t in s.rules.expressions]
            if not parts:
                out[i] = F.lit(False)
                continue
            total = parts[0]
            for p in parts[1:]:
                total = total & p if s.logic == "AND" else total | p
            out[i] = total
        return out

    def matches(self, fields: dict[str, Column]) -> Column:
        out = F.lit(False)
        for c in self.source_columns(fields).values():
            out = out | c
        return out

    def matched_ids(self, fields: dict[str, Column]) -> Column:
        """The ids of the sources that match, ascending."""
        cells = [F.when(c, F.lit(i)) for i, c in sorted(self.source_columns(fields).items())]
        return F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array().cast("array<int>")

    def matched_users(self, fields: dict[str, Column]) -> Column:
        """Users of the matching sources, in the order of their ids."""
        cells = [F.when(c, F.lit(self._live[i].user)) for i, c in sorted(self.source_columns(fields).items())]
        return F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array().cast("array<string>")

    def leaves(self) -> list[tuple[int, int, Leaf]]:
        """(dense id, source id, leaf) of all different leaves; equal leaves of a source share an id."""
        out = []
        for i, s in sorted(self._live.items()):
            for leaf in leaves_of(s.rules.expressions):
                out.append((len(out), i, leaf))
        return out

    def matched_items(self, fields: dict[str, Column]) -> Column:
        """map: leaf id -> what matched, for the leaves that match."""
        entries = []
        for n, i, leaf in self.leaves():
            column = fields.get(leaf.field, F.lit(None).cast("string"))
            values = self._live[i].rules.groups.get(leaf.group, [])
            m = MATCHERS[leaf.matcher]
            entries.append(F.when(m.predicate(column, values), F.struct(F.lit(n).alias("key"), m.item(column, values).alias("value"))))
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
