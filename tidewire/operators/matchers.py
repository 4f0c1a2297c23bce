"""Matchers: each turns a field column and a list of values into a predicate and the item that matched.

A matcher is never true for an absent (null) field, and never null: rules negate leaves, so a null would lose rows.
New matchers are added with ``register_matcher``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Matcher:
    name: str
    takes_values: bool
    predicate: Callable[[Column, list[str]], Column]
    item: Callable[[Column, list[str]], Column]


MATCHERS: dict[str, Matcher] = {}


def register_matcher(name: str, predicate, item=None, takes_values: bool = True) -> None:
    """``predicate(field, values)`` gives a boolean column, ``item(field, values)`` what matched (default: the field)."""
    MATCHERS[name] = Matcher(name, takes_values, predicate, item or (lambda field, _: field))


def sure(condition: Column) -> Column:
    """False where the condition is unknown."""
    return F.coalesce(condition, F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def first_of(pairs: list[tuple[Column, str]]) -> Column:
    """The label of the first condition that holds, else null."""
    if not pairs:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(sure(c), F.lit(label)) for c, label in pairs])


# --- multi-pattern search: contains, prefix, suffix, whole value, prefix and suffix --------------------


@dataclass(frozen=True)
class Pattern:
    text: str
    kind: str  # contains, prefix, suffix, full, infix
    tail: str = ""


def parse_pattern(raw: str) -> Pattern | None:
    """``^p$`` whole, ``^p``/``^p*`` prefix, ``p$``/``*p$`` suffix, ``^a*b$`` both ends, else contained.

    None for patterns of under two bytes. A ``*`` within a prefix or suffix pattern is an error.
    """
    starts, ends = raw.startswith("^"), raw.endswith("$") and len(raw) > 1
    body = raw[1 if starts else 0 : len(raw) - 1 if ends else len(raw)]
    if starts and body.endswith("*") and not ends:
        body = body[:-1]
    if ends and body.startswith("*") and not starts:
        body = body[1:]
    if not starts and not ends:
        body = body.strip("*")
    if len(body.encode()) < 2:
        return None
    if starts and ends and "*" in body:
        head, tail = body.split("*", 1)
        return Pattern(head, "infix", tail)
    if (starts or ends) and "*" in body:
        raise ValueError(f"'*' inside the pattern {raw!r}")
    return Pattern(body, "full" if starts and ends else "prefix" if starts else "suffix" if ends else "contains")


def _pattern_condition(field: Column, p: Pattern) -> Column:
    if p.kind == "full":
        return field == F.lit(p.text)
    if p.kind == "prefix":
        return field.startswith(p.text)
    if p.kind == "suffix":
        return field.endswith(p.text)
    if p.kind == "infix":
        return field.rlike(f"^{java_quote(p.text)}[^/]+{java_quote(p.tail)}$")
    return field.contains(p.text)


def java_quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


#: From so many patterns on, the contained ones of a field become one alternation.
MANY = 200


def wumanber(field: Column, values: list[str]) -> Column:
    patterns = [p for v in dict.fromkeys(values) if (p := parse_pattern(v))]
    inner = [p.text for p in patterns if p.kind == "contains"]
    rest = [p for p in patterns if p.kind != "contains" or len(inner) <= MANY]
    found = [_pattern_condition(field, p) for p in rest]
    if len(inner) > MANY:
        found.append(field.rlike("|".join(map(java_quote, inner))))
    return sure(any_of(found))


def wumanber_item(field: Column, values: list[str]) -> Column:
    pairs = [(p, v) for v in dict.fromkeys(values) if (p := parse_pattern(v))]
    return first_of([(_pattern_condition(field, p), v) for p, v in pairs])


# --- URL patterns ----------------------------------------------------------------------------------------


def url_segments(url: Column) -> Column:
    """Segments of a URL (host first) after query and fragment are cut off."""
    return F.split(F.regexp_replace(url, r"[?#].*$", ""), "/")


def url_condition(url: Column, pattern: str) -> Column:
    """Same number of segments; the host exact; ``*`` any segment, ``a*b`` prefix and suffix, else exact."""
    parts = re.sub(r"[?#].*$", "", pattern).split("/")
    segments = url_segments(url)
    out = (F.size(segments) == len(parts)) & (F.get(segments, F.lit(0)) == parts[0])
    for i, part in enumerate(parts[1:], 1):
        if part == "*":
            continue
        cell = F.get(segments, F.lit(i))
        if "*" in part:
            head, tail = part.split("*", 1)
            out = out & cell.startswith(head) & cell.endswith(tail) & (F.octet_length(cell) >= max(len(head.encode()), len(tail.encode())))
        else:
            out = out & (cell == part)
    return sure(out)


def posix(pattern: str) -> str:
    """POSIX bracket classes as Java ones; a pattern that cannot be compiled is rejected."""
    names = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit"}
    re.compile(re.sub(r"\[:\w+:\]", "a", pattern))
    return re.sub(r"\[:(\w+):\]", lambda m: rf"\\p{{{names[m[1]]}}}".replace("\\\\", "\\"), pattern)


def wildcard(field: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Glob match of the whole value: ``*`` any run, ``?`` one character."""
    expression = "".join(".*" if c == "*" else "." if c == "?" else java_quote(c) for c in pattern)
    return sure(field.rlike(("(?i)" if ignore_case else "") + f"(?s)^{expression}$"))


register_matcher("equals", lambda f, v: sure(f.isin(*v)) if v else F.lit(False))
register_matcher("exists", lambda f, v: f.isNotNull(), lambda f, v: F.lit(None).cast("string"), takes_values=False)
register_matcher("wumanber", wumanber, wumanber_item)
register_matcher("regex", lambda f, v: sure(any_of([f.rlike(posix(p)) for p in v])), lambda f, v: first_of([(f.rlike(posix(p)), p) for p in v]))
register_matcher("urlmatch", lambda f, v: any_of([url_condition(f, p) for p in v]), lambda f, v: first_of([(url_condition(f, p), p) for p in v]))
register_matcher("wildcard", lambda f, v: any_of([wildcard(f, p) for p in v]), lambda f, v: first_of([(wildcard(f, p), p) for p in v]))
