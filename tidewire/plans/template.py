"""Templates ``text${var}${func(a,b){body}}`` compiled to one string column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class TemplateError(ValueError):
    pass


class Template:
    """Variables are columns, functions take (arguments, body column); both are known when a template is parsed."""

    def __init__(self, variables: dict[str, Column], functions: dict[str, Callable[[list[str], Column], Column]] | None = None):
        self.variables = variables
        self.functions = functions or {}

    def column(self, text: str) -> Column:
        out, at = self._parts(text, 0, nested=False)
        if at != len(text):
            raise TemplateError(f"unexpected {text[at:]!r}")
        return out

    def _parts(self, text: str, at: int, nested: bool) -> tuple[Column, int]:
        parts, plain = [], ""
        while at < len(text) and not (nested and text[at] == "}"):
            if text.startswith("${", at):
                if plain:
                    parts.append(F.lit(plain))
                    plain = ""
                cell, at = self._cell(text, at + 2)
                parts.append(cell)
            else:
                plain += text[at]
                at += 1
        if plain or not parts:
            parts.append(F.lit(plain))
        return (F.concat(*parts) if len(parts) > 1 else parts[0]), at

    def _cell(self, text: str, at: int) -> tuple[Column, int]:
        end = at
        while end < len(text) and text[end] not in "(}":
            end += 1
        if end == len(text):
            raise TemplateError("${ is not closed")
        name = text[at:end]
        if text[end] == "}":
            if name not in self.variables:
                raise TemplateError(f"no variable {name!r}")
            return F.coalesce(self.variables[name].cast("string"), F.lit("")), end + 1
        close = text.find(")", end)
        if name not in self.functions or close < 0 or text[close + 1 : close + 2] != "{":
            raise TemplateError(f"bad function call {text[at:]!r}")
        body, at = self._parts(text, close + 2, nested=True)
        if text[at : at + 2] != "}}":
            raise TemplateError(f"the body of {name} is not closed")
        return self.functions[name](text[end + 1 : close].split(","), body), at + 2


FUNCTIONS: dict[str, Callable[[list[str], Column], Column]] = {
    "Base64": lambda args, body: F.base64(F.encode(body, "UTF-8")),
    "MD5": lambda args, body: F.md5(F.encode(body, "UTF-8")),
    "SHA1": lambda args, body: F.sha1(F.encode(body, "UTF-8")),
    "Upper": lambda args, body: F.upper(body),
}
