"""Tag predicates: a small grammar parsed at plan time into column expressions.

``[~|:]name[=|:|~]value`` with an optional ``@``. The name is matched exactly regardless of case, by
tokens that it must all contain (``:``), or by a regular expression regardless of case (``~``). The
value is free, or matched exactly with its case (``=``), by contained tokens regardless of case
(``:``), or by a regular expression with its case (``~``). ``name:`` and ``name~`` leave the value
free; ``name=`` asks for an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TagPredicate:
    name_mode: str  # exact, contains, regex
    name: str
    value_mode: str  # any, exact, contains, regex
    value: str = ""

    def canonical(self) -> str:
        """The predicate in its shortest form; parsing it gives the predicate again."""
        lead = {"exact": "", "contains": ":", "regex": "~"}[self.name_mode]
        tie = {"any": "", "exact": "=", "contains": ":", "regex": "~"}[self.value_mode]
        return f"{lead}{self.name}{tie}{self.value}"

    def describe(self) -> str:
        name = {"exact": "is", "contains": "contains", "regex": "matches"}[self.name_mode]
        if self.value_mode == "any":
            return f"tag {name} {self.name!r}"
        value = {"exact": "is", "contains": "contains", "regex": "matches"}[self.value_mode]
        return f"tag {name} {self.name!r} and value {value} {self.value!r}"

    def on_name(self, tag: Column) -> Column:
        if self.name_mode == "exact":
            return F.lower(tag) == self.name.lower()
        if self.name_mode == "contains":
            return _all_tokens(tag, self.name)
        return tag.rlike(f"(?i){checked_regex(self.name)}")

    def on_value(self, value: Column) -> Column:
        if self.value_mode == "any":
            return F.lit(True)
        if self.value_mode == "exact":
            return value == self.value
        if self.value_mode == "contains":
            return _all_tokens(value, self.value)
        return value.rlike(checked_regex(self.value))

    def on(self, tag: Column, value: Column) -> Column:
        """The predicate on a tag and its value; null tags and values don't match."""
        return F.coalesce(self.on_name(tag) & self.on_value(value), F.lit(False))


def _all_tokens(text: Column, tokens: str) -> Column:
    out = F.lit(True)
    for t in tokens.lower().split():
        out = out & F.contains(F.lower(text), F.lit(t))
    return out


def checked_regex(pattern: str) -> str:
    """The pattern, if it keeps to what linear-time engines offer as well."""
    if re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError(f"look-around and back-references aren't supported: {pattern!r}")
    re.compile(pattern)
    return pattern


def parse_predicate(text: str) -> TagPredicate:
    """Parse a predicate; raises ``ValueError`` if there is no name."""
    body = text.strip()
    mode = {":": "contains", "~": "regex"}.get(body[:1], "exact")
    body = body[1:] if mode != "exact" else body
    body = body[1:] if body.startswith("@") else body
    at = next((i for i, c in enumerate(body) if c in "=:~"), -1)
    if at < 0:
        name, tie, value = body, "", ""
    else:
        name, tie, value = body[:at], body[at], body[at + 1 :]
    if not name.strip():
        raise ValueError(f"a tag predicate needs a name: {text!r}")
    kind = {"": "any", "=": "exact", ":": "contains", "~": "regex"}[tie]
    if tie in (":", "~") and not value:
        kind = "any"
    out = TagPredicate(mode, name.strip(), kind, value if kind != "any" else "")
    for m, p in ((out.name_mode, out.name), (out.value_mode, out.value)):
        if m == "regex":
            checked_regex(p)
    return out
