"""Globs compiled to regular expressions at plan time, so that matching is a plain ``rlike``.

``*`` stays within a path element, ``**`` crosses them, ``?`` is one character, ``[...]`` a class and
``{a,b}`` an alternative. ``name/`` matches directories only, ``./x`` is anchored at the source,
``/x`` is absolute, and a bare ``x`` matches at any depth. Hidden files match only with ``dotfiles``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str, dotfiles: bool = True) -> str:
    """The regular expression of a glob for paths relative to the source."""
    body = glob[:-1] if glob.endswith("/") and len(glob) > 1 else glob
    anchored = body.startswith(("./", "/")) or "/" in body
    body = body[2:] if body.startswith("./") else body
    out, i = [], 0
    element = "" if dotfiles else r"(?!\.)"
    start = True
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out.append(r"(?:[^/]*/)*" if dotfiles else r"(?:(?!\.)[^/]*/)*")
            i += 3
            start = True
            continue
        if body.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append((element if start else "") + "[^/]*")
            i += 1
        elif c == "?":
            out.append((element if start else "") + "[^/]")
            i += 1
        elif c == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]")
            i = end + 1
        elif c == "{" and "}" in body[i:]:
            end = body.index("}", i)
            out.append("(?:" + "|".join(re.escape(p) for p in body[i + 1 : end].split(",")) + ")")
            i = end + 1
        else:
            out.append(re.escape(c) if c != "/" else "/")
            i += 1
        start = c == "/"
    lead = "" if anchored else r"(?:.*/)?"
    return f"^{lead}{''.join(out)}\\z"


def matches(path: Column, glob: str, is_dir: bool = False, dotfiles: bool = True) -> Column:
    """Whether a path matches; a glob that ends in a slash matches directories only."""
    if glob.endswith("/") and not is_dir:
        return F.lit(False)
    return path.rlike(glob_to_regex(glob, dotfiles))


def any_match(path: Column, globs: list[str], is_dir: bool = False) -> Column:
    """Whether any of the globs matches; false for no globs."""
    out = F.lit(False)
    for g in globs:
        out = out | matches(path, g, is_dir)
    return out


def passes(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Include list (any, or all paths if empty) and no exclude; a null path passes only empty lists."""
    ok = any_match(path, include) if include else F.lit(True)
    return F.coalesce(ok & ~any_match(path, exclude), F.lit(not include and not exclude))


def classify(path: Column, include: list[str], exclude: list[str]) -> Column:
    """``included``, ``excluded`` or ``unresolved``; an include beats an exclude."""
    return F.when(any_match(path, include), "included").when(any_match(path, exclude), "excluded").otherwise("unresolved")
