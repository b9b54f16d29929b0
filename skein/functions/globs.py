"""Globs as Java and Python regular expressions, in two dialects.

crossing=True: `*` and `?` also match `/` (excludes, vendored paths). crossing=False: they stop at `/` (architecture
rules). `**/`, `/**/` and `/**` match whole directories in both. Braces nest; classes may be negated by `!` or `^`.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str, crossing: bool) -> str:
    """An anchored pattern; ValueError if a class or brace isn't closed."""
    one, many = (".", ".*") if crossing else ("[^/]", "[^/]*")
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            j = i
            while j < len(glob) and glob[j] == "*":
                j += 1
            starts, ends = i == 0 or glob[i - 1] in "/{,", j == len(glob) or glob[j] in "},"
            if j - i >= 2 and starts and j < len(glob) and glob[j] == "/":
                out.append("(?:.*/)?")
                j += 1
            elif j - i >= 2 and starts and ends:
                out.append(".*" if i == 0 or glob[i - 1] != "/" else ".+")
            else:
                out.append(many)
            i = j
            continue
        if c == "?":
            out.append(one)
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:])
            out.append(f"[{'^' * negated}{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed brace in glob {glob!r}")
    return "^" + "".join(out) + "$"


def valid_globs(globs: list[str], crossing: bool = True) -> tuple[list[str], list[str]]:
    """(patterns of the valid globs, warnings for the others)."""
    patterns, warnings = [], []
    for g in globs:
        try:
            patterns.append(glob_regex(g, crossing))
        except ValueError as e:
            warnings.append(str(e))
    return patterns, warnings


def any_match(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(p) for p in patterns], F.lit(False))


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a path or one of its parent directories matches: a matched directory takes its contents with it."""
    patterns, _ = valid_globs(globs)
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.concat_ws("/", F.slice(F.split(path, "/"), F.lit(1), i)))
    return F.exists(parents, lambda p: any_match(p, patterns)) if patterns else F.lit(False)
