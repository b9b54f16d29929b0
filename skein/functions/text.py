"""Text expressions: lines, windows, signatures, ids and escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The lines of a text, each without its line end; a final line end starts no line."""
    parts = F.split(text, "\n")
    n = F.size(parts)
    last = F.element_at(parts, F.greatest(n, F.lit(1))) == ""
    kept = F.slice(parts, F.lit(1), F.when(last, n - 1).otherwise(n))
    return F.transform(kept, lambda x: F.regexp_replace(x, "\r$", ""))


def nth_line(text: Column, number: Column) -> Column:
    """The numbered line (from 1), trimmed; null beyond the text."""
    return F.trim(F.get(lines(text), number - 1))


def window(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end exactly as they stand, with their line ends."""
    parts = F.split(text, "\n")
    body = F.array_join(F.slice(parts, start, F.greatest(end - start + 1, F.lit(0))), "\n")
    return F.when(F.size(parts) > end, F.concat(body, F.lit("\n"))).otherwise(body)


def numbered(number: Column, line: Column, last: Column) -> Column:
    """A line behind its number, right-aligned to the width of the last number, four at least."""
    width = F.greatest(F.lit(4), F.length(last.cast("string")))
    return F.concat(F.lpad(number.cast("string"), width, F.lit(" ")), F.lit("  "), line)


def signature(line: Column) -> Column:
    """Up to the first brace, whose body becomes `{ ... }`."""
    line = F.trim(line)
    return F.when(line.contains("{"), F.concat(F.rtrim(F.substring_index(line, "{", 1)), F.lit(" { ... }"))).otherwise(line)


def text_signature(line: Column) -> Column:
    """For text output: a brace becomes an elided body and a final colon is followed by one; anything else gets one."""
    line = F.trim(line)
    return (
        F.when(line.contains("{"), signature(line))
        .when(line.endswith(":"), F.concat(line, F.lit(" ...")))
        .otherwise(F.concat(line, F.lit(" { ... }")))
    )


def definition_id(path: Column, start_line: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", path, start_line.cast("string"), kind, name)


def dot_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def mermaid_escape(text: Column) -> Column:
    for mark, code in (("#", "#35;"), ('"', "#quot;"), ("<", "#lt;"), (">", "#gt;")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def rotate_cycle(members: Column) -> Column:
    """The same cycle from its smallest member on."""
    at = F.array_position(members, F.array_min(members)).cast("int")
    n = F.size(members)
    return F.when(n > 0, F.concat(F.slice(members, at, n), F.slice(members, F.lit(1), F.greatest(at - 1, F.lit(0))))).otherwise(members)


def callee_matches(callee: Column, name: Column | str) -> Column:
    """A call names a symbol if it equals it or ends with it behind `.` or `::`."""
    name = F.lit(name) if isinstance(name, str) else name
    return (callee == name) | callee.endswith(F.concat(F.lit("."), name)) | callee.endswith(F.concat(F.lit("::"), name))


def callee_keys(callee: Column) -> Column:
    """The names that callee_matches() accepts for a call, so that matching is an equi-join."""
    cut = lambda mark: F.transform(
        F.sequence(F.lit(1), F.size(F.split(callee, mark))), lambda i: F.array_join(F.slice(F.split(callee, mark), i, 2**20), mark.replace("\\", ""))
    )
    plain = ~(F.contains(callee, F.lit(".")) | F.contains(callee, F.lit("::")))  # stands for itself only
    return F.when(plain, F.array(callee)).otherwise(F.array_distinct(F.concat(F.array(callee), cut(r"\."), cut("::"))))


def parse_slice_spec(spec: str) -> tuple[str, int | None, int | None]:
    """`file`, `file:a` or `file:a-b`, split at the last colon."""
    m = re.fullmatch(r"(.+):(\d+)(?:-(\d+))?", spec, re.S)
    if not m:
        if re.search(r":\d+-?[^/]*$", spec):
            raise ValueError(f"bad line range in {spec!r}")
        return spec, None, None
    start = int(m[2])
    end = int(m[3]) if m[3] else None
    if start < 1 or (end is not None and end < start):
        raise ValueError(f"bad line range in {spec!r}")
    return m[1], start, end
