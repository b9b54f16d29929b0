"""Path expressions: forward slashes, relative to a repository's root."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Empty for a file at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Without the dot; empty for none. A leading dot starts no extension."""
    return F.regexp_extract(name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name(path), r"^(.+)\.[^.]*$", "$1")


def components(path: Column) -> Column:
    return F.split(path, "/")


def sort_key(path: Column) -> Column:
    """Paths sort by component: `a/b` before `a-b`."""
    return F.split(path, "/")


def normalize(path: Column) -> Column:
    """Drops `.` and empty parts and resolves `..`; a `..` that leaves the root is kept, so `../x` never becomes `x`."""

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) != "..")
        return F.when((part == ".") | (part == ""), acc).when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def normalize_text(path: str) -> str:
    """normalize() for one Python string."""
    out = posixpath.normpath(path.lstrip("/")) if path.strip("/") else ""
    return "" if out == "." else out


def to_slash(path: Column, windows: bool = False) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")) if windows else path
