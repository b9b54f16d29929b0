"""Sources of trees: listing, contents, language filters and what was skipped."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, globs, paths
from ..schema import SOURCES
from .ignore import Ignore


class NoFiles(Exception):
    """No supported file was found; the payload is what the command line prints."""

    def __init__(self, root: str, skipped: list[dict]):
        super().__init__("no supported files found")
        self.payload = {"ok": False, "error": "no supported files found", "root": root, "hint": "check the path, --lang and exclude settings"}
        if skipped:
            self.payload["skipped_unsupported"] = skipped


def list_tree(root: str, exclude: list[str] = ()) -> list[tuple[str, int, int]]:
    """(path, size, mtime_ns) of a local tree's regular files, by path. Hidden, ignored and excluded entries are pruned;
    unreadable directories are passed over; the root itself is never pruned."""
    import re

    patterns = [re.compile(p) for p in globs.valid_globs(list(exclude))[0]]
    out: list[tuple[str, int, int]] = []

    def walk(directory: str, rel: str, ignore: Ignore | None) -> None:
        try:
            entries = list(os.scandir(directory))
        except OSError:
            return
        own = next((e for e in entries if e.name == ".gitignore" and e.is_file()), None)
        if own:
            with open(own.path, encoding="utf-8", errors="replace") as f:
                ignore = Ignore(f.read(), rel, ignore)
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") or any(p.search(path) for p in patterns) or (ignore and ignore.ignores(path, is_dir)):
                continue
            if is_dir:
                walk(e.path, path, ignore)
            elif e.is_file(follow_symlinks=False):
                s = e.stat()
                out.append((path, s.st_size, s.st_mtime_ns))

    walk(root, "", None)
    return sorted(out, key=lambda r: r[0].split("/"))


def read_tree(spark: SparkSession, root: str, repo: str | None = None, exclude: list[str] = ()) -> DataFrame:
    """One local tree as a sources table. Listed first, so that empty files, which readers of binary files drop, stay."""
    root = os.path.realpath(root)
    repo = repo or root
    rows = [(repo, p, size, mtime) for p, size, mtime in list_tree(root, exclude)]
    listed = spark.createDataFrame(rows, "repo string, path string, size long, mtime_ns long")
    if not any(r[2] for r in rows):
        return listed.withColumn("content", F.lit(b""))
    # one directory for the reader, joined to the listing by path
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{root}")
    found = found.select(F.expr(f"substring(path, {len('file:' + root) + 2})").alias("path"), "content")
    return listed.join(found, "path", "left").select("repo", "path", "size", "mtime_ns", F.coalesce("content", F.lit(b"")).alias("content"))


def read_trees(spark: SparkSession, roots: dict[str, str], exclude: list[str] = ()) -> DataFrame:
    """Several trees, each under its own repo key."""
    out = spark.createDataFrame([], SOURCES)
    for repo, root in roots.items():
        out = out.unionByName(read_tree(spark, root, repo, exclude))
    return out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A sources table that was written as Parquet, partitioned by repo: how many repositories are read at scale."""
    return spark.read.schema(SOURCES).parquet(path)


def with_language(sources: DataFrame) -> DataFrame:
    return sources.withColumn("lang", detect.language(F.col("path"), F.col("content")))


def supported(sources: DataFrame, langs: list[str] | None = None, max_bytes: int | None = None, exclude: list[str] = ()) -> DataFrame:
    """Files of supported languages: repo, path, lang, size, mtime_ns, content. Size is checked before content is read."""
    rows = sources.where(F.col("size") <= max_bytes) if max_bytes is not None else sources
    if exclude:
        rows = rows.where(~globs.excluded(F.col("path"), list(exclude)))
    rows = with_language(rows).where("lang is not null")
    return rows.where(F.col("lang").isin(*langs)) if langs is not None else rows


def single_file(sources: DataFrame, path: str, langs: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """One file, excludes aside; ValueError says why it can't be used."""
    row = with_language(sources.where(F.col("path") == path))
    found = row.select("lang", "size").first()
    if found is None:
        raise ValueError(f"no such file: {path}")
    if found["lang"] is None:
        raise ValueError(f"unknown language: {path}")
    if langs is not None and found["lang"] not in langs:
        raise ValueError(f"{path} is {found['lang']}, not {', '.join(langs)}")
    if max_bytes is not None and found["size"] > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes} bytes")
    return row


def skipped_groups(sources: DataFrame, samples: int = 3) -> DataFrame:
    """(repo, group, count, sample): files that look like source in no supported language, by extension."""
    rows = with_language(sources).where(F.col("lang").isNull() & detect.reportable(F.col("path"), F.col("content")))
    ext = F.lower(paths.extension(F.col("path")))
    return group_skipped(rows.select("repo", "path", F.when(ext == "", "(no extension)").otherwise(ext).alias("group")), samples)


def group_skipped(rows: DataFrame, samples: int = 3) -> DataFrame:
    """rows: repo, path, group. The sample is a bounded top-n per group, not a collected list."""
    from pyspark.sql import Window

    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("repo", "group").orderBy(paths.sort_key(F.col("path"))))).where(F.col("r") <= samples)
    sample = first.groupBy("repo", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("sample"))
    counts = rows.groupBy("repo", "group").agg(F.count("*").alias("count"))
    return counts.join(sample, ["repo", "group"])


def skipped_summary(groups: list[dict]) -> str:
    """One line: skipped 3 unsupported files: .zig 2, (no extension) 1."""
    total = sum(g["count"] for g in groups)
    if not total:
        return ""
    names = ", ".join(f"{g['group'] if g['group'].startswith('(') else '.' + g['group']} {g['count']}" for g in groups)
    return f"skipped {total} unsupported file{'s' * (total != 1)}: {names}"
