"""Queries over definitions and calls: references, dead symbols, impact, hotspots, skeletons, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detect, paths, text
from .recurse import impact_with_depth, reach_with_depth

KIND_ALIASES = {"fn": "function", "function": "function", "class": "class", "method": "method"}


def flat(symbols: DataFrame) -> DataFrame:
    """repo, path, name, kind, exported, line, end_line, id."""
    rows = symbols.select("repo", "path", "ord", "name", "kind", "exported", F.col("span.start_line").alias("line"), F.col("span.end_line").alias("end_line"))
    return rows.withColumn("id", text.definition_id(F.col("path"), F.col("line"), F.col("kind"), F.col("name")))


def definitions(symbols: DataFrame, name: str, scope: str | None = None) -> DataFrame:
    rows = flat(symbols).where(F.col("name") == name)
    return rows.where(F.col("path") == scope) if scope is not None else rows


def file_lines(sources: DataFrame) -> DataFrame:
    """(repo, path, line, content): numbered lines of text sources."""
    lines = F.posexplode(text.lines(detect.text_of(F.col("content")))).alias("n", "content")
    return sources.select("repo", "path", lines).select("repo", "path", (F.col("n") + 1).alias("line"), "content")


def matching_calls(calls: DataFrame, name: str | Column) -> DataFrame:
    return calls.where(text.callee_matches(F.col("callee_raw"), name))


def call_counts(calls: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, path, name, n): how often each file calls each of many names; names: (repo, name).

    Calls are counted by file and callee first, which takes the weight off common callees before they meet the names.
    """
    counts = calls.groupBy("repo", "path", "callee_raw").agg(F.count("*").alias("n"))
    keyed = counts.select("repo", "path", F.explode(text.callee_keys(F.col("callee_raw"))).alias("name"), "n")
    wanted = names.select("repo", "name").distinct()
    return keyed.join(wanted, ["repo", "name"], "left_semi").groupBy("repo", "path", "name").agg(F.sum("n").alias("n"))


def reference_scope(edges: DataFrame, defined_in: str) -> DataFrame:
    """(repo, path): a defining file and all that depend on it."""
    start = edges.select("repo").distinct().withColumn("source", F.lit(defined_in))
    reached = reach_with_depth(edges, start, reverse=True).select("repo", "path")
    return reached.unionByName(start.select("repo", F.col("source").alias("path")))


def references(symbols: DataFrame, calls: DataFrame, lines: DataFrame, edges: DataFrame, name: str, defined_in: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(definitions, references with their source line). Several definitions and no scope: ambiguous, no references."""
    found = definitions(symbols, name, defined_in)
    counts = found.groupBy("repo").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("definition_ids"))
    hits = matching_calls(calls, name)
    if defined_in is not None:
        hits = hits.join(reference_scope(edges, defined_in), ["repo", "path"], "left_semi")
    else:
        counts = counts.where("n <= 1")
    at = hits.select("repo", "path", F.col("span.start_line").alias("line"), F.lit("call").alias("kind"), F.col("callee_raw").alias("callee"))
    refs = at.join(counts.drop("n"), "repo").join(lines, ["repo", "path", "line"], "left")
    return found, refs.select("repo", "path", "line", "kind", "callee", F.trim(F.coalesce("content", F.lit(""))).alias("context"), "definition_ids")


def dead_verdict(definition_rows: DataFrame, call_rows: DataFrame) -> DataFrame:
    """definition_rows: (repo, name, path); call_rows: (repo, name, path, n) of matching calls. One verdict per defined name.

    Calls inside a defining file are its own; from elsewhere they keep the symbol alive, unless several definitions
    make it unclear which one.
    """
    homes = definition_rows.select("repo", "name", "path").distinct().withColumn("own", F.lit(1))
    split = call_rows.join(homes, ["repo", "name", "path"], "left")
    uses = split.groupBy("repo", "name").agg(F.sum(F.when(F.col("own").isNotNull(), F.col("n"))).alias("self_refs"), F.sum(F.when(F.col("own").isNull(), F.col("n"))).alias("cross_refs"))
    defs = definition_rows.groupBy("repo", "name").agg(F.count("*").alias("definitions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = defs.join(uses, ["repo", "name"], "left").select("repo", "name", "definitions", zero("self_refs").alias("self_refs"), zero("cross_refs").alias("cross_refs"))
    status = (
        F.when((F.col("cross_refs") > 0) & (F.col("definitions") > 1), "ambiguous")
        .when(F.col("cross_refs") > 0, "live_cross_file_references")
        .when(F.col("self_refs") > 0, "self_only_references")
        .otherwise("no_references")
    )
    rows = rows.withColumn("status", status)
    dead = F.when(F.col("status") == "ambiguous", None).otherwise(F.col("cross_refs") == 0)
    return rows.withColumn("dead", dead.cast("boolean"))


def dead(symbols: DataFrame, calls: DataFrame, edges: DataFrame, name: str, defined_in: str | None = None) -> DataFrame:
    """The verdict of one name per repository; a repository without the definition gets not_found and a null verdict."""
    hits = matching_calls(calls, name)
    if defined_in is not None:
        hits = hits.join(reference_scope(edges, defined_in), ["repo", "path"], "left_semi")
    named = F.lit(name).alias("name")
    found = dead_verdict(definitions(symbols, name, defined_in).select("repo", named, "path"), hits.groupBy("repo", "path").agg(F.count("*").alias("n")).select("repo", named, "path", "n"))
    missing = symbols.select("repo").distinct().join(found.select("repo"), "repo", "left_anti")
    absent = missing.select("repo", named, F.lit(0).alias("definitions"), F.lit(0).alias("self_refs"), F.lit(0).alias("cross_refs"), F.lit("not_found").alias("status"), F.lit(None).cast("boolean").alias("dead"))
    return found.unionByName(absent)


def impact(symbols: DataFrame, calls: DataFrame, edges: DataFrame, name: str, depth: int | None = None) -> DataFrame:
    """(repo, path, depth, calls_symbol) of all that depend on a defining file, by fewest hops."""
    sources = definitions(symbols, name).select("repo", F.col("path").alias("source")).distinct()
    hit = impact_with_depth(edges, sources, depth)
    callers = matching_calls(calls, name).select("repo", "path").distinct().withColumn("c", F.lit(True))
    return hit.join(callers, ["repo", "path"], "left").select("repo", "path", "depth", F.coalesce("c", F.lit(False)).alias("calls_symbol"))


def hotspots(symbols: DataFrame, top: int | None = 20) -> DataFrame:
    """Files by the number of their functions times their average length, both whole numbers."""
    rows = flat(symbols).where("kind in ('function', 'method')").withColumn("len", F.col("end_line") - F.col("line") + 1)
    return hotspots_of(rows.select("repo", "path", F.col("len").cast("long").alias("len")), top)


def hotspots_of(lengths: DataFrame, top: int | None) -> DataFrame:
    """lengths: (repo, path, len), one row per function."""
    out = lengths.groupBy("repo", "path").agg(F.count("*").alias("functions"), F.expr("sum(len) div count(*)").alias("avg_length"), F.max("len").alias("max_length"))
    out = out.withColumn("score", F.col("functions") * F.col("avg_length")).orderBy(F.desc("score"), "repo", paths.sort_key(F.col("path")))
    return out.limit(top) if top is not None else out


def skeleton(symbols: DataFrame, lines: DataFrame, as_text: bool = False) -> DataFrame:
    """A signature per symbol, from the line where it starts."""
    sign = text.text_signature if as_text else text.signature
    return flat(symbols).join(lines, ["repo", "path", "line"]).select("repo", "path", "ord", "name", "kind", "line", "exported", sign(F.col("content")).alias("signature"))


def show(symbols: DataFrame, sources: DataFrame, name: str, kind: str | None = None, scope: str | None = None, everything: bool = False) -> DataFrame:
    """Matches by path and line with the body of the first one, or of all."""
    if kind is not None and kind not in KIND_ALIASES:
        raise ValueError(f"unknown kind: {kind}")
    rows = definitions(symbols, name, scope)
    rows = rows.where(F.col("kind") == KIND_ALIASES[kind]) if kind else rows
    order = Window.partitionBy("repo").orderBy(paths.sort_key(F.col("path")), "line")
    rows = rows.withColumn("nr", F.row_number().over(order))
    body = text.window(detect.text_of(F.col("content")), F.col("line"), F.col("end_line"))
    joined = rows.join(sources.select("repo", "path", "content"), ["repo", "path"])
    shown = body if everything else F.when(F.col("nr") == 1, body)
    return joined.select("repo", "nr", "name", "kind", "path", "line", "end_line", "exported", shown.alias("body"))


def suggestions(symbols: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """Names that equal or contain the wanted one, whatever the case."""
    rows = symbols.where(F.lower("name").contains(name.lower())).select("name").distinct()
    return rows.orderBy("name").limit(limit)


def slice_bounds(total: Column | int, start: int, end: int | None, context: int = 10, most: int = 500) -> tuple[int, int]:
    """First and last line of a window: context around a single line, clamped to the text, at most `most` lines."""
    if start < 1 or (end is not None and end < start):
        raise ValueError("lines start at 1 and end at or after the first")
    total = max(int(total), 1)
    if end is None:
        start, end = max(1, start - context), start + context
    start, end = min(start, total), min(end, total)
    return start, min(end, start + most - 1)


def slice_lines(lines: DataFrame, path: str, start: int, end: int) -> DataFrame:
    return lines.where((F.col("path") == path) & F.col("line").between(start, end))
