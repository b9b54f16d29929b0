"""Architecture rules over edges, and the baseline that forgives what was there before."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import any_match, glob_regex
from ..functions.text import rotate_cycle
from ..sources.config import Rule


def compile_rules(rules: list[Rule]) -> list[tuple[Rule, str, str]]:
    """(rule, from pattern, to pattern); all invalid globs are named in one error."""
    out, bad = [], []
    for r in rules:
        try:
            out.append((r, glob_regex(r.source, False), glob_regex(r.target, False)))
        except ValueError as e:
            bad.append(f"rule {r.name}: {e}")
    if bad:
        raise ValueError("; ".join(bad))
    return out


def _hit(path: str, pattern: str) -> Column:
    return F.col(path).rlike(pattern)


def violations(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """(repo, rule, src, dst, severity): each local edge with each rule that forbids it. Rules are few, so an edge
    carries the array of those it breaks: no join."""
    compiled = compile_rules(rules)
    kind = "array<struct<rule:string,severity:string>>"
    if not compiled:
        broken = F.array().cast(kind)
    else:
        broken = F.filter(
            F.array(*[F.when(_hit("src", a) & _hit("dst", b), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r, a, b in compiled]).cast(kind),
            lambda x: x.isNotNull(),
        )
    rows = edges.where("kind = 'local'").select("repo", "src", "dst", F.explode(broken).alias("b"))
    return rows.select("repo", "b.rule", "src", "dst", "b.severity")


def dead_rules(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, from_pattern, to_pattern, from_matches, to_matches) of rules whose pattern matches no local edge's end.

    All rules are counted in one pass of conditional sums.
    """
    compiled = compile_rules(rules)
    spark = edges.sparkSession
    schema = "rule string, from_pattern string, to_pattern string, from_matches long, to_matches long"
    if not compiled:
        return spark.createDataFrame([], schema)
    local = edges.where("kind = 'local'")
    sums = [F.sum(_hit(c, p).cast("long")).alias(f"{c}{i}") for i, (_, a, b) in enumerate(compiled) for c, p in (("src", a), ("dst", b))]
    one = local.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.source).alias("from_pattern"), F.lit(r.target).alias("to_pattern"), F.coalesce(f"src{i}", F.lit(0)).alias("from_matches"), F.coalesce(f"dst{i}", F.lit(0)).alias("to_matches")) for i, (r, _, _) in enumerate(compiled)])).alias("r")
    return one.select(rows).select("r.*").where("from_matches = 0 or to_matches = 0")


def first_party(rows: DataFrame, vendor_globs: list[str], column: str = "path") -> tuple[DataFrame, DataFrame]:
    """(rows outside vendored paths, how many were left out per repo). Globs may cross directories."""
    from ..functions.globs import valid_globs

    vendored = any_match(F.col(column), valid_globs(vendor_globs)[0])
    return rows.where(~vendored), rows.where(vendored).groupBy("repo").agg(F.count("*").alias("excluded"))


# --- baseline


def canonical_cycles(cycles: DataFrame) -> DataFrame:
    """(repo, key): members from the smallest on, for cycles given in walking order."""
    return cycles.select("repo", F.to_json(rotate_cycle(F.col("members"))).alias("key"))


def cycle_keys(cycles: DataFrame) -> DataFrame:
    """Cycles as sets: the sorted members name a component whatever order it is given in."""
    return cycles.withColumn("key", F.to_json(F.array_sort("members")))


def new_cycles(cycles: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cycles that the baseline doesn't have. baseline: (repo, members)."""
    return cycle_keys(cycles).join(cycle_keys(baseline).select("repo", "key"), ["repo", "key"], "left_anti").drop("key")


def new_violations(found: DataFrame, baseline: DataFrame) -> DataFrame:
    return found.join(baseline.select("repo", "rule", "src", "dst"), ["repo", "rule", "src", "dst"], "left_anti")


def write_baseline(path: str, cycles: DataFrame, found: DataFrame) -> dict:
    """One repository's baseline file: version, cycles and violations, in a stable order."""
    data = {
        "version": 1,
        "cycles": sorted(sorted(r["members"]) for r in cycles.select("members").collect()),
        "rule_violations": [{"rule": r.rule, "from": r.src, "to": r.dst} for r in found.select("rule", "src", "dst").distinct().orderBy("rule", "src", "dst").collect()],
    }
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2)
        f.write("\n")
    return data


def read_baseline(spark: SparkSession, path: str, repo: str) -> tuple[DataFrame, DataFrame, int]:
    """(cycles, violations, how many entries). A missing file is an empty baseline."""
    data = {"cycles": [], "rule_violations": []}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if data.get("version") != 1:
            raise ValueError(f"{path}: unknown baseline version")
    slash = lambda p: p.replace("\\", "/")
    cycles = [(repo, [slash(p) for p in c]) for c in data["cycles"]]
    found = [(repo, v["rule"], slash(v["from"]), slash(v["to"])) for v in data["rule_violations"]]
    return (
        spark.createDataFrame(cycles, "repo string, members array<string>"),
        spark.createDataFrame(found, "repo string, rule string, src string, dst string"),
        len(cycles) + len(found),
    )
