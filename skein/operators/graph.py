"""The file graph: edges, degrees, roots, orphans and the assembled bundle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import JS_EXTS, TS_EXTS


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src, dst, kind): one edge per pair of files, with the kind of its first import; self loops stay."""
    known = files.select("repo", F.col("path").alias("dst"))
    found = imports.where("resolved is not null").select("repo", F.col("path").alias("src"), F.col("resolved").alias("dst"), "ord", "kind")
    return collapse_edges(found.join(known, ["repo", "dst"], "left_semi"))


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One row per (repo, src, dst): the kind of the smallest ord."""
    return edges.groupBy("repo", "src", "dst").agg(F.min_by("kind", "ord").alias("kind"))


def companion_edges(files: DataFrame, edges: DataFrame) -> DataFrame:
    """An edge to `x.d.ts` from the first of x's implementations that exists, unless there is one already."""
    path = F.col("path")
    base = F.regexp_replace(path, r"\.d\.ts$", "")
    wanted = files.where(path.endswith(".d.ts") & (paths.name(path) != ".d.ts"))
    tries = F.array(*[F.concat(base, F.lit(f".{e}")) for e in TS_EXTS + JS_EXTS])
    ranked = wanted.select("repo", path.alias("dst"), F.posexplode(tries).alias("rank", "src"))
    known = files.select("repo", path.alias("src"))
    found = ranked.join(known, ["repo", "src"]).groupBy("repo", "dst").agg(F.min_by("src", "rank").alias("src"))
    return found.join(edges, ["repo", "src", "dst"], "left_anti").select("repo", "src", "dst", F.lit("local").alias("kind"))


def build_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    own = import_edges(imports, files)
    return own.unionByName(companion_edges(files, own))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, path, in_deg, out_deg) of every node; one shuffle of the edges' ends."""
    ends = edges.select("repo", F.explode(F.array(F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    ends = ends.select("repo", "e.path", "e.i", "e.o").unionByName(nodes.select("repo", "path", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("repo", "path").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).select("repo", "path", "in_deg")


def heaviest(nodes: DataFrame, edges: DataFrame, top: int | None = None) -> DataFrame:
    """Nodes by distinct importers, then path."""
    out = in_degrees(nodes, edges).withColumnRenamed("in_deg", "dependents").orderBy(F.desc("dependents"), "repo", paths.sort_key(F.col("path")))
    return out.limit(top) if top is not None else out


def who_imports(edges: DataFrame, target: str) -> DataFrame:
    return edges.where(F.col("dst") == target).select("repo", F.col("src").alias("path")).distinct()


def edges_from(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("src") == path).select("repo", F.col("dst").alias("path"), "kind")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing points to; a self loop points to its node."""
    return nodes.select("repo", "path").join(edges.select("repo", F.col("dst").alias("path")), ["repo", "path"], "left_anti")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return roots(nodes, edges).join(edges.select("repo", F.col("src").alias("path")), ["repo", "path"], "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame, structural: DataFrame, tests: DataFrame) -> DataFrame:
    """Isolated nodes that are neither tests nor loaded by convention."""
    alone = isolated(nodes, edges)
    for other in (structural, tests):
        alone = alone.join(other.select("repo", "path"), ["repo", "path"], "left_anti")
    return alone


def test_entries(nodes: DataFrame, edges: DataFrame, tests: DataFrame, cargo: DataFrame) -> DataFrame:
    """Isolated test files, except those that Cargo loads."""
    return isolated(nodes, edges).join(tests.select("repo", "path"), ["repo", "path"], "left_semi").join(cargo.select("repo", "path"), ["repo", "path"], "left_anti")


def external_packages(imports: DataFrame) -> DataFrame:
    """(repo, path, package): what a file imports from elsewhere, up to the first `::`."""
    return imports.where("kind = 'external'").select("repo", "path", F.substring_index("raw", "::", 1).alias("package")).distinct()


@dataclass
class DependencyGraph:
    """The assembled graph of any number of repositories; every member is lazy."""

    files: DataFrame
    imports: DataFrame
    symbols: DataFrame
    calls: DataFrame
    edges: DataFrame
    scc: DataFrame
    roots: DataFrame
    orphans: DataFrame
    test_entries: DataFrame
    structural_entries: DataFrame
    skipped: DataFrame | None = None
