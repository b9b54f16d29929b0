"""The commands of the analyser as plans over tables, and a session that builds those tables once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import extract as X
from ..operators import graph as G
from ..operators import recurse, resolve, rules, structural, symbols
from ..operators.graph import DependencyGraph
from ..sources import scan
from ..sources.config import Config


@dataclass
class Workspace:
    """Sources and what is derived from them. Facts are extracted in one pass and written once; all else is lazy."""

    spark: SparkSession
    sources: DataFrame
    config: Config = field(default_factory=Config)
    langs: list[str] | None = None
    files: DataFrame = None
    facts: X.FactTables = None
    imports: DataFrame = None

    def __post_init__(self):
        c = self.config
        own = scan.supported(self.sources, self.langs, c.max_bytes, c.exclude)
        rows = recurse.cut(X.facts(own))
        self.files = own.select("repo", "path", "lang", "size", "mtime_ns")
        self.facts = X.split(rows)
        self.imports = resolve.resolve(self.facts.imports, self.files, resolve.contexts(self.sources))

    def require_files(self, root: str = "") -> None:
        if self.files.isEmpty():
            raise scan.NoFiles(root, [r.asDict() for r in scan.skipped_groups(self.sources).drop("repo").collect()])

    def graph(self) -> DependencyGraph:
        edges = recurse.cut(G.build_edges(self.imports, self.files))
        tests, cargo = structural.tests(self.files), structural.cargo_targets(self.files, self.sources)
        scc = recurse.cut(recurse.cyclic(recurse.components(edges), edges))
        suppressed = structural.suppressed(self.files, self.sources, cargo)
        return DependencyGraph(
            files=self.files,
            imports=self.imports,
            symbols=self.facts.symbols,
            calls=self.facts.calls,
            edges=edges,
            scc=scc,
            roots=G.roots(self.files, edges),
            orphans=G.orphans(self.files, edges, suppressed, tests),
            test_entries=G.test_entries(self.files, edges, tests, cargo),
            structural_entries=cargo.join(G.isolated(self.files, edges), ["repo", "path"], "left_semi"),
            skipped=scan.skipped_groups(self.sources),
        )

    def lines(self) -> DataFrame:
        return symbols.file_lines(self.sources)


@dataclass
class CheckResult:
    cycles: DataFrame
    violations: DataFrame
    orphans: DataFrame
    dead_rules: DataFrame
    suppressed: int
    syntax_errors: DataFrame | None

    def ok(self) -> bool:
        """No new cycle and no new violation of severity error."""
        return self.cycles.isEmpty() and self.violations.where("severity = 'error'").isEmpty()

    def exit_code(self, exit_zero: bool = False) -> int:
        return 0 if exit_zero or self.ok() else 1


def check(w: Workspace, g: DependencyGraph, baseline: str | None = None, syntax: bool = False, first_party: bool = False) -> CheckResult:
    """Cycles and rule violations beyond the baseline, and orphans, which no baseline covers."""
    found, broken, known = recurse.cycles(g.scc), rules.violations(g.edges, w.config.rules), 0
    if baseline is not None:
        repo = w.sources.select("repo").first()
        old_cycles, old_broken, known = rules.read_baseline(w.spark, baseline, repo["repo"] if repo else "")
        found, broken = rules.new_cycles(found, old_cycles), rules.new_violations(broken, old_broken)
    orphans = g.orphans
    if first_party or w.config.first_party:
        orphans, _ = rules.first_party(orphans, w.config.vendored)
    errors = None
    if syntax:
        errors = X.errors(scan.supported(w.sources, w.langs, w.config.max_bytes, w.config.exclude))
    return CheckResult(found, broken, orphans, rules.dead_rules(g.edges, w.config.rules), known, errors)


def orient(files: DataFrame, edges: DataFrame, scc: DataFrame, roots: DataFrame, orphans: DataFrame, external: DataFrame) -> DataFrame:
    """One row per repository: counts, entry points, cycles, orphans, packages and the three heaviest files."""
    listed = lambda df, name: df.groupBy("repo").agg(F.array_sort(F.collect_set("path")).alias(name))
    langs = files.groupBy("repo", "lang").agg(F.count("*").alias("n"))
    langs = langs.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("languages"))
    cycles = scc.where("cyclic").groupBy("repo").agg(F.count_distinct("scc_id").alias("cycles"), F.max("scc_size").alias("largest_cycle_size"))
    packages = external.groupBy("repo").agg(F.array_sort(F.collect_set("package")).alias("external_packages"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("in_deg")).alias("k"), paths.sort_key(F.col("path")).alias("p"), "path", "in_deg"))), 1, 3)
    # per repository the three heaviest, chosen by rank before anything is gathered
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("in_deg"), paths.sort_key(F.col("path"))))
    heavy = G.in_degrees(files, edges).withColumn("r", rank).where("r <= 3").groupBy("repo").agg(F.transform(top, lambda x: F.struct(x["path"].alias("file"), x["in_deg"].alias("dependents"))).alias("heaviest"))
    out = files.groupBy("repo").agg(F.count("*").alias("files"))
    for part in (langs, edges.groupBy("repo").agg(F.count("*").alias("edges")), listed(roots, "entry_points"), cycles, orphans.groupBy("repo").agg(F.count("*").alias("orphans")), packages, heavy):
        out = out.join(part, "repo", "left")
    return out.fillna(0, ["edges", "cycles", "largest_cycle_size", "orphans"])
