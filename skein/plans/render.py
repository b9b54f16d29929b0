"""Renderings as tables of lines (repo, ord, line), one document per repository; sinks only collect and print them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import graph as G
from ..operators import recurse
from ..operators.graph import DependencyGraph
from ..schema import LANGUAGES, UNKNOWN_COLOUR

DASH, LOOP = "—", "⟳"


def _map(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def _lines(sections: list[DataFrame]) -> DataFrame:
    """Sections of (repo, key array, line) one after the other."""
    out = None
    for i, s in enumerate(sections):
        own = s.select("repo", F.lit(i).alias("s"), "key", "line")
        out = own if out is None else out.unionByName(own)
    ord_ = F.row_number().over(Window.partitionBy("repo").orderBy("s", "key", "line")) - 1
    return out.select("repo", ord_.alias("ord"), "line")


def _fixed(repos: DataFrame, lines: list[str]) -> DataFrame:
    rows = F.posexplode(F.array(*map(F.lit, lines))).alias("i", "line")
    return repos.select("repo", rows).select("repo", F.array(F.lpad(F.col("i").cast("string"), 4, F.lit("0"))).alias("key"), "line")


def _marked_edges(edges: DataFrame, scc: DataFrame) -> DataFrame:
    inside = recurse.cycle_edges(edges, scc).select("repo", "src", "dst", F.lit(True).alias("on_cycle"))
    return edges.join(inside, ["repo", "src", "dst"], "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))


def _marked_nodes(files: DataFrame, scc: DataFrame) -> DataFrame:
    on = scc.where("cyclic").select("repo", "path", F.lit(True).alias("on_cycle"))
    return files.select("repo", "path", "lang").join(on, ["repo", "path"], "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))


def dot(files: DataFrame, edges: DataFrame, scc: DataFrame) -> DataFrame:
    colours = {n: c for n, _, _, _, c in LANGUAGES}
    repos = files.select("repo").distinct()
    head = ["digraph dependencies {", "  rankdir=LR;", '  node [shape=box fontname="monospace" fontsize=10];', "  edge [arrowsize=0.6];", ""]
    path = text.dot_escape(F.col("path"))
    label = text.dot_escape(paths.name(F.col("path")))
    style = F.when(F.col("on_cycle"), ' style=filled fillcolor="#ff000022"').otherwise("")
    nodes = _marked_nodes(files, scc).select("repo", paths.sort_key(F.col("path")).alias("key"), F.concat(F.lit('  "'), path, F.lit('" [label="'), label, F.lit('" color="'), _map(colours, F.col("lang"), UNKNOWN_COLOUR), F.lit('"'), style, F.lit("];")).alias("line"))
    look = F.when(F.col("on_cycle"), ' [color="#ff0000" style=dashed];').otherwise(";")
    arrows = _marked_edges(edges, scc).select("repo", F.array("src", "dst").alias("key"), F.concat(F.lit('  "'), text.dot_escape(F.col("src")), F.lit('" -> "'), text.dot_escape(F.col("dst")), F.lit('"'), look).alias("line"))
    return _lines([_fixed(repos, head), nodes, _fixed(repos, [""]), arrows, _fixed(repos, ["}"])])


def mermaid(files: DataFrame, edges: DataFrame, scc: DataFrame) -> DataFrame:
    repos = files.select("repo").distinct()
    every = files.select("repo", "path").unionByName(edges.select("repo", F.explode(F.array("src", "dst")).alias("path"))).distinct()
    number = F.row_number().over(Window.partitionBy("repo").orderBy(paths.sort_key(F.col("path")))) - 1
    ids = every.select("repo", "path", F.concat(F.lit("n"), number.cast("string")).alias("id"), F.lpad(number.cast("string"), 12, F.lit("0")).alias("at"))
    label = text.mermaid_escape(paths.name(F.col("path")))
    nodes = _marked_nodes(files, scc).join(ids, ["repo", "path"])
    boxes = nodes.select("repo", F.array("at").alias("key"), F.concat(F.lit("  "), "id", F.lit('["'), label, F.lit('"]')).alias("line"))
    a, b = ids.withColumnsRenamed({"path": "src", "id": "a", "at": "x"}), ids.withColumnsRenamed({"path": "dst", "id": "b", "at": "y"})
    arrow = F.when(F.col("on_cycle"), " -.-> ").otherwise(" --> ")
    arrows = _marked_edges(edges, scc).join(a, ["repo", "src"]).join(b, ["repo", "dst"]).select("repo", F.array("x", "y").alias("key"), F.concat(F.lit("  "), "a", arrow, "b").alias("line"))
    styles = nodes.where("on_cycle").select("repo", F.array("at").alias("key"), F.concat(F.lit("  style "), "id", F.lit(" fill:#ff000022")).alias("line"))
    return _lines([_fixed(repos, ["graph LR"]), boxes, _fixed(repos, [""]), arrows, styles])


def table_rows(files: DataFrame, edges: DataFrame, scc: DataFrame, roots: DataFrame, orphans: DataFrame, tests: DataFrame, external: DataFrame) -> DataFrame:
    """(repo, path, lang, local_in, local_out, ext, cycle, status); status: cycle, orphan, test-entry, entry or a dash."""
    flag = lambda df, n: df.select("repo", "path", F.lit(True).alias(n))
    rows = _marked_nodes(files, scc).join(G.degrees(files, edges), ["repo", "path"], "left")
    rows = rows.join(flag(roots, "root"), ["repo", "path"], "left").join(flag(orphans, "orphan"), ["repo", "path"], "left").join(flag(tests, "test"), ["repo", "path"], "left")
    rows = rows.join(external.groupBy("repo", "path").agg(F.count("*").alias("ext")), ["repo", "path"], "left")
    status = F.when(F.col("on_cycle"), "cycle").when(F.col("orphan"), "orphan").when(F.col("test"), "test-entry").when(F.col("root"), "entry").otherwise(DASH)
    return rows.select("repo", "path", "lang", F.col("in_deg").alias("local_in"), F.col("out_deg").alias("local_out"), F.coalesce("ext", F.lit(0)).alias("ext"), F.when(F.col("on_cycle"), LOOP).otherwise(DASH).alias("cycle"), status.alias("status"))


def table(rows: DataFrame) -> DataFrame:
    """table_rows() as lines in columns."""
    shown = {n: s for n, s, _, _, _ in LANGUAGES}
    left = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, F.lit(" ")))
    right = lambda c, n: F.lpad(c.cast("string"), n, F.lit(" "))
    line = F.concat_ws(" ", left(F.col("path"), 50), left(_map(shown, F.col("lang"), "unknown"), 12), right(F.col("local_in"), 8), right(F.col("local_out"), 9), right(F.col("ext"), 5), right(F.col("cycle"), 7), F.col("status"))
    head = f"{'FILE':<50} {'LANG':<12} {'LOCAL-IN':>8} {'LOCAL-OUT':>9} {'EXT':>5} {'CYCLES':>7} STATUS"
    return _lines([_fixed(rows.select("repo").distinct(), [head, "-" * 105]), rows.select("repo", paths.sort_key(F.col("path")).alias("key"), line.alias("line"))])


def _tree_lines(edges: dict[str, list[str]], on_cycle: set[tuple[str, str]], roots: list[str], skip: set[str], cycles: list[list[str]], tests: list[str], orphans: list[str], external: dict[str, list[str]]) -> list[str]:
    """One repository's tree: each entry with its dependencies, each shown once below it."""
    if not roots and not cycles:
        return ["(no entry points found)"]
    out: list[str] = []
    if not roots:
        out += ["(no entry points: dependency cycles detected)", "", "Cycles:"]
        out += ["  " + " -> ".join([*c, c[0]]) for c in cycles]
    for root in roots:
        if root in skip:
            continue
        out.append(f"{root}  [entry]")
        shown = {root}
        work = [(root, "", 0)]
        while work:
            node, prefix, i = work.pop()
            children, packages = edges.get(node, []), external.get(node, [])
            total = len(children) + len(packages)
            if i >= total:
                continue
            work.append((node, prefix, i + 1))
            last = i == total - 1
            branch, below = ("└── ", "    ") if last else ("├── ", "│   ")
            if i >= len(children):
                out.append(f"{prefix}{branch}{packages[i - len(children)]} [ext]")
                continue
            child = children[i]
            if (node, child) in on_cycle:
                out.append(f"{prefix}{branch}{child} {LOOP} CYCLE")
            elif child in shown:
                out.append(f"{prefix}{branch}{child} (already shown)")
            else:
                out.append(f"{prefix}{branch}{child}")
                shown.add(child)
                work.append((child, prefix + below, 0))
    for title, names in (("Test entry points:", tests), ("Orphaned files:", orphans)):
        if names:
            out += ["", title, *(f"  {n}" for n in names)]
    return out


def tree(g: DependencyGraph, show_external: bool = False) -> DataFrame:
    """The tree is sequential by nature: one task per repository draws its own."""
    rows = g.edges.select("repo", F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"))
    add = lambda what, df, a, b=None: df.select("repo", F.lit(what).alias("what"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast("string")).alias("b"))
    rows = rows.unionByName(add("loop", recurse.cycle_edges(g.edges, g.scc), "src", "dst")).unionByName(add("cycle", g.scc.where("cyclic"), "scc_id", "path"))
    for what, df in (("file", g.files), ("root", g.roots), ("orphan", g.orphans), ("test", g.test_entries)):
        rows = rows.unionByName(add(what, df, "path"))
    if show_external:
        rows = rows.unionByName(add("ext", G.external_packages(g.imports), "path", "package"))

    def run(pdf):
        import pandas as pd

        key = lambda p: p.split("/")
        of = lambda what: pdf[pdf["what"] == what]
        pairs = lambda what: list(zip(of(what)["a"], of(what)["b"], strict=True))
        names = lambda what: sorted(set(of(what)["a"]), key=key)
        edges, external, cycles = {}, {}, {}
        for into, what in ((edges, "edge"), (external, "ext"), (cycles, "cycle")):
            for a, b in pairs(what):
                into.setdefault(a, []).append(b)
            for v in into.values():
                v.sort(key=key)
        lines = _tree_lines(edges, set(pairs("loop")), names("root"), {*names("orphan"), *names("test")}, [cycles[k] for k in sorted(cycles, key=key)], names("test"), names("orphan"), external)
        return pd.DataFrame({"repo": pdf["repo"].iloc[0], "ord": range(len(lines)), "line": lines})

    return rows.groupBy("repo").applyInPandas(run, "repo string, ord int, line string")


def json_documents(g: DependencyGraph, with_symbols: bool = False) -> DataFrame:
    """(repo, document): the whole graph of a repository as one JSON text."""
    by = ["repo", "path"]
    in_order = lambda *cols: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*cols).alias("v")))), lambda x: x["v"])
    imports = g.imports.groupBy(by).agg(in_order("raw", "kind", "resolved", "span").alias("imports"))
    if with_symbols:
        cols = ["name", "kind", F.col("span.start_line").alias("line"), F.col("span.end_line").alias("end_line"), "exported"]
    else:
        cols = ["name", "kind", "span", "exported"]
    symbols = g.symbols.groupBy(by).agg(in_order(*cols).alias("symbols"))
    calls = g.calls.groupBy(by).agg(in_order("callee_raw", "span").alias("calls"))
    files = g.files.select("repo", "path", "lang").join(imports, by, "left").join(symbols, by, "left").join(calls, by, "left")
    key = paths.sort_key(F.col("path"))
    files = files.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct("path", "lang", "imports", "symbols", "calls").alias("v")))), lambda x: x["v"]).alias("files"))
    listed = lambda df, name: df.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "path"))), lambda x: x["path"]).alias(name))
    edges = g.edges.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind"))).alias("edges"))
    cycles = recurse.cycles(g.scc).groupBy("repo").agg(F.array_sort(F.collect_list("members")).alias("cycles"))
    reasons = g.structural_entries.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("path", "reason"))).alias("structural_entries"))
    external = G.external_packages(g.imports).groupBy(by).agg(F.array_sort(F.collect_set("package")).alias("p"))
    external = external.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "p")))).alias("external_deps"))
    out = files
    for part in (edges, cycles, listed(g.roots, "roots"), listed(g.orphans, "orphans"), listed(g.test_entries, "test_entries"), reasons, external):
        out = out.join(part, "repo", "left")
    if g.skipped is not None:
        skipped = g.skipped.groupBy("repo").agg(F.collect_list(F.struct("group", "count", "sample")).alias("skipped_unsupported"))
        out = out.join(skipped, "repo", "left")
    lists = [c for c in out.columns if c not in ("repo", "external_deps", "skipped_unsupported")]
    out = out.withColumns({c: F.coalesce(F.col(c), F.array().cast(dict(out.dtypes)[c])) for c in lists})
    fields = [F.col("repo").alias("root"), *[F.col(c) for c in out.columns if c != "repo"]]
    return out.select("repo", F.to_json(F.struct(*fields)).alias("document"))


def write_lines(lines: DataFrame, output: str | None = None) -> str:
    """One repository's lines as text, to a file if one is named."""
    body = "".join(f"{r['line']}\n" for r in lines.orderBy("repo", "ord").select("line").collect())
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(body)
    return body


def dump(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)
