"""The command line: `python -m skein.cli COMMAND [PATH]`."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import paths
from .functions.text import parse_slice_spec
from .operators import graph as G
from .operators import recurse, rules, symbols
from .plans import commands, render
from .schema import resolve_languages
from .session import session
from .sources import config as C
from .sources import scan

GUIDE = """skein answers questions about source trees as tables of files, imports, definitions, calls and edges.
Start with `orient`, then `query --heaviest`, `refs NAME`, `impact NAME`, `check`. --format json gives stable fields.
Exit codes: 0 fine, 1 findings (check) or nothing found (show), 2 the request can't be carried out.
"""


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _paths(df: DataFrame) -> list[str]:
    return [r["path"] for r in df.orderBy(paths.sort_key(F.col("path"))).select("path").collect()]


def _target(w: commands.Workspace, root: str, path: str, selector: str) -> str:
    """A scanned file's path from the root; anything else ends with exit code 2."""
    own = os.path.relpath(os.path.realpath(path), root) if os.path.isabs(path) else os.path.normpath(path)
    own = own.replace(os.sep, "/")
    if w.files.where(F.col("path") == own).isEmpty():
        print(json.dumps({"found": False, "selector": selector, "target": path, "root": root, "error": "not a scanned file"}), file=sys.stdout)
        raise SystemExit(2)
    return own


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    sub = p.add_subparsers(dest="command")

    def add(command: str, **positional) -> argparse.ArgumentParser:
        s = sub.add_parser(command)
        for k, v in positional.items():
            s.add_argument(k, **v)
        s.add_argument("--path", default=".")
        s.add_argument("--format")
        s.add_argument("--lang", action="append")
        s.add_argument("--exclude", action="append", default=[])
        s.add_argument("--first-party", action="store_true")
        return s

    g = add("graph")
    g.add_argument("--no-external", action="store_true")
    g.add_argument("--show-external", action="store_true")
    g.add_argument("--symbols", action="store_true")
    g.add_argument("--output")
    c = add("check")
    for flag in ("--exit-zero", "--syntax", "--update-baseline"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--baseline")
    q = add("query")
    one = q.add_mutually_exclusive_group(required=True)
    one.add_argument("--who-imports")
    one.add_argument("--deps-of")
    one.add_argument("--path-between", nargs=2)
    for flag in ("--cycles", "--orphans", "--heaviest", "--largest-cycle"):
        one.add_argument(flag, action="store_true")
    q.add_argument("--top", type=int, default=20)
    add("symbols")
    for command in ("refs", "dead", "impact", "show"):
        s = add(command, name={})
        s.add_argument("--defined-in")
        s.add_argument("--depth", type=int)
        s.add_argument("--kind")
        s.add_argument("--all", action="store_true")
    add("skeleton")
    add("orient")
    add("hotspots").add_argument("--top", type=int, default=20)
    sl = add("slice", target={})
    sl.add_argument("start", type=int, nargs="?")
    sl.add_argument("end", type=int, nargs="?")
    sl.add_argument("--context", type=int, default=10)
    sl.add_argument("--max", type=int, default=500)
    sl.add_argument("--no-linenos", action="store_true")
    add("init").add_argument("--force", action="store_true")
    add("agent-info")
    return p


def slice_text(target: str, start: int | None, end: int | None, context: int, most: int, as_json: bool, plain: bool) -> str:
    """A window of any text file; it needs no scan and no session."""
    path = target
    if start is None:
        path, start, end = parse_slice_spec(target)
        if start is None:
            raise ValueError("expected FILE:START[-END] or FILE START [END]")
    with open(path, encoding="utf-8") as f:
        body = f.read()
    kept = body.splitlines(keepends=True) if "\x0b" not in body else [x + "\n" for x in body.split("\n")]
    a, b = symbols.slice_bounds(len(kept), start, end, context, most)
    lines = kept[a - 1 : b]
    if as_json:
        return render.dump({"path": path, "start_line": a, "end_line": b, "lines": [x.rstrip("\r\n") for x in lines]}) + "\n"
    if plain:
        return "".join(lines)
    width = max(4, len(str(b)))
    return "".join(f"{n:>{width}}  {x.rstrip(chr(10)).rstrip(chr(13))}\n" for n, x in enumerate(lines, a))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv if argv else ["graph"])
    if a.command == "agent-info":
        print(GUIDE, end="")
        return 0
    if a.command == "slice":
        try:
            print(slice_text(a.target, a.start, a.end, a.context, a.max, a.format == "json", a.no_linenos), end="")
        except (OSError, ValueError) as e:
            print(f"error: {e}", file=sys.stderr)
            return 2
        return 0
    root = os.path.realpath(a.path)
    only = None
    if os.path.isfile(root):
        root, only = os.path.split(root)
    try:
        config = C.load(root)
        langs = resolve_languages(C.choose(a.lang, config.languages, None))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    config.exclude = [*config.exclude, *a.exclude]
    spark = session("local[*]")
    spark.sparkContext.setLogLevel("ERROR")
    sources = scan.read_tree(spark, root, root, [] if only else config.exclude)
    if a.command == "init":
        found = {r["lang"] for r in scan.supported(sources).select("lang").distinct().collect()}
        try:
            print(C.init(root, sorted(found), a.force))
        except FileExistsError as e:
            print(f"error: {e}", file=sys.stderr)
            return 2
        return 0
    if only:
        try:
            scan.single_file(sources, only, langs, config.max_bytes)
        except ValueError as e:
            print(f"error: {e}", file=sys.stderr)
            return 2
        sources = sources.where(F.col("path") == only)
    w = commands.Workspace(spark, sources, config, langs)
    try:
        w.require_files(root)
        return _run(a, w, root)
    except scan.NoFiles as e:
        print(json.dumps(e.payload))
        return 2


def _run(a, w: commands.Workspace, root: str) -> int:
    fmt = C.choose(a.format, w.config.format, {"graph": "tree", "check": "text"}.get(a.command, "table"))
    known = {"graph": ("tree", "json", "table", "dot", "mermaid"), "check": ("text", "json")}.get(a.command, ("table", "text", "json"))
    if fmt not in known:
        print(f"error: unknown format {fmt}", file=sys.stderr)
        return 2
    js = fmt == "json"
    first_party = a.first_party or w.config.first_party

    def out(value, lines=None) -> None:
        print(render.dump(value) if js else "\n".join(lines if lines is not None else map(str, value)))

    if a.command == "symbols":
        rows = _rows(symbols.flat(w.facts.symbols).orderBy(paths.sort_key(F.col("path")), "ord"))
        out(rows, [f"{r['path']}:{r['line']}  {r['kind']}  {r['name']}" for r in rows])
        return 0
    if a.command == "hotspots":
        out(_rows(symbols.hotspots(w.facts.symbols, a.top).drop("repo").withColumnRenamed("path", "file")))
        return 0
    if a.command == "skeleton":
        rows = _rows(symbols.skeleton(w.facts.symbols, w.lines(), not js).orderBy(paths.sort_key(F.col("path")), "ord").drop("repo", "ord"))
        out(rows, [f"{r['path']}: {r['signature']}" for r in rows])
        return 0
    if a.command == "show":
        rows = _rows(symbols.show(w.facts.symbols, w.sources, a.name, a.kind, a.defined_in, a.all).orderBy("nr").drop("repo"))
        if not rows:
            near = [r[0] for r in symbols.suggestions(w.facts.symbols, a.name).collect()]
            print(f"{a.name}: not found" + (f"; similar: {', '.join(near)}" if near else ""), file=sys.stderr)
            return 1
        out(rows, [r["body"] if r["body"] is not None else f"also: {r['path']}:{r['line']}" for r in rows])
        return 0
    g = w.graph()
    passed_over = scan.skipped_summary(_rows(g.skipped.drop("repo").orderBy(F.desc("count"), "group")))
    if passed_over:
        print(passed_over, file=sys.stderr)
    if a.command == "graph":
        if js:
            print(render.json_documents(g, a.symbols).first()["document"])
            return 0
        if fmt == "tree":
            lines = render.tree(g, a.show_external and not a.no_external)
        elif fmt == "table":
            external = G.external_packages(g.imports)
            lines = render.table(render.table_rows(g.files, g.edges, g.scc, g.roots, g.orphans, g.test_entries, external.where("false") if a.no_external else external))
        else:
            lines = (render.dot if fmt == "dot" else render.mermaid)(g.files, g.edges, g.scc)
        body = render.write_lines(lines, a.output)
        if not a.output:
            print(body, end="")
        return 0
    if a.command == "check":
        if a.update_baseline:
            rules.write_baseline(a.baseline or os.path.join(root, ".skein-baseline.json"), recurse.cycles(g.scc), rules.violations(g.edges, w.config.rules))
            return 0
        try:
            r = commands.check(w, g, a.baseline, a.syntax, first_party)
        except ValueError as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
        broken = [{"rule": x.rule, "from": x.src, "to": x.dst, "severity": x.severity} for x in r.violations.orderBy("rule", "src", "dst").collect()]
        value = {"ok": r.ok(), "cycles": [x["members"] for x in r.cycles.orderBy("scc_id").collect()], "orphans": _paths(r.orphans), "rule_violations": broken, "suppressed": r.suppressed}
        dead = _rows(r.dead_rules.orderBy("rule"))
        value["dead_rules"] = dead
        for x in dead:
            ends = " and ".join(f"{side!r}" for side, n in ((x["from_pattern"], x["from_matches"]), (x["to_pattern"], x["to_matches"])) if not n)
            print(f"warning: rule {x['rule']}: {ends} matches no file of an edge", file=sys.stderr)
        if r.syntax_errors is not None:
            value["syntax_errors"] = [{"file": x.path, "message": x.message, "line": x.span.start_line, "column": x.span.start_col} for x in r.syntax_errors.orderBy("path", "span").collect()]
        out(value, [f"cycle: {' -> '.join([*c, c[0]])}" for c in value["cycles"]] + [f"{x['severity']}: {x['rule']}: {x['from']} -> {x['to']}" for x in broken] + [f"orphan: {p}" for p in value["orphans"]] + ["ok" if value["ok"] else "failed"])
        return r.exit_code(a.exit_zero)
    if a.command == "query":
        return _query(a, w, g, root, out, first_party)
    if a.command == "orient":
        row = commands.orient(g.files, g.edges, g.scc, g.roots, g.orphans, G.external_packages(g.imports)).drop("repo").first().asDict(recursive=True)
        row["skipped_unsupported"] = _rows(g.skipped.drop("repo").orderBy(F.desc("count"), "group"))
        out(row, [f"{k}: {v}" for k, v in row.items()])
        return 0
    scope = _target(w, root, a.defined_in, "defined-in") if a.defined_in else None
    if a.command == "refs":
        defs, refs = symbols.references(w.facts.symbols, w.facts.calls, w.lines(), g.edges, a.name, scope)
        defs, refs = _rows(defs.drop("repo")), _rows(refs.drop("repo").orderBy("path", "line"))
        out({"symbol": a.name, "defined_in": scope, "ambiguous": len(defs) > 1 and scope is None, "definitions": defs, "references": refs}, [f"{r['path']}:{r['line']}  {r['context']}" for r in refs])
        return 0
    if a.command == "dead":
        row = symbols.dead(w.facts.symbols, w.facts.calls, g.edges, a.name, scope).first().asDict()
        out({"symbol": a.name, "found": row["definitions"] > 0, **{k: row[k] for k in ("dead", "status", "self_refs", "cross_refs")}}, [f"{a.name}: {row['status']}"])
        return 0
    if symbols.definitions(w.facts.symbols, a.name).isEmpty():
        out({"symbol": a.name, "found": False, "error": "no such symbol"}, [f"{a.name}: not found"])
        return 0
    hit = _rows(symbols.impact(w.facts.symbols, w.facts.calls, g.edges, a.name, a.depth).orderBy("depth", "path").drop("repo"))
    out({"symbol": a.name, "found": True, "impact": hit}, [f"{r['depth']}  {r['path']}{'  calls it' if r['calls_symbol'] else ''}" for r in hit])
    return 0


def _query(a, w, g, root, out, first_party) -> int:
    if a.who_imports:
        out(_paths(G.who_imports(g.edges, _target(w, root, a.who_imports, "who-imports"))))
    elif a.deps_of:
        out(_paths(recurse.transitive_deps(g.edges, _target(w, root, a.deps_of, "deps-of"))))
    elif a.path_between:
        x, y = (_target(w, root, p, "path-between") for p in a.path_between)
        row = [x] if x == y else next((r["route"] for r in recurse.shortest_path(g.edges, x, y).collect()), None)
        out(row, row or ["no path"])
    elif a.cycles:
        out([r["members"] for r in recurse.cycles(g.scc).orderBy("scc_id").collect()])
    elif a.largest_cycle:
        row = next((r["members"] for r in recurse.largest_cycle(g.scc).collect()), None)
        out(row, row or ["no cycles"])
    elif a.orphans:
        rows = g.orphans
        if first_party:
            kept, left = rules.first_party(rows, w.config.vendored)
            out({"orphans": _paths(kept), "excluded_orphans": sum(r["excluded"] for r in left.collect())}, _paths(kept))
        else:
            out(_paths(rows))
    else:
        nodes, left = rules.first_party(g.files, w.config.vendored) if first_party else (g.files, None)
        heavy = G.heaviest(g.files, g.edges).join(nodes.select("repo", "path"), ["repo", "path"], "left_semi")
        rows = _rows(heavy.orderBy(F.desc("dependents"), paths.sort_key(F.col("path"))).limit(a.top).select("path", "dependents"))
        value = rows if left is None else {"heaviest": rows, "excluded_files": sum(r["excluded"] for r in left.collect())}
        out(value, [f"{r['dependents']:>5}  {r['path']}" for r in rows])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
