"""The graph engine: trees on disk, resolution tables, properties, renderers, commands and state."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from skein import cli
from skein.functions import detect, globs, text
from skein.operators import graph as G
from skein.operators import recurse, resolve, rules, store, symbols
from skein.operators import extract as X
from skein.operators.extract.languages import expand_use
from skein.plans import commands, projects, render
from skein.schema import SOURCES
from skein.sources import config as C
from skein.sources import scan
from skein.sources.ignore import Ignore
from skein.streaming import index

CYCLE = {"a.py": "import b\n", "b.py": "import c\n", "c.py": "import a\n", "__init__.py": "", "lonely.py": "import os\n", "test_x.py": "x = 1\n"}


def write(root, tree):
    for path, body in tree.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return str(root)


@pytest.fixture(scope="module")
def cyclic(spark, tmp_path_factory):
    root = write(tmp_path_factory.mktemp("cycle"), CYCLE)
    w = commands.Workspace(spark, scan.read_tree(spark, root, "r"))
    return w, w.graph()


def paths_of(df):
    return sorted(r["path"] for r in df.collect())


# --- globs, lines, slices


@pytest.mark.parametrize(
    ("glob", "crossing", "yes", "no"),
    [
        ("**/vendor/**", True, ["vendor/a", "x/vendor/y/z"], ["vendors/a", "vendor"]),
        ("*.py", True, ["a.py", "x/a.py"], ["a.pyc"]),
        ("*.py", False, ["a.py"], ["x/a.py"]),
        ("core/**", False, ["core/a", "core/a/b"], ["core", "xcore/a"]),
        ("src/{a,b}/[!x]?.ts", False, ["src/a/yz.ts", "src/b/12.ts"], ["src/c/yz.ts", "src/a/xz.ts", "src/a/y/.ts"]),
        ("a/**/b", False, ["a/b", "a/x/y/b"], ["ab", "a/xb"]),
    ],
)
def test_globs(glob, crossing, yes, no):
    import re

    p = re.compile(globs.glob_regex(glob, crossing))
    assert all(p.search(x) for x in yes) and not any(p.search(x) for x in no)


def test_bad_globs_are_named():
    assert globs.valid_globs(["a[", "b*"])[0] == [globs.glob_regex("b*", True)]
    with pytest.raises(ValueError, match="rule r"):
        rules.compile_rules([C.Rule("r", "a{", "b")])


def test_lines_and_windows(spark):
    df = spark.createDataFrame([("a\r\nb\n",), ("",), ("x",), ("\n\n",)], "t string")
    assert [r[0] for r in df.select(text.lines(F.col("t"))).collect()] == [["a", "b"], [], ["x"], ["", ""]]
    assert [r[0] for r in df.select(text.window(F.col("t"), F.lit(1), F.lit(1))).collect()] == ["a\r\n", "", "x", "\n"]


def test_slices(tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("".join(f"line {i}\n" for i in range(1, 31)))
    assert cli.slice_text(f"{p}:5-6", None, None, 10, 500, False, True) == "line 5\nline 6\n"
    assert cli.slice_text(str(p), 2, None, 1, 500, False, False) == "   1  line 1\n   2  line 2\n   3  line 3\n"
    got = json.loads(cli.slice_text(f"{p}:29", None, None, 10, 3, True, False))
    assert (got["start_line"], got["end_line"]) == (19, 21)
    assert symbols.slice_bounds(30, 99, None) == (30, 30)
    with pytest.raises(ValueError):
        symbols.slice_bounds(30, 0, None)
    assert cli.main(["slice", str(p)]) == 2


# --- sources


def test_scan_prunes_and_keeps_empty_files(spark, tmp_path):
    root = write(tmp_path, {"a.py": "", "b/c.ts": "x", ".hidden/x.py": "", "skip/d.py": "y", "gen/e.py": "z", "gen/keep.py": "k", ".gitignore": "gen/*\n!gen/keep.py\n# no\n", "n.zigzag": "s", "Makefile": "all:\n", "LICENSE-MIT": "t", "p.png": "b"})
    src = scan.read_tree(spark, root, "r", ["skip"])
    assert paths_of(src) == ["LICENSE-MIT", "Makefile", "a.py", "b/c.ts", "gen/keep.py", "n.zigzag", "p.png"]
    assert {r.path: bytes(r.content) for r in src.where("path in ('a.py', 'b/c.ts')").collect()} == {"a.py": b"", "b/c.ts": b"x"}
    assert paths_of(scan.supported(src)) == ["a.py", "b/c.ts", "gen/keep.py"]
    assert paths_of(scan.supported(src, ["python"], 0)) == ["a.py"]
    groups = {r.group: (r["count"], r.sample) for r in scan.skipped_groups(src).collect()}
    assert groups == {"zigzag": (1, ["n.zigzag"]), "(no extension)": (1, ["Makefile"])}
    for bad, langs in (("n.zigzag", None), ("a.py", ["rust"]), ("none.py", None)):
        with pytest.raises(ValueError):
            scan.single_file(src, bad, langs)
    with pytest.raises(scan.NoFiles):
        commands.Workspace(spark, src, langs=["rust"]).require_files(root)


def test_ignore_rules():
    i = Ignore("*.log\n/build\nsrc/**/tmp\ndocs/\n!keep.log\n", "", None)
    assert i.ignores("x/a.log", False) and not i.ignores("keep.log", False) and i.ignores("build", True) and not i.ignores("x/build", True)
    assert i.ignores("src/a/b/tmp", True) and i.ignores("docs", True) and not i.ignores("docs", False)
    assert Ignore("a", "sub", i).ignores("sub/a", False) and Ignore("!b.log", "sub", i).ignores("sub/b.log", False) is False


def test_config_layers(tmp_path):
    (tmp_path / C.FILE).write_text('languages = ["py"]\nmax_file_size_kb = 2\n[[rules]]\nname = "n"\nfrom = "a/**"\nto = "b/**"\nseverity = "warn"\n')
    c = C.load(str(tmp_path), {"SKEIN_MAX_FILE_SIZE_KB": "3", "SKEIN_FIRST_PARTY": "true"})
    assert (c.languages, c.max_bytes, c.first_party, c.rules[0].severity, c.vendored) == (["py"], 3072, True, "warn", C.DEFAULT_VENDOR_GLOBS)
    assert C.choose(None, "json", "tree") == "json" and C.choose("dot", "json", "tree") == "dot"
    with pytest.raises(FileExistsError):
        C.init(str(tmp_path), ["python"])
    assert "python" in open(C.init(str(tmp_path), ["python"], force=True)).read()


# --- resolution tables: language, import, from, kind, known files, expected


@pytest.mark.parametrize(
    ("lang", "raw", "path", "kind", "known", "want"),
    [
        ("python", ".", "p/a.py", "local", ["p/__init__.py"], "p/__init__.py"),
        ("python", "..m", "p/q/a.py", "local", ["p/m.py", "m.py"], "p/m.py"),
        ("python", "x.y", "p/a.py", "external", ["p/x/y.py", "x/y/__init__.py"], "x/y/__init__.py"),
        ("typescript", "./u.service", "a/m.ts", "local", ["a/u.service.ts", "a/u.ts"], "a/u.service.ts"),
        ("typescript", "./u.js", "a/m.ts", "local", ["a/u.ts"], "a/u.ts"),
        ("javascript", "./d", "m.js", "local", ["d/index.js"], "d/index.js"),
        ("javascript", "../../x", "a/m.js", "local", ["x.js"], None),
        ("java", "a.b.C", "M.java", "external", ["src/main/java/a/b/C.java"], "src/main/java/a/b/C.java"),
        ("c", "h.h", "src/m.c", "local", ["include/h.h", "h.h"], "h.h"),
        ("c", "h.h", "m.c", "system", ["h.h"], None),
        ("rust", "crate::a::Item", "src/main.rs", "local", ["src/a.rs", "src/main.rs"], "src/a.rs"),
        ("rust", "crate::Config", "src/x/y.rs", "local", ["src/lib.rs", "src/main.rs"], "src/lib.rs"),
        ("rust", "super::helper", "src/a/b.rs", "local", ["src/a/mod.rs"], "src/a/mod.rs"),
        ("rust", "foo", "src/bar.rs", "local", ["src/foo.rs", "src/bar/foo.rs"], "src/bar/foo.rs"),
        ("rust", "sub/x.rs", "src/main.rs", "local", ["src/sub/x.rs"], "src/sub/x.rs"),
        ("ruby", "../x", "a/b.rb", "local", ["x.rb"], "x.rb"),
        ("php", "./i.php", "a/m.php", "local", ["a/i.php", "i.php"], "a/i.php"),
        ("php", "A\\B", "m.php", "external", ["A/B.php"], None),
        ("lua", "a.b", "x/m.lua", "external", ["a/b/init.lua"], "a/b/init.lua"),
        ("lua", "b", "x/m.lua", "external", ["x/b.lua"], "x/b.lua"),
        ("bash", "../lib.sh", "a/m.sh", "local", ["lib.sh"], "lib.sh"),
        ("zig", "x/y.zig", "a/m.zig", "local", ["a/x/y.zig"], "a/x/y.zig"),
        ("swift", "Foundation", "m.swift", "external", ["Foundation.swift"], None),
    ],
)
def test_candidates(lang, raw, path, kind, known, want):
    assert next((c for c in resolve.candidates(lang, raw, path, kind) if c in known), None) == want


def test_aliases_and_modules():
    ctx = json.loads(resolve.context_of('{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["x/*", "y/*"], "@/a/*": ["z/*"], "one": ["o.ts"]}}}', "// c\nmodule  example.com/m // x\n", [""]))
    first = lambda raw: resolve.candidates("typescript", raw, "m.ts", "external", ctx)
    assert first("@/a/q")[0] == "src/z/q" and "src/y/b.ts" in first("@/b") and first("one")[0] == "src/o.ts" and first("react") == []
    assert resolve.candidates("go", "example.com/m/p", "m.go", "external", ctx) == ["go:p"] and resolve.candidates("go", "example.com/mx", "m.go", "external", ctx) == []
    assert resolve.context_of("{bad", None, []) == '{"manifests": []}'


def test_bare_rust_paths_need_a_declaration(spark):
    tree = {"src/main.rs": "mod cli;\nuse cli::Run;\nuse serde::Value;\n", "src/cli.rs": "use crate::cli::X;\n", "src/serde.rs": ""}
    src = projects.sources(spark, {"r": tree})
    w = commands.Workspace(spark, src)
    got = {(r.path, r.raw): (r.resolved, r.kind) for r in w.imports.collect()}
    assert got[("src/main.rs", "cli::Run")] == ("src/cli.rs", "local")
    assert got[("src/main.rs", "serde::Value")] == (None, "external")
    assert got[("src/cli.rs", "crate::cli::X")] == (None, "local")


# --- extraction


def facts(lang, body, path="x"):
    f = X.extract_file(lang, body.encode(), path)
    return [i[:2] for i in f.imports.values()], [s[:3] for s in f.symbols], [c[0] for c in f.calls]


def test_python_facts():
    imports, syms, calls = facts("python", "import a.b as c, d\nfrom . import x, y\nfrom ..m import z\nimportlib.import_module('q')\n@dec\ndef f(v: T) -> R:\n    def inner(): pass\n    a.b(g())\nclass _K(Base):\n    def m(self): pass\n")
    assert imports == [("a.b", "external"), ("d", "external"), (".x", "local"), (".y", "local"), ("..m", "local"), ("q", "external")]
    assert syms == [("f", "function", True), ("_K", "class", False), ("m", "method", True)]
    assert {"a.b", "g", "T", "R", "Base"} <= set(calls)
    span = X.extract_file("python", b"@dec\ndef f():\n    pass\n").symbols[0][3]
    assert span[:2] == (1, 0) and span[2] == 3
    assert facts("python", "def ok():\n    pass\nclass (:\nimport z\n")[0] == [("z", "external")]


@pytest.mark.parametrize(
    ("lang", "body", "calls"),
    [
        ("typescript", "import fs = require('fs');\nabstract class A {\n  abstract go(): void;\n  run(): void { this.go(); f(1) }\n  x = make();\n  y =\n    late();\n}\ninterface I { m(a: number): string; n(): void }\nconst w = new Worker();\n", ["this.go", "f", "make", "late", "Worker"]),
        ("javascript", "class K {\n  #p() { return q() }\n  static async r() {}\n  get s() { return this.#p() }\n}\n", ["q", "this.#p"]),
        ("java", "record P(int x, int y) { int s() { return add(x); } }\n", ["add"]),
        ("csharp", "record P(int X);\nrecord struct Q(int Y);\nclass C { void M() { Run(); } }\n", ["Run"]),
        ("c", "#define X(a) foo(a)\n#define Y(a) \\\n  bar(a)\nint proto(int);\nstatic int (*fp)(int);\nint x = init();\nint main(void) { int y = g(1); if (y) return h(y); else k(); return X(y); }\n", ["init", "g", "h", "k", "X"]),
        ("cpp", "int proto(int);\nclass A {\npublic:\n  A();\n  explicit A(int);\n  void f();\n  int z = start();\n  void g() { f(); B b(1); ns::run(); return h(); }\n};\nauto p = new A();\n", ["start", "f", "run", "h", "A"]),
        ("go", "package a\ntype (\n\tT int\n)\ntype I interface {\n\tM()\n\tN(x int) int\n}\nfunc f() { g(); t.M() }\n", ["g", "t.M"]),
        ("swift", "import class UIKit.UIView\nfunc top() { go() }\nclass K {\n  init(x: Int) { super.init(); run() }\n}\nenum E {\n  case a(Int)\n}\n", ["go", "super.init", "run"]),
        ("rust", '#[path = "x.rs"]\nmod y;\nuse a::{B, c};\nenum E { V(u8), W(Inner) }\nfn f() { g(); E::V(1); }\n', ["Inner", "g", "E::V"]),
        ("bash", "if check; then run x; fi\nf() ( sub; )\nwhile read l; do eat; done\n", ["check", "run", "sub", "read", "eat"]),
        ("python", "import importlib\nx = importlib.import_module('zz')\nfrom a import (b)\nf(1)\nclass (:\n", ["importlib.import_module", "f"]),
    ],
)
def test_calls_are_calls_only(lang, body, calls):
    assert facts(lang, body)[2] == calls


def test_definitions_around_short_forms():
    assert facts("swift", "import class UIKit.UIView\nfunc top() { go() }\n")[:2] == ([("UIKit.UIView", "external")], [("top", "function", True)])
    assert facts("python", "x = importlib.import_module('zz')\nclass (:\n")[0] == [("zz", "external")]
    spans = {n: sp for n, _, _, sp in X.extract_file("ruby", b"class K\n  def y = z\n  def w=(v)\n    v\n  end\nend\n").symbols}
    assert spans["K"][2] == 6 and spans["y"][2] == 2 and spans["w="][2] == 5
    assert X.extract_file("bash", b"f() (\n  sub\n)\necho x\n").symbols[0][3][2] == 3


def test_javascript_facts():
    imports, syms, calls = facts("typescript", "import a, { b } from './a';\nimport './side';\nexport * from './re';\nconst d = await import('./dyn');\n// import no from 'no'\nexport abstract class K extends Base { private run(x: Item): void { this.go(x); } }\nexport const f = async (x: number) => x + 1;\nconst g = function () {};\ninterface I {}\nconst s = \"import q from 'q'\"; const re = /'import'/g;\n")
    assert imports == [("./a", "local"), ("./side", "local"), ("./re", "local"), ("./dyn", "local")]
    assert ("K", "class", True) in syms and ("run", "method", False) in syms and ("f", "function", True) in syms and ("g", "function", False) in syms
    assert {"Base", "this.go", "Item"} <= set(calls)


def test_rust_facts():
    assert expand_use("a::{b, c::{d, self}, e as f}") == ["a::b", "a::c::d", "a::c", "a::e"]
    imports, syms, calls = facts("rust", 'mod x;\n#[path = "p/q.rs"]\nmod y;\nmod inner { use super::z; mod deep; }\nextern crate ext;\npub(crate) struct S;\nenum E { A, B(u8) }\nimpl S { pub fn m(&self) { helper!(1); a::b(); self.c(); } }\ntrait T { fn req(); }\n#[macro_export]\nmacro_rules! mac { () => {} }\n')
    assert [r for r, _ in imports] == ["x", "p/q.rs", "z", "self::inner::deep", "ext"] or ("x", "local") in imports
    assert {("S", "class", True), ("E", "class", False), ("A", "class", False), ("B", "class", False), ("m", "method", True), ("req", "method", False), ("mac", "function", True)} <= set(syms)
    assert {"helper", "a::b", "self.c"} <= set(calls)


@pytest.mark.parametrize(
    ("lang", "body", "imports", "names", "calls"),
    [
        ("java", "import a.b.C;\npublic class K { private int f(int x) { return new D().g(x); } public K() {} }\n", ["a.b.C"], {"K", "f"}, {"g", "D"}),
        ("c", '#include "a.h"\n#include <b.h>\ntypedef struct { int x; } T;\nstatic int *f(void) { return p->m(1); }\n', ["a.h", "b.h"], {"T", "f"}, {"p->m"}),
        ("cpp", '#include "a.h"\nclass K { void in() {} };\nvoid K::out() { ns::f(1); make<int>(2); }\n', ["a.h"], {"K", "in", "out"}, {"f", "make"}),
        ("csharp", "using A.B;\nusing X = C.D;\nnamespace N { public record R(int a); class K { public void M() { Do<int>(1); new T(); } } }\n", ["A.B", "C.D"], {"R", "K", "M"}, {"Do", "T"}),
        ("go", 'package a\nimport "fmt"\ntype S struct{ x int }\nfunc (s *S) M() { fmt.Println(s.x) }\nfunc f() {}\n', ["fmt"], {"S", "M", "f"}, {"fmt.Println"}),
        ("swift", "import UIKit\nclass K { private func f() { g(); o.m() } }\nprotocol P {}\n", ["UIKit"], {"K", "f", "P"}, {"g", "o.m"}),
        ("ruby", "require 'json'\nrequire_relative 'x'\nclass A::B\n  def self.c\n    D.run(1)\n  end\n  def e\n  end\nend\n", ["json", "x"], {"B", "c", "e"}, {"D.run", "D"}),
        ("php", "<?php\nnamespace N;\nuse A\\{B, C};\nuse D\\E as F;\nclass K { public function m() { $this->n(); S::t(); new U(); } }\n", ["A\\B", "A\\C", "D\\E"], {"K", "m"}, {"n", "S::t", "U"}),
        ("scala", "import a.{B, C => D}\nimport x.y\nclass K { private def f = g(1) }\n", ["a.B", "a.C", "x.y"], {"K", "f"}, {"g"}),
        ("lua", "local a = require('x.y')\nlocal function f() a.b() end\nfunction M:g() o:h() end\n", ["x.y"], {"f", "g"}, {"a.b", "o:h"}),
        ("elixir", "defmodule A.B do\n  alias C.{D, E}\n  defp f(x), do: G.h(x)\nend\n", ["C.D", "C.E"], {"A.B", "f"}, {"G.h"}),
        ("haskell", "module M (f) where\nimport qualified Data.Map as Map\ndata T = A | B\nf x = (g x)\nh = 1\n", ["Data.Map"], {"T", "f", "h"}, {"g"}),
        ("bash", "source ./a.sh\n. \"/etc/b\"\nf() {\n  ls -l | grep x\n}\n", ["./a.sh", "/etc/b"], {"f"}, {"ls", "grep"}),
        ("zig", 'const s = @import("std");\npub fn f() void { a.b(); }\nconst T = struct { x: u8 };\n', ["std"], {"s", "f", "T"}, {"a.b"}),
        ("objectivec", '#import "A.h"\n@import B.C;\n@implementation K\n- (void)run:(int)x with:(int)y { [self go:x]; f(1); }\n@end\n', ["A.h", "B.C"], {"K", "run"}, {"go", "f"}),
    ],
)
def test_other_languages(lang, body, imports, names, calls):
    i, s, c = facts(lang, body)
    assert [r for r, _ in i] == imports
    assert {n for n, _, _ in s} == names
    assert calls <= set(c)


def test_small_projects(spark):
    _, f, imports, edges = projects.analysed(spark)
    assert sorted((r.repo, r.src, r.dst) for r in edges.collect()) == sorted(projects.EDGES)
    assert sorted((r.repo, r.raw, r.kind) for r in imports.collect()) == sorted(projects.IMPORTS)


# --- the graph


def test_cycle_graph(cyclic):
    w, g = cyclic
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [("a.py", "b.py"), ("b.py", "c.py"), ("c.py", "a.py")]
    assert [r.members for r in recurse.cycles(g.scc).collect()] == [["a.py", "b.py", "c.py"]]
    assert paths_of(g.orphans) == ["__init__.py", "lonely.py"] and paths_of(g.test_entries) == ["test_x.py"]
    assert commands.check(w, g).exit_code() == 1 and commands.check(w, g).exit_code(exit_zero=True) == 0


def test_baseline_round_trip(cyclic, tmp_path):
    w, g = cyclic
    p = str(tmp_path / "base.json")
    rules.write_baseline(p, recurse.cycles(g.scc), rules.violations(g.edges, []))
    r = commands.check(w, g, baseline=p)
    assert r.ok() and r.suppressed == 1 and r.cycles.isEmpty()


def test_renderers(cyclic):
    w, g = cyclic
    tree = render.write_lines(render.tree(g))
    assert "⟳ CYCLE" not in tree.splitlines()[0] and "Orphaned files:" in tree
    dot = render.write_lines(render.dot(g.files, g.edges, g.scc))
    assert dot.startswith("digraph") and '"a.py" -> "b.py" [color="#ff0000" style=dashed];' in dot
    mermaid = render.write_lines(render.mermaid(g.files, g.edges, g.scc))
    assert mermaid.startswith("graph LR") and "-.->" in mermaid and "style n" in mermaid
    table = render.write_lines(render.table(render.table_rows(g.files, g.edges, g.scc, g.roots, g.orphans, g.test_entries, G.external_packages(g.imports))))
    assert [x.split()[-1] for x in table.splitlines()[2:]] == ["orphan", "cycle", "cycle", "cycle", "orphan", "test-entry"]
    doc = json.loads(render.json_documents(g).first()["document"])
    assert doc["cycles"] == [["a.py", "b.py", "c.py"]] and doc["external_deps"] == {"lonely.py": ["os"]} and len(doc["files"]) == 6


def test_random_graphs_against_plain_recursion(spark):
    rng = random.Random(7)
    pairs = sorted({(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(60)})
    edges = spark.createDataFrame([("r", a, b, "local") for a, b in pairs], "repo string, src string, dst string, kind string")
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def depths(start):
        seen, level = {start: 0}, [start]
        while level:
            level = [b for a in level for b in sorted(after.get(a, ())) if b not in seen and not seen.update({b: seen[a] + 1})]
        return seen

    start = pairs[0][0]
    want = depths(start)
    got = {r.path: r.depth for r in recurse.reach_with_depth(edges, recurse.one_source(edges, start)).collect()}
    assert got == {n: d for n, d in want.items() if d}
    reach = {n: set(depths(n)) for n in {x for p in pairs for x in p}}
    scc = {n: min(m for m in reach if m in reach[n] and n in reach[m]) for n in reach}
    for form in (recurse.scc_by_repo, recurse.scc_distributed):
        assert {r.path: r.scc_id for r in form(edges).collect()} == scc
    far = max(want, key=lambda n: want[n])
    route = recurse.shortest_path(edges, start, far).first()["route"]
    assert len(route) == want[far] + 1 and all((a, b) in pairs for a, b in zip(route, route[1:], strict=False))
    assert recurse.shortest_path(edges, start, start).first()["route"] == [start]


def test_bounded_closure_counts_nodes_not_routes(spark):
    names = [f"{layer}{i}" for layer in "abc" for i in range(101)]
    pairs = [(n, "end") for n in names[:101]] + [(x, y) for k in (0, 101) for x in names[k + 101 : k + 202] for y in names[k : k + 101]]
    pairs += [("a0", "c0"), ("end", "a1")]  # cycles
    pairs += [(f"t{i + 1}", f"t{i}") for i in range(9)] + [("t0", "c0")]
    edges = spark.createDataFrame([("r", a, b, "local") for a, b in pairs], "repo string, src string, dst string, kind string")
    found = lambda depth: {r.path: r.depth for r in recurse.bounded_closure_sql(spark, edges, "end", depth).collect()}
    want = {n: 1 + i // 101 for i, n in enumerate(names)}  # more than a million routes of three edges
    assert found(3) == want
    assert found(2) == {n: d for n, d in want.items() if d < 3} and found(0) == {}
    assert found(12) == want | {f"t{i}": i + 4 for i in range(9)}


def test_structural_entries(spark):
    tree = {
        "index.html": '<script src="/src/boot.ts?x"></script>', "package.json": '{"scripts": {"b": "node scripts/build.ts"}}', "src/boot.ts": "", "scripts/build.ts": "", "lonely.ts": "",
        "vite.config.ts": "", "src/w.stories.tsx": "", "src/setupTests.ts": "", "app/routes/x.ts": "", "global.d.ts": "", "w.ts": "", "w.d.ts": "", "amb.d.ts": "declare module 'x'",
        "crates/a/Cargo.toml": "", "crates/a/build.rs": "", "crates/a/tests/t.rs": "", "crates/a/src/bin/x.rs": "", "crates/a/src/stray.rs": "",
    }
    g = commands.Workspace(spark, projects.sources(spark, {"r": tree})).graph()
    assert paths_of(g.orphans) == ["crates/a/src/stray.rs", "lonely.ts"]
    assert {(r.path, r.reason) for r in g.structural_entries.collect()} == {("crates/a/build.rs", "cargo build script"), ("crates/a/tests/t.rs", "cargo test target"), ("crates/a/src/bin/x.rs", "cargo binary target")}
    assert [(r.src, r.dst) for r in g.edges.collect()] == [("w.ts", "w.d.ts")]


def test_symbol_queries(spark):
    tree = {"app.py": "from lib import used, twice\n\ndef main():\n    used()\n    lib.twice()\n", "lib.py": "def used():\n    pass\n\ndef own():\n    return own2()\n\ndef own2():\n    pass\n\ndef twice():\n    pass\n\ndef unused():\n    pass\n", "other.py": "def twice():\n    pass\n"}
    w = commands.Workspace(spark, projects.sources(spark, {"r": tree}))
    g = w.graph()
    verdict = lambda n, scope=None: symbols.dead(w.facts.symbols, w.facts.calls, g.edges, n, scope).first()
    assert [(verdict(n).status, verdict(n).dead) for n in ("used", "own2", "unused", "twice", "nope")] == [("live_cross_file_references", False), ("self_only_references", True), ("no_references", True), ("ambiguous", None), ("not_found", None)]
    assert verdict("twice", "lib.py").dead is False
    defs, refs = symbols.references(w.facts.symbols, w.facts.calls, w.lines(), g.edges, "used")
    assert [(r.path, r.line, r.context) for r in refs.collect()] == [("app.py", 4, "used()")] and defs.count() == 1
    assert symbols.references(w.facts.symbols, w.facts.calls, w.lines(), g.edges, "twice")[1].isEmpty()
    assert [tuple(r)[1:] for r in symbols.impact(w.facts.symbols, w.facts.calls, g.edges, "used").collect()] == [("app.py", 1, True)]
    top = symbols.hotspots(w.facts.symbols).first()
    assert (top.path, top.functions, top.avg_length, top.score) == ("lib.py", 5, 2, 10)
    shown = symbols.show(w.facts.symbols, w.sources, "twice").orderBy("nr").collect()
    assert [(r.path, r.body) for r in shown] == [("lib.py", "def twice():\n    pass\n"), ("other.py", None)]
    assert {r.signature for r in symbols.skeleton(w.facts.symbols, w.lines(), True).where("path = 'other.py'").collect()} == {"def twice(): ..."}
    assert [r[0] for r in symbols.suggestions(w.facts.symbols, "USE").collect()] == ["unused", "used"]


def test_rules_and_first_party(spark):
    edges = spark.createDataFrame([("r", "core/a.py", "app/b.py", "local"), ("r", "app/b.py", "vendor/x.py", "local"), ("r", "core/x/y.py", "app/z/q.py", "external")], "repo string, src string, dst string, kind string")
    own = [C.Rule("one", "core/*", "app/*"), C.Rule("none", "nope/**", "app/**", "warn")]
    assert [(r.rule, r.src) for r in rules.violations(edges, own).collect()] == [("one", "core/a.py")]
    assert [(r.rule, r.from_matches, r.to_matches) for r in rules.dead_rules(edges, own).collect()] == [("none", 0, 1)]
    kept, left = rules.first_party(edges.select("repo", F.col("dst").alias("path")), C.DEFAULT_VENDOR_GLOBS)
    assert kept.count() == 2 and left.first()["excluded"] == 1


def test_fact_store(spark, tmp_path):
    tree = {"a.py": "import b\n", "b.py": "", "c.py": "def f(): pass\n"}
    files = scan.supported(projects.sources(spark, {"r": tree}))
    first = store.update(spark, files, None, str(tmp_path / "1"))
    assert first.where("fact = 'import'").count() == 1
    changed = scan.supported(projects.sources(spark, {"r": {"a.py": "import c, b\n", "b.py": ""}}))
    hits, misses = store.split_hits(changed, first)
    assert paths_of(misses) == ["a.py"] and {r.path for r in hits.collect()} == {"b.py"}
    assert store.update(spark, changed, str(tmp_path / "1"), str(tmp_path / "2")).where("fact = 'import'").count() == 2


def test_streaming_index(spark, tmp_path):
    drops = str(tmp_path / "drops")
    for body in ("import b\n", "import b, c\n"):
        rows = projects.sources(spark, {"r": {"a.py": body}}).withColumn("mtime_ns", F.lit(len(body)).cast("long"))
        rows.coalesce(1).write.mode("append").parquet(drops)
        index.start(spark, drops, str(tmp_path / "store"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert {r.text for r in index.current_facts(spark, str(tmp_path / "store")).where("fact = 'import'").collect()} == {"b", "c"}


def test_detection(spark):
    rows = spark.createDataFrame([("a.h", bytearray(b"@interface X")), ("b.h", bytearray(b"class X;")), ("c.h", bytearray(b"int subclass;")), ("run", bytearray(b"#!/usr/bin/env python3.12\n")), ("x.PY", bytearray(b""))], "path string, content binary")
    got = {r[0]: r[1] for r in rows.select("path", detect.language(F.col("path"), F.col("content"))).collect()}
    assert got == {"a.h": "objectivec", "b.h": "cpp", "c.h": "c", "run": "python", "x.PY": None}


def test_entry_and_registered_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists("bench.py")


def test_repository_keys_stay_text(spark, tmp_path):
    rows = [("007", "a.py", 8, 1, bytearray(b"import b\n")), ("7", "b.py", 6, 1, bytearray(b"x = 1\n"))]
    files = scan.supported(spark.createDataFrame(rows, SOURCES))
    first = store.update(spark, files, None, str(tmp_path / "one"))
    again = store.update(spark, files, str(tmp_path / "one"), str(tmp_path / "two"))
    assert {r.repo for r in first.collect()} == {r.repo for r in again.collect()} == {"007", "7"}
