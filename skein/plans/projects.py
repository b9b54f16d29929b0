"""Small source trees in every language, as tables: what the extraction and resolution queries run on.

The expected rows of the literal queries are written out by hand, those of CALLS read off the extractor and checked
against the sources by eye; they are no independent oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import graph as G
from ..operators import resolve
from ..schema import SOURCES
from ..sources import scan

#: repo: {path: content}. Two files each; the first imports the second where its language can name a file.
PROJECTS: dict[str, dict[str, str]] = {
    "python": {"main.py": "from helper import greet\nimport os\n\n\ndef run():\n    return greet('x')\n", "helper.py": "class Base:\n    def go(self):\n        pass\n\n\ndef greet(name: str):\n    return name\n"},
    "typescript": {"main.ts": "import { greet } from './helper';\nexport const run = () => greet('x');\n", "helper.ts": "export function greet(name: string) { return name; }\n"},
    "javascript": {"main.js": "const { greet } = require('./helper');\ngreet(1);\n", "helper.js": "function greet(x) { return x; }\nmodule.exports = { greet };\n"},
    "java": {"app/Main.java": "package app;\nimport app.Helper;\npublic class Main { void run() { Helper.greet(); } }\n", "app/Helper.java": "package app;\npublic class Helper { public static void greet() {} }\n"},
    "c": {"main.c": '#include "helper.h"\n#include <stdio.h>\nint main(void) { return greet(); }\n', "helper.h": "static int greet(void) { return 1; }\n"},
    "cpp": {"main.cpp": '#include "helper.hpp"\nint main() { return ns::greet(); }\n', "helper.hpp": "namespace ns { inline int greet() { return 1; } }\n"},
    "rust": {"src/main.rs": "mod helper;\nuse helper::greet;\nfn main() { greet(); }\n", "src/helper.rs": "pub fn greet() {}\n"},
    "go": {"go.mod": "module example.com/app\n", "main.go": 'package main\n\nimport (\n\t"fmt"\n\t"example.com/app/util"\n)\n\nfunc main() { fmt.Println(util.Greet()) }\n', "util/util.go": "package util\n\nfunc Greet() string { return \"x\" }\n"},
    "zig": {"main.zig": 'const helper = @import("helper.zig");\nconst std = @import("std");\npub fn main() void { helper.greet(); }\n', "helper.zig": "pub fn greet() void {}\n"},
    "csharp": {"Main.cs": "using System.Text;\nclass Program { static void Main() { Helper.Greet(); } }\n", "Helper.cs": "public class Helper { public static void Greet() {} }\n"},
    "objectivec": {"main.m": '#import "Helper.h"\n#import <Foundation/Foundation.h>\nint main(void) { [Helper greet]; return 0; }\n', "Helper.h": "#import <Foundation/Foundation.h>\n@interface Helper : NSObject\n+ (void)greet;\n@end\n"},
    "swift": {"main.swift": "import Foundation\ngreet()\n", "helper.swift": "public func greet() { print(1) }\n"},
    "ruby": {"main.rb": "require_relative 'helper'\nHelper.greet\n", "helper.rb": "module Helper\n  def self.greet\n    1\n  end\nend\n"},
    "php": {"main.php": "<?php\nrequire_once './helper.php';\ngreet();\n", "helper.php": "<?php\nfunction greet() { return 1; }\n"},
    "scala": {"Main.scala": "import util.Helper\nobject Main { def run() = Helper.greet() }\n", "Helper.scala": "package util\nobject Helper { def greet(): Int = 1 }\n"},
    "lua": {"main.lua": "local h = require('helper')\nh.greet()\n", "helper.lua": "local M = {}\nfunction M.greet() return 1 end\nreturn M\n"},
    "elixir": {"main.ex": "defmodule Main do\n  alias Helper\n  def run, do: Helper.greet(1)\nend\n", "helper.ex": "defmodule Helper do\n  def greet(x) do\n    x\n  end\nend\n"},
    "haskell": {"Main.hs": "module Main where\nimport Helper\nmain = print (greet 1)\n", "Helper.hs": "module Helper (greet) where\ngreet x = x\n"},
    "bash": {"main.sh": "#!/bin/bash\nsource ./helper.sh\ngreet world\n", "helper.sh": "greet() {\n  echo \"$1\"\n}\n"},
}

QUERIES: dict = {}
SQL: dict[str, str] = {}


def sources(spark: SparkSession, trees: dict[str, dict[str, str]] = PROJECTS) -> DataFrame:
    rows = [(repo, path, len(body.encode()), 0, bytearray(body.encode())) for repo, tree in trees.items() for path, body in tree.items()]
    return spark.createDataFrame(rows, SOURCES)


def analysed(spark: SparkSession) -> tuple[DataFrame, X.FactTables, DataFrame, DataFrame]:
    """(files, facts, resolved imports, edges) of the small trees."""
    src = sources(spark)
    own = scan.supported(src)
    facts = X.split(X.facts(own))
    files = own.select("repo", "path", "lang", "size", "mtime_ns")
    imports = resolve.resolve(facts.imports, files, resolve.contexts(src))
    return files, facts, imports, G.build_edges(imports, files)


def heaviest_files(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    files, _, _, edges = analysed(spark)
    return G.heaviest(files, edges)


def _values(rows: list[tuple], columns: str) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns})"


#: Languages whose first file names the second: (repo, importer, imported).
EDGES = [
    ("python", "main.py", "helper.py"), ("typescript", "main.ts", "helper.ts"), ("javascript", "main.js", "helper.js"), ("java", "app/Main.java", "app/Helper.java"), ("c", "main.c", "helper.h"),
    ("cpp", "main.cpp", "helper.hpp"), ("rust", "src/main.rs", "src/helper.rs"), ("go", "main.go", "util/util.go"), ("zig", "main.zig", "helper.zig"), ("ruby", "main.rb", "helper.rb"),
    ("php", "main.php", "helper.php"), ("lua", "main.lua", "helper.lua"), ("bash", "main.sh", "helper.sh"),
]

IMPORTS = [
    ("python", "helper", "local"), ("python", "os", "external"), ("typescript", "./helper", "local"), ("javascript", "./helper", "local"), ("java", "app.Helper", "local"),
    ("c", "helper.h", "local"), ("c", "stdio.h", "system"), ("cpp", "helper.hpp", "local"), ("rust", "helper", "local"), ("rust", "helper::greet", "local"),
    ("go", "fmt", "external"), ("go", "example.com/app/util", "local"), ("zig", "helper.zig", "local"), ("zig", "std", "external"), ("csharp", "System.Text", "external"),
    ("objectivec", "Helper.h", "external"), ("objectivec", "Foundation/Foundation.h", "system"), ("objectivec", "Foundation/Foundation.h", "system"), ("swift", "Foundation", "external"),
    ("ruby", "helper", "local"), ("php", "./helper.php", "local"), ("scala", "util.Helper", "external"), ("lua", "helper", "local"), ("elixir", "Helper", "external"), ("haskell", "Helper", "external"), ("bash", "./helper.sh", "local"),
]

#: Every call: (repo, callee, line, first column, column behind it).
CALLS = [
    ("bash", "echo", 2, 2, 6), ("bash", "source", 2, 0, 6), ("bash", "greet", 3, 0, 5), ("c", "greet", 3, 24, 29), ("cpp", "greet", 2, 24, 29), ("csharp", "Greet", 2, 44, 49),
    ("elixir", "Helper.greet", 3, 22, 27), ("go", "fmt.Println", 8, 18, 25), ("go", "util.Greet", 8, 31, 36), ("haskell", "print", 3, 7, 12), ("haskell", "greet", 3, 14, 19),
    ("java", "greet", 3, 40, 45), ("javascript", "require", 1, 18, 25), ("javascript", "greet", 2, 0, 5), ("lua", "require", 1, 10, 17), ("lua", "h.greet", 2, 2, 7), ("objectivec", "greet", 3, 25, 30),
    ("php", "greet", 3, 0, 5), ("python", "str", 6, 16, 19), ("python", "greet", 6, 11, 16), ("ruby", "Helper", 2, 0, 6), ("ruby", "Helper.greet", 2, 7, 12), ("rust", "greet", 3, 12, 17),
    ("scala", "greet", 2, 33, 38), ("swift", "print", 1, 22, 27), ("swift", "greet", 2, 0, 5), ("typescript", "greet", 2, 25, 30), ("zig", "helper.greet", 3, 28, 33),
]

SYMBOLS = [
    ("python", "run", "function", True, 5, 6), ("python", "Base", "class", True, 1, 3), ("python", "go", "method", True, 2, 3), ("python", "greet", "function", True, 6, 7),
    ("typescript", "run", "function", True, 2, 2), ("typescript", "greet", "function", True, 1, 1), ("javascript", "greet", "function", False, 1, 1),
    ("java", "Main", "class", True, 3, 3), ("java", "run", "method", False, 3, 3), ("java", "Helper", "class", True, 2, 2), ("java", "greet", "method", True, 2, 2),
    ("c", "main", "function", True, 3, 3), ("c", "greet", "function", False, 1, 1), ("cpp", "main", "function", True, 2, 2), ("cpp", "ns", "class", True, 1, 1), ("cpp", "greet", "function", True, 1, 1),
    ("rust", "main", "function", False, 3, 3), ("rust", "greet", "function", True, 1, 1), ("go", "main", "function", False, 8, 8), ("go", "Greet", "function", True, 3, 3),
    ("zig", "helper", "function", False, 1, 1), ("zig", "std", "function", False, 2, 2), ("zig", "main", "function", True, 3, 3), ("zig", "greet", "function", True, 1, 1),
    ("csharp", "Program", "class", False, 2, 2), ("csharp", "Main", "method", False, 2, 2), ("csharp", "Helper", "class", True, 1, 1), ("csharp", "Greet", "method", True, 1, 1),
    ("objectivec", "main", "function", True, 3, 3), ("objectivec", "Helper", "class", True, 2, 4), ("objectivec", "greet", "method", True, 3, 3), ("swift", "greet", "function", True, 1, 1),
    ("ruby", "Helper", "class", True, 1, 5), ("ruby", "greet", "method", True, 2, 4), ("php", "greet", "function", True, 2, 2), ("scala", "Main", "class", True, 2, 2), ("scala", "run", "function", True, 2, 2),
    ("scala", "Helper", "class", True, 2, 2), ("scala", "greet", "function", True, 2, 2), ("lua", "greet", "function", True, 2, 2), ("elixir", "Main", "class", True, 1, 4), ("elixir", "run", "function", True, 3, 3),
    ("elixir", "Helper", "class", True, 1, 5), ("elixir", "greet", "function", True, 2, 4), ("haskell", "main", "function", True, 3, 3), ("haskell", "greet", "function", True, 2, 2), ("bash", "greet", "function", True, 1, 3),
]


def extract_symbols_x1_x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = analysed(spark)[1].symbols
    return s.select("repo", "name", "kind", "exported", F.col("span.start_line").alias("line"), F.col("span.end_line").alias("end_line"))


def extract_imports_x1_x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark)[2].select("repo", "raw", "kind")


def extract_calls_x1_x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = analysed(spark)[1].calls
    return c.select("repo", F.col("callee_raw").alias("callee"), F.col("span.start_line").alias("line"), F.col("span.start_col").alias("col"), F.col("span.end_col").alias("end_col"))


def resolve_edges_r1_r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark)[3].select("repo", "src", "dst")


def syntax_errors_x20(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = {"python": {"a.py": "def f(:\n  pass\n", "b.py": "x = 1\n"}, "go": {"a.go": "package a\nfunc f() { g(\n"}, "rust": {"a.rs": "fn f() {}\n"}}
    return X.errors(scan.supported(sources(spark, broken))).select("repo", "path", F.col("span.start_line").alias("line")).distinct()


QUERIES |= {f.__name__: f for f in (extract_symbols_x1_x19, extract_imports_x1_x19, extract_calls_x1_x19, resolve_edges_r1_r15, syntax_errors_x20)}
SQL |= {
    "extract_symbols_x1_x19": _values(SYMBOLS, "repo, name, kind, exported, line, end_line"),
    "extract_imports_x1_x19": _values(IMPORTS, "repo, raw, kind"),
    "resolve_edges_r1_r15": _values(EDGES, "repo, src, dst"),
    "extract_calls_x1_x19": _values(CALLS, "repo, callee, line, col, end_col"),
    "syntax_errors_x20": _values([("python", "a.py", 1), ("go", "a.go", 2)], "repo, path, line"),
}
