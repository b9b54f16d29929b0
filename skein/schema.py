"""The relational model: every table is keyed by repo first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPAN = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
SOURCES = "repo string, path string, size long, mtime_ns long, content binary"
FILES = "repo string, path string, lang string, size long, mtime_ns long"
IMPORTS = f"repo string, path string, lang string, ord int, raw string, kind string, span {SPAN}"
SYMBOLS = f"repo string, path string, ord int, name string, kind string, exported boolean, span {SPAN}"
CALLS = f"repo string, path string, ord int, callee_raw string, span {SPAN}"
EDGES = "repo string, src string, dst string, kind string"

#: Language, shown name, aliases, extensions, colour in diagrams.
LANGUAGES: list[tuple[str, str, tuple[str, ...], tuple[str, ...], str]] = [
    ("python", "python", ("py",), ("py", "pyi"), "#3776ab"),
    ("typescript", "typescript", ("ts",), ("ts", "tsx", "mts", "cts"), "#3178c6"),
    ("javascript", "javascript", ("js",), ("js", "jsx", "mjs", "cjs"), "#f7df1e"),
    ("java", "java", ("java",), ("java",), "#b07219"),
    ("c", "c", ("c",), ("c", "h"), "#555555"),
    ("cpp", "cpp", ("cpp",), ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "#f34b7d"),
    ("rust", "rust", ("rs",), ("rs",), "#dea584"),
    ("go", "go", ("go",), ("go",), "#00add8"),
    ("zig", "zig", ("zig",), ("zig",), "#f7a41d"),
    ("csharp", "csharp", ("cs",), ("cs",), "#178600"),
    ("objectivec", "objc", ("objc",), ("m", "mm"), "#438eff"),
    ("swift", "swift", ("swift",), ("swift",), "#f05138"),
    ("ruby", "ruby", ("rb",), ("rb", "rake", "gemspec"), "#cc342d"),
    ("php", "php", ("php",), ("php",), "#4f5d95"),
    ("scala", "scala", ("scala",), ("scala", "sc"), "#c22d40"),
    ("lua", "lua", ("lua",), ("lua",), "#000080"),
    ("elixir", "elixir", ("ex",), ("ex", "exs"), "#6e4a7e"),
    ("haskell", "haskell", ("hs",), ("hs",), "#5e5086"),
    ("bash", "bash", ("sh",), ("sh", "bash"), "#89e051"),
]
UNKNOWN_COLOUR = "#999999"
JS_EXTS = ("js", "jsx", "mjs", "cjs")
TS_EXTS = ("ts", "tsx", "mts", "cts")
LANG_OF_ALIAS = {a: n for n, shown, aliases, _, _ in LANGUAGES for a in (n, shown, *aliases)}
LANG_OF_EXT = {e: n for n, _, _, exts, _ in LANGUAGES for e in exts}


def lang_dim(spark: SparkSession) -> DataFrame:
    """One row per language: lang, shown, aliases, exts, colour."""
    rows = [(n, s, list(a), list(e), c) for n, s, a, e, c in LANGUAGES]
    return spark.createDataFrame(rows, "lang string, shown string, aliases array<string>, exts array<string>, colour string")


def resolve_languages(names: list[str] | None) -> list[str] | None:
    """Full names of a language filter given by names or aliases; unknown names raise."""
    if names is None:
        return None
    bad = [n for n in names if n not in LANG_OF_ALIAS]
    if bad:
        raise ValueError(f"unknown language: {', '.join(bad)}")
    return sorted({LANG_OF_ALIAS[n] for n in names})
