"""Path predicates: tests, files loaded by tools or frameworks, Cargo targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.detect import text_of
from ..schema import JS_EXTS, TS_EXTS

#: The names that mark tests, configuration, setup, runtime entries, routes and ambient types.
TEST_DIRS = ("tests", "test", "spec", "specs", "__tests__", "__mocks__")
CONFIG_NAMES = (
    "vite.config", "vitest.config", "jest.config", "playwright.config", "cypress.config", "webpack.config", "rollup.config", "tsup.config", "tsdown.config", "esbuild.config",
    "rspack.config", "next.config", "nuxt.config", "astro.config", "svelte.config", "tailwind.config", "postcss.config", "babel.config", "eslint.config", ".eslintrc",
    "prettier.config", ".prettierrc", "stylelint.config", "commitlint.config", "lint-staged.config", "wdio.conf", "karma.conf", "protractor.conf", "unocss.config",
)
STORYBOOK_STEMS = ("main", "preview", "manager", "test-runner")
SETUP_STEMS = ("setup", "setuptests", "testsetup", "vitest.setup", "jest.setup")
ENTRY_PARENTS = ("", "src", "app", "client")
ENTRY_STEMS = ("main", "index", "bootstrap", "client", "server", "entry-client", "entry-server", "renderer")
ANYWHERE_STEMS = ("middleware", "instrumentation", "service-worker", "sw")
ROUTE_STEMS = ("page", "layout", "route", "loading", "error", "not-found", "template", "default")
AMBIENT_NAMES = ("global.d.ts", "globals.d.ts", "types.d.ts", "env.d.ts", "vite-env.d.ts", "next-env.d.ts", "react-app-env.d.ts")
HTML_FILES = ("index.html", "app.html", "src/index.html", "public/index.html")
CARGO_REASONS = {
    "build": "cargo build script", "bin": "cargo binary target", "lib": "cargo library target",
    "examples": "cargo example target", "benches": "cargo bench target", "tests": "cargo test target",
}


def is_test(path: Column) -> Column:
    stem = paths.stem(path)
    return F.arrays_overlap(paths.components(path), F.array(*map(F.lit, TEST_DIRS))) | stem.rlike(r"_(?:test|spec)$|^(?:test|spec)_|\.(?:test|spec)")


def is_js(lang: Column) -> Column:
    return lang.isin("javascript", "typescript")


def is_declaration(path: Column) -> Column:
    return F.lower(path).endswith(".d.ts")


def _lowered(path: Column) -> tuple[Column, Column, Column, Column]:
    low = F.lower(path)
    return paths.name(low), paths.stem(low), paths.components(low), paths.name(paths.parent(low))


def is_config(path: Column) -> Column:
    name, stem, parts, _ = _lowered(path)
    names = "|".join(n.replace(".", r"\.") for n in CONFIG_NAMES)
    story = F.arrays_overlap(parts, F.array(F.lit(".storybook"), F.lit("storybook"))) & stem.isin(*STORYBOOK_STEMS)
    return name.rlike(rf"^(?:{names})(?:\.|$)") | story


def is_setup(path: Column) -> Column:
    name, stem, _, _ = _lowered(path)
    return stem.isin(*SETUP_STEMS) | name.contains(".setup.")


def is_story(path: Column) -> Column:
    name, _, parts, _ = _lowered(path)
    return name.contains(".stories.") | name.contains(".story.") | F.array_contains(parts, "stories")


def is_runtime_entry(path: Column) -> Column:
    _, stem, _, parent = _lowered(path)
    return ~is_declaration(path) & ((parent.isin(*ENTRY_PARENTS) & stem.isin(*ENTRY_STEMS)) | stem.isin(*ANYWHERE_STEMS) | stem.endswith(".worker"))


def is_route(path: Column) -> Column:
    _, stem, parts, _ = _lowered(path)
    return ~is_declaration(path) & (F.arrays_overlap(parts, F.array(F.lit("pages"), F.lit("routes"))) | (F.array_contains(parts, "app") & stem.isin(*ROUTE_STEMS)))


def html_entries(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files that a quoted value of one of the known pages names."""
    pages = sources.where(F.col("path").isin(*HTML_FILES)).select("repo", text_of(F.col("content")).alias("text"))
    quoted = F.regexp_extract_all("text", F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0))
    value = pages.select("repo", F.explode(quoted).alias("v")).select("repo", F.expr("substring(v, 2, length(v) - 2)").alias("v"))
    cut = F.trim(F.regexp_extract("v", r"^([^?#]*)", 1))
    named = value.where(~F.col("v").contains("://")).select("repo", paths.normalize(F.regexp_replace(F.regexp_replace(cut, "^/", ""), r"^\./", "")).alias("path")).where("path <> ''").distinct()
    return files.select("repo", "path").join(named, ["repo", "path"], "left_semi")


def script_entries(files: DataFrame, sources: DataFrame) -> DataFrame:
    """JS and TS files that a script of package.json mentions, with or without extension.

    Scripts are few per repository, so each is compared with its repository's files, as containment asks for.
    """
    manifest = sources.where(F.col("path") == "package.json").select("repo", F.try_parse_json(text_of(F.col("content"))).alias("v"))
    scripts = manifest.select("repo", F.explode(F.map_values(F.try_variant_get("v", "$.scripts", "map<string,variant>"))).alias("s"))
    scripts = scripts.select("repo", F.try_variant_get("s", "$", "string").alias("script")).where("script is not null")
    own = files.where(is_js(F.col("lang")) & ~is_declaration(F.col("path"))).select("repo", "path")
    bare = F.regexp_replace("path", r"\.[^.]*$", "")
    return own.join(scripts, (own.repo == scripts.repo) & F.contains(F.col("script"), bare)).select(own.repo, "path").distinct()


def ambient_entries(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Declaration files without an implementation beside them that declare globals by name, directory or content."""
    path = F.col("path")
    decl = files.where(is_js(F.col("lang")) & is_declaration(path)).select("repo", "path")
    base = F.regexp_replace(path, r"\.d\.ts$", "")
    tries = decl.select("repo", path.alias("decl"), F.explode(F.array(*[F.concat(base, F.lit(f".{e}")) for e in TS_EXTS + JS_EXTS])).alias("path"))
    paired = tries.join(files.select("repo", "path"), ["repo", "path"], "left_semi").select("repo", F.col("decl").alias("path"))
    alone = decl.join(paired, ["repo", "path"], "left_anti").join(sources.select("repo", "path", "content"), ["repo", "path"], "left")
    name, _, parts, _ = _lowered(path)
    text = text_of(F.col("content"))
    declares = text.contains("declare global") | text.contains("declare module") | text.contains("/// <reference")
    return alone.where(name.isin(*AMBIENT_NAMES) | F.arrays_overlap(parts, F.array(F.lit("types"), F.lit("@types"))) | declares).select("repo", "path")


def cargo_targets(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo, path, reason) of Rust files that Cargo loads by convention."""
    path, parts = F.col("path"), paths.components(F.col("path"))
    manifests = sources.where(paths.name(path) == "Cargo.toml").select("repo", paths.parent(path).alias("crate"))
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(-i)), F.lit(""))
    up = lambda i: F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - i, F.lit(0))), "/")
    n, name = F.size(parts), at(1)
    cases = [
        (name == "build.rs", 1, "build"),
        ((n >= 2) & (at(2) == "src") & (name == "main.rs"), 2, "bin"),
        ((n >= 2) & (at(2) == "src") & (name == "lib.rs"), 2, "lib"),
        ((n >= 3) & (at(3) == "src") & (at(2) == "bin"), 3, "bin"),
        ((n >= 4) & (at(4) == "src") & (at(3) == "bin") & (name == "main.rs"), 4, "bin"),
    ]
    for d in ("examples", "benches", "tests"):
        cases += [((n >= 2) & (at(2) == d), 2, d), ((n >= 3) & (at(3) == d) & (name == "main.rs"), 3, d)]
    options = F.array(*[F.when(when, F.struct(F.lit(rank).alias("rank"), up(i).alias("crate"), F.lit(CARGO_REASONS[r]).alias("reason"))) for rank, (when, i, r) in enumerate(cases)])
    tries = files.where("lang = 'rust'").select("repo", "path", F.explode(F.filter(options, lambda x: x.isNotNull())).alias("o")).select("repo", "path", "o.*")
    return tries.join(manifests, ["repo", "crate"]).groupBy("repo", "path").agg(F.min_by("reason", "rank").alias("reason"))


def suppressed(files: DataFrame, sources: DataFrame, cargo: DataFrame) -> DataFrame:
    """(repo, path) of files used by convention: they are no orphans."""
    path = F.col("path")
    named = files.where(is_js(F.col("lang")) & (is_config(path) | is_setup(path) | is_story(path) | is_runtime_entry(path) | is_route(path))).select("repo", "path")
    others = (html_entries(files, sources), script_entries(files, sources), ambient_entries(files, sources), cargo)
    for other in others:
        named = named.unionByName(other.select("repo", "path"))
    return named.distinct()


def tests(files: DataFrame) -> DataFrame:
    return files.where(is_test(F.col("path"))).select("repo", "path")
