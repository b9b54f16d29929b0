"""Import resolution: ranked candidates per import, joined to the known files, smallest rank wins.

A candidate is a key of the `targets` table: a file's own path, or `go:` and a directory for the first Go file directly
inside it. Only string work happens in Python; the choice is one equi-join and one aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import JS_EXTS, TS_EXTS

#: Context of a repository that resolution needs: aliases [[pattern, [targets]]], go module, directories with a Cargo.toml.
Context = dict


def _join(base: str, rest: str) -> str:
    """The normal form of a path below a directory; a `..` beyond the root stays."""
    out: list[str] = []
    for part in (base + "/" + rest).split("/"):
        if part in ("", "."):
            continue
        if part == ".." and out and out[-1] != "..":
            out.pop()
        else:
            out.append(part)
    return "/".join(out)


def _dir(path: str) -> str:
    return path.rpartition("/")[0]


def python_candidates(raw: str, path: str, kind: str, ctx: Context) -> list[str]:
    rest = raw.lstrip(".")
    dots = len(raw) - len(rest)
    if dots:
        base = _join(_dir(path), "/".join([".."] * (dots - 1)))
        if not rest:
            return [_join(base, "__init__.py")]
        target = _join(base, rest.replace(".", "/"))
    else:
        target = _join("", rest.replace(".", "/"))
    return [f"{target}.py", f"{target}/__init__.py"]


def _js_target(target: str, exts: tuple[str, ...]) -> list[str]:
    out = [target, *(f"{target}.{e}" for e in exts)]
    stem, _, ext = target.rpartition(".")
    if stem and ext in JS_EXTS:
        out += [f"{stem}.{e}" for e in exts]
    return out + [_join(target, f"index.{e}") for e in exts]


def _js(exts: tuple[str, ...]):
    def candidates(raw: str, path: str, kind: str, ctx: Context) -> list[str]:
        if raw.startswith("."):
            return _js_target(_join(_dir(path), raw), exts)
        best: tuple[int, list[str], str] | None = None
        for pattern, targets in ctx.get("aliases", []):
            head, star, tail = pattern.partition("*")
            if not star:
                if pattern == raw:
                    best = (1 << 30, targets, "")
                    break
            elif len(raw) >= len(head) + len(tail) and raw.startswith(head) and raw.endswith(tail) and (best is None or len(head) > best[0]):
                best = (len(head), targets, raw[len(head) : len(raw) - len(tail)])
        if best is None:
            return []
        return [c for t in best[1] for c in _js_target(_join("", t.replace("*", best[2], 1)), exts)]

    return candidates


def java_candidates(raw: str, path: str, kind: str, ctx: Context) -> list[str]:
    name = raw.replace(".", "/") + ".java"
    return [name, f"src/main/java/{name}"]


def c_candidates(raw: str, path: str, kind: str, ctx: Context) -> list[str]:
    if kind == "system":
        return [_join(d, raw) for d in ("include", "inc")]
    return [_join(d, raw) for d in (_dir(path), "", "include", "src", "inc")]


def go_candidates(raw: str, path: str, kind: str, ctx: Context) -> list[str]:
    if raw.startswith(("./", "../")):
        return ["go:" + _join(_dir(path), raw)]
    module = ctx.get("go_module")
    if not module or (raw != module and not raw.startswith(module + "/")):
        return []
    return ["go:" + raw[len(module) + 1 :]]


def ruby_candidates(raw: str, path: str, kind: str, ctx: Context) -> list[str]:
    if raw.startswith("/") or kind != "local":
        return []
    return [_join(_dir(path), raw if raw.endswith(".rb") else raw + ".rb")]


def php_candidates(raw: str, path: str, kind: str, ctx: Context) -> list[str]:
    return [] if raw.startswith("/") or "\\" in raw else [_join(_dir(path), raw), _join("", raw)]


def lua_candidates(raw: str, path: str, kind: str, ctx: Context) -> list[str]:
    def each(target: str) -> list[str]:
        return [f"{target}.lua", _join(target, "init.lua")] + [target] * target.endswith(".lua")

    if raw.startswith(("./", "../")):
        return each(_join(_dir(path), raw))
    if raw.startswith("/"):
        return []
    module = raw.replace(".", "/")
    return each(_join("", module)) + each(_join(_dir(path), module))


def bash_candidates(raw: str, path: str, kind: str, ctx: Context) -> list[str]:
    return [] if raw.startswith("/") else [_join(_dir(path), raw)]


def zig_candidates(raw: str, path: str, kind: str, ctx: Context) -> list[str]:
    return [_join(_dir(path), raw)] if raw.endswith(".zig") or "/" in raw else []


# --- Rust


def _module_dir(path: str) -> str:
    """Where a file's submodules live: mod, lib and main own their directory, others one of their name."""
    name = path.rpartition("/")[2]
    stem = name[:-3] if name.endswith(".rs") else name
    return _dir(path) if stem in ("mod", "lib", "main") else _join(_dir(path), stem)


def _crate_base(path: str, manifests: frozenset[str]) -> str:
    """The nearest directory named src, else the nearest one with a manifest, else the root."""
    parts = path.split("/")[:-1]
    for i in range(len(parts), 0, -1):
        if parts[i - 1] == "src":
            return "/".join(parts[:i])
    for i in range(len(parts), -1, -1):
        if "/".join(parts[:i]) in manifests:
            return "/".join(parts[:i])
    return ""


def _shortened(base: str, segments: list[str]) -> list[str]:
    out = []
    for n in range(len(segments), 0, -1):
        path = _join(base, "/".join(segments[:n]))
        out += [f"{path}.rs", f"{path}/mod.rs"]
    return out


def _owner(directory: str) -> list[str]:
    """Files that can define the module whose children live in a directory."""
    out = [_join(directory, "mod.rs")]
    if directory:
        out.append(f"{directory}.rs")
    return out + [_join(directory, f) for f in ("lib.rs", "main.rs")]


def _is_path_attribute(raw: str) -> bool:
    return "/" in raw or "\\" in raw or raw.lower().endswith(".rs")


def declared_candidates(raw: str, path: str) -> list[str]:
    """Where `mod raw;` can point."""
    if _is_path_attribute(raw):
        return [_join(_dir(path), raw.replace("\\", "/"))]
    return _shortened(_module_dir(path), [raw]) + _shortened(_dir(path), [raw])


def rust_candidates(raw: str, path: str, kind: str, ctx: Context) -> list[str]:
    """Candidates that must come from a `mod` declaration carry the prefix `mod:`."""
    base = _crate_base(path, frozenset(ctx.get("manifests", [])))
    if _is_path_attribute(raw):
        return declared_candidates(raw, path) if kind == "local" else []
    if raw == "crate":
        return [_join(base, f) for f in ("lib.rs", "main.rs")]
    if raw == "self":
        return [path]
    if raw == "super":
        return _owner(_dir(_module_dir(path)))
    if "::" not in raw:
        return declared_candidates(raw, path) if kind == "local" else ["mod:" + c for c in _shortened(base, [raw])]
    head, _, rest = raw.partition("::")
    anchor: list[str] = []
    declared = False
    if head == "crate":
        start, anchor = base, [_join(base, f) for f in ("lib.rs", "main.rs")]
    elif head == "self":
        start, anchor = _module_dir(path), [path]
    elif head == "super":
        start, rest = _module_dir(path), raw
        while rest.startswith("super::"):
            start, rest = _dir(start), rest[7:]
        anchor = _owner(start)
    else:
        start, rest, declared = base, raw, True
    segments = [s for s in rest.split("::") if s]
    if segments[-1:] == ["*"]:
        segments.pop()
    if "*" in segments:
        return []
    found = _shortened(start, segments) + anchor
    return ["mod:" + c for c in found] if declared else found


CANDIDATES: dict[str, Callable[[str, str, str, Context], list[str]]] = {
    "python": python_candidates,
    "javascript": _js(JS_EXTS + TS_EXTS),
    "typescript": _js(TS_EXTS + JS_EXTS),
    "java": java_candidates,
    "c": c_candidates,
    "cpp": c_candidates,
    "rust": rust_candidates,
    "go": go_candidates,
    "ruby": ruby_candidates,
    "php": php_candidates,
    "lua": lua_candidates,
    "bash": bash_candidates,
    "zig": zig_candidates,
}


def candidates(lang: str, raw: str, path: str, kind: str, ctx: Context | None = None) -> list[str]:
    """Candidate keys in order; none for languages whose imports never name files."""
    make = CANDIDATES.get(lang)
    return make(raw, path, kind, ctx or {}) if make else []


# --- manifests


def context_of(tsconfig: str | None, go_mod: str | None, manifests: list[str]) -> str:
    """A repository's context as JSON; unreadable manifests count as absent."""
    ctx: Context = {"manifests": sorted(manifests)}
    if go_mod:
        for line in go_mod.splitlines():
            words = line.split("//")[0].split()
            if len(words) >= 2 and words[0] == "module":
                ctx["go_module"] = words[1].strip('"')
                break
    if tsconfig:
        try:
            options = json.loads(tsconfig).get("compilerOptions") or {}
            base = options.get("baseUrl") or ""
            table = options.get("paths") or {}
            ctx["aliases"] = [[k, [f"{base}/{t}" if base else t for t in v if isinstance(t, str)]] for k, v in sorted(table.items()) if isinstance(v, list) and v]
        except (ValueError, AttributeError):
            pass
    return json.dumps(ctx)


def contexts(sources: DataFrame) -> DataFrame:
    """(repo, ctx): what the manifests at a repository's root say, and where Cargo manifests lie."""
    path = F.col("path")
    own = sources.where(path.isin("tsconfig.json", "go.mod") | (paths.name(path) == "Cargo.toml"))
    pick = lambda name: F.max(F.when(path == name, F.col("content").cast("string")))
    rows = own.groupBy("repo").agg(
        pick("tsconfig.json").alias("ts"), pick("go.mod").alias("go"), F.collect_set(F.when(paths.name(path) == "Cargo.toml", paths.parent(path))).alias("cargo")
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            ctx = [context_of(r["ts"], r["go"], r["cargo"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["repo"] for r in rows], pa.string()), pa.array(ctx, pa.string())], names=["repo", "ctx"])

    return rows.mapInArrow(run, "repo string, ctx string")


# --- the join


def targets(files: DataFrame) -> DataFrame:
    """(repo, key, target): every file by its path, and for each directory its first Go file."""
    own = files.select("repo", F.col("path").alias("key"), F.col("path").alias("target"))
    go = files.where(paths.extension(F.col("path")) == "go").groupBy("repo", F.concat(F.lit("go:"), paths.parent(F.col("path"))).alias("key")).agg(F.min("path").alias("target"))
    return own.unionByName(go)


def ranked_match(wanted: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """wanted: repo, keys, candidates (array). Gives repo, keys, target of the first candidate that is known.

    An inner join and then the smallest rank, so that a missing earlier candidate never hides a later one.
    """
    ranked = wanted.select("repo", *keys, F.posexplode("candidates").alias("rank", "key"))
    return ranked.join(known, ["repo", "key"]).groupBy("repo", *keys).agg(F.min_by("target", "rank").alias("target"))


def with_candidates(imports: DataFrame, ctx: DataFrame | None) -> DataFrame:
    """(repo, path, ord, lang, raw, kind) plus `candidates`."""
    rows = imports.select("repo", "path", "ord", "lang", "raw", "kind")
    rows = rows.join(ctx, "repo", "left") if ctx is not None else rows.withColumn("ctx", F.lit(None).cast("string"))

    def run(batches):
        import pyarrow as pa

        parsed: dict[str | None, Context] = {None: {}}
        for b in batches:
            out = []
            for lang, raw, path, kind, c in zip(*(b.column(n).to_pylist() for n in ("lang", "raw", "path", "kind", "ctx")), strict=True):
                if c not in parsed:
                    parsed[c] = json.loads(c)
                out.append(candidates(lang, raw, path, kind, parsed[c]))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("repo", "path", "ord", "kind")), pa.array(out, pa.list_(pa.string()))], names=["repo", "path", "ord", "kind", "candidates"])

    return rows.mapInArrow(run, "repo string, path string, ord int, kind string, candidates array<string>")


def resolve(imports: DataFrame, files: DataFrame, ctx: DataFrame | None = None) -> DataFrame:
    """The imports with `resolved` and the rewritten `kind`.

    Resolved and not system: local. Unresolved local: external. System stays. A file's import of itself stays local
    without a target.
    """
    known = targets(files)
    wanted = with_candidates(imports, ctx)
    keys = ["path", "ord"]
    plain = wanted.withColumn("candidates", F.transform("candidates", lambda c: F.regexp_replace(c, "^mod:", "")))
    winners = ranked_match(plain.select("repo", *keys, "candidates"), keys, known)
    # Rust paths without a qualifier count only if some `mod` declaration names their target.
    bare = F.startswith(F.coalesce(F.get("candidates", F.lit(0)), F.lit("")), F.lit("mod:"))
    unsure = wanted.where(bare).select("repo", *keys)
    declaring = (F.col("lang") == "rust") & (F.col("kind") == "local") & ~F.col("raw").contains("::") & ~F.col("raw").isin("crate", "self", "super")
    declared = winners.join(imports.where(declaring).select("repo", *keys), ["repo", *keys], "left_semi").select("repo", "target").distinct()
    doubtful = winners.join(unsure, ["repo", *keys], "left_semi")
    refused = doubtful.join(declared, ["repo", "target"], "left_anti").select("repo", *keys)
    winners = winners.join(refused, ["repo", *keys], "left_anti")
    out = imports.join(winners, ["repo", *keys], "left")
    own = (F.col("lang") == "rust") & (F.col("target") == F.col("path"))
    kind: Column = (
        F.when(F.col("kind") == "system", F.col("kind")).when(F.col("target").isNotNull(), "local").when(F.col("kind") == "local", "external").otherwise(F.col("kind"))
    )
    return out.select("repo", "path", "lang", "ord", "raw", kind.alias("kind"), F.when(own, None).otherwise(F.col("target")).alias("resolved"), "span")
