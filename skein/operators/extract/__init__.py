"""Fact extraction: one Arrow pass over (file, content) gives imports, symbols, calls and syntax errors.

Each source is lexed once for all its facts. `register()` adds or replaces a language's extractor.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...schema import SPAN
from . import languages, python_lang
from .lexer import Facts, Source

#: Part of the fact store's key: facts of another version are extracted anew.
VERSION = "2+declared-names"

_extra: dict[str, Callable[[bytes, str], Facts]] = {}


def register(lang: str, extractor: Callable[[bytes, str], Facts]) -> None:
    """A language's extractor: (content, path) to Facts. It must be importable on the workers."""
    _extra[lang] = extractor


def extract_file(lang: str, content: bytes, path: str = "") -> Facts:
    if lang in _extra:
        return _extra[lang](content, path)
    if lang == "python":
        return python_lang.extract(content, path)
    return languages.extract(lang, content)


def syntax_errors(lang: str, content: bytes) -> list[tuple[str, tuple[int, int, int, int]]]:
    """(message, span): the standard parser's error for Python; unbalanced brackets and unclosed strings elsewhere.

    An approximation for all languages but Python: without a grammar only the bracket structure is checked.
    """
    if lang == "python":
        import ast
        import warnings

        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(content)
            return []
        except SyntaxError as e:
            line, col = e.lineno or 1, max(0, (e.offset or 1) - 1)
            return [(e.msg or "syntax error", (line, col, e.end_lineno or line, max(col, (e.end_offset or 1) - 1)))]
        except (ValueError, RecursionError) as e:
            return [(str(e), (1, 0, 1, 0))]
    source = Source(content, languages.RULES[lang])
    out, stack = [], []
    close = {")": "(", "]": "[", "}": "{"}
    code = source.code
    if lang == "bash":  # case patterns close what they don't open
        code = re.sub(r"^[^()\n]*\)", lambda m: " " * len(m[0]), code, flags=re.M)
    for m in re.finditer(r"[()\[\]{}]", code):
        c, at = m[0], m.start()
        if c in "([{":
            stack.append((c, at))
        elif stack and stack[-1][0] == close[c]:
            stack.pop()
        else:
            out.append((f"unexpected '{c}'", source.span(at, at + 1)))
    out += [(f"unclosed '{c}'", source.span(at, at + 1)) for c, at in stack]
    return sorted(out, key=lambda e: e[1])


@dataclass
class FactTables:
    imports: DataFrame
    symbols: DataFrame
    calls: DataFrame


_ROWS = f"repo string, path string, lang string, fact string, ord int, text string, kind string, exported boolean, span {SPAN}"


def facts(files: DataFrame, with_errors: bool = False) -> DataFrame:
    """files: repo, path, lang, content. One tagged row per fact; filter the files before, nothing is pushed through."""

    def run(batches):
        import pyarrow as pa

        span_type = pa.struct([(n, pa.int32()) for n in ("start_line", "start_col", "end_line", "end_col")])
        for batch in batches:
            rows = []
            for repo, path, lang, content in zip(*(batch.column(n).to_pylist() for n in ("repo", "path", "lang", "content")), strict=True):
                f = extract_file(lang, content or b"", path)
                rows += [(repo, path, lang, "import", i, raw, kind, None, span) for i, (raw, kind, span) in enumerate(f.imports.values())]
                rows += [(repo, path, lang, "symbol", i, *s) for i, s in enumerate(f.symbols)]
                rows += [(repo, path, lang, "call", i, text, None, None, span) for i, (text, span) in enumerate(f.calls)]
                if with_errors:
                    rows += [(repo, path, lang, "error", i, text, None, None, span) for i, (text, span) in enumerate(syntax_errors(lang, content or b""))]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            spans = [dict(zip(("start_line", "start_col", "end_line", "end_col"), s, strict=True)) for s in cols[8]]
            types = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)] + [pa.array(spans, span_type)], names=["repo", "path", "lang", "fact", "ord", "text", "kind", "exported", "span"])

    return files.select("repo", "path", "lang", "content").mapInArrow(run, _ROWS)


def split(rows: DataFrame) -> FactTables:
    """The fact tables of facts(); store `rows` first if more than one of them is read."""
    at = lambda fact: rows.where(F.col("fact") == fact)
    return FactTables(
        at("import").select("repo", "path", "lang", "ord", F.col("text").alias("raw"), "kind", "span"),
        at("symbol").select("repo", "path", "ord", F.col("text").alias("name"), "kind", "exported", "span"),
        at("call").select("repo", "path", "ord", F.col("text").alias("callee_raw"), "span"),
    )


def errors(files: DataFrame) -> DataFrame:
    """(repo, path, message, span) of files that don't parse."""
    return facts(files, with_errors=True).where("fact = 'error'").select("repo", "path", F.col("text").alias("message"), "span")
