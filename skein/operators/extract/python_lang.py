"""Python facts from the standard parser, with a line-based fallback for sources that it refuses."""

from __future__ import annotations

import ast
import re
import warnings

from .lexer import Facts, Rules, Source

RULES = Rules(line=("#",), strings=(('"""', '"""', "\\", True), ("'''", "'''", "\\", True), ('"', '"', "\\", False), ("'", "'", "\\", False)))


def _at(source: Source, line: int, col: int) -> int:
    return source.starts[min(line, len(source.starts)) - 1] + col


def _kind(raw: str) -> str:
    return "local" if raw.startswith(".") else "external"


def extract(content: bytes, path: str) -> Facts:
    source = Source(content, RULES)
    facts = Facts(source)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return _fallback(source, facts)
    ends = lambda n: (_at(source, n.lineno, n.col_offset), _at(source, n.end_lineno, n.end_col_offset))

    def define(node, kind: str) -> None:
        first = min([node, *node.decorator_list], key=lambda n: n.lineno)
        start = _at(source, first.lineno, first.col_offset)
        if first is not node:
            start = source.raw.rindex("@", 0, start + 1) if "@" in source.raw[: start + 1] else start
        facts.add_symbol(node.name.encode().decode("latin-1"), kind, not node.name.startswith("_"), start, ends(node)[1])

    def use(node) -> None:
        a, b = ends(node)
        text = source.raw[a:b]
        if isinstance(node, ast.Name):
            facts.add_call(text, a, b)
        elif isinstance(node, ast.Attribute):
            facts.add_call(text, b - len(node.attr.encode()), b)

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            define(node, "function")
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for alias in node.names:
                facts.add_import(alias.name.encode().decode("latin-1"), "external", *ends(alias))
        elif isinstance(node, ast.ImportFrom):
            raw = "." * node.level + (node.module or "")
            names = [raw] if node.module else [raw + a.name for a in node.names if a.name != "*"] or [raw]
            for r in names:
                facts.add_import(r.encode().decode("latin-1"), _kind(r), *ends(node))
        elif isinstance(node, ast.ClassDef):
            define(node, "class")
            for item in node.body:
                if isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    define(item, "method")
            for base in node.bases:
                use(base)
        elif isinstance(node, ast.Call):
            use(node.func)
            f = node.func
            dynamic = (isinstance(f, ast.Name) and f.id == "__import__") or (isinstance(f, ast.Attribute) and f.attr == "import_module" and isinstance(f.value, ast.Name) and f.value.id == "importlib")
            if dynamic and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
                raw = node.args[0].value
                facts.add_import(raw.encode().decode("latin-1"), _kind(raw), *ends(node.args[0]))
        elif isinstance(node, (ast.AnnAssign, ast.arg)) and isinstance(node.annotation, ast.Name):
            use(node.annotation)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and isinstance(node.returns, ast.Name):
            use(node.returns)
    return facts.sort()


_IMPORT = re.compile(r"^[ \t]*import[ \t]+([^\n#;]+)", re.M)
_FROM = re.compile(r"^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(\([^)]*\)|[^\n#;]+)", re.M)
_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:\.\w+)*)[ \t]*\(")
_DYNAMIC = re.compile(r"(?<![\w.])(?:importlib\.import_module|__import__)[ \t]*\([ \t]*([\"'])([^\"'\n]+)\1")
_WORDS = frozenset("import from if elif while for return and or not in is lambda def class print with assert yield del raise except await".split()) - {"print"}


def _block_end(code: str, at: int, indent: int) -> int:
    """End of the last line from `at` on that is indented deeper."""
    end = at
    for line in re.finditer(r"\n([ \t]*)(\S[^\n]*)", code[at:]):
        if len(line[1].expandtabs()) <= indent:
            break
        end = at + line.end()
    return end


def _fallback(source: Source, facts: Facts) -> Facts:
    code = source.code
    for m in _IMPORT.finditer(code):
        for part in m[1].split(","):
            raw = part.split(" as ")[0].strip()
            if re.fullmatch(r"[\w.]+", raw):
                facts.add_import(raw, "external", m.start(1), m.end(1))
    for m in _FROM.finditer(code):
        names = [n.split(" as ")[0].strip() for n in m[2].strip("()").split(",")]
        raws = [m[1]] if m[1].strip(".") else [m[1] + n for n in names if re.fullmatch(r"\w+", n)]
        for raw in raws:
            facts.add_import(raw, _kind(raw), m.start(), m.end())
    for m in _DYNAMIC.finditer(source.text):
        if code[m.start()] == source.text[m.start()]:
            facts.add_import(m[2], _kind(m[2]), m.start(2) - 1, m.end(2) + 1)
    open_: list[tuple[int, str]] = []
    for m in _DEF.finditer(code):
        indent = len(m[1].expandtabs())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        kind = "class" if m[2] == "class" else "method" if open_ and open_[-1][1] == "class" else "function" if not open_ else None
        open_.append((indent, m[2]))
        if kind:
            last = source.line_end(m.end())
            facts.add_symbol(m[3], kind, not m[3].startswith("_"), m.start() + len(m[1]), _block_end(code, last, indent))
    for m in _CALL.finditer(code):
        if m[1] not in _WORDS and not re.search(r"(?:def|class)[ \t]+$", code[max(0, m.start() - 8) : m.start()]):
            facts.add_call(m[1], m.start(1) + m[1].rfind(".") + 1, m.end(1))
    return facts.sort()
