"""Facts of eighteen languages from the masked source: one short function each over shared helpers."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

from .lexer import C_LIKE, IDENT, JS_RULES, Facts, Rules, Source

NESTED = Rules(line=("//",), block=(("/*", "*/"),), nested=True)
RULES: dict[str, Rules] = {
    "javascript": JS_RULES,
    "typescript": JS_RULES,
    "java": Rules(line=("//",), block=(("/*", "*/"),), strings=(('"""', '"""', "\\", True), *C_LIKE.strings)),
    "c": C_LIKE,
    "cpp": C_LIKE,
    "objectivec": C_LIKE,
    "csharp": Rules(line=("//",), block=(("/*", "*/"),), strings=(('@"', '"', "", True), *C_LIKE.strings)),
    "go": Rules(line=("//",), block=(("/*", "*/"),), strings=(("`", "`", "", True), *C_LIKE.strings)),
    "rust": Rules(line=("//",), block=(("/*", "*/"),), nested=True, strings=(('r##"', '"##', "", True), ('r#"', '"#', "", True), ('"', '"', "\\", True), ("'", "'", "\\", False)), char_literals=True),
    "zig": Rules(line=("//", "\\\\"), strings=C_LIKE.strings),
    "swift": Rules(line=("//",), block=(("/*", "*/"),), nested=True, strings=(('"""', '"""', "\\", True), ('"', '"', "\\", False))),
    "scala": Rules(line=("//",), block=(("/*", "*/"),), nested=True, strings=(('"""', '"""', "", True), ('"', '"', "\\", False), ("'", "'", "\\", False)), char_literals=True),
    "php": Rules(line=("//", "#"), block=(("/*", "*/"),), strings=(('"', '"', "\\", True), ("'", "'", "\\", True))),
    "ruby": Rules(line=("#",), block=(("\n=begin", "\n=end"),), strings=(('"', '"', "\\", True), ("'", "'", "\\", True), ("`", "`", "\\", True))),
    "lua": Rules(line=("--",), block=(("--[[", "]]"),), strings=(("[[", "]]", "", True), *C_LIKE.strings)),
    "elixir": Rules(line=("#",), strings=(('"""', '"""', "\\", True), ('"', '"', "\\", True), ("'", "'", "\\", False)), char_literals=True),
    "haskell": Rules(line=("--",), block=(("{-", "-}"),), nested=True, strings=(('"', '"', "\\", False), ("'", "'", "\\", False)), char_literals=True),
    "bash": Rules(line_at_start=("#",), strings=(('"', '"', "\\", True), ("'", "'", "", True))),
}

CHAIN = rf"{IDENT}(?:\s*(?:\?\.|\.|::|->)\s*{IDENT})*"
C_WORDS = frozenset(
    "if else for while switch case return catch try do new delete throw sizeof alignof void const decltype noexcept static_cast dynamic_cast reinterpret_cast const_cast "
    "struct enum union class operator template typename using namespace defined".split()
)
KEYWORDS = C_WORDS | frozenset(
    "typeof instanceof in of function def fn func let var import export from as async await yield super with interface trait impl and or not is synchronized assert foreach lock "
    "fixed checked unchecked nameof default".split()
)
#: Words before a parenthesis that call nothing, by language.
WORDS = {
    "c": C_WORDS, "cpp": C_WORDS, "objectivec": C_WORDS, "go": KEYWORDS | {"go", "defer", "range", "select", "type", "struct", "chan", "map"}, "rust": KEYWORDS | {"match", "loop", "pub", "where"},
    "php": KEYWORDS | {"echo", "print", "isset", "unset", "empty", "list", "array", "require", "include", "require_once", "include_once", "elseif", "match", "exit", "die"},
    "lua": frozenset("and or not if elseif while until return function local in for do then repeat end nil true false".split()),
    "elixir": KEYWORDS | {"cond", "unless", "when", "do", "end"}, "ruby": KEYWORDS | {"unless", "until", "when", "then", "elsif"}, "scala": KEYWORDS | {"match"}, "swift": KEYWORDS | {"guard", "repeat", "where"},
}


def _tail(text: str) -> str:
    return re.split(r"\.|::|->", text)[-1].strip()


def _tidy(text: str) -> str:
    return re.sub(r"\s+|\?(?=\.)", "", text)


def scan(f: Facts, pattern: str, flags: int = re.M, on: str = "code") -> Iterator[re.Match]:
    return re.compile(pattern, flags).finditer(getattr(f.source, on))


def quoted(f: Facts, pattern: str) -> Iterator[tuple[str, int, int]]:
    """Matches whose last group is a string's contents; the text around them must be code."""
    for m in re.compile(pattern, re.M).finditer(f.source.text):
        if f.source.code[m.start()] == f.source.text[m.start()] and not f.source.code[m.start()].isspace():
            k = m.lastindex
            yield m[k], m.start(k) - 1, m.end(k) + 1


class Nest:
    """Which bracket an offset stands in directly."""

    def __init__(self, s: Source):
        self.code, self.opens, self.ends = s.code, sorted(s.pairs), s.pairs
        self.up: dict[int, int] = {}
        stack: list[int] = []
        for a in self.opens:
            while stack and s.pairs[stack[-1]] < a:
                stack.pop()
            self.up[a] = stack[-1] if stack else -1
            stack.append(a)

    def parent(self, at: int) -> int:
        """The offset of the innermost open bracket around an offset, or -1."""
        k = bisect.bisect_left(self.opens, at) - 1
        a = self.opens[k] if k >= 0 else -1
        while a >= 0 and self.ends[a] < at:
            a = self.up[a]
        return a

    def before(self, at: int, marks: str = ";{}(") -> str:
        """The text from the last of some marks up to an offset, in the same bracket or from its start."""
        a = max([self.parent(at), *(self.code.rfind(c, max(0, at - 400), at) for c in marks)])
        return self.code[a + 1 : at]


def bodies_of(s: Source, head: str) -> set[int]:
    """Offsets of the braces that open after a head."""
    return {m.end() - 1 for m in re.compile(rf"{head}[^;{{}}()]*\{{").finditer(s.code)}


def calls(f: Facts, full: bool, words: frozenset[str] = KEYWORDS, heads: str = "", generics: bool = False, pattern: str | None = None, skip: Callable[[int, str], bool] | None = None) -> None:
    """Names before a parenthesis; full keeps the receiver. heads: a pattern that marks a definition right before the name; skip: (offset, name)."""
    between = r"\s*(?:::)?(?:<[\w\s,.<>\[\]?:&*]*>)?" if generics else r"\s*"
    head = re.compile(rf"(?:{heads})\s*$") if heads else None
    for m in scan(f, pattern or rf"(?<![\w.$:>\x80-\xff])({CHAIN}){between}\("):
        text = _tidy(m[1])
        last = _tail(text)
        if last in words:
            continue
        if head and head.search(f.source.code, max(0, m.start() - 60), m.start()) or skip and skip(m.start(), text):
            continue
        f.add_call(text if full else last, m.end(1) - len(last), m.end(1))
    # a call on a call's result: the receiver has no name
    for m in scan(f, rf"[)\]]\s*\??\.\s*({IDENT}){between}\("):
        f.add_call(f"().{m[1]}" if full else m[1], m.start(1), m.end(1))


def news(f: Facts, pattern: str = rf"\bnew\s+({IDENT}(?:\s*(?:\.|::)\s*{IDENT})*)", full: bool = False) -> None:
    for m in scan(f, pattern):
        text = _tidy(m[1])
        f.add_call(text if full else _tail(text), m.start(1), m.end(1))


def enclosing(f: Facts, blocks: list[tuple[int, int]], at: int) -> tuple[int, int] | None:
    """The innermost of some blocks that holds an offset."""
    best = None
    for a, b in blocks:
        if a < at < b and (best is None or a > best[0]):
            best = (a, b)
    return best


def word_in_head(head: str, *words: str) -> bool:
    return bool(re.search(rf"\b(?:{'|'.join(words)})\b", head))


# --- JavaScript and TypeScript


def _ecma(f: Facts, typed: bool) -> None:
    s = f.source
    rel = lambda raw: "local" if raw.startswith(".") else "external"
    forms = [
        r"\bimport\s+(?:type\s+)?(?:[\w*${},\s]+?\s+from\s*)?[\"']([^\"'\n]+)[\"']",
        r"\bexport\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*[\"']([^\"'\n]+)[\"']",
        r"(?<![\w.])(?:require|import)\s*\(\s*[\"']([^\"'\n]+)[\"']\s*[,)]",
    ]
    if typed:
        forms.append(r"\bimport\s+\w+\s*=\s*require\s*\(\s*[\"']([^\"'\n]+)[\"']")
    forms.append(r"\bnew\s+URL\s*\(\s*[\"']([^\"'\n]+)[\"']\s*,")
    found = sorted((a, b, raw) for p in forms for raw, a, b in quoted(f, p))
    for a, b, raw in found:
        f.add_import(raw, rel(raw), a, b)
    braces = s.depth_braces()
    top = lambda at: enclosing(f, braces, at) is None
    name = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
    for m in scan(f, rf"(export\s+(?:default\s+)?)?((?:async\s+)?function\s*\*?\s*({name}))"):
        if top(m.start(2)):
            f.add_symbol(m[3], "function", bool(m[1]), m.start(2), s.body_end(m.end()))
    for m in scan(f, rf"(export\s+)?\b(?:const|let|var)\s+(({name})(?:\s*:[^=\n]+)?\s*=\s*(?:async\s*)?(?:function\b|(?:<[^>\n]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n]+)?=>|{name}\s*=>))"):
        if top(m.start(2)):
            f.add_symbol(m[3], "function", bool(m[1]), m.start(2), _value_end(s, m.end()))
    classes, heads = [], set()
    for m in scan(f, rf"(export\s+(?:default\s+)?)?((?:abstract\s+)?class\s+({name}))"):
        if top(m.start(2)):
            end = s.body_end(m.end())
            f.add_symbol(m[3], "class", bool(m[1]), m.start(2), end)
            classes.append((s.code.find("{", m.end()), end - 1))
    for a, b in classes:
        inner = [(x, y) for x, y in s.pairs.items() if a < x < y <= b]
        for m in re.compile(rf"(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+|\*\s*)*(#?{name})\s*(?:<[^>\n]*>)?\(").finditer(s.code, a + 1, b):
            close = s.pairs.get(m.end() - 1)
            if close is None or enclosing(f, inner, m.start()) or m[1] in KEYWORDS or re.search(r"[.=]\s*$", s.code[a : m.start()][-4:]):
                continue
            if re.match(r"\s*(?::[^;{}=]+(?:\{[^{}]*\}[^;{}=]*)?)?\{", s.code[close + 1 :]):
                f.add_symbol(m[1], "method", False, m.start(), s.body_end(close + 1))
                heads.add(s.span(m.start(1), m.end(1)))
    nest, types = Nest(s), bodies_of(s, r"\b(?:class|interface)\b")
    member = re.compile(r"[\s*#]*(?:(?:public|private|protected|static|async|readonly|override|abstract|declare|get|set)\b[\s*#]*)*\Z")

    def signature(at: int, text: str) -> bool:
        # a member's head, with a body or without, and `import x = require()`
        if nest.parent(at) in types:
            own = nest.before(at)
            return bool(member.match(own) or member.match(own.rpartition("\n")[2]) and not re.search(r"[=.,+\-*/?:&|]\s*\Z", own.rpartition("\n")[0]))
        return typed and text == "require" and bool(re.search(r"\bimport\s+\w+\s*=\s*\Z", s.code[max(0, at - 80) : at]))

    calls(f, True, heads=r"function\s*\*?|class|\bnew", generics=typed, skip=signature, pattern=rf"(?<![\w.$\x80-\xff])({name}(?:\s*\??\.\s*#?{name})*)\s*{'(?:<[^()<>=]*>)?' if typed else ''}\(")
    f.calls = [c for c in f.calls if c[1] not in heads]
    news(f, rf"\bnew\s+({name}(?:\s*\.\s*{name})*)", full=True)
    if typed:
        for m in scan(f, r":\s*([A-Z][\w$]*)|<\s*([A-Z][\w$]*)|\b(?:extends|implements)\s+([A-Za-z_$][\w$.]*)"):
            k = m.lastindex
            f.add_call(m[k], m.start(k), m.end(k))


def _value_end(s: Source, at: int) -> int:
    """End of an arrow or function value."""
    rest = re.match(r"\s*", s.code[at:]).end() + at
    if s.code[rest : rest + 1] == "{" or s.code[at - 8 : at].endswith("function"):
        return s.body_end(rest)
    return s.body_end(rest, ";\n").__index__() - (s.code[s.body_end(rest, ";\n") - 1] in ";\n")


# --- the C family


def _includes(f: Facts, marks: str = "include") -> None:
    for m in scan(f, rf'^[ \t]*#[ \t]*(?:{marks})[ \t]*(?:"([^"\n]+)"|<([^>\n]+)>)', on="text"):
        k = m.lastindex
        f.add_import(m[k], "local" if k == 1 else "system", m.start(k) - 1, m.end(k) + 1)


_FUNCTION = re.compile(rf"(?:^|(?<=[;{{}}]))[ \t]*((?:[A-Za-z_][\w:<>,*&~ \t\x80-\xff]*?[\s*&])?)((?:{IDENT}\s*::\s*)*~?{IDENT}|operator\s*[^\s(]+)\s*\(", re.M)


def _functions(f: Facts, kind: Callable[[str, int], str], classes: list[tuple[int, int]] = ()) -> None:
    s = f.source
    bodies: list[tuple[int, int]] = []
    for m in _FUNCTION.finditer(s.code):
        close = s.pairs.get(m.end() - 1)
        last = _tail(m[2])
        if close is None or last in C_WORDS or enclosing(f, bodies, m.start(2)) or re.search(r"\b(?:return|else|typedef|new|throw)\b", m[1]) or "#" in m[1]:
            continue
        after = re.match(r"[\s\w]*?(?:->[^{;]+?)?(?::[^;{]*(?:\{[^{}]*\}[^;{]*)*)?\s*\{", s.code[close + 1 : close + 600])
        if not after or re.match(r"\s*[,;=)]", s.code[close + 1 :]):
            continue
        if not m[1].strip() and "::" not in m[2] and not classes:
            continue
        open_ = close + after.end()
        end = s.pairs.get(open_, len(s.code) - 1) + 1
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        bodies.append((start, end))
        f.add_symbol(last, kind(m[2], m.start(2)), "static" not in m[1].split(), start, end)


def _directives(s: Source) -> list[tuple[int, int]]:
    """Spans of preprocessor lines with their continuations."""
    return [m.span() for m in re.finditer(r"^[ \t]*#[^\n]*(?:(?<=\\)\n[^\n]*)*", s.code, re.M)]


_TYPE_WORDS = frozenset("int char long short float double unsigned signed bool auto size_t".split())
_NO_TYPE = re.compile(r"\b(?:return|else|throw|case|goto|new|delete|do|co_await|co_return|co_yield|and|or|not)\b")
_TYPE_BEFORE = re.compile(r"\s*(?:(?:public|private|protected)\s*:\s*)*(?:[A-Za-z_][\w:]*(?:\s*<[^;{}()]*>)?[\s*&]+)+\Z")


def _declared(f: Facts) -> Callable[[int, str], bool]:
    """Whether a name before a parenthesis is declared there: on a preprocessor line, behind a type, or a member of a class."""
    s = f.source
    lines, nest = _directives(s), Nest(s)
    starts, types = [a for a, _ in lines], bodies_of(s, r"\b(?:class|struct|union)\b")

    def test(at: int, text: str) -> bool:
        k = bisect.bisect_right(starts, at) - 1
        if k >= 0 and at < lines[k][1]:
            return True
        if text in _TYPE_WORDS:
            return True
        own = nest.before(at)
        if k >= 0 and lines[k][1] > at - len(own):
            own = own[lines[k][1] - (at - len(own)) :]
        if nest.parent(at) in types:
            return "=" not in own
        return bool(_TYPE_BEFORE.match(own)) and not _NO_TYPE.search(own)

    return test


def c(f: Facts) -> None:
    s = f.source
    _includes(f)
    _functions(f, lambda n, at: "function")
    tags = set()
    for m in scan(f, rf"(typedef\s+)?\b(struct|enum|union)\s+({IDENT})?\s*\{{"):
        end = s.pairs.get(m.end() - 1, len(s.code) - 1) + 1
        if m[3] and m[2] != "union":
            tags.add(m[3])
            f.add_symbol(m[3], "class", True, m.start(2), end)
        if m[1]:
            for d in re.finditer(rf"({IDENT})\s*(?=[,;])", s.code[end : s.code.find(";", end) + 1]):
                if d[1] not in tags:
                    f.add_symbol(d[1], "class", True, m.start(), end + d.end())
    calls(f, True, C_WORDS, skip=_declared(f))
    _drop_heads(f)


def _drop_heads(f: Facts) -> None:
    """Definitions aren't calls: drop a call whose name is that of a symbol that starts on its line or whose head holds it."""
    heads = {(n, line) for n, k, _, (line, *_r) in f.symbols if k != "class"}
    f.calls = [c for c in f.calls if (_tail(c[0]), c[1][0]) not in heads]


def cpp(f: Facts) -> None:
    s = f.source
    _includes(f)
    classes = []
    for m in scan(f, rf"\b(?:class|struct|enum(?:\s+class)?|namespace)\s+({IDENT}(?:::{IDENT})*)\b[^;{{}}()=]*\{{"):
        end = s.pairs.get(m.end() - 1, len(s.code) - 1) + 1
        f.add_symbol(m[1], "class", True, m.start(), end)
        if not m[0].startswith("namespace"):
            classes.append((m.end() - 1, end))
    _functions(f, lambda n, at: "method" if "::" in n or enclosing(f, classes, at) else "function", classes or [(-1, -1)])
    f.sort()
    declared = _declared(f)
    for m in scan(f, rf"(?<![\w.:>\x80-\xff])({CHAIN})\s*(?:<[\w\s,:*&<>]*>)?\s*\("):
        text = _tidy(m[1])
        last = _tail(text)
        if last not in C_WORDS and not re.search(r"\bnew\s+\Z", s.code[max(0, m.start() - 40) : m.start()]) and not declared(m.start(), text):
            f.add_call(last if "::" in text else text, m.end(1) - len(last), m.end(1))
    news(f)
    _drop_heads(f)


def objectivec(f: Facts) -> None:
    s = f.source
    _includes(f, "include|import")
    for m in scan(f, rf"^[ \t]*@import\s+({IDENT}(?:\.{IDENT})*)\s*;"):
        f.add_import(m[1], "system", m.start(1), m.end(1))
    _functions(f, lambda n, at: "function")
    f.symbols = [(n, k, True, sp) for n, k, _, sp in f.symbols]
    for m in scan(f, rf"^[ \t]*@(?:interface|implementation)\s+({IDENT})"):
        end = s.code.find("@end", m.end())
        f.add_symbol(m[1], "class", True, m.start() + len(m[0]) - len(m[0].lstrip()), end + 4 if end >= 0 else len(s.code.rstrip()))
    for m in scan(f, rf"^[ \t]*([-+]\s*\([^)]*\)\s*({IDENT}))"):
        f.add_symbol(m[2], "method", True, m.start(1), s.body_end(m.end()))
    calls(f, False, C_WORDS, skip=_declared(f))
    for m in scan(f, r"\["):
        close = s.pairs.get(m.start())
        if close is None:
            continue
        inner = re.sub(r"[(\[{][^()\[\]{}]*[)\]}]", lambda x: "_" * len(x[0]), s.code[m.end() : close])
        inner = re.sub(r"[(\[{][^()\[\]{}]*[)\]}]", lambda x: "_" * len(x[0]), inner)
        sel = re.match(rf"\s*[\w.@\"_\x80-\xff]+\s+({IDENT})\s*(?::|$)", inner)
        if sel:
            f.add_call(sel[1], m.end() + sel.start(1), m.end() + sel.end(1))
    _drop_heads(f)


# --- Java, C#, Scala, Swift, Go, Zig, PHP


def _members(f: Facts, types: str, skip: frozenset[str], rule: Callable[[str, str, bool], bool], type_rule: Callable[[str], bool], constructor: bool = True) -> None:
    """Types and their methods in languages with modifiers before a name."""
    s = f.source
    blocks: list[tuple[int, int, str, str]] = []
    mods = r"((?:(?:@\w+(?:\([^)]*\))?|\[[^\]\n]*\]|public|private|protected|internal|static|final|abstract|sealed|partial|readonly|strictfp|default|virtual|override|async|unsafe|extern|new|synchronized|native|non-sealed)\s+)*)"
    for m in scan(f, rf"{mods}\b({types})\s+({IDENT})"):
        if s.code[m.start(2) - 1 : m.start(2)] in (".", "@") and s.code[m.start(2) - 1] == ".":
            continue
        end = s.body_end(m.end())
        start = m.start(1) if m[1] else m.start(2)
        f.add_symbol(m[3], "class", type_rule(m[1]), start, end)
        blocks.append((s.code.find("{", m.end(), end), end, m[2].split()[-1], m[3]))
    spans = [(a, b) for a, b, _, _ in blocks if a >= 0]
    kinds = {a: (k, n) for a, _, k, n in blocks}
    bodies: list[tuple[int, int]] = []
    for m in scan(f, rf"(?<![\w.]){mods}((?:<[^<>(){{}};]*(?:<[^<>]*>[^<>(){{}};]*)*>\s*)?(?:{IDENT}(?:\.{IDENT})*(?:<[^(){{}};]*>)?(?:\s*\[\s*\])*\??\s+)?)({IDENT})\s*(?:<[^<>(){{}};]*>)?\("):
        own = enclosing(f, spans, m.start(3))
        close = s.pairs.get(m.end() - 1)
        if own is None or close is None or m[3] in KEYWORDS | skip or enclosing(f, bodies, m.start(3)):
            continue
        kind, type_name = kinds[own[0]]
        returns = m[2].strip()
        if not returns and not (constructor and m[3] == type_name) or returns.split()[:1] and returns.split()[0] in ("return", "new", "else", "throw", "await", "yield"):
            continue
        if not re.match(r"[^;{}=]*(?:\{|;|=>)", s.code[close + 1 :]):
            continue
        end = s.body_end(close + 1)
        start = m.start(1) if m[1] else m.start(2) if returns else m.start(3)
        bodies.append((m.start(3), end))
        f.add_symbol(m[3], "method", rule(m[1], kind, True), start, end)


def java(f: Facts) -> None:
    for m in scan(f, rf"^[ \t]*import\s+(?:static\s+)?({IDENT}(?:\.{IDENT})*(?:\.\*)?)\s*;"):
        f.add_import(m[1], "external", m.start(1), m.end(1))
    _members(f, "class|interface|@interface|enum|record", frozenset(), lambda mods, kind, _: "public" in mods.split() or (kind == "interface" and "private" not in mods.split()), lambda mods: "public" in mods.split())
    calls(f, False, heads=r"\bnew|@|\brecord")
    news(f)
    _drop_heads(f)


def csharp(f: Facts) -> None:
    for m in scan(f, rf"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:{IDENT}\s*=\s*)?({IDENT}(?:\.{IDENT})*)\s*;"):
        f.add_import(m[1], "external", m.start(1), m.end(1))
    public = lambda mods, *_: "public" in mods.split()
    _members(f, r"class|interface|struct|enum|record(?:\s+(?:class|struct))?", frozenset(), public, public)
    calls(f, False, generics=True, heads=r"\bnew|\b(?:class|struct|record(?:\s+(?:class|struct))?)")
    news(f)
    _drop_heads(f)


def scala(f: Facts) -> None:
    s = f.source
    for m in scan(f, r"^[ \t]*import\s+([^\n;]+)"):
        for raw, at in _scala_clauses(m[1], m.start(1)):
            f.add_import(raw, "external", at, at + len(raw))
    for m in scan(f, rf"((?:(?:private|protected|final|sealed|abstract|implicit|case|override|lazy|inline|open)(?:\[\w+\])?\s+)*)\b(class|object|trait|def)\s+({IDENT})"):
        if m[2] == "def":
            end = _scala_end(s, m.end())
        else:
            tail = re.match(r"[^\n{]*(?:\{)?", s.code[m.end() :])
            end = s.body_end(m.end()) if tail and tail[0].endswith("{") else m.end() + len(tail[0].rstrip())
        start = m.start(1) if m[1] else m.start(2)
        f.add_symbol(m[3], "function" if m[2] == "def" else "class", "private" not in m[1], start, end)
    calls(f, False, WORDS["scala"], heads=r"\bdef|\bclass|\bobject|\btrait", generics=False, pattern=rf"(?<![\w.\x80-\xff])({CHAIN})(?:\[[^\]\n]*\])?\(")


def _scala_end(s: Source, at: int) -> int:
    i = at
    while i < len(s.code):
        c = s.code[i]
        if c in "([":
            i = s.pairs.get(i, i)
        elif c == "{":
            return s.pairs.get(i, len(s.code) - 1) + 1
        elif c == "\n" and not re.match(r"\s*[={]", s.code[i:]) and not re.search(r"=\s*$", s.code[at:i]):
            return i
        i += 1
    return len(s.code.rstrip())


def _scala_clauses(text: str, at: int) -> list[tuple[str, int]]:
    """Clauses split at commas outside braces; selectors expand to their original names; `given` stays the prefix."""
    out, depth, start = [], 0, 0
    parts = []
    for i, c in enumerate(text + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append((text[start:i], start))
            start = i + 1
    for part, offset in parts:
        m = re.match(rf"\s*([^{{}}]+?)\.\{{([^}}]*)\}}", part)
        if not m:
            raw = re.split(r"\s+as\s+|=>", part.strip())[0].strip()
            out.append((re.sub(r"\.given\b.*$", "", raw), at + offset + len(part) - len(part.lstrip())))
            continue
        for item in m[2].split(","):
            own = re.split(r"=>|\s+as\s+", item.strip())[0].strip()
            if own:
                raw = m[1].strip() if own.startswith("given") else f"{m[1].strip()}.{own}"
                out.append((raw, at + offset))
    return [(re.sub(r"\s+", "", r), p) for r, p in out]


def swift(f: Facts) -> None:
    s = f.source
    for m in scan(f, rf"^[ \t]*(?:@\w+\s+)*import\s+(?:(?:struct|class|enum|protocol|func|var|let|typealias)\s+)?({IDENT}(?:\.{IDENT})*)"):
        f.add_import(m[1], "external", m.start(1), m.end(1))
    types: list[tuple[int, int]] = []
    for m in scan(f, rf"((?:(?:@\w+|public|private|fileprivate|internal|open|final|static|override|mutating|indirect|required|convenience|class(?=\s+func))(?:\(set\))?\s+)*)\b(class|struct|enum|protocol|actor|func)\s+({IDENT}|[-+*/<>=!]+)"):
        if re.search(r"\bimport[ \t]+\Z", s.code[max(0, m.start(2) - 20) : m.start(2)]):
            continue
        end = s.body_end(m.end(), "\n" if m[2] == "func" else ";")
        exported = not word_in_head(m[1], "private", "fileprivate")
        start = m.start(1) if m[1] else m.start(2)
        if m[2] == "func":
            f.add_symbol(m[3], "method" if enclosing(f, types, m.start(2)) else "function", exported, start, end)
        else:
            types.append((m.end(), end))
            f.add_symbol(m[3], "class", exported, start, end)
    nest, enums = Nest(s), bodies_of(s, r"\benum\b")
    # `init` without a receiver and the cases of an enum are declared there
    calls(f, True, WORDS["swift"], heads=r"\bfunc", skip=lambda at, text: text in ("init", "subscript") or nest.parent(at) in enums and bool(re.match(r"\s*(?:indirect\s+)?case\b", nest.before(at).rpartition("\n")[2])))


def go(f: Facts) -> None:
    s = f.source
    rel = lambda raw: "local" if raw.startswith(("./", "../")) else "external"
    for m in scan(f, r'^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"', on="text"):
        f.add_import(m[1], rel(m[1]), m.start(1) - 1, m.end(1) + 1)
    for m in scan(f, r"^[ \t]*import\s*\("):
        close = s.pairs.get(m.end() - 1, m.end())
        for q in re.finditer(r'"([^"\n]+)"', s.text[m.end() : close]):
            f.add_import(q[1], rel(q[1]), m.end() + q.start(), m.end() + q.end())
    upper = lambda n: n[:1].isupper()
    for m in scan(f, rf"^func\s*(\([^)]*\)\s*)?({IDENT})"):
        f.add_symbol(m[2], "method" if m[1] else "function", upper(m[2]), m.start(), s.body_end(m.end(), "\n"))
    for m in scan(f, rf"^[ \t]*type\s+({IDENT})"):
        f.add_symbol(m[1], "class", upper(m[1]), m.start(1), s.body_end(m.end(), "\n") - (s.code[s.body_end(m.end(), "\n") - 1] == "\n"))
    for m in scan(f, r"^[ \t]*type\s*\("):
        close, at = s.pairs.get(m.end() - 1, m.end()), m.end()
        while t := re.compile(rf"[\s;]*({IDENT})").match(s.code, at, close):
            end = min(s.body_end(t.end(), "\n"), close)
            f.add_symbol(t[1], "class", upper(t[1]), t.start(1), end - (s.code[end - 1] == "\n"))
            at = max(end, t.end())
    nest, methods = Nest(s), {m.end() - 1 for m in scan(f, r"\binterface\s*\{")}
    calls(f, True, WORDS["go"], heads=r"\bfunc(?:\s*\([^)]*\))?", generics=False, skip=lambda at, _: nest.parent(at) in methods)


def zig(f: Facts) -> None:
    s = f.source
    for raw, a, b in quoted(f, r'@import\s*\(\s*"([^"\n]+)"'):
        f.add_import(raw, "local" if raw.endswith(".zig") or "/" in raw else "external", a, b)
    braces = s.depth_braces()
    for m in scan(f, rf"((?:pub|export|extern|inline)\s+)*\bfn\s+({IDENT})"):
        start = m.start()
        f.add_symbol(m[2], "function", "pub" in s.code[start : m.start(2)].split(), start, s.body_end(m.end()))
    for m in scan(f, rf"((?:pub|export|extern|threadlocal)\s+)*\b(?:const|var)\s+({IDENT})\s*(?::[^=\n]+)?=\s*((?:packed|extern)\s+)?(struct|enum|union)?"):
        if m[2] != "_" and enclosing(f, braces, m.start()) is None:
            f.add_symbol(m[2], "class" if m[4] else "function", "pub" in s.code[m.start() : m.start(2)].split(), m.start(), s.body_end(m.end()) if not m[4] else _after_semicolon(s, s.body_end(m.end())))
    calls(f, True, heads=r"\bfn")


def _after_semicolon(s: Source, at: int) -> int:
    m = re.compile(r"\s*;").match(s.code, at)
    return m.end() if m else at


def php(f: Facts) -> None:
    s = f.source
    braces = s.depth_braces()
    scopes: list[tuple[int, int]] = []
    for m in scan(f, rf"((?:(?:abstract|final|readonly)\s+)*)\b(class|interface|trait|enum|namespace)\s+({IDENT}(?:\\{IDENT})*)[^;{{}}()]*\{{"):
        if m[2] == "namespace":
            continue
        end = s.pairs.get(m.end() - 1, len(s.code) - 1) + 1
        scopes.append((m.end() - 1, end))
    spaces = [(m.end() - 1, s.pairs.get(m.end() - 1, len(s.code))) for m in scan(f, r"\bnamespace\b[^;{}]*\{")]
    outer = lambda at: all((a, b) in spaces for a, b in braces if a < at < b)
    for m in scan(f, rf"^[ \t]*use\s+(?:function\s+|const\s+)?\\?({IDENT}(?:\\{IDENT})*)(\\?\{{[^}}]*\}})?"):
        if enclosing(f, scopes, m.start()):
            continue
        if m[2]:
            for item in m[2].strip("\\{}").split(","):
                own = re.sub(r"^(?:function|const)\s+", "", re.split(r"\s+as\s+", item.strip())[0])
                if own:
                    f.add_import(f"{m[1]}\\{own}", "external", m.start(1), m.end())
            continue
        for item in s.code[m.start(1) : s.code.find(";", m.end())].split(","):
            own = re.split(r"\s+as\s+", item.strip())[0].lstrip("\\")
            if re.fullmatch(rf"{IDENT}(?:\\{IDENT})*", own):
                f.add_import(own, "external", m.start(1), m.end(1))
    for raw, a, b in quoted(f, r"\b(?:include|require)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?[\"']([^\"'\n$]+)[\"']"):
        f.add_import(raw, "local" if raw.startswith(".") else "external", a, b)
    for m in scan(f, rf"((?:(?:abstract|final|readonly)\s+)*)\b(class|interface|trait|enum)\s+({IDENT})[^;{{}}()]*\{{"):
        start = m.start(1) if m[1] else m.start(2)
        f.add_symbol(m[3], "class", outer(m.start(2)), start, s.pairs.get(m.end() - 1, len(s.code) - 1) + 1)
    for m in scan(f, rf"((?:(?:public|private|protected|static|abstract|final)\s+)*)\bfunction\s+&?\s*({IDENT})\s*\("):
        own = enclosing(f, scopes, m.start())
        inner = enclosing(f, braces, m.start())
        method = own is not None and inner is not None and inner[0] == own[0]
        start = m.start(1) if m[1] else m.start()
        f.add_symbol(m[2], "method" if method else "function", "public" in m[1].split() if method else outer(m.start()), start, s.body_end(m.end() - 1))
    for m in scan(f, rf"(?<![\w$\\\x80-\xff])((?:\$?{IDENT}\s*(?:->|\?->|::)\s*)?)(\\?{IDENT}(?:\\{IDENT})*)\s*\("):
        if _tail(m[2]) in WORDS["php"] or re.search(r"\b(?:function|new)\s+&?\s*$", s.code[max(0, m.start() - 20) : m.start()]):
            continue
        text = _tidy(m[1]) + m[2] if "::" in m[1] else m[2]
        f.add_call(text, m.start(2), m.end(2))
    for m in scan(f, rf"(?:->|\?->)\s*({IDENT})\s*\("):
        if not any(c[0] == m[1] and c[1] == s.span(m.start(1), m.end(1)) for c in f.calls[-200:]):
            f.add_call(m[1], m.start(1), m.end(1))
    for m in scan(f, rf"\bnew\s+\\?({IDENT}(?:\\{IDENT})*)"):
        f.add_call(m[1].split("\\")[-1], m.start(1), m.end(1))


# --- Rust


def expand_use(tree: str) -> list[str]:
    """A use tree as single paths: braces expand, aliases go, `self` in braces is its prefix."""
    tree = re.sub(r"\s+as\s+\w+", "", tree.strip())
    tree = re.sub(r"\s+", "", tree).lstrip(":")
    m = re.match(r"([^{}]*)\{(.*)\}$", tree, re.S)
    if not m:
        return [tree] if tree else []
    out, depth, start = [], 0, 0
    body = m[2] + ","
    for i, c in enumerate(body):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            for item in expand_use(body[start:i]):
                out.append(m[1].rstrip(":") if item == "self" and m[1] else m[1] + item)
            start = i + 1
    return out


def rust(f: Facts) -> None:
    s = f.source
    inline = []  # (open, close, name)
    for m in scan(f, rf"\bmod\s+({IDENT})\s*\{{"):
        inline.append((m.end() - 1, s.pairs.get(m.end() - 1, len(s.code)), m[1]))

    def chain(at: int) -> list[str]:
        return [n for a, b, n in sorted(inline) if a < at < b]

    found: list[tuple[int, str, str, int]] = []
    for m in scan(f, rf"\bmod\s+({IDENT})\s*;"):
        attrs = re.search(r"((?:#\s*\[[^\]]*\]\s*)*)(?:pub(?:\([^)]*\))?\s+)?$", s.text[: m.start()])
        own = re.search(r'path\s*=\s*"([^"]+)"', attrs[1]) if attrs else None
        outer = chain(m.start())
        raw = own[1] if own else "::".join(["self", *outer, m[1]]) if outer else m[1]
        found.append((m.start(1), raw, "local", m.end(1)))
    for m in scan(f, r"(?<![\w.])use\s+([^;]+);"):
        outer = chain(m.start())
        for raw in expand_use(m[1]):
            raw = _rebase(raw, outer)
            if raw:
                local = raw.split("::")[0] in ("crate", "self", "super")
                found.append((m.start(1), raw, "local" if local else "external", m.end(1)))
    for m in scan(f, rf"\bextern\s+crate\s+({IDENT})"):
        found.append((m.start(1), m[1], "external", m.end(1)))
    for a, raw, kind, b in sorted(found, key=lambda x: x[0]):
        f.add_import(raw, kind, a, b)
    vis = r"((?:pub(?:\s*\([^)]*\))?\s+)?)"
    owners = []
    for m in scan(f, r"\b(?:impl|trait)\b[^;{}]*\{"):
        owners.append((m.end() - 1, s.pairs.get(m.end() - 1, len(s.code))))
    for m in scan(f, rf"{vis}((?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*)\bfn\s+({IDENT})"):
        start = next(m.start(k) for k in (1, 2, 0) if k == 0 or m[k])
        inner = enclosing(f, s.depth_braces(), m.start(3))
        kind = "method" if inner and any(a == inner[0] for a, _ in owners) else "function"
        f.add_symbol(m[3], kind, bool(m[1]), start, s.body_end(m.end()))
    for m in scan(f, rf"{vis}\b(struct|enum|union|trait|type)\s+({IDENT})"):
        start = m.start(1) if m[1] else m.start(2)
        end = s.body_end(m.end())
        if m[2] == "struct":
            end = _after_semicolon(s, end) if s.code[end - 1] == ")" else end
        f.add_symbol(m[3], "class", bool(m[1]), start, end)
        if m[2] == "enum":
            open_ = s.code.find("{", m.end(), end)
            at = open_ + 1
            while open_ >= 0 and (v := re.compile(rf"(?:\s|,|#\s*\[[^\]]*\])*({IDENT})").match(s.code, at, end)):
                stop = v.end()
                while stop < end - 1 and s.code[stop] != ",":
                    stop = s.pairs.get(stop, stop) + 1 if s.code[stop] in "({[" else stop + 1
                f.add_symbol(v[1], "class", False, v.start(1), stop if s.code[stop - 1] != "\n" else v.end())
                at = stop
    for m in scan(f, rf"((?:#\s*\[[^\]]*\]\s*)*)\bmacro_rules!\s*({IDENT})"):
        f.add_symbol(m[2], "function", "macro_export" in m[1], m.start() + len(m[1]), s.body_end(m.end()))
    heads = {(x[3][0]) for x in f.symbols}
    nest, enums = Nest(s), bodies_of(s, r"\benum\b")
    uses = [m.span() for m in scan(f, r"(?<![\w.])use\s+[^;]+;")]
    use_starts = [a for a, _ in uses]

    def declared(at: int) -> bool:
        """A variant of an enum, or a name that a `use` brings in."""
        k = bisect.bisect_right(use_starts, at) - 1
        return nest.parent(at) in enums and "=" not in nest.before(at, ",{") or k >= 0 and at < uses[k][1]

    for m in scan(f, rf"(?<![\w.:\x80-\xff])({IDENT}(?:\s*(?:\.|::)\s*{IDENT})*)\s*(!)?\s*(?:::\s*<[^()]*>)?\s*([(\[{{])"):
        text, last = _tidy(m[1]), _tail(_tidy(m[1]))
        if not m[2] and m[3] != "(" or last in WORDS["rust"] or declared(m.start()):
            continue
        if re.search(r"\b(?:fn|macro_rules!|struct|enum|union)\s*$", s.code[max(0, m.start() - 16) : m.start()]) and s.span(m.start(), m.start())[0] in heads:
            continue
        f.add_call(text, m.end(1) - len(last), m.end(1))
    for m in scan(f, r"(?<![\w\x80-\xff])([A-Z][A-Za-z0-9_]*)(?!\s*[(!\w])"):
        if not re.search(r"\b(?:struct|enum|union|trait|type|fn|mod)\s+$", s.code[max(0, m.start() - 10) : m.start()]) and not m[1].isupper() and not declared(m.start()):
            f.add_call(m[1], m.start(1), m.end(1))
    for m in scan(f, r"#\s*!?\s*\[\s*([A-Za-z_]\w*)(?!\s*=|\w)(?:\s*\(([^\]]*)\))?"):
        f.add_call(m[1], m.start(1), m.end(1))
        if m[1] == "derive":
            for d in re.finditer(r"[A-Za-z_]\w*", m[2] or ""):
                if not d[0][:1].isupper():
                    f.add_call(d[0], m.start(2) + d.start(), m.start(2) + d.end())


def _rebase(raw: str, outer: list[str]) -> str:
    """A path inside inline modules, seen from the file: `super` leaves one inline level, `self` names the inner module."""
    if not outer:
        return raw
    parts = raw.split("::")
    level = list(outer)
    if parts[0] == "self":
        parts = parts[1:]
    elif parts[0] == "super":
        while parts and parts[0] == "super" and level:
            level.pop()
            parts = parts[1:]
        if not level and parts and parts[0] == "super":
            return "::".join(parts)
    else:
        return raw
    return "::".join(["self", *level, *parts])


# --- languages with `end`, layout or no brackets


def _end_blocks(f: Facts, openers: str, closer: str = r"\bend\b") -> list[tuple[int, int]]:
    """(start of the opener, end of its closer) pairs."""
    out, stack = [], []
    for m in re.finditer(rf"(?P<open>{openers})|(?P<close>{closer})", f.source.code, re.M):
        if m.lastgroup == "open" or m["open"] is not None:
            stack.append(m.start("open"))
        elif stack:
            out.append((stack.pop(), m.end()))
    return out


def ruby(f: Facts) -> None:
    s = f.source
    for m in scan(f, r"(?<![\w.])(require|require_relative|load|autoload)\b[ \t(]*(?::\w+[ \t]*,[ \t]*)?([\"'])([^\"'\n]*)\2", on="text"):
        raw = m[3]
        if "#{" in raw or s.code[m.start(1)] != s.text[m.start(1)]:
            continue
        f.add_import(raw, "local" if m[1] == "require_relative" or raw.startswith(("./", "../")) else "external", m.start(3) - 1, m.end(3) + 1)
    block = r"(?:^|(?<=[;=(]))[ \t]*(?:class|module|def(?![ \t]+[\w.?!]+(?:[ \t]+=|\([^)\n]*\)[ \t]*=)(?![=~>]))|if|unless|while|until|case|begin|for)\b|\bdo\b(?:[ \t]*\|[^|\n]*\|)?[ \t]*$"
    ends = {}
    for a, b in _end_blocks(f, block):
        ends[a + len(s.code[a:]) - len(s.code[a:].lstrip(" \t"))] = b
    for m in scan(f, rf"^[ \t]*(class|module)\s+(?!<<)((?:{IDENT}::)*{IDENT})"):
        at = m.start(1)
        f.add_symbol(m[2].split("::")[-1], "class", True, at, ends.get(at, s.line_end(at)))
    for m in scan(f, rf"^[ \t]*(?:(?:private|public|protected|module_function)\s+)?(def)\s+(self\.|{IDENT}\.)?({IDENT}[?!=]?|[-+*/<>=\[\]!~%]+)"):
        at = m.start(1)
        f.add_symbol(m[3], "method" if m[2] else "function", True, at, ends.get(at, ends.get(m.start(), s.line_end(at))))
    for m in scan(f, rf"(?<![\w:@$])({IDENT}(?:::{IDENT})*)?(\.|&\.)?({IDENT}[?!]?)[ \t]*(\()|(?<![\w:@$.])({IDENT}(?:::{IDENT})*|@?{IDENT})(?:\.|&\.)({IDENT}[?!]?)"):
        if m[4]:
            recv, call, at = (m[1] if m[2] else None), m[3], m.start(3)
            if not m[2] and m[1]:
                call, at = m[1] + m[3], m.start(1)
        else:
            recv, call, at = m[5], m[6], m.start(6)
        if call in WORDS["ruby"] or re.search(r"\bdef\s+(?:self\.)?$", s.code[max(0, m.start() - 12) : at]):
            continue
        if recv and recv[:1].isupper():
            f.add_call(f"{recv}.{call}", at, at + len(call))
            f.add_call(recv, at - len(recv) - 1, at - 1)
        else:
            f.add_call(call, at, at + len(call))


def lua(f: Facts) -> None:
    s = f.source
    for m in scan(f, r"(?<![\w.:])require\s*\(?\s*(?:\"([^\"\n]+)\"|'([^'\n]+)')", on="text"):
        if s.code[m.start()] == s.text[m.start()]:
            k = m.lastindex
            f.add_import(m[k], "local" if m[k].startswith(".") else "external", m.start(k) - 1, m.end(k) + 1)
    ends = dict(_end_blocks(f, r"\b(?:function|if|do|repeat)\b", r"\b(?:end|until)\b"))
    for m in scan(f, rf"(local\s+)?\b(function)\s+({IDENT}(?:\.{IDENT})*)(:{IDENT})?"):
        name = m[4][1:] if m[4] else m[3].split(".")[-1]
        table = bool(m[4]) or "." in m[3]
        f.add_symbol(name, "method" if m[4] else "function", table or not m[1], m.start(), ends.get(m.start(2), s.line_end(m.end())))
    for m in scan(f, rf"(local\s+)?({IDENT}(?:\.{IDENT})*)\s*=\s*(function)\b"):
        f.add_symbol(m[2].split(".")[-1], "function", "." in m[2] or not m[1], m.start(), ends.get(m.start(3), s.line_end(m.end())))
    for m in scan(f, rf"(?<![\w.:])({IDENT}(?:[.:]{IDENT})*)\s*(?=[(\"'{{]|\[\[)"):
        last = re.split(r"[.:]", m[1])[-1]
        if m[1] in WORDS["lua"] or re.search(r"\bfunction\s+$", s.code[max(0, m.start() - 12) : m.start()]) or s.code[m.end() : m.end() + 1] == "{" and "=" in s.code[m.start() : m.end()]:
            continue
        f.add_call(m[1], m.end(1) - len(last), m.end(1))


def elixir(f: Facts) -> None:
    s = f.source
    mod = r"[A-Z]\w*(?:\.[A-Z]\w*)*"
    found = []
    for m in scan(f, rf"^[ \t]*(?:import|alias|use|require)[ \t(]+({mod})(\.\{{[^}}]*\}})?"):
        if m[2]:
            found += [(m.start(1), f"{m[1]}.{x.strip()}", m.end()) for x in m[2][2:-1].split(",") if x.strip()]
        else:
            found.append((m.start(1), m[1], m.end(1)))
    for a, raw, b in found:
        f.add_import(raw, "external", a, b)
    ends = dict(_end_blocks(f, r"\b(?:do|fn)\b(?!:)"))
    starts = sorted(ends)

    def close(at: int) -> int:
        head_end = s.line_end(at)
        k = next((a for a in starts if at < a and (a <= head_end or not re.search(r"\S", s.code[head_end:a].replace(",", "")))), None)
        one_line = re.search(r",\s*do:", s.code[at:head_end])
        return head_end if one_line or k is None else ends[k]

    for m in scan(f, rf"^[ \t]*(defmodule)\s+({mod})"):
        f.add_symbol(m[2], "class", True, m.start(1), close(m.start(1)))
    for m in scan(f, rf"^[ \t]*(def|defp|defmacro|defmacrop)[ \t]+({IDENT}[?!]?)"):
        f.add_symbol(m[2], "function", not m[1].endswith("p"), m.start(1), close(m.start(1)))
    heads = {(n, sp[0]) for n, k, _, sp in f.symbols}
    definers = {"def", "defp", "defmacro", "defmacrop", "defmodule", "defstruct", "defimpl", "defprotocol", "defdelegate", "defguard", "defexception", "quote", "unquote", "cond"}
    for m in scan(f, rf"(?<![\w.@:])((?:(?:{mod}|{IDENT})\.)*{IDENT}[?!]?)\("):
        last = m[1].split(".")[-1]
        if last in WORDS["elixir"] | definers or (last, s.span(m.start(), m.start())[0]) in heads and "." not in m[1] and re.search(r"\bdef\w*[ \t]+$", s.code[max(0, m.start() - 14) : m.start()]):
            continue
        f.add_call(m[1], m.end(1) - len(last), m.end(1))


def haskell(f: Facts) -> None:
    s = f.source
    mod = r"[A-Z][\w']*(?:\.[A-Z][\w']*)*"
    for m in scan(f, rf"^import\s+(?:safe\s+)?(?:qualified\s+)?({mod})"):
        f.add_import(m[1], "external", m.start(1), m.end(1))
    head = re.search(rf"^module\s+({mod})\s*(\(.*?\)\s*where|where)", s.code, re.M | re.S)
    exports = None
    if head and head[2].startswith("("):
        body = head[2][1:].rsplit(")", 1)[0]
        if not re.search(rf"\bmodule\s+{re.escape(head[1])}\b", body):
            exports = set(re.findall(r"[A-Za-z_][\w']*", re.sub(r"\bmodule\s+\S+", "", body)))
    out = lambda n: exports is None or n in exports
    at = head.end() if head else 0
    tops = [m for m in re.compile(r"^\S[^\n]*", re.M).finditer(s.code, at)]
    seen: dict[str, int] = {}
    for k, m in enumerate(tops):
        limit = tops[k + 1].start() if k + 1 < len(tops) else len(s.code)
        end = m.start() + len(s.code[m.start() : limit].rstrip())
        t = re.match(r"(data|newtype|type|class)\s+(?:family\s+|instance\s+)?(?:[^=\n]*=>\s*)?([A-Z][\w']*)", m[0])
        if t:
            f.add_symbol(t[2], "class", out(t[2]), m.start(), end)
            continue
        d = re.match(r"([a-z_][\w']*)(?=[^\n]*(?:=|\|)|\s*$)", m[0])
        if not d or d[1] in ("module", "import", "instance", "where", "deriving", "infixl", "infixr", "infix", "foreign", "default") or re.match(r"[a-z_][\w']*(?:\s*,\s*[a-z_][\w']*)*\s*::", m[0]):
            continue
        if d[1] in seen:
            n, kind, ex, sp = f.symbols[seen[d[1]]]
            f.symbols[seen[d[1]]] = (n, kind, ex, (*sp[:2], *s.span(end, end)[:2]))
            continue
        seen[d[1]] = len(f.symbols)
        f.add_symbol(d[1], "function", out(d[1]), m.start(), end)
    words = frozenset("if then else case of let in where do data newtype type class instance module import deriving qualified as hiding infixl infixr forall".split())
    for m in scan(f, rf"(?<![\w'.])((?:{mod}\.)?[a-z_][\w']*)[ \t]+(?=[\w(\"'\[])"):
        before = s.code[max(0, m.start() - 2) : m.start()]
        if m[1] in words or m.start() in {s.starts[x[3][0] - 1] + x[3][1] for x in f.symbols} or (before[-1:].isspace() and re.search(r"[\w'\")\]][ \t]+$", s.code[max(0, m.start() - 30) : m.start()]) and not re.search(r"\b(?:then|else|of|in|do|return|if|case|let)[ \t]+$", s.code[max(0, m.start() - 12) : m.start()])) or before == "" or before[-1:] == "\n":
            continue
        f.add_call(m[1], m.start(1), m.end(1))


def bash(f: Facts) -> None:
    s = f.source
    for m in scan(f, r"(?:^|[;&|(]|\bthen\b|\bdo\b|\belse\b)[ \t]*(?:source|\.)[ \t]+(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s;&|\"'#)]+))", on="text"):
        k = m.lastindex
        raw = m[k]
        if not raw.startswith("$") and "$" not in raw:
            f.add_import(raw, "external" if raw.startswith("/") else "local", m.start(k), m.end(k))
    for m in scan(f, r"^[ \t]*(?:(function)[ \t]+([\w:.-]+)[ \t]*(?:\(\))?|([\w:.-]+)[ \t]*\(\))\s*(?=[{(])"):
        n = m[2] or m[3]
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        subshell = s.code[m.end() : m.end() + 1] == "("
        f.add_symbol(n, "function", True, start, s.pairs.get(m.end(), len(s.code) - 1) + 1 if subshell else s.body_end(m.end()))
    words = frozenset("if then else elif fi for while until do done case esac in function select time coproc".split())
    for m in scan(f, r"(?:^|[;&|(`{!])[ \t]*(?:(?:if|then|else|elif|while|until|do|time|!)[ \t]+)*((?:[A-Za-z_]\w*=\S*[ \t]+)*)([\w./:+-]+)(?=[ \t\n;&|)]|$)"):
        if m[2] in words or re.match(r"[\w.-]+[ \t]*\(\)", s.code[m.start(2) :]) or re.fullmatch(r"[A-Za-z_]\w*=.*", m[2]) or m[2].isdigit():
            continue
        f.add_call(m[2], m.start(2), m.end(2))


EXTRACTORS: dict[str, tuple[Callable[[Facts], None], bool]] = {
    "javascript": (lambda f: _ecma(f, False), True),
    "typescript": (lambda f: _ecma(f, True), True),
    "java": (java, False),
    "c": (c, True),
    "cpp": (cpp, True),
    "objectivec": (objectivec, True),
    "csharp": (csharp, False),
    "scala": (scala, False),
    "swift": (swift, False),
    "go": (go, False),
    "zig": (zig, False),
    "php": (php, False),
    "rust": (rust, True),
    "ruby": (ruby, False),
    "lua": (lua, False),
    "elixir": (elixir, False),
    "haskell": (haskell, False),
    "bash": (bash, False),
}


def extract(lang: str, content: bytes) -> Facts:
    run, dedupe = EXTRACTORS[lang]
    facts = Facts(Source(content, RULES[lang]), dedupe)
    run(facts)
    return facts.sort()
