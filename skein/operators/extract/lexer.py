"""One lexer for all languages: it blanks comments and strings, keeps every offset, and pairs brackets.

Sources are bytes read as Latin-1, so offsets are byte offsets; names are decoded at the end.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

IDENT = r"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*"


@dataclass(frozen=True)
class Rules:
    """How a language writes comments and strings. strings: (open, close, escape mark or none, may span lines)."""

    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    nested: bool = False
    strings: tuple[tuple[str, str, str, bool], ...] = (('"', '"', "\\", False), ("'", "'", "\\", False))
    regexes: bool = False
    char_literals: bool = False  # a quote starts a literal only if one follows soon
    line_at_start: tuple[str, ...] = ()  # comment marks that count after white space only


C_LIKE = Rules(line=("//",), block=(("/*", "*/"),))
JS_RULES = Rules(line=("//",), block=(("/*", "*/"),), strings=C_LIKE.strings + (("`", "`", "\\", True),), regexes=True)
_BEFORE_REGEX = re.compile(r"(?:[(,=:\[!&|?{};+\-*%~^<>\n]|\b(?:return|typeof|case|in|of|do|else|void|delete))\s*$")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BLANK = re.compile(r"[^\n]")


def _blank(text: str) -> str:
    return _BLANK.sub(" ", text)


class Source:
    """raw; text (comments blank); code (comments and string contents blank)."""

    def __init__(self, content: bytes, rules: Rules):
        self.raw = content.decode("latin-1")
        self.rules = rules
        self.starts = [0] + [m.end() for m in re.finditer("\n", self.raw)]
        self.text, self.code = self._mask()
        self._pairs: dict[int, int] | None = None

    def _mask(self) -> tuple[str, str]:
        r, raw = self.rules, self.raw
        marks = [*(o for o, _ in r.block), *r.line, *(s[0] for s in r.strings)]
        marks += [rf"(?:(?<=\s)|^){re.escape(m)}" for m in r.line_at_start]
        plain = sorted((re.escape(m) for m in [*(o for o, _ in r.block), *r.line, *(s[0] for s in r.strings)]), key=len, reverse=True)
        plain += [rf"(?:(?<=\s)|(?<![\s\S])){re.escape(m)}" for m in r.line_at_start]
        if r.regexes:
            plain.append("/")
        opener = re.compile("|".join(plain)) if plain else None
        text, code, done, at = [], [], 0, 0
        strings = sorted(r.strings, key=lambda s: -len(s[0]))
        while opener and (m := opener.search(raw, at)):
            i, mark = m.start(), m[0]
            block = next((b for b in r.block if b[0] == mark), None)
            if block:
                end = self._block_end(i, block)
            elif mark in r.line or mark in r.line_at_start:
                end = raw.find("\n", i)
                end = len(raw) if end < 0 else end
            elif mark == "/" and not any(s[0] == "/" for s in strings):
                found = _REGEX.match(raw, i) if _BEFORE_REGEX.search(raw, max(0, i - 40), i) or not raw[:i].strip() else None
                if not found:
                    at = i + 1
                    continue
                end = found.end()
                text.append(raw[done:end])
                code.append(raw[done : i + 1] + _blank(raw[i + 1 : end - 1]) + raw[end - 1 : end])
                done = at = end
                continue
            else:
                string = next(s for s in strings if s[0] == mark)
                if r.char_literals and mark == "'" and not re.match(r"'(?:\\[^\n]{1,10}?|[^'\\\n]{1,4})'", raw[i : i + 14]):
                    at = i + 1
                    continue
                body = i + len(mark)
                end, close = self._string_end(body, string)
                text.append(raw[done:end])
                code.append(raw[done:body] + _blank(raw[body : end - close]) + raw[end - close : end])
                done = at = end
                continue
            text.append(raw[done:i] + _blank(raw[i:end]))
            code.append(raw[done:i] + _blank(raw[i:end]))
            done = at = end
        text.append(raw[done:])
        code.append(raw[done:])
        return "".join(text), "".join(code)

    def _block_end(self, i: int, block: tuple[str, str]) -> int:
        raw, depth, at = self.raw, 1, i + len(block[0])
        while True:
            end = raw.find(block[1], at)
            if end < 0:
                return len(raw)
            inner = raw.find(block[0], at, end) if self.rules.nested else -1
            if inner >= 0:
                depth, at = depth + 1, inner + len(block[0])
                continue
            depth, at = depth - 1, end + len(block[1])
            if not depth:
                return at

    def _string_end(self, body: int, string: tuple[str, str, str, bool]) -> tuple[int, int]:
        """(end, length of the closing mark); an unclosed single-line string ends with its line."""
        _, close, escape, lines = string
        raw, at = self.raw, body
        while at < len(raw):
            c = raw[at]
            if escape and c == escape:
                at += 2
            elif raw.startswith(close, at):
                return at + len(close), len(close)
            elif c == "\n" and not lines:
                return at, 0
            else:
                at += 1
        return len(raw), 0

    @property
    def pairs(self) -> dict[int, int]:
        """Offset of each opening bracket to that of its closing one."""
        if self._pairs is None:
            out, stack = {}, []
            for m in re.finditer(r"[()\[\]{}]", self.code):
                c = m[0]
                if c in "([{":
                    stack.append((c, m.start()))
                else:
                    want = {")": "(", "]": "[", "}": "{"}[c]
                    k = len(stack) - 1
                    while k >= 0 and stack[k][0] != want:
                        k -= 1
                    if k >= 0:
                        out[stack[k][1]] = m.start()
                        del stack[k:]
            self._pairs = out
        return self._pairs

    def span(self, start: int, end: int) -> tuple[int, int, int, int]:
        """1-based lines and 0-based byte columns."""
        a, b = bisect.bisect_right(self.starts, start) - 1, bisect.bisect_right(self.starts, end) - 1
        return a + 1, start - self.starts[a], b + 1, end - self.starts[b]

    def line_end(self, at: int) -> int:
        end = self.code.find("\n", at)
        return len(self.code) if end < 0 else end

    def body_end(self, at: int, stop: str = ";") -> int:
        """End of a definition whose head is at `at`: behind its braces, or behind the stop mark that comes first."""
        i, code = at, self.code
        while i < len(code):
            c = code[i]
            if c == "{":
                return self.pairs.get(i, len(code) - 1) + 1
            if c in "([":
                i = self.pairs.get(i, i)
            elif c in stop:
                return i + 1
            elif c in ")]}":
                return i
            i += 1
        return len(code.rstrip())

    def depth_braces(self) -> list[tuple[int, int]]:
        return sorted((a, b) for a, b in self.pairs.items() if self.code[a] == "{")


def name(text: str) -> str:
    return text.encode("latin-1").decode("utf-8", "replace")


class Facts:
    """Rows of one file, in order, de-duplicated as the language asks."""

    def __init__(self, source: Source, dedupe_symbols: bool = False):
        self.source = source
        self.dedupe_symbols = dedupe_symbols
        self.imports: dict[str, tuple] = {}
        self.symbols: list[tuple] = []
        self.calls: list[tuple] = []
        self._seen: set[tuple[str, int]] = set()

    def add_import(self, raw: str, kind: str, start: int, end: int) -> None:
        raw = name(raw)
        if raw and raw not in self.imports:
            self.imports[raw] = (raw, kind, self.source.span(start, end))

    def add_symbol(self, text: str, kind: str, exported: bool, start: int, end: int) -> None:
        text, span = name(text), self.source.span(start, end)
        if self.dedupe_symbols and (text, span[0]) in self._seen:
            return
        self._seen.add((text, span[0]))
        self.symbols.append((text, kind, exported, span))

    def add_call(self, text: str, start: int, end: int) -> None:
        self.calls.append((name(text), self.source.span(start, end)))

    def sort(self) -> Facts:
        self.symbols.sort(key=lambda s: (s[3][0], s[3][1]))
        self.calls.sort(key=lambda c: (c[1][0], c[1][1]))
        return self
