"""Language detection as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LANG_OF_EXT, LANGUAGES
from . import paths

SNIFF_BYTES, TEXT_BYTES = 65_536, 1024

#: What marks a header as Objective-C or C++.
OBJC_MARKS = ("@class", "@end", "@implementation", "@interface", "@optional", "@property", "@protocol", "@required", "@selector")
CPP_WORDS = ("class", "constexpr", "friend", "namespace", "noexcept", "nullptr", "operator", "override", "private", "protected", "public", "template", "typename", "virtual")

#: Interpreters, and those that may carry a version.
INTERPRETERS = {
    "python": "python", "python2": "python", "python3": "python", "pypy": "python", "pypy3": "python",
    "node": "javascript", "nodejs": "javascript",
    "ts-node": "typescript", "ts-node-esm": "typescript", "tsx": "typescript",
    "bash": "bash", "dash": "bash", "ksh": "bash", "sh": "bash", "zsh": "bash",
    "ruby": "ruby", "jruby": "ruby", "php": "php", "lua": "lua", "luajit": "lua", "elixir": "elixir",
    "runghc": "haskell", "runhaskell": "haskell", "scala": "scala", "scala-cli": "scala", "swift": "swift",
}
VERSIONED = ("python", "pypy", "node", "bash", "ruby", "php", "lua")

#: Extensions of files that are no source, and names of repository metadata.
NON_SOURCE = (
    "cfg conf csv ini json json5 jsonc plist properties toml tsv xml yaml yml lock mod sum adoc markdown md org pdf rst txt "
    "bmp gif icns ico jpeg jpg png svg tiff webp eot otf ttf woff woff2 aac avi flac mov mp3 mp4 ogg wav webm "
    "7z bz2 gz jar rar tar tgz war xz zip zst a bin class dat dll dylib exe lib o obj pdb pyc pyo so wasm "
    "cer crt der key p12 pem pfx bak log map swp tmp"
).split()
METADATA = "AUTHORS CHANGELOG CODEOWNERS CONTRIBUTORS COPYING COPYRIGHT LICENCE LICENSE MAINTAINERS NOTICE OWNERS PATENTS README TODO VERSION".split()


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def text_of(content: Column, limit: int | None = None) -> Column:
    """Bytes as text, invalid sequences replaced."""
    return F.try_validate_utf8(F.make_valid_utf8((F.substring(content, 1, limit) if limit else content).cast("string")))


def header_language(content: Column) -> Column:
    """objectivec, cpp or c for the start of a `.h` file."""
    text = text_of(content, SNIFF_BYTES)
    objc = text.rlike("|".join(OBJC_MARKS)) | text.rlike(r'(?m)^[^\S\n]*(?:#import(?:\s|<| ")|[-+] \()')
    words = text.rlike(rf"(?<![A-Za-z0-9_])(?:{'|'.join(CPP_WORDS)})(?![A-Za-z0-9_])")
    cpp = text.contains("::") | text.contains('extern "C++"') | words
    return F.when(objc, "objectivec").when(cpp, "cpp").otherwise("c")


def shebang_language(first_line: Column) -> Column:
    """The language of a `#!` line, else null."""

    def command(part: Column) -> Column:
        base = F.substring_index(part, "/", -1)
        version = F.regexp_extract(base, rf"^({'|'.join(VERSIONED)})[0-9.]+$", 1)
        return F.coalesce(_lookup(INTERPRETERS, base), _lookup(INTERPRETERS, version))

    parts = F.filter(F.split(F.regexp_replace(first_line, "^#!", ""), r"\s+"), lambda p: p != "")
    names = F.filter(F.slice(parts, 2, 2**20), lambda p: ~p.startswith("-") & ~p.contains("="))
    via_env = F.get(F.filter(F.transform(names, command), lambda x: x.isNotNull()), F.lit(0))
    first = F.get(parts, F.lit(0))
    return F.when(first_line.startswith("#!"), F.when(F.substring_index(first, "/", -1) == "env", via_env).otherwise(command(first)))


def language(path: Column, content: Column) -> Column:
    """By extension (case-sensitive), a sniff of headers, and the shebang where there is no extension; else null."""
    ext = paths.extension(path)
    first_line = F.substring_index(text_of(content, TEXT_BYTES), "\n", 1)
    return F.when(ext == "h", header_language(content)).when(ext == "", shebang_language(first_line)).otherwise(_lookup(LANG_OF_EXT, ext))


def extensions_of(lang: str) -> tuple[str, ...]:
    return next((e for n, _, _, e, _ in LANGUAGES if n == lang), ())


def reportable(path: Column, content: Column) -> Column:
    """Whether an unsupported file looks like source: an extension that isn't data, or text without extension and NUL."""
    ext, head = F.lower(paths.extension(path)), F.substring(content, 1, TEXT_BYTES)
    metadata = F.lower(paths.name(path)).rlike(f"^(?:{'|'.join(METADATA).lower()})")
    text = (F.length(head) > 0) & ~F.contains(head, F.lit(b"\0"))
    return F.when(ext != "", ~ext.isin(NON_SOURCE)).otherwise(~metadata & F.coalesce(text, F.lit(False)))
