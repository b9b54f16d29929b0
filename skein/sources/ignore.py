"""A gitignore matcher: comments, negation, anchoring, directory-only patterns, `*`, `?`, classes and `**`."""

from __future__ import annotations

import re


def _pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern over a relative path, negated, directories only)."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\n\r"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:].removeprefix("\\")
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1 if line[i + 1] == "!" else 0).replace("\\", "\\\\") + "]", end + 1
        elif line[i] == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(line[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + "$"), negated, only_dirs


class Ignore:
    """The patterns of one directory's file, over those of its parents."""

    def __init__(self, text: str = "", base: str = "", parent: Ignore | None = None):
        self.rules = [p for line in text.splitlines() if (p := _pattern(line))]
        self.base, self.parent = base, parent

    def ignores(self, path: str, is_dir: bool) -> bool:
        """path: from the root. The last pattern that matches decides, deeper files first."""
        node: Ignore | None = self
        while node:
            own = path[len(node.base) + 1 :] if node.base else path
            for pattern, negated, only_dirs in reversed(node.rules):
                if (is_dir or not only_dirs) and pattern.match(own):
                    return not negated
            node = node.parent
        return False
