"""Configuration: defaults, then .skein.toml, then SKEIN_ variables; command-line flags win over all."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

DEFAULT_VENDOR_GLOBS = ["**/vendor/**", "**/third_party/**", "**/external/**"]
FILE = ".skein.toml"


@dataclass
class Rule:
    name: str
    source: str
    target: str
    severity: str = "error"


@dataclass
class Config:
    languages: list[str] | None = None
    exclude: list[str] = field(default_factory=list)
    max_file_size_kb: int | None = None
    format: str | None = None
    no_external: bool = False
    no_progress: bool = False
    first_party: bool = False
    vendor_globs: list[str] | None = None
    rules: list[Rule] = field(default_factory=list)

    @property
    def max_bytes(self) -> int | None:
        return None if self.max_file_size_kb is None else self.max_file_size_kb * 1024

    @property
    def vendored(self) -> list[str]:
        return DEFAULT_VENDOR_GLOBS if self.vendor_globs is None else self.vendor_globs


def _from_env(value: str, kind: str):
    if "bool" in kind:
        return value.strip().lower() in ("1", "true", "yes", "on")
    if "int" in kind:
        return int(value)
    if "list" in kind:
        return [v.strip() for v in value.strip("[]").split(",") if v.strip()]
    return value


def load(root: str, env: dict[str, str] | None = None) -> Config:
    env = os.environ if env is None else env
    values: dict = {}
    path = os.path.join(root, FILE)
    if os.path.isfile(path):
        with open(path, "rb") as f:
            values = tomllib.load(f)
    known = {f.name: str(f.type) for f in fields(Config)}
    values = {k: v for k, v in values.items() if k in known}
    for k, kind in known.items():
        if (v := env.get(f"SKEIN_{k.upper()}")) is not None and k != "rules":
            values[k] = _from_env(v, kind)
    rules = [Rule(r["name"], r["from"], r["to"], r.get("severity", "error")) for r in values.pop("rules", [])]
    for r in rules:
        if r.severity not in ("error", "warn"):
            raise ValueError(f"rule {r.name}: unknown severity {r.severity}")
    return Config(**values, rules=rules)


def choose(flag, configured, default):
    """Flag over configuration over built-in."""
    return flag if flag is not None else configured if configured is not None else default


def template(languages: list[str]) -> str:
    listed = ", ".join(f'"{x}"' for x in languages)
    return f"""# languages = [{listed}]
exclude = ["**/node_modules/**", "**/target/**", "**/dist/**"]
# max_file_size_kb = 500
# format = "json"
# first_party = true
# vendor_globs = ["**/vendor/**"]

# [[rules]]
# name = "core stays independent"
# from = "core/**"
# to = "app/**"
# severity = "error"
"""


def init(root: str, languages: list[str], force: bool = False) -> str:
    """Writes the template; refuses to replace a file without force."""
    path = os.path.join(root, FILE)
    if os.path.exists(path) and not force:
        raise FileExistsError(f"{path} exists; use --force to replace it")
    with open(path, "w", encoding="utf-8") as f:
        f.write(template(languages))
    return path
