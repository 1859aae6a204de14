"""Run settings: flags before environment before file, with one place that validates them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace

from . import plain_yaml


class ConfigError(ValueError):
    pass


#: Folders left out unless others are named.
DEFAULT_EXCLUDE = ("vendor", "node_modules", "storage", "dist", "build", ".git")
#: Settings files that are looked for at the source root.
FILES = ("loomgraph.yaml", "loomgraph.yml", "loomgraph.json")


@dataclass
class Config:
    src: str = "."
    out: str = "spec"
    lang: str = "fr"
    endpoint: str = ""
    model: str = ""
    key: str = ""
    workers: int = 4
    max_tokens: int = 4096
    strategy: str = "auto"
    domain_depth: int = 1
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDE))
    facts: list[str] = field(default_factory=list)
    extractors: dict[str, list[str]] = field(default_factory=dict)
    extractor_timeout: float = 300
    timeouts: dict[str, float] = field(default_factory=dict)
    index: list[str] = field(default_factory=list)
    routes: str = ""
    reduce_batch: int = 30
    log_level: str = "info"
    format: str = "text"
    crosscheck: bool = False
    repair: bool = False
    retry_failed: bool = False

    def checked(self) -> Config:
        c = replace(self, crosscheck=self.crosscheck or self.repair, domain_depth=max(1, self.domain_depth))
        for ok, problem in (
            (c.lang in ("fr", "en"), f"lang {c.lang!r} is neither fr nor en"),
            (c.workers >= 1, "workers must be at least 1"),
            (c.max_tokens >= 1, "max_tokens must be at least 1"),
            (c.reduce_batch >= 1, "reduce_batch must be at least 1"),
            (c.log_level in ("debug", "info", "warn", "error"), f"unknown log level {c.log_level!r}"),
            (c.format in ("text", "json"), f"format {c.format!r} is neither text nor json"),
            (all(t > 0 for t in (c.extractor_timeout, *c.timeouts.values())), "a timeout must be positive"),
            (c.strategy in ("auto", "namespace", "directory"), f"unknown strategy {c.strategy!r}"),
            (all(n and argv for n, argv in c.extractors.items()), "an extractor needs a name and a command"),
        ):
            if not ok:
                raise ConfigError(problem)
        return c

    def needs_model(self) -> Config:
        if not self.endpoint or not self.model:
            raise ConfigError("endpoint and model are required")
        return self


#: Environment variables by setting.
ENVIRONMENT = {"endpoint": "LOOMGRAPH_ENDPOINT", "model": "LOOMGRAPH_MODEL", "key": "LOOMGRAPH_KEY"}


def read_file(path: str) -> dict:
    """Settings of a JSON file, or of a YAML one."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    found = json.loads(text) if path.endswith(".json") else plain_yaml.load(text)
    if not isinstance(found or {}, dict):
        raise ConfigError(f"{path} holds no settings")
    return found or {}


def find_file(src: str) -> str | None:
    """The settings file at a source root, if there is one."""
    return next((p for n in FILES if os.path.isfile(p := os.path.join(src, n))), None)


def seconds(text: str | float) -> float:
    """'300s', '5m', '1h30m', '250ms' or a number of seconds."""
    if not isinstance(text, str):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ConfigError(f"timeout {text!r} is no duration")
    return sum(float(n) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[u] for n, u in parts)


def _own_names(file: Mapping[str, object]) -> dict:
    """A file's settings by our names: `domain_strategy`, `facts_files`, and extractors as a list of name, cmd, args and timeout."""
    out = dict(file)
    for theirs, ours in (("domain_strategy", "strategy"), ("facts_files", "facts")):
        if theirs in out:
            out[ours] = out.pop(theirs)
    if isinstance(out.get("extractors"), list):
        out["timeouts"] = {e["name"]: seconds(e["timeout"]) for e in out["extractors"] if e.get("name") and e.get("timeout")}
        out["extractors"] = {e.get("name") or "": [e["cmd"], *map(str, e.get("args") or [])] if e.get("cmd") else [] for e in out["extractors"]}
    return {k: v for k, v in out.items() if v is not None}


def resolve(flags: Mapping[str, object], file: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None) -> Config:
    """Flags (None where not given) over the environment over a file over defaults. Facts files are joined without repeats;
    an empty list of excludes in a file leaves the default."""
    env = os.environ if env is None else env
    known = {f.name for f in fields(Config)}
    held = _own_names(file or {})
    if not held.get("exclude"):
        held.pop("exclude", None)
    merged: dict[str, object] = {}
    for source in (held, {k: env[v] for k, v in ENVIRONMENT.items() if env.get(v)}, {k: v for k, v in flags.items() if v is not None}):
        if unknown := set(source) - known:
            raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
        merged |= source
    given: Sequence[str] = flags.get("facts") or []  # type: ignore[assignment]
    merged["facts"] = list(dict.fromkeys([*given, *(held.get("facts") or [])]))
    return Config(**merged).checked()  # type: ignore[arg-type]
