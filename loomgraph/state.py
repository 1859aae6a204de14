"""Run progress and token counters in one small file, replaced atomically after every step."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from .operators.render import write_atomic

PHASES = ("map", "reduce", "crosscheck")


class State:
    def __init__(self, path: str):
        self.path = path
        self.data: dict = {"version": 1, "phase": "", "started_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.data |= json.load(f)
        for key in ("counters", "tokens", "extractors"):
            self.data.setdefault(key, {})
        for p in PHASES:
            self.data["tokens"].setdefault(p, {"prompt": 0, "completion": 0})

    def save(self, **changes) -> None:
        self.data |= changes
        write_atomic(self.path, json.dumps(self.data, indent=2, sort_keys=True) + "\n")

    def progress(self, name: str, done: int, total: int) -> None:
        """A phase that goes on: units done of those that were to do."""
        self.data["counters"][name] = {"total": total, "done": done, "failed": 0}
        self.save(phase=name)

    def phase(self, name: str, total: int, failed: int, prompt: int = 0, completion: int = 0) -> None:
        """A finished phase: its counters are replaced, its tokens added to earlier runs'."""
        t = self.data["tokens"].setdefault(name, {"prompt": 0, "completion": 0})
        t["prompt"], t["completion"] = t["prompt"] + prompt, t["completion"] + completion
        self.data["counters"][name] = {"total": total, "done": total - failed, "failed": failed}
        self.save(phase=name)
