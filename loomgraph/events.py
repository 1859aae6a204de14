"""What a run tells while it goes on: events to a sink, a function that takes them. All are told by the driver."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

LOG = logging.getLogger("loomgraph")
#: Units of a phase between two lines of the plain log.
EVERY = 25


@dataclass(frozen=True)
class Event:
    """kind: started, scanned, warning, extractor, facts, phase, unit, ended, nodes, violations, finished."""

    kind: str
    values: dict = field(default_factory=dict)


Sink = Callable[[Event], None]


def silent(event: Event) -> None:
    """A sink that drops all."""


def plain(event: Event) -> None:
    """A sink that logs all, of units every twenty-fifth and the last."""
    v = event.values
    if event.kind == "unit" and v["done"] % EVERY and v["done"] != v["total"]:
        return
    level = logging.WARNING if event.kind == "warning" else logging.INFO
    LOG.log(level, "%s %s", event.kind, " ".join(f"{k}={x}" for k, x in v.items()))


class Polled:
    """Calls `look` every `seconds` while a block runs, and once when it ends."""

    def __init__(self, look: Callable[[], None], seconds: float = 1.0):
        self.look, self.seconds, self.over = look, seconds, threading.Event()

    def _run(self) -> None:
        while not self.over.wait(self.seconds):
            self.look()

    def __enter__(self) -> None:
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()
        self.look()
