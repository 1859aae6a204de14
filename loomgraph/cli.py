"""Commands: run, verify, drift and stats."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from . import durable, events
from .config import Config, ConfigError, find_file, read_file, resolve
from .operators import checks
from .operators.model import HttpChat
from .session import session
from .state import State


def parse(argv: list[str]) -> tuple[str, Config]:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("command", choices=("run", "verify", "drift", "stats"))
    p.add_argument("--config")
    for name in ("src", "out", "lang", "endpoint", "model", "key", "strategy", "routes", "log-level", "format"):
        p.add_argument(f"--{name}")
    for name in ("workers", "max-tokens", "domain-depth", "reduce-batch", "extractor-timeout"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--exclude", type=lambda text: [x.strip() for x in text.split(",") if x.strip()], help="names, with commas between them")
    for name in ("facts", "index"):
        p.add_argument(f"--{name}", action="append")
    for name in ("crosscheck", "repair", "retry-failed"):
        p.add_argument(f"--{name}", action="store_true", default=None)
    a = vars(p.parse_args(argv))
    command, file = a.pop("command"), a.pop("config")
    file = file or find_file(a["src"] or ".")
    return command, resolve(a, read_file(file) if file else None)


def stats_text(state: dict) -> str:
    """A run's phase, counters, tokens and extractors."""
    lines = [f"phase: {state['phase'] or 'none'}"]
    lines += [f"{p}: {c['done']}/{c['total']} done, {c['failed']} failed" for p, c in state["counters"].items()]
    lines += [f"tokens {p}: {t['prompt']}+{t['completion']}" for p, t in state["tokens"].items()]
    return "\n".join(lines + [f"extractor {n}: {s}" for n, s in sorted(state["extractors"].items())])


def summary_text(s: dict, state: dict) -> str:
    """What a finished run made: nodes by type, coverage, failures, tokens, extractors."""
    t, c, u = s["types"], s["coverage"], s["units"]
    lines = ["nodes: " + ", ".join(f"{t.get(k, 0)} {label}" for k, label in (("domain", "domains"), ("entity", "entities"), ("endpoint", "endpoints"), ("rule", "rules")))]
    lines.append(f"coverage: endpoints {c['endpoints_referenced']}/{c['endpoints_total']}, entities {c['entities_touched']}/{c['entities_total']}")
    lines.append("failures: " + ", ".join(f"{u[k][1]}/{u[k][0]} {k}" for k in ("chunks", "domains")))
    lines.append("tokens: " + ", ".join(f"{p} {n['prompt']}+{n['completion']}" for p, n in state["tokens"].items()))
    if state["extractors"]:
        lines.append("extractors: " + " ".join(f"{n}={x}" for n, x in sorted(state["extractors"].items())))
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    """0 if all is well, 1 on violations, drift or failure, 130 if interrupted."""
    from . import pipeline

    spark = None
    try:
        command, config = parse(sys.argv[1:] if argv is None else argv)
        if command == "stats":
            print(stats_text(State(f"{config.out}/state.json").data) if config.format == "text" else json.dumps(State(f"{config.out}/state.json").data, sort_keys=True))
            return 0
        logging.basicConfig(stream=sys.stderr, format="%(levelname)s %(message)s")
        events.LOG.setLevel({"warn": "WARNING"}.get(config.log_level, config.log_level.upper()))
        spark = session()
        if command == "run":
            c = config.needs_model()
            summary = pipeline.run(spark, c, HttpChat(c.endpoint, c.model, c.key, c.max_tokens), events.plain)
            print(summary_text(summary, State(f"{c.out}/state.json").data))
            return 0
        if command == "verify":
            rows = pipeline.verify(spark, config).orderBy("node_id", "check", "detail").collect()
            for r in rows:
                print(f"{r.node_id}: {r.check}: {r.detail}")
            return int(bool(rows))
        statuses = pipeline.drift(spark, config)
        report = checks.drift_report(statuses).collect()[0].asDict()
        if config.format == "json":
            print(json.dumps(report, sort_keys=True))
        else:
            for r in statuses.where("status in ('stale', 'broken')").orderBy("rule_id").toLocalIterator():
                print(f"{r.status.upper():8} {r.rule_id}")
            print(", ".join(f"{report[k]} {k}" for k in ("ok", "stale", "broken", "unknown")))
        return int(report["drifted"])
    except KeyboardInterrupt:
        return 130
    except (ConfigError, pipeline.IntegrityError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if spark is not None:
            durable.sweep(spark)


if __name__ == "__main__":
    sys.exit(main())
