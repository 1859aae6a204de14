"""Talking to a text model: the client, strict reply validators and the correction loop.

A model is any callable from messages to (reply, usage); tests use a function. The validators are the semantics: a reply
counts only if every rule in it passes, and the first error is what the model is told to correct.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from ..functions import exprs as X

Message = dict[str, str]
Usage = tuple[int, int]
Chat = Callable[[list[Message]], tuple[str, Usage]]

#: Seconds to wait before each repeated call, seconds a call may take, bytes of a reply.
BACKOFF = (2, 8, 20)
CALL_TIMEOUT = 180
REPLY_BYTES = 32 << 20


class ModelError(RuntimeError):
    """A call that failed for good, or replies that stayed invalid."""


@dataclass
class HttpChat:
    """A chat-completions endpoint. Network errors, 429 and 5xx are repeated; any other status is final."""

    endpoint: str
    model: str
    key: str = ""
    max_tokens: int = 4096
    temperature: float = 0.1
    backoff: tuple[float, ...] = BACKOFF

    def __call__(self, messages: list[Message]) -> tuple[str, Usage]:
        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        problem = ""
        for wait in (0.0, *self.backoff):
            time.sleep(wait)
            try:
                with urllib.request.urlopen(urllib.request.Request(self.endpoint.rstrip("/") + "/chat/completions", body, headers), timeout=CALL_TIMEOUT) as r:
                    got = json.loads(r.read(REPLY_BYTES))
                usage = got.get("usage") or {}
                return got["choices"][0]["message"]["content"], (usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0))
            except urllib.error.HTTPError as e:
                problem = f"status {e.code}: {e.read(200).decode('utf-8', 'replace')}"
                if e.code != 429 and e.code < 500:
                    break
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                problem = str(e)
            except (KeyError, IndexError, ValueError) as e:
                raise ModelError(f"unusable response: {e}") from e
        raise ModelError(problem)


def strip_fences(reply: str) -> str:
    """A reply without white space and code fences around it."""
    reply = reply.strip()
    if not reply.startswith("```"):
        return reply
    _, found, rest = reply.partition("\n")
    return (rest[: rest.rfind("```")] if "```" in rest else rest).strip() if found else ""


class Rejected(ValueError):
    """A reply that a validator refuses; `code` names the check that failed first."""

    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


def first_error(validate: Callable[[], Any]) -> str:
    """The code of the check that fails first; 'ok' if none does."""
    try:
        validate()
        return "ok"
    except Rejected as e:
        return e.code


def chat_json(chat: Chat, messages: list[Message], validate: Callable[[Any], Any], corrections: int) -> tuple[Any, Usage]:
    """The first valid reply, decoded; after an invalid one the model sees it again with its error. Raises ModelError."""
    messages, prompt, completion = list(messages), 0, 0
    error = ""
    for _ in range(corrections + 1):
        reply, usage = chat(messages)
        prompt, completion = prompt + usage[0], completion + usage[1]
        try:
            return validate(json.loads(strip_fences(reply))), (prompt, completion)
        except (ValueError, TypeError, AttributeError) as e:
            error = str(e)
            messages += [{"role": "assistant", "content": reply}, {"role": "user", "content": f"Invalid reply: {error}. Send the corrected JSON only."}]
    raise ModelError(error)


def parse_lines(lines: str) -> tuple[int, int]:
    m = re.fullmatch(r"(\d+)-(\d+)", lines or "")
    if not m or not 1 <= int(m[1]) <= int(m[2]):
        raise Rejected("lines", f"invalid line range {lines!r}")
    return int(m[1]), int(m[2])


def _listed(rule: dict, key: str) -> list:
    return rule.get(key) or []


def _common(k: int, rule: dict, entities: set[str], endpoints: set[str]) -> None:
    for name, known in (("entities", entities), ("endpoints", endpoints)):
        for x in _listed(rule, name):
            if x not in known:
                raise Rejected(name, f"rule {k}: {x!r} is not among the allowed {name}")
    if rule.get("nature") not in X.NATURES:
        raise Rejected("nature", f"rule {k}: nature {rule.get('nature')!r}")
    if rule.get("origin") not in X.ORIGINS:
        raise Rejected("origin", f"rule {k}: origin {rule.get('origin')!r}")
    if not 0 <= float(rule.get("confidence") or 0) <= 1:
        raise Rejected("confidence", f"rule {k}: confidence {rule['confidence']} is outside [0, 1]")


def validate_map(reply: dict, path: str, start: int, end: int, entities: Iterable[str], endpoints: Iterable[str]) -> dict:
    """Rules that cite only their chunk and name only known entities and endpoints."""
    entities, endpoints = set(entities), set(endpoints)
    for k, rule in enumerate(reply.get("rules") or []):
        if rule.get("ears_kind") not in X.EARS_KINDS:
            raise Rejected("ears", f"rule {k}: EARS kind {rule.get('ears_kind')!r}")
        if not _listed(rule, "citations"):
            raise Rejected("citations", f"rule {k}: no citation")
        for c in rule["citations"]:
            c = c or {}
            if c.get("path") != path:
                raise Rejected("path", f"rule {k}: citation of {c.get('path')!r}, not {path!r}")
            a, b = parse_lines(c.get("lines") or "")
            if a < start or b > end:
                raise Rejected("span", f"rule {k}: lines {a}-{b} are outside the chunk {start}-{end}")
        _common(k, rule, entities, endpoints)
    return reply


def slug_of(text: str, words: int = 5) -> str:
    slug = re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")
    return "-".join(slug.split("-")[:words])


def unique(name: str, taken: set[str]) -> str:
    k, free = 2, name
    while free in taken:
        free, k = f"{name}-{k}", k + 1
    taken.add(free)
    return free


def validate_reduce(reply: dict, citations: set[tuple[str, str]], entities: Iterable[str], endpoints: Iterable[str]) -> dict:
    """Rules that cite only candidates' citations, word for word; slugs are repaired before anything is judged."""
    entities, endpoints, taken = set(entities), set(endpoints), set()
    for k, rule in enumerate(reply.get("rules") or []):
        slug = slug_of(rule.get("slug") or "") or slug_of(rule.get("title") or "")
        if not slug:
            raise Rejected("slug", f"rule {k}: no slug and no title")
        rule["slug"] = unique(slug, taken)
        if rule.get("ears_kind") not in X.EARS_KINDS:
            raise Rejected("ears", f"rule {k}: EARS kind {rule.get('ears_kind')!r}")
        if not _listed(rule, "citations"):
            raise Rejected("citations", f"rule {k}: no citation")
        for c in rule["citations"]:
            c = c or {}
            if (c.get("path"), c.get("lines")) not in citations:
                raise Rejected("citation", f"rule {k}: citation {c.get('path')}:{c.get('lines')} is no candidate's")
        _common(k, rule, entities, endpoints)
    return reply


def validate_verdict(reply: dict) -> dict:
    if reply.get("verdict") not in X.VERDICTS:
        raise Rejected("verdict", f"verdict {reply.get('verdict')!r}")
    if not (reply.get("reason") or "").strip():
        raise Rejected("reason", "no reason")
    return reply


def grounded(citations: Iterable[dict], cited_paths: set[str], symbols: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """Proposed citations of already cited paths that overlap a precise symbol there, each once."""
    out: dict[tuple[str, str], dict] = {}
    for c in citations:
        c = c or {}
        try:
            a, b = parse_lines(c.get("lines") or "")
        except ValueError:
            continue
        if c.get("path") in cited_paths and any(s <= b and e >= a for s, e in symbols.get(c["path"], [])):
            out.setdefault((c["path"], c["lines"]), {"path": c["path"], "lines": c["lines"]})
    return list(out.values())


@dataclass
class Reduced:
    summary: str = ""
    rules: list[dict] = field(default_factory=list)
    dropped: int = 0
    usage: Usage = (0, 0)
    error: str = ""


def reduce_adaptively(candidates: list[dict], call: Callable[[list[dict], int], tuple[dict, Usage]], floor: int = 5) -> Reduced:
    """Reduce a batch; one that fails is halved and both halves tried, down to `floor` candidates, which get two
    corrections and are dropped, and counted, if they still fail."""
    try:
        reply, usage = call(candidates, 0 if len(candidates) > floor else 2)
        return Reduced(reply.get("domain_summary") or "", reply.get("rules") or [], 0, usage)
    except ModelError as e:
        if len(candidates) <= floor:
            return Reduced(dropped=len(candidates), error=str(e))
    middle = len(candidates) // 2
    a, b = (reduce_adaptively(part, call, floor) for part in (candidates[:middle], candidates[middle:]))
    return Reduced(a.summary or b.summary, a.rules + b.rules, a.dropped + b.dropped, (a.usage[0] + b.usage[0], a.usage[1] + b.usage[1]), a.error or b.error)
