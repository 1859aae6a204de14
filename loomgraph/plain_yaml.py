"""The part of YAML that settings and page heads use: block and flow mappings and lists, quoted and plain scalars, literal
and folded texts, comments. No anchors, tags, several documents or keys over several lines; those are refused."""

from __future__ import annotations

import json
import re

_COMMENT = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')|(?:^|(?<=\s))#.*""")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},"'#&*!|>%@`-][^:#]*?|-[^\s:][^:#]*?)\s*:(?=\s|$)\s*""")
_WORDS = {"null": None, "~": None, "": None, "true": True, "false": False}


class YamlError(ValueError):
    """A text that isn't in this part of YAML."""


def load(text: str, typed: bool = True):
    """The value of a text; plain scalars stay texts unless `typed`."""
    lines = []
    for number, raw in enumerate(text.split("\n"), 1):
        bare = _COMMENT.sub(lambda m: m[1] or "", raw).rstrip()
        if "\t" in raw[: len(raw) - len(raw.lstrip())]:
            raise YamlError(f"line {number}: a tab indents")
        lines.append((len(bare) - len(bare.lstrip()), bare.lstrip(), raw))
    reader = _Reader(lines, typed)
    reader.skip()
    if reader.at >= len(lines):
        return None
    value = reader.block(lines[reader.at][0])
    reader.skip()
    if reader.at < len(lines):
        raise YamlError(f"line {reader.at + 1}: {lines[reader.at][1]!r} belongs to nothing")
    return value


class _Reader:
    def __init__(self, lines: list[tuple[int, str, str]], typed: bool):
        self.lines, self.typed, self.at = lines, typed, 0

    def skip(self) -> None:
        while self.at < len(self.lines) and not self.lines[self.at][1]:
            self.at += 1

    def block(self, indent: int):
        text = self.lines[self.at][1]
        if text == "-" or text.startswith("- "):
            return self.items(indent)
        if _KEY.match(text):
            return self.mapping(indent)
        self.at += 1
        return self.inline(text)

    def items(self, indent: int) -> list:
        out = []
        while (found := self.here(indent)) is not None and (found == "-" or found.startswith("- ")):
            rest = found[1:].lstrip()
            if not rest:
                self.at += 1
                out.append(self.below(indent))
            elif _KEY.match(rest) or rest.startswith("- "):
                inner = indent + len(found) - len(rest)
                self.lines[self.at] = (inner, rest, self.lines[self.at][2])
                out.append(self.block(inner))
            else:
                self.at += 1
                out.append(self.inline(rest))
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while (found := self.here(indent)) is not None and (m := _KEY.match(found)):
            key, rest = str(_scalar(m[1], False)), found[m.end() :]
            if key in out:
                raise YamlError(f"line {self.at + 1}: {key!r} twice")
            self.at += 1
            if rest in ("|", ">", "|-", ">-"):
                out[key] = self.lines_below(indent, rest)
            elif rest:
                out[key] = self.inline(rest)
            else:
                self.skip()
                beside = self.at < len(self.lines) and self.lines[self.at][0] == indent and self.lines[self.at][1].startswith("-")
                out[key] = self.items(indent) if beside else self.below(indent)
        return out

    def here(self, indent: int) -> str | None:
        self.skip()
        if self.at >= len(self.lines) or self.lines[self.at][0] < indent:
            return None
        if self.lines[self.at][0] > indent:
            raise YamlError(f"line {self.at + 1}: {self.lines[self.at][1]!r} is indented too far")
        return self.lines[self.at][1]

    def below(self, indent: int):
        self.skip()
        if self.at >= len(self.lines) or self.lines[self.at][0] <= indent:
            return None
        return self.block(self.lines[self.at][0])

    def lines_below(self, indent: int, mark: str) -> str:
        found = []
        while self.at < len(self.lines) and (not self.lines[self.at][2].strip() or len(self.lines[self.at][2]) - len(self.lines[self.at][2].lstrip()) > indent):
            found.append(self.lines[self.at][2])
            self.at += 1
        while found and not found[-1].strip():
            found.pop()
        margin = min((len(x) - len(x.lstrip()) for x in found if x.strip()), default=0)
        return ("\n" if mark[0] == "|" else " ").join(x[margin:].rstrip() for x in found) + ("" if mark.endswith("-") else "\n")

    def inline(self, text: str):
        while text[:1] in "[{" and text.count("[") + text.count("{") > text.count("]") + text.count("}") and self.at < len(self.lines):
            text += " " + self.lines[self.at][1]
            self.at += 1
        value, end = _flow(text, 0, self.typed, "")
        if text[end:].strip():
            raise YamlError(f"{text!r}: {text[end:]!r} follows a value")
        return value


def _flow(text: str, at: int, typed: bool, stops: str):
    while at < len(text) and text[at] == " ":
        at += 1
    if text[at : at + 1] in ("[", "{"):
        listed, close = text[at] == "[", "]" if text[at] == "[" else "}"
        out: list = []
        at += 1
        while True:
            while text[at : at + 1] in (" ", ","):
                at += 1
            if at >= len(text):
                raise YamlError(f"{text!r} has no end")
            if text[at] == close:
                return (out if listed else dict(out)), at + 1
            if listed:
                value, at = _flow(text, at, typed, ",]")
                out.append(value)
            else:
                m = _KEY.match(text, at)
                if m is None:
                    raise YamlError(f"{text!r}: no key at {text[at:]!r}")
                value, at = _flow(text, m.end(), typed, ",}")
                out.append((str(_scalar(m[1], False)), value))
    if text[at : at + 1] in ('"', "'"):
        m = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'""").match(text, at)
        if m is None:
            raise YamlError(f"{text!r} has no end")
        return _scalar(m[0], typed), m.end()
    if text[at : at + 1] in ("&", "*", "!", "%", "@", "`"):
        raise YamlError(f"{text[at:]!r} isn't read")
    end = at
    while end < len(text) and text[end] not in stops:
        end += 1
    return _scalar(text[at:end].strip(), typed), end


def _scalar(text: str, typed: bool):
    if text[:1] == '"':
        try:
            return json.loads(text)
        except ValueError as e:
            raise YamlError(f"{text}: {e}") from e
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    if not typed:
        return text
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text
