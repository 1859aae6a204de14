"""Structure of source files by lexical scanning: definitions, imports, modules, tables and routes.

A scanner first blanks comments and literals (keeping every offset), pairs the braces that are left, and then reads
declarations off the blanked text. That makes it tolerant of errors; what a full parser would know from types (which
router a variable is) it can only tell by name. Runs in mapInPandas over files; everything after is relational.

Defined results: content that isn't UTF-8 is read with replacement; an unknown language or empty file gives nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LITERALS = {
    "php": r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|#(?!\[)[^\n]*|<<<[ \t]*([\"']?)(\w+)\1\n[\s\S]*?\n[ \t]*\2\b|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'",
    "go": r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'",
    "js": r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|`(?:[^`\\]|\\[\s\S])*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<=[=(,:?!&|])\s*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/",
    "rust": r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|\br(#*)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\.[^'\n]*)'",
    "sql": r"/\*[\s\S]*?(?:\*/|\Z)|--[^\n]*",
}
_FAMILY = {"php": "php", "go": "go", "javascript": "js", "typescript": "js", "tsx": "js", "rust": "rust", "sql": "sql"}
_MASKS = {k: re.compile(v) for k, v in _LITERALS.items()}
_NOT_BLANK = re.compile(r"[^\n]")


def mask(language: str, text: str) -> str:
    """The text with comments and literals blanked out, offsets and line ends kept."""
    return _MASKS[_FAMILY[language]].sub(lambda m: _NOT_BLANK.sub(" ", m[0]), text)


class Source:
    """A file's text, its blanked twin, line numbers and brace pairs."""

    def __init__(self, language: str, text: str):
        self.language, self.text, self.code = language, text, mask(language, text)
        self.close: dict[int, int] = {}
        #: Where the innermost open brace changes, and to which (-1 outside of all).
        self._turns: list[int] = []
        self._inner: list[int] = []
        stack: list[int] = []
        braces: list[int] = []
        for m in re.finditer(r"[{}()]", self.code):
            if m[0] in "{(":
                stack.append(m.start())
                if m[0] == "{":
                    braces.append(m.start())
            elif stack:
                opened = stack.pop()
                self.close[opened] = m.start()
                if braces and braces[-1] == opened:
                    braces.pop()
            self._turns.append(m.start())
            self._inner.append(braces[-1] if braces else -1)
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1

    def body(self, at: int, stop: str = ";") -> tuple[int, bool]:
        """(last offset of a declaration that goes on at `at`, whether it has a body in braces)."""
        code, n = self.code, len(self.code)
        while at < n:
            c = code[at]
            if c == "(":
                at = self.close.get(at, n)
            elif c == "{":
                return self.close.get(at, n - 1), True
            elif c in stop:
                return at, False
            at += 1
        return n - 1, False

    def within(self, at: int, spans: list[tuple[int, int]]) -> bool:
        """Whether the innermost brace around `at` is one of the spans' own."""
        k = bisect_left(self._turns, at) - 1
        inner = self._inner[k] if k >= 0 else -1
        while inner >= 0 and inner not in self.close:  # one that nothing closes holds nothing
            k = bisect_left(self._turns, inner) - 1
            inner = self._inner[k] if k >= 0 else -1
        return inner >= 0 and inner in {self.code.find("{", s) for s, _ in spans}


Found = dict[str, list[dict]]


def _definition(s: Source, kind: str, name: str, start: int, end: int, visibility: str | None = None) -> dict:
    return {"kind": kind, "name": name, "visibility": visibility, "start_line": s.line(start), "end_line": s.line(end)}


def _import(s: Source, target: str, start: int, end: int) -> dict:
    target = target.strip()
    target = (target[: k] if (k := target.find(" as ")) > 0 else target).strip("\"'`;").strip()
    return {"target": target, "start_line": s.line(start), "end_line": s.line(end)}


def scan_php(s: Source) -> Found:
    out: Found = {"definitions": [], "imports": [], "modules": []}
    for m in re.finditer(r"\bnamespace\s+([\w\\]+)\s*([;{])", s.code):
        end = s.close.get(m.end() - 1, m.end() - 1) if m[2] == "{" else m.end() - 1
        out["modules"].append({"name": m[1], "start_line": s.line(m.start()), "end_line": s.line(end)})
    types: list[tuple[int, int]] = []
    for m in re.finditer(r"(?<![\w$>:])((?:(?:abstract|final|readonly)\s+)*)(class|interface|trait|enum)\s+(\w+)", s.code):
        end, body = s.body(m.end())
        if body:
            types.append((m.start(), end))
            out["definitions"].append(_definition(s, m[2], m[3], m.start(), end))
    anonymous = [(m.start(), s.body(m.end())[0]) for m in re.finditer(r"\bnew\s+class\b", s.code)]
    for m in re.finditer(r"(?<![\w$>:])((?:(?:public|private|protected|static|abstract|final)\s+)*)function\s+&?\s*(\w+)\s*\(", s.code):
        end, _ = s.body(m.end() - 1)
        method = s.within(m.start(), types + anonymous)
        seen = re.search(r"public|private|protected", m[1])
        out["definitions"].append(_definition(s, "method" if method else "function", m[2], m.start(), end, seen[0] if seen and method else None))
    for m in re.finditer(r"(?m)^\s*use\s+(?!\()([^;{}]+?)(?:\{([^}]*)\})?\s*;", s.code):
        if s.within(m.start(), types + anonymous):
            continue
        clauses = (m[2] if m[2] is not None else m[1]).split(",")
        at = m.start(2) if m[2] is not None else m.start(1)
        for c in clauses:
            if name := re.sub(r"^\s*(?:function|const)\s+", "", c).strip():
                out["imports"].append(_import(s, name, at, at + len(c)))
            at += len(c) + 1
    return out


def scan_go(s: Source) -> Found:
    out: Found = {"definitions": [], "imports": [], "modules": []}
    for m in re.finditer(r"(?m)^package\s+(\w+)", s.code):
        out["modules"].append({"name": m[1], "start_line": s.line(m.start()), "end_line": s.line(m.end())})
    for m in re.finditer(r"(?m)^func\s*(\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", s.code):
        end, body = s.body(m.end() - 1, "\n")
        out["definitions"].append(_definition(s, "method" if m[1] else "function", m[2], m.start(), end if body else s.close.get(m.end() - 1, m.end())))
    for m in re.finditer(r"(?m)^[ \t]*type\s+(?:\(|(\w+))", s.code):
        if m[1]:
            end, _ = s.body(m.end(), "\n")
            out["definitions"].append(_definition(s, "type", m[1], m.start(), end - (s.code[end] == "\n")))
        else:
            end = s.close.get(m.end() - 1, m.end())
            at = m.end()
            while (x := re.compile(r"\s*(\w+)").match(s.code, at)) and x.end() < end:
                out["definitions"].append(_definition(s, "type", x[1], m.start(), end))
                at = s.body(x.end(), "\n")[0] + 1
    for m in re.finditer(r"(?m)^import\s*(\()?", s.code):
        end = s.close.get(m.end() - 1, m.end()) if m[1] else (s.code + "\n").find("\n", m.end())
        for x in re.finditer(r'"([^"\n]*)"', s.text[m.end() : end]):
            at = m.end() + x.start()
            out["imports"].append(_import(s, x[1], at, at))
    return out


_JS_NOT_METHODS = frozenset("if for while switch catch function with return await new typeof super import constructor_".split())


def scan_js(s: Source) -> Found:
    out: Found = {"definitions": [], "imports": [], "modules": []}
    typed = s.language != "javascript"
    for m in re.finditer(r"(?<![\w$.])((?:abstract\s+)?)class\s+([\w$]+)", s.code):
        end, body = s.body(m.end())
        if body and not m[1]:
            out["definitions"].append(_definition(s, "class", m[2], m.start(), end))
    for m in re.finditer(r"(?<![\w$.=(,:?]\s)(?<![\w$.=(,:?])(?:async\s+)?function\s+([\w$]+)", s.code):
        end, body = s.body(m.end())
        if body:
            out["definitions"].append(_definition(s, "function", m[1], m.start(), end))
    for m in re.finditer(r"(?:(?<=[{};,\n])|(?<=\*/))[ \t]*((?:(?:static|async|get|set|public|private|protected|override|readonly)\s+|\*\s*)*)(#?[\w$]+)\s*(?:<[^<>(){}]*>)?\(", s.code):
        close = s.close.get(m.end() - 1)
        if m[2] in _JS_NOT_METHODS or close is None:
            continue
        after = re.compile(r"\)\s*(?::[^;={}()]*(?:\{[^{}]*\}[^;={}()]*)*)?\{").match(s.code, close)
        if after:
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            out["definitions"].append(_definition(s, "method", m[2], start, s.close.get(after.end() - 1, len(s.code) - 1)))
    if typed:
        for kind in ("interface", "enum"):
            for m in re.finditer(rf"(?<![\w$.]){kind}\s+([\w$]+)", s.code):
                end, body = s.body(m.end())
                if body:
                    out["definitions"].append(_definition(s, kind, m[1], m.start(), end))
        for m in re.finditer(r"(?<![\w$.])type\s+([\w$]+)\s*(?:<[^=]*>)?\s*=", s.code):
            at, n = m.end(), len(s.code)
            while at < n and s.code[at] != ";" and not (s.code[at] == "\n" and not re.match(r"\s*[|&?:]", s.code[at:]) and s.code[m.end() : at].strip()):
                at = s.close.get(at, at) + 1 if s.code[at] in "{(" else at + 1
            out["definitions"].append(_definition(s, "type", m[1], m.start(), min(at, n - 1) - (at < n and s.code[at] == "\n")))
    for m in re.finditer(r"(?<![\w$.])import\b(?!\s*\()", s.code):
        x = re.compile(r"import\b[^;'\"`]*?(['\"])([^'\"\n]*)\1").match(s.text, m.start())
        if x:
            out["imports"].append(_import(s, x[2], m.start(), x.end()))
    return out


def scan_rust(s: Source) -> Found:
    out: Found = {"definitions": [], "imports": [], "modules": []}
    pub = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
    for m in re.finditer(rf"(?<![\w]){pub}mod\s+(\w+)", s.code):
        out["modules"].append({"name": m[1], "start_line": s.line(m.start()), "end_line": s.line(s.body(m.end())[0])})
    for kind, words in (("function", r"(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn"), ("struct", "struct"), ("enum", "enum"), ("trait", r"(?:unsafe\s+)?trait")):
        for m in re.finditer(rf"(?<![\w]){pub}{words}\s+(\w+)", s.code):
            end, body = s.body(m.end())
            if body or kind == "struct":
                out["definitions"].append(_definition(s, kind, m[1], m.start(), end))
    for m in re.finditer(r"(?m)^[ \t]*(?:unsafe\s+)?impl\b\s*(?:<[^{]*?>\s*)?(?:[\w:<>', ]+?\s+for\s+)?(\w+)\s*(?:where[^{]*)?\{", s.code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        out["definitions"].append(_definition(s, "impl", m[1], start, s.close.get(m.end() - 1, len(s.code) - 1)))
    for m in re.finditer(rf"(?m)^[ \t]*{pub}use\s+([^;]+);", s.code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        out["imports"].append(_import(s, m[1], start, m.end() - 1))
    return out


#: Scanners by language; add one to teach the engine another language.
SCANNERS: dict[str, Callable[[Source], Found]] = {"php": scan_php, "go": scan_go, "javascript": scan_js, "typescript": scan_js, "tsx": scan_js, "rust": scan_rust}


def parse(language: str, content: bytes | str) -> Found:
    """Definitions by (start, name), imports by (start, target) and modules by start, without repeats."""
    text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content
    found = SCANNERS[language](Source(language, text))
    seen: set[tuple] = set()
    once = lambda rows, key: [r for r in rows if not (k := tuple(r[c] for c in key)) in seen and not seen.add(k)]
    d = once(found["definitions"], ("kind", "name", "start_line", "end_line"))
    i = once(found["imports"], ("target", "start_line", "end_line"))
    m = once(found["modules"], ("name", "start_line", "end_line"))
    return {
        "definitions": sorted(d, key=lambda r: (r["start_line"], r["name"])),
        "imports": sorted(i, key=lambda r: (r["start_line"], r["target"])),
        "modules": sorted(m, key=lambda r: r["start_line"]),
    }


_DEF = "array<struct<kind:string,name:string,visibility:string,start_line:int,end_line:int>>"
_IMP = "array<struct<target:string,start_line:int,end_line:int>>"
_MOD = "array<struct<name:string,start_line:int,end_line:int>>"


def parse_files(files: DataFrame, *kept: str) -> DataFrame:
    """(path, language, definitions, imports, modules) of the files (path, language, content) with a known language; with
    the columns `kept`, of all files."""
    kinds = "".join(f"{files.schema[k].name} {files.schema[k].dataType.simpleString()}, " for k in kept)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [parse(g, c) if g in SCANNERS and c is not None else {"definitions": [], "imports": [], "modules": []} for g, c in zip(f["language"], f["content"])]
            yield pd.DataFrame({"path": f["path"], "language": f["language"]} | {k: f[k] for k in kept} | {k: [x[k] for x in found] for k in ("definitions", "imports", "modules")})

    read = files if kept else files.where(F.col("language").isin(sorted(SCANNERS)))
    return read.select(*dict.fromkeys(("path", "language", "content", *kept))).mapInPandas(run, f"path string, language string, {kinds}definitions {_DEF}, imports {_IMP}, modules {_MOD}")


# ---------------------------------------------------------------- DDL

#: What a table element that is no column begins with.
_NO_COLUMN = frozenset("primary foreign unique constraint check key index exclude like".split())
_SQL = re.compile(r"(?P<note>--[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<gap>\s+)|(?P<mark>[(),;])|(?P<text>\"[^\"]*\"|`[^`]*`|'[^']*'|\[[^\]]*\]|[^\s(),;\"`']+|.)")
_QUOTES = "\"'`"


def _sql_tokens(sql: str) -> list[tuple[str, str, int, bool]]:
    """(kind, text, offset, whether a gap or comment stands before) of a script, gaps and comments left out."""
    out, gap = [], True
    for m in _SQL.finditer(sql):
        if m.lastgroup in ("note", "gap"):
            gap = True
        else:
            out.append((m.lastgroup, m[0], m.start(), gap))
            gap = False
    return out


def _after_create(tokens: list[tuple[str, str, int, bool]], k: int) -> int | None:
    """Index of the name token of a CREATE TABLE statement that begins at token k."""
    words = [t[1].lower() for t in tokens[k : k + 7]]
    n = 1
    while n < len(words) and words[n] in ("temp", "temporary", "unlogged"):
        n += 1
    if words[:1] != ["create"] or words[n : n + 1] != ["table"]:
        return None
    n += 4 if words[n + 1 : n + 4] == ["if", "not", "exists"] else 1
    return k + n


def parse_tables(sql: str) -> list[dict]:
    """Tables created by a script: name, columns as name:type, the statement's line.

    A column's type is what follows its name up to the next gap, so `numeric(10, 2)` gives `numeric(10`. Comments are
    gaps. A statement whose brackets don't close gives no table.
    """
    tokens, out, k = _sql_tokens(sql), [], 0
    while k < len(tokens):
        at = _after_create(tokens, k)
        if at is None:
            k += 1
            continue
        line, name, k = sql.count("\n", 0, tokens[k][2]) + 1, "", at
        while k < len(tokens) and tokens[k][0] == "text" and (not name or not tokens[k][3]):
            name, k = name + tokens[k][1], k + 1
        if not name or k >= len(tokens) or tokens[k][1] != "(":
            continue
        elements: list[list[str]] = [[]]
        depth, k = 1, k + 1
        while k < len(tokens) and depth:
            _, text, _, gap = tokens[k]
            depth += {"(": 1, ")": -1}.get(text, 0)
            if text == "," and depth == 1:
                elements.append([])
            elif depth:
                if gap or not elements[-1]:
                    elements[-1].append("")
                elements[-1][-1] += text
            k += 1
        if depth:
            continue
        columns = []
        for fields in elements:
            if not fields or re.match(r"\w*", fields[0])[0].lower() in _NO_COLUMN:
                continue
            kind = fields[1].strip(_QUOTES + ",").lower() if len(fields) > 1 else ""
            columns.append(":".join(filter(None, (fields[0].strip(_QUOTES), kind))))
        out.append({"name": name.strip(_QUOTES), "columns": columns, "line": line})
    return out


# ---------------------------------------------------------------- routes

#: HTTP verbs and how routers spell them.
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE", "ANY")
_VERB_CALL = {**{v: v for v in VERBS}, **{v.title(): v for v in VERBS}}


def _arguments(s: Source, open_at: int) -> list[str]:
    """The original texts of a call's arguments."""
    end, depth, begin, out = s.close.get(open_at, open_at), 0, open_at + 1, []
    for k in range(open_at + 1, end):
        c = s.code[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(s.text[begin:k].strip())
            begin = k + 1
    out.append(s.text[begin:end].strip())
    return [a for a in out if a]


def _text(argument: str) -> str | None:
    m = re.fullmatch(r"[\"`']([^\"`']*)[\"`']", argument)
    return m[1] if m else None


def _handler(argument: str, package: str) -> str:
    """A handler's name; 'closure' for a function literal."""
    if argument.startswith("func"):
        return "closure"
    m = re.match(r"&?([\w.]+)", argument)
    if not m:
        return ""
    name = m[1]
    return f"{package}.{name}" if package and "." not in name else name


def go_routes(text: str) -> list[dict]:
    """Routes that a Go file registers: method, path with its groups' prefixes, handler, lines. By name only."""
    s = Source("go", text)
    package = (re.search(r"(?m)^package\s+(\w+)", s.code) or [None, ""])[1]
    functions = [(m.start(), s.body(m.end() - 1, "\n")[0]) for m in re.finditer(r"(?m)^func\s*(?:\([^)]*\)\s*)?\w+\s*(?:\[[^\]]*\])?\(", s.code)] or [(0, len(text))]
    receivers = dict(re.findall(r"\b(\w+)\s+\*?([A-Z]\w*)\b", s.code))
    out, seen = [], set()
    for begin, end in functions:
        groups: dict[str, tuple[str, str]] = {}
        for m in re.finditer(r"(\w+)\s*:?=\s*(\w+)\.(?:Group|Route|PathPrefix)\(", s.code[begin:end]):
            args = _arguments(s, begin + m.end() - 1)
            if args and (p := _text(args[0])) is not None:
                groups[m[1]] = (m[2], p)

        def prefix(name: str, guard: frozenset[str] = frozenset()) -> str:
            if name not in groups or name in guard:
                return ""
            base, own = groups[name]
            return prefix(base, guard | {name}).rstrip("/") + own

        for m in re.finditer(r"(\w+)\.(\w+)\(", s.code[begin:end]):
            at = begin + m.end() - 1
            args = _arguments(s, at)
            verb = _VERB_CALL.get(m[2])
            path = None
            if verb and len(args) >= 2:
                path, rest = _text(args[0]), args[1:]
            elif m[2] in ("Handle", "Method", "MethodFunc") and len(args) >= 3 and (v := _text(args[0])) and v.upper() in VERBS:
                verb, path, rest = v.upper(), _text(args[1]), args[2:]
            elif m[2] in ("HandleFunc", "Handle") and len(args) >= 2 and (p := _text(args[0])) and " " in p and p.split(" ")[0] in VERBS:
                verb, path = p.split(" ", 1)
                rest = args[1:]
            if path is None or not (path.startswith("/") or path == ""):
                continue
            full = prefix(m[1]).rstrip("/") + path if m[1] in groups else path
            key = f"{verb} {full}"
            if key in seen:
                continue
            seen.add(key)
            name = _handler(rest[-1], package)
            if (x := re.fullmatch(r"(\w+)\.(\w+)", name)) and x[1] in receivers and x[1] != package:
                name = f"{package}.{receivers[x[1]]}.{x[2]}"
            out.append({"method": verb, "path": full, "handler": "" if name == "closure" else name, "closure": name == "closure", "start_line": s.line(begin + m.start()), "end_line": s.line(s.close.get(at, at))})
    return out


def php_routes(text: str) -> list[dict]:
    """Routes that a PHP file registers with Route::verb: method, path, controller and action, lines."""
    s = Source("php", text)
    out = []
    for m in re.finditer(r"\bRoute::(get|post|put|patch|delete|options|any)\s*\(", s.code):
        at = m.end() - 1
        args = _arguments(s, at)
        path = _text(args[0]) if args else None
        if path is None:
            continue
        target = args[1] if len(args) > 1 else ""
        controller = action = ""
        if x := re.match(r"\[\s*\\?([\w\\]+)::class\s*,\s*['\"](\w+)['\"]", target):
            controller, action = x[1], x[2]
        elif x := re.fullmatch(r"['\"]([\w\\]+)@(\w+)['\"]", target):
            controller, action = x[1], x[2]
        out.append({"method": m[1], "path": path if path.startswith("/") else "/" + path, "controller": controller, "action": action, "start_line": s.line(m.start()), "end_line": s.line(s.close.get(at, at))})
    return out


def php_tables(text: str) -> list[dict]:
    """Tables that a PHP file creates with Schema::create: name, columns, lines."""
    s = Source("php", text)
    out = []
    for m in re.finditer(r"\bSchema::create\s*\(", s.code):
        at = m.end() - 1
        args = _arguments(s, at)
        name = _text(args[0]) if args else None
        if name is None:
            continue
        end = s.close.get(at, len(text))
        columns = [f"{x[2]}:{x[1]}" for x in re.finditer(r"->(\w+)\(\s*['\"](\w+)['\"]", s.text[at:end])]
        out.append({"name": name, "columns": columns, "start_line": s.line(m.start()), "end_line": s.line(end)})
    return out
