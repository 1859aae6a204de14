"""Finding source files that do not parse, from maps of lexer states and bracket summaries that compose.

A chunk is a map from the lexer state it is entered in to a summary: the closing brackets it needs from before, the
opening brackets it leaves, the lexer state it ends in, and what its local grammar found wrong. Maps compose
associatively, so a file's verdict is a reduction over its chunks in line order, within strides first, then over these.
Each chunk is read where it lies, and no text is shuffled by file. All chunks are read from the ordinary state; only for
the files of which a chunk ends in another one (within a comment, literal, template, markup or text between tags) their
chunks are read from that state as well, and again while this shows further states.

The local grammars judge balanced code by what may stand next to what: two names, a name and a number or string, a
declaring keyword after a name, an operator without its operand, conflict markers, another language's openers.
Comments and literals are opaque to them.

Defined results: null content is empty and valid; a file of no known language is not judged; a chunk delivered twice
counts once, at the first line that any delivery gives; a null start line sorts first. PHP without an opening tag doesn't
count as PHP.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..durable import Cut, cut

CLOSES = {")": "(", "]": "[", "}": "{"}

#: The languages' reserved words, as far as the grammars need them.
WORDS = {
    "javascript": "async await break case catch class const continue debugger default delete do else export extends false finally for from function get if import in instanceof let new null of return set static super switch this throw true try typeof undefined var void while with yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate default dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while macro_rules",
    "php": "abstract and array as bool break callable case catch class clone const continue declare default die do echo else elseif enum exit extends false final finally float fn for foreach from function global goto if implements include include_once instanceof insteadof int interface isset iterable list match mixed namespace never new null or print private protected public readonly require require_once return self static string switch throw trait true try unset use var void while xor yield",
}
TYPED = " abstract accessor any as asserts declare enum global implements infer interface is keyof module namespace never out override private protected public readonly satisfies type unique unknown"
#: Words that may stand after a name or literal.
AFTER = {
    "javascript": "extends from in instanceof of",
    "typescript": "as extends from implements in instanceof is of satisfies",
    "go": "chan func interface map struct range",
    "rust": "as else for if in where",
    "php": "and as extends implements instanceof insteadof or xor use",
}
#: Words that open a declaration or statement and can't follow a name.
OPENS = {
    "javascript": "async break case class const continue do else export for function if import let return static switch throw try var while new typeof",
    "go": "package import type var const return if for switch select defer go break continue",
    "rust": "fn struct enum impl trait mod use let pub match while loop return static type unsafe extern const",
    "php": "class function if for foreach while switch return public private protected abstract final namespace try throw echo new interface trait const",
}
FAMILY = {"javascript": "javascript", "typescript": "javascript", "tsx": "javascript", "go": "go", "rust": "rust", "php": "php"}
NAME, NUMBER, STRING, VARIABLE, KEYWORD, PUNCT = "n", "0", "s", "v", "k", "p"
CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?: [^\n]*)?$|={7}$", re.M)


#: Between a state's place and its stack of open brackets (T: template text; J: inside a tag; C: between tags).
MARK = "\x1f"


def stacked(state: str) -> str:
    """The stack that a state holds."""
    return state.partition(MARK)[2]


@dataclass(slots=True)
class Summary:
    """What a chunk needs and leaves. state is '' for the ordinary state, else where in a token the chunk ends and, after
    a mark, the open brackets, templates and tags; last is its last operator or word, 'x' for any other token."""

    need: str = ""
    left: str = ""
    state: str = ""
    error: str = ""
    top: str = ""
    tag: bool = False
    last: str = ""

    def then(self, other: Summary) -> Summary:
        """This chunk followed by `other`, which must have been read from this one's state."""
        left, need, error = self.left, self.need, self.error or other.error
        held = sum(map(stacked(self.state).count, "([{"))
        left = left[: len(left) - held]  # what the state holds is part of what `other` leaves
        top = self.top or (other.top if not left and not need else "")
        for c in other.need:
            if not left:
                need += c
            elif left[-1] == CLOSES[c]:
                left = left[:-1]
            else:
                error = error or f"{left[-1]} closed by {c}"
                break
        return Summary(need, left + other.left, other.state, error, top, self.tag or other.tag, other.last or self.last)


def _words(language: str) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    family = FAMILY[language]
    typed = language in ("typescript", "tsx")
    words = WORDS[family] + (TYPED if typed else "")
    return frozenset(words.split()), frozenset(AFTER["typescript" if typed else family].split()), frozenset(OPENS[family].split())


_TABLES = {language: _words(language) for language in FAMILY}
_ID = r"[A-Za-z_\u0080-￿][\w]*"
_TOKENS = {
    "javascript": r"(?P<w>[A-Za-z_$\u0080-￿#][\w$]*)|(?P<d>\d[\w.]*|\.\d\w*)|(?P<s>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|(?P<l>\n)|(?P<b>[(){}\[\]])|(?P<p>=>|\.\.\.|\?\.|&&|\|\||\?\?|[-+]{2}|[=!]==?|[<>]=|[-+*/%&|^]=|[^\s\w])",
    "go": rf"(?P<w>{_ID})|(?P<d>\d[\w.]*|\.\d\w*)|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:[0-7]{{3}}|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[^\n]))')|(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|(?P<l>\n)|(?P<b>[(){{}}\[\]])|(?P<p>:=|\.\.\.|<-|&&|\|\||[-+]{{2}}|[=!<>]=|[^\s\w])",
    "rust": rf"(?P<s>b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]+\}}|[^\n]))'|(?:br|r|cr)(?P<h>#*)\"[\s\S]*?\"(?P=h))|(?P<w>(?:r\#)?{_ID})|(?P<d>\d(?:[\w]|\.\d)*)|(?P<c>//[^\n]*|/\*)|(?P<l>\n)|(?P<b>[(){{}}\[\]])|(?P<t>'{_ID})|(?P<p>::|->|=>|\.\.[.=]?|&&|\|\||[=!<>]=|[^\s\w])",
    "php": rf"(?P<s>\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'|`[^`]*`)|(?P<h><<<[ \t]*(?P<q>[\"']?)(?P<m>\w+)(?P=q)(?:\n|\Z))|(?P<v>\${_ID})|(?P<w>\\?{_ID}(?:\\{_ID})*)|(?P<d>\d[\w.]*|\.\d\w*)|(?P<c>//(?:(?!\?>)[^\n])*|\#(?!\[)(?:(?!\?>)[^\n])*|/\*[\s\S]*?\*/)|(?P<l>\n)|(?P<b>[(){{}}\[\]])|(?P<p>\?>|\?->|->|=>|::|\.\.\.|&&|\|\||\?\?|[-+]{{2}}|[=!]==?|[<>]=|[^\s\w])",
}
_MATCH = {family: re.compile(p).match for family, p in _TOKENS.items()}
_SPACE = re.compile(r"[ \t\r\f\v ﻿]+")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TAG = re.compile(r"\s*([A-Za-z_$][\w$.:-]*)|\s*(>)")
_ATTRIBUTE = re.compile(r"\s*(?:[A-Za-z_$][\w$:.-]*\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'))?|//[^\n]*|/\*[\s\S]*?\*/)")
_NEST = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_CALL_BEFORE = frozenset(")]}")
_NO_OPERAND = frozenset("= + * / % | ^ & , ( [ && || ?? == === != !== <= >= := => ...".split())

#: What no file ends with.
_PENDING = frozenset("= + % | ^ & , . && || ?? == === != !== <= >= := => -> ?-> :: ...".split())
#: Words that no file ends with.
DECLARES = {
    "javascript": "class const export extends function import let new throw typeof var",
    "go": "chan const defer func go goto if import interface map package range struct switch type var",
    "rust": "as const enum extern fn for if impl in let match mod mut pub static struct trait type unsafe use where while",
    "php": "abstract class const extends function implements insteadof interface namespace new private protected public trait use",
}


def lex(language: str, text: str, state: str = "", path: str = "") -> Summary:
    """The summary of a chunk of code, read from the lexer state `state`."""
    return _Lexer(language, text, state, path).run()


class _Lexer:
    def __init__(self, language: str, text: str, state: str, path: str):
        self.language, self.text, self.state = language, text, state
        self.family = FAMILY[language]
        self.words, self.after, self.opens = _TABLES[language]
        self.markup = language == "tsx" or (language == "javascript" and not path.lower().endswith((".mjs", ".cjs")))

    def enter(self) -> tuple[int, str]:
        """Where code begins, and in what state if it doesn't."""
        t, s = self.text, self.state.partition(MARK)[0]
        if s.startswith("comment"):
            depth = int(s[7:] or 1)
            if self.family != "rust":
                k = t.find("*/")
                return (k + 2, "") if k >= 0 else (len(t), s)
            for m in _NEST.finditer(t):
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    return m.end(), ""
            return len(t), f"comment{depth}"
        for mark, rx in (("until ", s[6:]), ("html", r"<\?(?:php\b|=)")):
            if s.startswith(mark):
                m = re.search(rx, t)
                return (m.end(), "") if m else (len(t), s)
        return 0, s

    def run(self) -> Summary:
        text, family, n = self.text, self.family, len(self.text)
        match, words, after, opens = _MATCH[family], self.words, self.after, self.opens
        out = Summary()
        at, state = self.enter()
        if family == "php":
            first = re.match(r"\s*(?:#![^\n]*\n)?\s*<\?(?:php\b|=)", text) if not self.state else None
            out.tag = "<?php" in text or "<?=" in text
            if first:
                at = first.end()
        elif not self.state and text.startswith("#!") and not text.startswith("#!["):
            at = (text.find("\n") + 1) or n
        stack = list(stacked(self.state))  # brackets and templates and tags
        kinds: list[str] = []  # Go: what each brace is
        prev, value, before, line, fresh = "", "", "", True, True
        questions = [0] * (1 + sum(x in "([{" for x in stack))
        error = ""
        if state in ("template", "markup"):
            at, error = (self.template(at, stack), "") if state == "template" else self.tags(at, stack)
            out.state = state if at < 0 and not error else ""
            if at > 0 and text[at - 1] == "{" and stack[-1:] == ["{"]:
                prev, value = PUNCT, "{"
                questions.append(0)
            else:
                prev, value = STRING, "``" if state == "template" else "<>"
        elif state:
            out.state = state
        if out.state or error:
            at = n
        tight = family in ("rust", "php")
        members = ("->", "?->", "::") if family == "php" else (".", "?.")
        free = 0  # Rust: the bracket that opened a macro's own tokens
        while at < n:
            space = _SPACE.match(text, at)
            if space:
                at = space.end()
                if at >= n:
                    break
            m = match(text, at)
            if m is None:
                error = "a stray character"
                break
            kind, token = m.lastgroup, m[0]
            if kind in ("h", "q", "m") and family == "rust":
                kind = "s"
            if kind == "l":
                line, at = True, m.end()
                if text[at : at + 7] in ("<<<<<<<", "=======", ">>>>>>>", "|||||||") and CONFLICT.match(text, at):
                    error = "a conflict marker"
                    break
                continue
            if kind == "c":
                at = m.end()
                if token == "/*":  # Rust's comments nest
                    depth = 1
                    for x in _NEST.finditer(text, at):
                        depth += 1 if x[0] == "/*" else -1
                        if not depth:
                            at = x.end()
                            break
                    else:
                        out.state = f"comment{depth}"
                        break
                elif "\n" in token:
                    line = True
                continue
            start, at = at, m.end()
            if start == 0 and CONFLICT.match(text):
                error = "a conflict marker"
                break
            if kind == "w":
                bare = "" if value in members else token
                if bare in words :
                    now = KEYWORD
                elif family == "php" and bare.lower() in words:
                    now, bare = KEYWORD, bare.lower()
                else:
                    now = NAME
            elif kind == "d":
                now = NUMBER
            elif kind == "s":
                now = STRING
            elif kind == "v":
                now = VARIABLE
            elif kind == "t":
                now = "t"
            elif kind in ("h", "q", "m"):  # a heredoc
                end = re.compile(rf"(?m)^[ \t]*{m['m']}\b").search(text, at)
                if end is None:
                    out.state = rf"until (?m)^[ \t]*{m['m']}\b"
                    break
                at, now, token = end.end(), STRING, "''"
            else:
                now = PUNCT
            same = tight or not line

            if now == PUNCT:
                if kind == "b":
                    if token in "([{":
                        if family == "go":
                            kinds.append("type" if token == "{" and value in ("struct", "interface") else "import" if token == "(" and value in ("import", "const", "var", "type") else "args" if token == "(" else "block" if token == "{" and prev != NAME or token == "{" and before == ")" else "other")
                        stack.append(token)
                        questions.append(0)
                        if family == "rust" and value == "!" and not free and text[start - 1 : start] in ("!", " "):
                            free = len(stack)
                    else:
                        if value in _NO_OPERAND and value not in (",", "(", "[", "...", "=>") and not (value in "*&" or (value == "|" and family == "rust") or (value in ("=", "+", "==", "||", "&&") and family == "rust") or (value in "?" )):
                            error = f"{value} before {token}"
                            break
                        if stack and stack[-1] == CLOSES[token]:
                            if free == len(stack):
                                free = 0
                            stack.pop()
                            questions.pop()
                            if kinds:
                                kinds.pop()
                            if stack and stack[-1] in "TJC" and token == "}":
                                inside = "template" if stack[-1] == "T" else "markup"
                                at, error = (self.template(at, stack), "") if inside == "template" else self.tags(at, stack)
                                if error:
                                    break
                                if at < 0:
                                    out.state = inside
                                    break
                                if text[at - 1] == "{":
                                    token = "{"
                                    questions.append(0)
                                else:
                                    now, token = STRING, "``" if inside == "template" else "<>"
                        elif stack and stack[-1] in "([{":
                            error = f"{stack[-1]} closed by {token}"
                            break
                        elif stack:
                            error = f"{token} in markup"
                            break
                        else:
                            out.need += token
                elif token == "`":
                    stack.append("T")
                    at = self.template(at, stack)
                    if at < 0:
                        out.state = "template"
                        break
                    if text[at - 1] == "{":
                        token = "{"
                        questions.append(0)
                    else:
                        now, token = STRING, "``"
                elif token in ("/", "/=") and family == "javascript" and (prev in ("", PUNCT, KEYWORD) and value not in _CALL_BEFORE and value not in ("this", "super", "null", "true", "false", "undefined")):
                    x = _REGEX.match(text, start)
                    if x is None:
                        if text.startswith("/*", start):
                            out.state = "comment"
                        else:
                            error = "/ without a left side"
                        break
                    at, now, token = x.end(), STRING, "//"
                elif token == "/" and text.startswith("/*", start):
                    out.state = "comment"
                    break
                elif token == "<" and self.markup and (prev in ("", PUNCT, KEYWORD) and value not in _CALL_BEFORE) and (x := _TAG.match(text, at)) and not (x[1] and re.match(r"\s*(?:,|extends\b)", text[x.end() : x.end() + 12])):
                    stack.append("J")
                    at, error = self.tags(start, stack, True)
                    if error:
                        break
                    if at < 0:
                        out.state = "markup"
                        break
                    if text[at - 1] == "{":
                        token = "{"
                        questions.append(0)
                    else:
                        now, token = STRING, "<>"
                elif token in "\"'":
                    if family == "rust" and token == '"':
                        out.state = r'until (?s)(?:[^"\\]|\\.)*?"'
                    elif family == "php":
                        out.state = rf"until (?s)\A(?:[^{token}\\]|\\.)*{token}"
                    else:
                        error = "a string without an end"
                    break
                elif token == "`" and family == "go":
                    out.state = "until `"
                    break
                elif token == "?>":
                    x = re.search(r"<\?(?:php\b|=)", text[at:])
                    if x is None:
                        out.state = "html"
                        break
                    at, token = at + x.end(), ";"
                elif token == "?" and family == "javascript":
                    questions[-1] += 1
                elif token in ";":
                    questions[-1] = 0
                    if value in ("=", "+", "==", "===", "&&", "||", ":=", "[") and prev == PUNCT:
                        error = f"{value} before ;"
                        break
                elif token == ":" and self.language == "javascript" and stack and stack[-1] == "(" and prev in (NAME,) and before in ("(", ",") and not questions[-1]:
                    error = "a type in an untyped language"
                    break
                elif token == "<" and text.startswith("<?php", start):
                    error = "another language's opener"
                    break
                elif token == "#" and family == "go" or token in "\\@$" and family in ("go", "rust") and token != "@" and not (token == "$" and family == "rust") or token == "@" and family == "go":
                    error = f"a stray {token}"
                    break
                if token == ":" and questions[-1]:
                    questions[-1] -= 1
                if family in ("javascript", "go") and token == "..." and prev in (NUMBER,):
                    error = "a number before ..."
                    break
                if token == "." and (fresh or (value in (";", "}") and line)) and family == "javascript" and prev == PUNCT and value == ";":
                    error = "a statement that begins with ."
                    break
            elif prev and prev != PUNCT and same and not free:
                if now == NAME:
                    if prev == NAME:
                        if family != "go" or before == "n" or (kinds and kinds[-1] == "block" and fresh2):
                            error = f"{value} {token}"
                            break
                    elif prev in (NUMBER, STRING):
                        if not (family == "php" and prev == STRING and value == "''"):
                            error = f"a literal before {token}"
                            break
                    elif prev == VARIABLE:
                        error = f"a variable before {token}"
                        break
                elif now == KEYWORD:
                    if prev in (NAME, NUMBER, STRING, VARIABLE) and bare not in after and (prev == NAME and bare in opens or prev in (NUMBER, STRING) and bare in opens):
                        if not (family == "rust" and (prev == STRING and bare in ("fn", "unsafe"))) and not (family == "php" and bare in ("static", "new")):
                            error = f"{value} before {bare}"
                            break
                elif now in (NUMBER, STRING):
                    if prev in (NUMBER, STRING, VARIABLE) and not (family == "go" and token[0] == "`"):
                        error = "two literals"
                        break
                    if prev == NAME:
                        if now == NUMBER or not (family == "go" and (token[0] == "`" or before in ("(", "") or not kinds or kinds[-1] in ("import", "type"))) and not (family == "javascript" and token == "``") and not (family == "php" and token == "''"):
                            error = f"{value} before a literal"
                            break
                elif now == VARIABLE and (prev in (NUMBER, STRING, VARIABLE) or prev == NAME and fresh2):
                    error = f"{value} {token}"
                    break
            if now in (NUMBER,) and value == "..." and prev == PUNCT and family != "rust":
                error = "a number after ..."
                break
            if family in ("go", "rust") and not stack and (line or not prev) and now in (NAME, NUMBER, STRING) and not out.top and (prev == "" or value in ("}", ")", ";", '"') or family == "go"):
                if family == "go" or not re.match(r"\s*(?:!|::)", text[at : at + 8]):
                    out.top = out.top or f"{token} at the top"
            before = "n" if prev == NAME and not line else value if now == NAME else before
            if now == NAME and prev == PUNCT:
                before = value
            fresh2 = now in (NAME,) and (prev == "" or value in (";", "{", "}") or (line and family == "go"))
            fresh = token == ";"
            prev, line = now, False
            value = token if now != KEYWORD else bare
        if not error and any(x in "TJC" for x in stack):
            out.state += MARK + "".join(stack)
        out.left = "".join(x for x in stack if x in "([{")
        out.error = error
        out.last = value if prev in (PUNCT, KEYWORD) else "x" if prev else ""
        return out

    def template(self, at: int, stack: list[str]) -> int:
        """From within template text: after its end (T popped), or after its next ${ (a { pushed); -1 without either."""
        at = _TEMPLATE.match(self.text, at).end()
        if self.text.startswith("`", at):
            stack.pop()
            return at + 1
        if self.text.startswith("${", at):
            stack.append("{")
            return at + 2
        return -1

    def tags(self, at: int, stack: list[str], opening: bool = False) -> tuple[int, str]:
        """From within markup: after its end, or after the next { of an expression (pushed); (-1, '') without either."""
        text, n = self.text, len(self.text)
        if opening:
            x = _TAG.match(text, at + 1)
            at = x.end()
            if x[2]:
                stack[-1] = "C"
            elif (g := re.compile(r"<[^<>(){};]*>").match(text, at)) is not None:
                at = g.end()
        while stack and stack[-1] in "JC":
            if stack[-1] == "J":
                while (x := _ATTRIBUTE.match(text, at)) and x.end() > at:
                    at = x.end()
                while at < n and text[at].isspace():
                    at += 1
                if text.startswith("/>", at):
                    stack.pop()
                    at += 2
                elif text.startswith(">", at):
                    stack[-1] = "C"
                    at += 1
                elif text.startswith("={", at) or text.startswith("{", at) or re.match(r"=\s*\{", text[at : at + 20]):
                    at = text.index("{", at) + 1
                    stack.append("{")
                    return at, ""
                elif at >= n:
                    return -1, ""
                else:
                    return at, f"{text[at]} in a tag"
            else:
                x = re.compile(r"[<{}>]").search(text, at)
                if x is None:
                    return -1, ""
                at = x.end()
                if x[0] == "{":
                    stack.append("{")
                    return at, ""
                if x[0] in "}>":
                    return at, f"{x[0]} between tags"
                if (c := re.compile(r"\s*/\s*[\w$.:-]*\s*>").match(text, at)) is not None:
                    at = c.end()
                    stack.pop()
                elif (o := _TAG.match(text, at)) is not None:
                    at = o.end()
                    stack.append("C" if o[2] else "J")
                elif not text[at:].strip():
                    return -1, ""
                else:
                    return at, "< between tags"
        return at, ""


def compose(maps: list[dict[str, Summary]], state: str = "") -> tuple[Summary | None, str]:
    """(summary of consecutive chunks entered in `state`, ''); or (None, the state that a chunk must yet be read from)."""
    whole = None
    for m in maps:
        part = m.get(whole.state if whole else state)
        if part is None:
            return None, whole.state if whole else state
        whole = whole.then(part) if whole else part
    return whole or Summary(state=state), ""


def verdict(language: str, whole: Summary) -> str:
    """What is wrong with a file of this summary; '' if nothing is."""
    if whole.error or whole.top:
        return whole.error or whole.top
    if whole.state and whole.state != "html":
        return "it ends within a literal, comment or markup"
    if whole.need:
        return f"{whole.need[0]} closes nothing"
    if whole.left:
        return f"{whole.left[-1]} isn't closed"
    if not whole.state and (whole.last in _PENDING or whole.last in DECLARES[FAMILY[language]].split()):
        return f"it ends after {whole.last}"
    return "no opening tag" if language == "php" and not whole.tag else ""


#: Lines of a file that are composed in one task before the file is.
STRIDE = 50_000
_FIELDS = ("need", "left", "state", "error", "top", "tag", "last")
_SUMMARY = "need string, `left` string, state string, error string, `top` string, tag boolean, `last` string"
_MAP = "struct<" + _SUMMARY.replace(" ", ":").replace(",:", ",") + ">"


#: Rows of ids, lines and states that a broadcast may have; more go by an ordinary join.
BROADCAST = 100_000


def _small(table: Cut) -> DataFrame:
    """The table, for a broadcast if it is small: then the texts that it is joined with stay where they are."""
    return F.broadcast(table.df) if table.rows <= BROADCAST else table.df


def settled(chunks: DataFrame, bound: int) -> DataFrame:
    """Chunks with the first line that any delivery gives, where it is `bound` or beyond and a delivery gives none; for
    others it makes no difference. Only ids and lines of such chunks are brought together."""
    far = chunks.where(F.col("start_line").isNull() | (F.col("start_line") >= bound)).groupBy("file_id", "id").agg(F.min("start_line").alias("__first"), F.count_if(F.col("start_line").isNull()).alias("__n"))
    few = cut(far.where("__n > 0 and __first is not null").drop("__n"))
    if not few.rows:
        return chunks
    return chunks.join(_small(few), ["file_id", "id"], "left").withColumn("start_line", F.coalesce("start_line", "__first")).drop("__first")


def _known(chunks: DataFrame, languages: DataFrame) -> DataFrame:
    """The chunks of files of a known language; `languages` is the fixed table (extension, language)."""
    extension = F.lower(F.regexp_extract(F.trim("path"), r"(\.[A-Za-z0-9]+)$", 1))
    names = languages.where(F.col("language").isin(list(FAMILY))).select(F.lower("extension").alias("__e"), F.col("language").alias("__language")).distinct()
    few = names.count() <= 1000  # broadcast only if it is as small as it should be
    text = F.coalesce("content", F.lit(""))
    named = settled(chunks.select("file_id", "id", "repo", "path", "start_line", "content"), STRIDE).withColumn("__e", extension).join(F.broadcast(names) if few else names, "__e")
    return named.select("file_id", "id", "repo", F.col("__language").alias("language"), F.col("start_line").alias("start"), F.trim("path").alias("path"), text.alias("content"))


def _maps(rows: list[dict]) -> list[dict[str, Summary]]:
    """The maps of chunks (or strides), each once, in line order, from rows of one entry state each."""
    by: dict[str, tuple[list, dict]] = {}
    for r in rows:
        key, found = by.setdefault(r["id"], ([r["start"]], {}))
        key.append(r["start"])
        found[r["entry"]] = Summary(*(r["x"][f] for f in _FIELDS))
    first = lambda lines: min((x for x in lines if x is not None), default=None)
    placed = [((n := first(lines)) is not None, n or 0, k, found) for k, (lines, found) in by.items()]
    return [found for *_, found in sorted(placed, key=lambda p: p[:3])]


def _read(known: DataFrame) -> DataFrame:
    """(file_id, id, repo, language, start, entry, x): each chunk's summary from the state `entry`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lex(g, t, e, p or "") for g, p, t, e in zip(*(b.column(k).to_pylist() for k in ("language", "path", "content", "entry")))]
            x = pa.StructArray.from_arrays([pa.array([getattr(y, f) for y in found], pa.bool_() if f == "tag" else pa.string()) for f in _FIELDS], list(_FIELDS))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("file_id", "id", "repo", "language", "start", "entry")), x], ["file_id", "id", "repo", "language", "start", "entry", "x"])

    return known.mapInArrow(run, f"file_id bigint, id string, repo string, language string, start int, entry string, x {_MAP}")


def _judge(parts: DataFrame) -> DataFrame:
    """(file_id, repo, language, reason, want): a verdict on each file, or the state that its chunks must be read from."""
    stride = F.coalesce((F.col("start") / STRIDE).cast("int"), F.lit(0)).alias("stride")
    grouped = parts.groupBy("file_id", stride).agg(F.max("repo").alias("repo"), F.max("language").alias("language"), F.collect_set(F.struct("start", "id", "entry", "x")).alias("rows"))
    kind = f"array<struct<start:int,id:string,entry:string,want:string,x:{_MAP}>>"
    row_type = to_arrow_type(StructType.fromDDL(f"map {kind}")["map"].dataType)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The map of each stride, over the states that its chunks have been read from."""
        for b in batches:
            out = []
            for n, rows in zip(b.column("stride").to_pylist(), b.column("rows").to_pylist()):
                maps, own = _maps(rows), []
                for e in sorted({r["entry"] for r in rows}):
                    whole, want = compose(maps, e)
                    own.append({"start": n, "id": str(n), "entry": e, "want": want, "x": {f: getattr(whole, f) for f in _FIELDS} if whole else None})
                out.append(own)
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("repo"), b.column("language"), pa.array(out, row_type)], ["file_id", "repo", "language", "map"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reasons, wants = [], []
            for language, lists in zip(b.column("language").to_pylist(), b.column("maps").to_pylist()):
                whole, want = _through([r for own in lists for r in own])
                reasons.append(verdict(language, whole) or None if whole else None)
                wants.append(want if whole is None else None)
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("repo"), b.column("language"), pa.array(reasons, pa.string()), pa.array(wants, pa.string())], ["file_id", "repo", "language", "reason", "want"])

    strides = grouped.mapInArrow(reduce, f"file_id bigint, repo string, language string, map {kind}")
    files = strides.groupBy("file_id").agg(F.max("repo").alias("repo"), F.max("language").alias("language"), F.collect_list("map").alias("maps"))
    return files.mapInArrow(judge, "file_id bigint, repo string, language string, reason string, want string")


def _through(rows: list[dict]) -> tuple[Summary | None, str]:
    """compose() over strides of which some have no summary yet from some states."""
    by: dict[int, dict[str, dict]] = {}
    for r in rows:
        by.setdefault(r["start"], {})[r["entry"]] = r
    whole = None
    for n in sorted(by):
        state = whole.state if whole else ""
        r = by[n].get(state)
        if r is None:
            return None, state
        if r["x"] is None:
            return None, r["want"]
        part = Summary(*(r["x"][f] for f in _FIELDS))
        whole = whole.then(part) if whole else part
    return whole, ""


def invalid_files(chunks: DataFrame, languages: DataFrame) -> DataFrame:
    """(file_id, repo, language, reason) for each file of a known language; reason is null for valid files."""
    known = _known(chunks, languages)
    parts = cut(_read(known.withColumn("entry", F.lit("")))).df
    judged = cut(_judge(parts)).df
    done = [judged.where("want is null")]
    # The same state is never wanted twice, and a file's chunks end in finitely many.
    while (wanted := cut(judged.where("want is not null").select("file_id", F.col("want").alias("entry")))).rows:
        more = cut(_read(known.join(_small(wanted), "file_id"))).df
        parts = cut(parts.join(wanted.df.select("file_id"), "file_id", "left_semi").unionByName(more)).df
        judged = cut(_judge(parts)).df
        done.append(judged.where("want is null"))
    return functools.reduce(DataFrame.unionByName, done).drop("want")


def rates(files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, rate) of invalid_files()."""
    return files.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count("reason").alias("n_invalid")).withColumn("rate", F.col("n_invalid") / F.col("n_files"))
