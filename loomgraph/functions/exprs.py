"""Scalar functions as Column expressions: everything stays in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension to language.
LANGUAGES = {".php": "php", ".go": "go", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".rs": "rust"}
#: The kinds, natures, origins and verdicts that replies may name.
EARS_KINDS = ("ubiquitous", "event", "state", "optional", "unwanted")
NATURES = ("business", "presentation", "technical")
ORIGINS = ("explicit", "implicit")
VERDICTS = ("supported", "partial", "unsupported")

CONTROL = r"[\x{01}-\x{08}\x{0e}-\x{1f}\x{7f}]"


def slugify(s: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one dash, no dash at either end."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-"), F.lit("-"))


def slug_words(s: Column, words: int = 5) -> Column:
    """The slug's first words."""
    return F.array_join(F.slice(F.split(slugify(s), "-"), 1, words), "-")


def segments(name: Column) -> Column:
    """A qualified name's segments, split at backslashes, '::' and '/', trimmed, without empty ones."""
    return F.filter(F.transform(F.split(name, r"\\+|::|/"), lambda x: F.trim(x)), lambda x: x != "")


def domain_of_namespace(namespace: Column, depth: int = 1) -> Column:
    """Domain of a namespace: the slug of its only segment, or of the `depth` segments after the first; '' for none."""
    s = segments(F.coalesce(namespace, F.lit("")))
    return F.when(F.size(s) == 0, "").when(F.size(s) == 1, slugify(F.element_at(s, 1))).otherwise(slugify(F.array_join(F.slice(s, 2, max(1, depth)), "-")))


def domain_of_path(path: Column) -> Column:
    """Domain of a path: the slug of its first folder, or 'root'."""
    p = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"^\./", ""), "^/", "")
    return F.when(F.locate("/", p) > 1, slugify(F.substring_index(p, "/", 1))).otherwise("root")


def domain(namespace: Column, path: Column, depth: int = 1, strategy: str = "namespace") -> Column:
    """The namespace's domain, or the path's if the strategy is 'directory' or the namespace gives none."""
    if strategy == "directory":
        return domain_of_path(path)
    return F.coalesce(F.nullif(domain_of_namespace(namespace, depth), F.lit("")), domain_of_path(path))


def range_start(lines: Column) -> Column:
    """A of a valid line range 'A-B' (1 <= A <= B), else null."""
    return F.when(_range_ok(lines), _range_part(lines, 1))


def range_end(lines: Column) -> Column:
    """B of a valid line range 'A-B', else null."""
    return F.when(_range_ok(lines), _range_part(lines, 2))


def _range_part(lines: Column, k: int) -> Column:
    return F.regexp_extract(lines, r"^(\d+)-(\d+)\z", k).try_cast("bigint")


def _range_ok(lines: Column) -> Column:
    return F.coalesce((_range_part(lines, 1) >= 1) & (_range_part(lines, 1) <= _range_part(lines, 2)), F.lit(False))


def text_lines(text: Column) -> Column:
    """Lines of a text; no line after a final newline; an empty text has none."""
    parts = F.split(text, "\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def line_count(text: Column) -> Column:
    return F.size(text_lines(text)).cast("bigint")


def join_lines(lines: Column, first: Column, last: Column) -> Column:
    """Lines first..last (1-based) joined."""
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def short_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return short_hash(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n"), content))


def import_target(s: Column) -> Column:
    """An import clause's target: cut at ' as ', without quotes, backticks and semicolons."""
    return F.trim(F.regexp_replace(F.substring_index(F.trim(s), " as ", 1), "[\"'`;]", ""))


def language_of(path: Column) -> Column:
    """The language of a path's extension, whatever its case; '' if unknown."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))), F.lit(""))


def looks_binary(text: Column) -> Column:
    """Text form of the binary test: a NUL, or more than 30 control characters in a hundred, of the first 8000."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 8000)
    return (F.instr(head, "\0") > 0) | (F.regexp_count(head, F.lit(CONTROL)) * 100 > F.length(head) * 30)


def word_set(text: Column, least: int = 3) -> Column:
    """Distinct lower-cased runs of letters and digits of at least `least` code points."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.length(w) >= least))


def numbered(content: Column, start: Column) -> Column:
    """Each line with its absolute number and a tab before it."""
    return F.array_join(F.transform(F.split(content, "\n"), lambda x, i: F.concat((start + i).cast("string"), F.lit("\t"), x)), "\n")


def percent(part: Column, total: Column) -> Column:
    """Truncated percentage as text; 'n/a' of nothing."""
    return F.when(total == 0, "n/a").otherwise(F.concat((F.floor(part * 100 / F.nullif(total, F.lit(0)))).cast("bigint").cast("string"), F.lit("%")))


def two_decimals(x: Column) -> Column:
    """Two decimals of the exact binary value, ties to even.

    The built-in formats round the shortest decimal form instead. Here 200 x is computed as a rounded product and its
    exact error (the factor is split in two halves, whose products are exact), so half-way cases are decided exactly.
    """
    a = F.abs(x)
    k = F.floor(a * 100).cast("double")
    middle, product = 2 * k + 1, a * 200.0
    big = a * 134217729.0
    high = big - (big - a)
    error = (high * 200.0 - product) + (a - high) * 200.0
    up = (product > middle) | ((product == middle) & ((error > 0) | ((error == 0) & (k % 2 == 1))))
    n = (k + F.when(up, 1).otherwise(0)).cast("bigint")
    sign = F.when((x < 0) & (n > 0), "-").otherwise("")
    return F.concat(sign, F.floor(n / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def mermaid_id(slug: Column) -> Column:
    return F.replace(slug, F.lit("-"), F.lit("_"))


def rule_domain(rule_id: Column) -> Column:
    """The second dot-separated segment; '' without one."""
    return F.coalesce(F.get(F.split(rule_id, r"\.", 3), F.lit(1)), F.lit(""))


def node_file(kind: Column, node_id: Column) -> Column:
    """Path of a node's file."""
    cut_prefix = lambda p: F.regexp_replace(node_id, f"^{p}\\.", "")
    return (
        F.when(kind == "domain", F.concat(F.lit("nodes/domains/"), cut_prefix("domain"), F.lit(".md")))
        .when(kind == "entity", F.concat(F.lit("nodes/entities/"), cut_prefix("entity"), F.lit(".md")))
        .when(kind == "endpoint", F.concat(F.lit("nodes/endpoints/"), cut_prefix("endpoint"), F.lit(".md")))
        .otherwise(F.concat(F.lit("nodes/rules/"), cut_prefix("rule"), F.lit(".md")))
    )


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("entity."), slugify(name))


def endpoint_id(verb: Column, path: Column) -> Column:
    return F.concat(F.lit("endpoint."), slugify(F.concat(verb, F.lit(" "), path)))


def route_verb(attrs: Column) -> Column:
    """attrs['method'], or attrs['verb'] if that is empty."""
    return F.coalesce(F.nullif(F.try_element_at(attrs, F.lit("method")), F.lit("")), F.try_element_at(attrs, F.lit("verb")), F.lit(""))


def route_handler(attrs: Column) -> Column:
    """attrs['handler'], else controller@action, else ''."""
    handler, controller, action = (F.coalesce(F.try_element_at(attrs, F.lit(k)), F.lit("")) for k in ("handler", "controller", "action"))
    return F.when(handler != "", handler).when((controller != "") & (action != ""), F.concat(controller, F.lit("@"), action)).otherwise(controller)


def columns_of(columns: Column) -> Column:
    """A comma-separated list without blanks and empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(columns, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def requirement_of(body: Column) -> Column:
    """The requirement a rule's body states, or its first line."""
    stated = F.regexp_extract(body, r"(?md)^\*\*Exigence \(EARS\)\*\* : (.*)$", 1)
    return F.when(stated != "", stated).otherwise(F.substring_index(body, "\n", 1))


def criteria_of(body: Column) -> Column:
    """The numbered criteria after their heading, with their numbers, up to the first line that isn't numbered."""
    after = F.regexp_extract(body, r"(?ms)^\*\*Critères d'acceptation\*\*[^\n]*\n(.*)\z", 1)
    block = F.regexp_extract(F.concat(after, F.lit("\n")), r"\A((?:[ \t\r]*\d[^\n]*\n)*)", 1)
    return F.transform(F.filter(F.split(block, "\n"), lambda x: x != ""), lambda x: F.trim(x))


def strip_fences(s: Column) -> Column:
    """A reply without its code fence."""
    t = F.regexp_replace(s, r"\A\s+|\s+\z", "")
    body = F.when(F.instr(t, "\n") > 0, F.regexp_replace(t, r"\A[^\n]*\n", "")).otherwise("")
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(body, r"(?s)\A(.*)```.*\z", "$1"), r"\A\s+|\s+\z", "")).otherwise(t)


def language_name(code: Column) -> Column:
    return F.when(code == "en", "English").otherwise("French")


def truncate(s: Column, n: int) -> Column:
    """At most n characters, an ellipsis where some were cut (whole characters, not bytes)."""
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("…"))).otherwise(s)


def token_display(n: Column) -> Column:
    """1.1M, 189k or 950."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def thousands(n: Column) -> Column:
    """An integer with commas."""
    return F.format_number(n, 0)


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a segment of the path is hidden or matches a name or glob pattern; a matched folder hides what is below."""
    tests = [_glob(p) for p in patterns]
    rx = "|".join(t for t in tests if t)
    hidden = lambda x: x.startswith(".") & ~x.isin(".", "..")
    return F.exists(F.split(path, "/"), lambda x: hidden(x) | (F.regexp_like(x, F.lit(f"^(?:{rx})$")) if rx else F.lit(False)))


def _glob(pattern: str) -> str | None:
    """A name pattern of *, ? and [..] as a regular expression; None for a malformed one."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.find("]", k + 2)
            if end < 0:
                return None
            inner = pattern[k + 1 : end]
            out += "[" + ("^" if inner.startswith("^") else "") + inner.lstrip("^").replace("\\", "\\\\").replace("[", "\\[") + "]"
            k = end
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out += "\\" + pattern[k] if not pattern[k].isalnum() else pattern[k]
        else:
            out += c if c.isalnum() or c == "_" else "\\" + c
        k += 1
    return out
