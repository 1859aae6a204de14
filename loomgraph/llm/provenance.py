"""Finding generated, minified, vendored source files and data blobs kept as code, by grammars.

A file becomes sequences over which grammars are inferred, in vectorised steps for a batch of files:

* its structural tokens (names, numbers and literals collapsed to one token each, comments and blanks dropped) and the
  characters of its literals, by Re-Pair: round after round the most frequent adjacent pairs become rules, until no pair
  occurs twice;
* its tokens with their names, and again with names told by where they stood last, by a grammar whose rules equal texts
  share whatever stands around them: runs become one symbol, then the pair whose hash is the least of its neighbours',
  and a rule's name is the hash of its expansion;
* the words of the comment at its head, as phrases.

Evidence:

* generated - one long rule, reused again and again, covers most of the file; or its folder or name says so;
* blob - literals make up most of the file, by tokens or by characters, and their grammar is hardly smaller than they;
* minified - many characters a line and hardly a blank;
* vendored - half of the file's rules recur in another repository, whatever its names are; or a folder of third-party code;
* notices - a phrase at the heads of files in several repositories, if a good part of the files with it are generated
  (or vendored) by the evidence above, makes the other files with it so, too. What notices say is learned from the
  corpus. A short list of usual wordings is asked as well, for corpora too small to learn from (`notices`).

A file's text is put together from its chunks by file; rules and phrases are counted by their hash and repository,
combined before the shuffle, so a rule that every file has is one counter. A file of more than SEGMENT lines is seen in
segments, so that no file is too large for a task; its sums are those of its segments.

Defined results: null content is empty; empty files are hand-written; a chunk delivered twice counts once, at the first
line that any delivery gives; null lines sort first; a null path gives no path evidence; a null repository is one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import cut
from .syntax import WORDS, settled

_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
#: A # alone in the first column is a token.
_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|(?m:^[\t-\r\x1c- ]\s*#(?![\[!])[^\n]*|^#(?![\[!])[^\n]+)")
_NAME = re.compile(r"[A-Za-z_$\u0080-￿][\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")
#: Lines of a dump whose quotes lie elsewhere; heredocs and Rust's raw strings.
_DUMP = r"\n[ \t]*(?:[A-Za-z0-9+/=]{40,}|(?:[0-9A-Fa-f]{2,16}[ ,]+){8,}[^\n]*)[\\,;\"'` \t\r]*(?=\n|\Z)"
_LONG = r"<<<[ \t]*(?P<q>[\"']?)(?P<end>\w+)(?P=q)\r?\n[\s\S]*?(?m:^)[ \t]*(?P=end)\b|\bb?r(?P<raw>#*)\"[\s\S]*?\"(?P=raw)"
#: What is a token is in the group; comments are matched without it.
_REST = rf"{_COMMENT.pattern}|(?P<token>{_NAME.pattern}|{_NUMBER.pattern}|[(){{}}\[\].,;:=<>+*&|!?-]|{_DUMP}|{_STRING.pattern}|\S)"
_TOKEN = re.compile(_REST)
_TOKEN_OR_LONG = re.compile(rf"(?P<long>{_LONG})|{_REST}")
_RAW_BEGINS = re.compile(r"r(?:(?<=\br)|(?<=\bbr))#*\"")
_WORD = re.compile(r"\b[^\W\d]{3,24}\b")
#: How notices of generation and of provenance are worded.
GENERATED_NOTICE = re.compile(r"code generated by|do not (?:edit|modify)|@generated\b|auto-?generated\b|(?:produced|generated|created) automatically|automatically (?:produced|generated|created)|(?:généré|produit|créé)e? automatiquement|ne pas (?:modifier|éditer)|automatisch (?:generiert|erzeugt|erstellt)|nicht (?:bearbeiten|ändern|editieren)|generad[oa] automáticamente|no (?:editar|modificar)|gerad[oa] automaticamente|não (?:editar|modificar|edite)|changes? (?:\w+ )*(?:will be|is|are) (?:lost|overwritten)", re.I)
VENDORED_NOTICE = re.compile(r"@license\s+\S+|released under the .{0,40}licen[cs]e|licensed under the .{0,60}licen[cs]e|\bupstream\b.{0,12}https?:|(?:bundled|local|vendored|imported) copy|imported from https?:|\(c\) \d{4} .{0,60}(?:authors|contributors)|copyright \d{4}.{0,60}(?:authors|contributors)", re.I | re.S)
#: Folders of third-party code.
VENDORED_PATH = re.compile(r"(?:^|[/\\])(?:vendor|node_modules|third[_-]?party|bower_components|godeps|jspm_packages|site-packages|externals?[/\\][\w.-]*-\d[\w.]*)[/\\]", re.I)
_HEAD = re.compile(r"\s*(?:<\?php\b)?\s*((?:(?://|#(?!\[))[^\n]*\s*|/\*[\s\S]*?\*/\s*)+)")

#: Folders and names of generated and minified files.
GENERATED_PATH = re.compile(r"(?:^|[/\\\\])(?:generated|__generated__)[/\\\\]|\.(?:gen|generated|pb|min|bundle)\.\w+\s*$", re.I)

RULE_TOKENS, RULE_USES = 6, 5
#: Shares and bounds of the evidence; see the module.
REUSE = 0.65
DATA, DATA_TOKENS = 0.75, 40
#: A blob's literals have so many characters, and less than so much of them are words; coded with their grammar they take
#: so much of what coding the characters one by one would take (at UNIFORM bits a character at least).
DATA_CHARS, WORDED, INFORMATION, UNIFORM = 200, 0.4, 0.5, 2.0
LINE, BLANKS = 150, 0.1
#: Shared rules expand to so many tokens, or to so many if names don't count.
STRETCH, RENAMED = 32, 96
#: So many repositories must share one, or so many if names don't count; and so many of a file's rules.
REPOSITORIES, REPOSITORIES_RENAMED, SHARED = 2, 3, 0.5
#: Shorter texts are alike by chance.
LEAST_TOKENS = 16
#: A notice is so many words in a row, at heads in so many repositories, of which so many files and such a share have a kind.
PHRASE, NOTICE_REPOSITORIES, NOTICE_FILES, NOTICE = 3, 3, 2, 0.3
#: Lines of a file that one task looks at together.
SEGMENT = 50_000


class _Classes(dict):
    """The structural token of a token by its first character: a name, a literal, a number or the character itself."""

    def __missing__(self, c: str) -> str:
        self[c] = got = "0" if c.isdigit() else "a" if c.isalpha() or c in "_$" or c > "\x7f" else '"' if c in "\"'`\n" else c
        return got


_CLASSES = _Classes()
_LITERAL_BEGINS = frozenset("\"'`\n0123456789")


def tokens_of(text: str) -> list[str]:
    """The tokens of a source text, comments and blanks left out. A dump's line begins with its newline."""
    if "<<<" in text or ('r"' in text or "r#" in text) and _RAW_BEGINS.search(text):
        found = [m["token"] or (t := m["long"]) and ('"' + t + '"' if len(t) > 4 else t) for m in _TOKEN_OR_LONG.finditer("\n" + text)]
    else:
        found = _TOKEN.findall("\n" + text)
    return list(filter(None, found))


class _Codes(dict):
    """A number for each token, remembered: a hash (names have the bit NAMED), above it the structural token, then LITERAL."""

    def __missing__(self, token: str) -> int:
        code = zlib.crc32(token.encode("utf-8", "replace"))
        if _NAME.match(token) and token not in _KEYWORDS:
            code |= NAMED
        code |= ord(_CLASSES[token[0]]) << CODE_BITS
        if token[0] in _LITERAL_BEGINS:
            code |= LITERAL
        if len(self) > 500_000:
            self.clear()
        self[token] = code
        return code


_CODES = _Codes()
_KEYWORDS = frozenset(w for words in WORDS.values() for w in words.split())
NAMED, CODE_BITS, LITERAL = 1 << 33, 34, 1 << 42


def coded(tokens: list[str]) -> np.ndarray:
    """The numbers of tokens."""
    return np.fromiter(map(_CODES.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def structure(codes: np.ndarray) -> bytes:
    """The structural tokens, a byte each."""
    return (codes >> CODE_BITS).astype(np.uint8).tobytes()


def _pairs_taken(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the pairs that begin at `at` are replaced: no two overlap, the better goes first, runs from the left."""
    here, left, right = rank[at], np.where(at > 0, rank[at - 1], -1), rank[at + 1]
    run = here == left
    start = np.maximum.accumulate(np.where(~run, np.arange(len(at)), -1))
    odd = (np.arange(len(at)) - start) % 2 == 1
    begins = at[start]
    beaten = np.where(begins > 0, rank[begins - 1], -1) > here  # the pair before its run is better
    take = (here >= right) & ~odd & ((here > left) | run & ~beaten)
    chosen = np.flatnonzero(take)
    clash = np.zeros(len(chosen), dtype=bool)
    clash[1:] = at[chosen[1:]] == at[chosen[:-1]] + 1
    take[chosen[clash]] = False
    return take


def _pairs_counted(at: np.ndarray, symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs that begin at `at`, symbols under `size`, those that occur twice: (where they begin, pair by pair, the
    first of each pair among these, how often each occurs). Pairs are in order, and so is where each begins."""
    name, place = size.bit_length(), len(symbols).bit_length()
    if 2 * name + place <= 63:  # pair and place in one number sort several times faster than places by pair
        both = ((symbols[at] << name | symbols[at + 1]) << place) | at
        both.sort()
        key, at = both >> place, both & ((1 << place) - 1)
    else:
        key = symbols[at] * np.int64(size) + symbols[at + 1]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
    again = np.zeros(len(key) + 1, dtype=bool)
    again[1:-1] = key[1:] == key[:-1]
    twice = again[1:] | again[:-1]
    first = np.flatnonzero(~again[:-1][twice])
    at = at[twice]
    return at, first, np.diff(first, append=len(at))


def re_pair(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence: (bits of its grammar, largest share that one long rule's uses cover).

    A round replaces, in every sequence, its most frequent pair and all pairs at least half as frequent that don't
    overlap a more frequent one; it ends for a sequence when no pair occurs twice. The bits are those of the last
    sequence's symbols by their entropy and two bytes for each rule. Rules count from RULE_TOKENS tokens and RULE_USES uses on.
    """
    k = len(sequences)
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)
    share = np.zeros(k)
    owner = np.repeat(np.arange(k), sizes)
    # each sequence has symbols of its own, numbered by byte, then by rule
    symbols = owner * 256 + np.frombuffer(b"".join(sequences), dtype=np.uint8)
    present = np.bincount(symbols, minlength=1) > 0
    symbols = (np.cumsum(present) - 1)[symbols]
    whose = [np.flatnonzero(present) >> 8]
    next_symbol = terminals = len(whose[0]) if len(symbols) else 0
    spans = np.ones(len(symbols), dtype=np.int64)
    # A pair is live while it occurs twice. One that doesn't never will again, whatever its sides become, and a symbol
    # between two such is final; it is set aside.
    live = np.zeros(len(symbols), dtype=bool)
    live[:-1] = owner[1:] == owner[:-1]
    final = []
    while True:
        at, first, count = _pairs_counted(np.flatnonzero(live), symbols, next_symbol)
        pair = np.repeat(np.arange(len(count)), count)
        of = owner[at[first]]
        most = np.zeros(k, dtype=np.int64)
        np.maximum.at(most, of, count)
        worth = np.where(count * 2 >= most[of], count * (len(count) + 1) + np.arange(len(count)), -1)
        rank = np.full(len(symbols) + 1, -1, dtype=np.int64)
        rank[at] = worth[pair]
        g = np.flatnonzero(rank >= 0)
        g = g[_pairs_taken(rank, g)] if len(g) else g
        back_g = rank[g] % (len(count) + 1)
        times = np.bincount(back_g, minlength=len(count))
        saves = times[back_g] >= 2  # a pair of which overlaps left one use saves nothing
        g, back_g = g[saves], back_g[saves]
        if not len(g):
            break
        used = times >= 2
        whose.append(of[used])
        width, uses = spans[g] + spans[g + 1], times[back_g]
        long = (width >= RULE_TOKENS) & (uses >= RULE_USES)
        np.maximum.at(share, owner[g][long], (uses * width / sizes[owner[g]])[long])
        symbols[g] = next_symbol + (np.cumsum(used) - 1)[back_g]
        spans[g] = width
        next_symbol += len(whose[-1])
        going = np.zeros(k, dtype=bool)
        going[owner[g]] = True
        live[:] = False
        live[at] = True
        live[g] = live[g + 1]
        keep = live.copy()
        keep[1:] |= live[:-1]
        keep &= going[owner]
        gone = ~keep
        gone[g + 1] = keep[g + 1] = False
        final.append(symbols[gone])
        keep = np.flatnonzero(keep)
        symbols, owner, spans, live = symbols[keep], owner[keep], spans[keep], live[keep]
    times = np.bincount(np.concatenate([*final, symbols]), minlength=next_symbol)
    name, of = np.flatnonzero(times), np.concatenate(whose)
    rules = np.bincount(of[terminals:], minlength=k)
    times, of = times[name], of[name]
    rest = np.bincount(of, times, minlength=k)
    return np.bincount(of, times * np.log2(rest[of] / times), minlength=k) + 16.0 * rules, share


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LEFT, _RUN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def common_rules(codes: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash of the expansion) of the rules of at least `least` symbols, or of an owner's whole sequence.

    A step makes each run of one symbol a symbol, then each pair whose hash is less than those of the pairs beside it.
    What is made depends on the symbols around alone, so equal stretches of two sequences get equal rules but for their
    ends. A symbol that expands to `least` symbols takes part no more.
    """
    symbols, spans = _mixed(codes.astype(np.uint64)), np.ones(len(codes), dtype=np.int64)
    owner = owner.copy()
    with np.errstate(over="ignore"):
        while True:
            free = spans < least
            joins = (owner[1:] == owner[:-1]) & free[1:] & free[:-1]
            if not joins.any():
                break
            new = np.ones(len(symbols), dtype=bool)
            new[1:] = ~(joins & (symbols[1:] == symbols[:-1]))
            if not new.all():
                first = np.flatnonzero(new)
                length = np.diff(first, append=len(symbols))
                spans = np.add.reduceat(spans, first)
                symbols, owner = symbols[first], owner[first]
                symbols = np.where(length > 1, _mixed(symbols + _RUN * length.astype(np.uint64)), symbols)
                free = spans < least
                joins = (owner[1:] == owner[:-1]) & free[1:] & free[:-1]
            made = np.where(joins, _mixed(symbols[:-1] * _LEFT + symbols[1:]) >> np.uint64(1), _NONE)
            beside = np.concatenate(([_NONE], made, [_NONE]))
            take = np.flatnonzero((made < beside[:-2]) & (made <= beside[2:]) & joins)
            symbols[take] = made[take]
            spans[take] += spans[take + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[take + 1] = False
            symbols, owner, spans = symbols[keep], owner[keep], spans[keep]
    alone = np.bincount(owner, minlength=1)[owner] == 1
    kept = (spans >= least) | alone
    return owner[kept], symbols[kept]


def stretches(texts: list[np.ndarray]) -> list[list[int]]:
    """For each text's numbers of tokens the hashes of its shared rules; see common_rules().

    Even hashes are of tokens with their names. Odd ones tell a name by how far back it stood last, so a copy with other
    names has them too; they are longer. A text under LEAST_TOKENS tokens has none.
    """
    lists = [c if len(c) >= LEAST_TOKENS else c[:0] for c in texts]
    codes = np.concatenate(lists) & ((1 << CODE_BITS) - 1) if lists else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
    if not len(codes):
        return [[] for _ in texts]
    whose, found = common_rules(codes, owner, STRETCH)
    found &= ~np.uint64(1)
    many = np.bincount(owner, minlength=len(lists))[owner] >= RENAMED
    codes, owner = codes[many], owner[many]
    if len(codes):
        named = np.flatnonzero(codes & NAMED)
        key = owner[named] * np.int64(1 << 34) + codes[named]
        order = np.argsort(key, kind="stable")
        by, key = named[order], key[order]
        back = np.zeros(len(by), dtype=np.int64)
        back[1:] = np.where(key[1:] == key[:-1], np.diff(by), 0)
        codes[by] = NAMED + np.where(back <= STRETCH, back, 0)
        w, f = common_rules(codes, owner, RENAMED)
        whose, found = np.concatenate([whose, w]), np.concatenate([found, f | np.uint64(1)])
    out: list[list[int]] = [[] for _ in texts]
    for k, h in zip(whose.tolist(), found.view(np.int64).tolist()):
        out[k].append(h)
    return [list(dict.fromkeys(x)) for x in out]


def head(text: str) -> str:
    """The comment at the head of a text."""
    m = _HEAD.match(text)
    return m[1] if m else ""


_PROSE = re.compile(r"[^\W\d_]+|\d+")


def phrases(comment: str) -> list[int]:
    """Hashes of the distinct phrases of PHRASE words of a comment; all numbers are one word, and alone no phrase."""
    words = ["0" if w[0].isdigit() else w.lower() for w in _PROSE.findall(comment)]
    found = {" ".join(words[k : k + PHRASE]) for k in range(len(words) - PHRASE + 1)} - {" ".join("0" * PHRASE)}
    return sorted(int.from_bytes(hashlib.blake2b(p.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for p in found)


def literals(tokens: list[str], codes: np.ndarray) -> tuple[bytes, float, int]:
    """Of all literals, blanks dropped: (their bytes, bits by entropy of characters, characters in words)."""
    found = "\n".join(compress(tokens, (codes & LITERAL).tolist()))
    raw = "".join(found.split()).encode("utf-8", "replace")
    if not raw:
        return b"", 0.0, 0
    n = np.bincount(np.frombuffer(raw, dtype=np.uint8))
    n = n[n > 0]
    return raw, max(UNIFORM, float(-(n / len(raw) * np.log2(n / len(raw))).sum())) * len(raw), sum(map(len, _WORD.findall(found)))


def evidence(texts: list[str], notices: bool = True) -> dict[str, list]:
    """What each text (a file or a segment of one) shows, as sums that add up over segments."""
    codes, held = [], []
    for t in texts:  # the tokens of one text at a time, so that they lie in the same memory
        found = tokens_of(t)
        codes.append(coded(found))
        held.append(literals(found, codes[-1]))
    tokens = [structure(c) for c in codes]
    bits, share = re_pair(tokens + [raw for raw, _, _ in held])
    heads = [head(t) for t in texts]
    return {
        "chars": [len(t) for t in texts],
        "lines": [t.count("\n") + 1 for t in texts],
        "blanks": [sum(map(t.count, " \t\n\r")) for t in texts],
        "tokens": [len(s) for s in tokens],
        "data": [sum(map(s.count, (b"0", b'"', b",", b"-"))) for s in tokens],
        "reused": [float(x) * len(s) for x, s in zip(share, tokens)],
        "literal": [len(raw) for raw, _, _ in held],
        "packed": [float(x) for x in bits[len(texts) :]],
        "entropy": [x for _, x, _ in held],
        "words": [x for _, _, x in held],
        "generated": [notices and bool(GENERATED_NOTICE.search(h)) for h in heads],
        "vendored": [notices and bool(VENDORED_NOTICE.search(h)) for h in heads],
        "phrases": [phrases(h) for h in heads],
        "stretches": stretches(codes),
    }


_SUMS = ("chars", "lines", "blanks", "tokens", "data", "reused", "literal", "packed", "entropy", "words")
_TYPES = {"reused": "double", "packed": "double", "entropy": "double", "generated": "boolean", "vendored": "boolean", "phrases": "array<bigint>", "stretches": "array<bigint>"}
_ARROW = {"double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64()}
_COLUMNS = (*_SUMS, "generated", "vendored", "phrases", "stretches")


def _parts(chunks: DataFrame) -> DataFrame:
    """(file_id, segment, repo, path, parts) of the distinct chunks; texts are shuffled once."""
    kept = settled(chunks.select("file_id", "id", "repo", "path", "start_line", "content"), SEGMENT)
    placed = kept.select("file_id", "id", "repo", F.trim("path").alias("path"), F.col("start_line").alias("start"), F.coalesce("content", F.lit("")).alias("content"))
    placed = placed.withColumn("segment", F.coalesce((F.col("start") / SEGMENT).cast("int"), F.lit(0))).repartition("file_id", "segment")
    once = placed.groupBy("file_id", "segment", "id").agg(F.min("start").alias("start"), F.max("repo").alias("repo"), F.max("path").alias("path"), F.min("content").alias("content"))
    return once.groupBy("file_id", "segment").agg(F.max("repo").alias("repo"), F.max("path").alias("path"), F.array_sort(F.collect_list(F.struct(F.coalesce("start", F.lit(-1)).alias("start"), "id", "content"))).alias("parts"))


def _notices(heads: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, told_generated, told_vendored): files with a phrase that much of a kind's files share; see the module."""
    said = heads.select("file_id", "repo", F.explode("phrases").alias("p"))
    marked = said.join(files.select("file_id", "is_generated", "is_vendored"), "file_id")
    by_repo = marked.groupBy("p", "repo").agg(F.count("*").alias("n"), F.count_if("is_generated").alias("g"), F.count_if("is_vendored").alias("v"))
    known = by_repo.groupBy("p").agg(F.count("*").alias("repos"), F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("v").alias("v"))
    much = lambda c: (F.col(c) >= NOTICE_FILES) & (F.col(c) >= NOTICE * F.col("n"))
    told = known.where(F.col("repos") >= NOTICE_REPOSITORIES).select("p", (much("g") & (F.col("g") >= F.col("v"))).alias("g"), (much("v") & (F.col("v") > F.col("g"))).alias("v")).where("g or v")
    return said.join(told, "p").groupBy("file_id").agg(F.bool_or("g").alias("told_generated"), F.bool_or("v").alias("told_vendored"))


def kinds(chunks: DataFrame, notices: bool = True, folders: bool = True) -> DataFrame:
    """(file_id, kind) of files that aren't hand-written: generated, blob, minified or vendored; the first that holds.

    Without `notices` the list of usual wordings isn't asked, without `folders` no path is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 400):
                part = b.slice(lo, 400)
                seen = evidence(["\n".join(p["content"] for p in ps) for ps in part.column(4).to_pylist()], notices)
                columns = [pa.array(seen[c], _ARROW[_TYPES.get(c, "bigint")]) for c in _COLUMNS]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), *columns], ["file_id", "segment", "repo", "path", *_COLUMNS])

    schema = "file_id bigint, segment int, repo string, path string, " + ", ".join(f"`{c}` {_TYPES.get(c, 'bigint')}" for c in _COLUMNS)
    seen = cut(_parts(chunks).select("file_id", "segment", "repo", "path", "parts").mapInArrow(run, schema))
    odd = F.col("h").bitwiseAND(1) == 1
    pieces = seen.df.select("file_id", "repo", F.explode("stretches").alias("h"))
    common = pieces.select("h", "repo").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(odd, REPOSITORIES_RENAMED).otherwise(REPOSITORIES)).select("h")
    shared = pieces.join(common, "h").groupBy("file_id").agg(F.count_if(~odd).alias("shared"), F.count_if(odd).alias("shared_renamed"))
    files = seen.df.groupBy("file_id").agg(*(F.sum(c).alias(c) for c in _SUMS), F.sum(F.size("stretches")).alias("n_stretches"), F.sum(F.size(F.filter("stretches", lambda h: h.bitwiseAND(1) == 1))).alias("n_renamed"), F.max("path").alias("path"), F.min_by(F.struct("generated", "vendored"), "segment").alias("head"))
    path = F.coalesce("path", F.lit(""))
    matches = lambda rx: F.regexp_like(path, F.lit("(?i)" + rx.pattern)) if folders else F.lit(False)
    told_by_rules = F.coalesce((F.col("shared") >= SHARED * (F.col("n_stretches") - F.col("n_renamed"))) | (F.col("n_renamed") > 0) & (F.col("shared_renamed") >= SHARED * F.col("n_renamed")), F.lit(False))
    reused = (F.col("reused") >= REUSE * F.col("tokens")) & (F.col("tokens") >= DATA_TOKENS)
    mostly = (F.col("data") >= DATA * F.col("tokens")) & (F.col("tokens") >= DATA_TOKENS) | (F.col("literal") >= DATA * (F.col("chars") - F.col("blanks"))) & (F.col("words") < WORDED * F.col("literal"))
    judged = files.join(shared, "file_id", "left").select(
        "file_id",
        (mostly & (F.col("literal") >= DATA_CHARS) & (F.col("packed") >= INFORMATION * F.col("entropy"))).alias("is_blob"),
        ((F.col("chars") >= LINE * F.col("lines")) & (F.col("blanks") < BLANKS * F.col("chars")) & (F.col("chars") >= 2 * LINE)).alias("is_minified"),
        (matches(VENDORED_PATH) | told_by_rules & ~reused).alias("is_vendored"),
        (matches(GENERATED_PATH) | reused).alias("is_generated"),
        "head",
    )
    held = cut(judged)
    told = _notices(seen.df.where("size(phrases) > 0"), held.df)
    f = held.df.join(told, "file_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.when(F.col("is_blob"), "blob").when(F.col("is_minified"), "minified").when(F.col("head.vendored") | flag("told_vendored") | F.col("is_vendored"), "vendored").when(F.col("head.generated") | flag("told_generated") | F.col("is_generated"), "generated")
    return f.select("file_id", kind.alias("kind")).where("kind is not null")
