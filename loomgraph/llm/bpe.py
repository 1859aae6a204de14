"""Exact byte-pair encoding of whole columns by per-prefix dynamic programming.

For every prefix of a word there is exactly one token that can end its encoding. An Aho-Corasick automaton over the
vocabulary lists, at each byte, the tokens that are suffixes of the prefix read so far; a candidate is the last token
if it fits the last token of the prefix before it, that is, if byte-pair merging would never join across their border.
Following the stored last tokens back from the end gives the ids. The work is linear in the text for any input, also
for one word of a million letters. Texts are cut into words by the tokenizer's own pattern first; words repeat, so each
worker keeps a bounded table from word to ids.

Defined results: null and empty text give an empty list; special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Words a worker remembers; beyond it the table is emptied and filled again. Results don't depend on it.
MEMO_WORDS = 400_000
#: Fixed value: the split pattern of this tokenizer family, with possessive runs and Unicode white space spelled out.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}"""


def word_splitter():
    """The function that cuts a text into words as PATTERN does.

    The standard library's engine is several times faster but knows no Unicode properties, so the classes are spelled
    out for the first 65,536 code points; texts with later ones go through the slower engine.
    """
    import re

    import regex

    first = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def members(prop: str) -> str:
        runs: list[list[int]] = []
        for c in map(ord, regex.findall(prop, first)):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)

    letter, digit, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\p{White_Space}")
    fast = re.compile(f" ?(?:[{letter}]++|[{digit}]++)|'(?:[sdmt]|ll|ve|re)| ?[^{space}{letter}{digit}]++|[{space}]+(?![^{space}])|[{space}]").findall
    slow = regex.compile(PATTERN).findall
    late = re.compile("[\U00010000-\U0010ffff]").search

    def split(text: str) -> list[str]:
        return slow(text) if not text.isascii() and late(text) else fast(text)

    return split


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable bytes stand for themselves, others follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens and the two parts each was merged from, read from a tokenizer file in JSON."""

    def __init__(self, spec: dict):
        stand_in = byte_alphabet()
        model = spec["model"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ids = {t: i for t, i in model["vocab"].items() if t not in special}
        as_bytes = lambda t: bytes(stand_in[c] for c in t)
        self.token_of = {as_bytes(t).decode("latin-1"): i for t, i in ids.items()}
        self.length = {i: len(t) for t, i in self.token_of.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.parts.setdefault(whole, (a, b))
            self.joined[a, b] = whole

    @classmethod
    def read(cls, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> Vocabulary:
        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            return cls(json.load(f))


class Encoder:
    """Encodes texts with a Vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.words = word_splitter()
        self.automaton = ahocorasick.Automaton()
        for token, i in vocabulary.token_of.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between the tokens `left` and `right`.

        Both are taken apart again in the reverse order of their merges. If at some moment the two parts that touch
        the border have a merge that would have come earlier than the one just undone, merging would have crossed it.
        """
        joined, parts = self.v.joined, self.v.parts
        before = 1 << 60  # merges of a lower id were open to the two parts now at the border
        while True:
            whole = joined.get((left, right))
            if whole is not None and whole < before:
                return False
            take_left = left > right
            if left not in parts and right not in parts:
                return True
            if (take_left and left in parts) or right not in parts:
                before, left = left, parts[left][1]
            else:
                before, right = right + 1, parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (of any length)."""
        text = word.encode("utf-8").decode("latin-1")
        whole = self.v.token_of.get(text)
        if whole is not None:
            return [whole]
        n, fits = len(text), self.fits
        last = [-1] * (n + 1)
        step = [0] * (n + 1)
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = end - size
            if before:
                previous = last[before]
                if previous < 0:
                    continue
                ok = fits.get((previous, token))
                if ok is None:
                    if len(fits) > 2_000_000:
                        fits.clear()
                    ok = fits[previous, token] = self.pair_fits(previous, token)
                if not ok:
                    continue
            last[end], step[end] = token, size
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= step[at]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for None and ''."""
        if not text:
            return []
        self.memo.trim()
        return list(chain.from_iterable(map(self.memo.__getitem__, self.words(text))))

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        self.memo.trim()
        return sum(map(len, map(self.memo.__getitem__, self.words(text))))


class _Memo(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> list[int]:
        ids = self.encoder.encode_word(word)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str = TOKENIZER_DIR, name: str = TOKENIZER, spec: str | None = None) -> Encoder:
    """This process's encoder, built once; from the tokenizer file's text `spec`, if given, else from the file."""
    if (folder, name) not in _ENCODERS:
        _ENCODERS[folder, name] = Encoder(Vocabulary(json.loads(spec)) if spec else Vocabulary.read(folder, name))
    return _ENCODERS[folder, name]


def _shipped(df: DataFrame, folder: str, name: str):
    """The tokenizer file, read by the driver and sent to each executor once; its size is the vocabulary's."""
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(key, ids array<int>) for each row of `df`, repeated rows included. One narrow stage, no shuffle."""
    kind = df.schema[key].dataType.simpleString()
    spec = _shipped(df, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name, spec.value)
        for batch in batches:
            offsets, flat = [0], []
            for t in batch.column(1).to_pylist():
                flat += e.encode(t)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_column(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens int) for each row of `df`; 0 for null and empty text."""
    kind = df.schema[key].dataType.simpleString()
    spec = _shipped(df, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name, spec.value)
        for batch in batches:
            n = pa.array([e.count(t) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], [key, "n_tokens"])

    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, n_tokens int")
