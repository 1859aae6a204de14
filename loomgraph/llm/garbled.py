"""Finding and restoring text that was decoded with the wrong character encoding.

Text in UTF-8 that was read in a single-byte encoding shows runs of non-ASCII characters that, encoded back, are valid
UTF-8 again. For each run of each document every chain of up to three such encode-decode steps is tried. A character
trigram model, smoothed by interpolation and trained on the clean records (those where no chain applies to any run),
scores the run and each candidate in its context; the likeliest candidate is accepted if it beats the run as it stands
by a margin in nats. Single-byte text read in another single-byte encoding is restored in the same way, by one exchange
of encodings and a wider margin. The margin is validated: on runs of clean records no candidate passes it, and runs garbled on
purpose do (tests). A replacement character inside or beside a word shows a loss that can't be restored; such records
are found, too, and what is lost stays as it is.

The model's counts cover all clean records, combined before the shuffle; the model that is broadcast keeps the most
frequent MODEL_SIZE trigrams, a documented bound of the classifier. Two narrow passes over the non-ASCII records.

Defined results: null, empty and pure-ASCII texts are clean; repeated rows are judged each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte encodings that UTF-8 is mistaken for.
WRONG = ("latin-1", "cp1252", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850", "cp1254", "cp866", "cp1253", "cp1257")
#: What single-byte text in the last of these was taken for.
RIGHT = "cp1252"
STEPS = 3
MARGIN = 2.0
#: Exchanging one single-byte encoding for another always gives some text, so it must be likelier by more.
SWAP_MARGIN = 3.0
MODEL_SIZE = 200_000
RUN = re.compile(r"[^\x00-\x7f]+")
LOSS = "�"


def byte_maps() -> dict[str, dict[str, int]]:
    """The byte of each character in each encoding; bytes without a character pass through as C1 controls."""
    out = {}
    for name in WRONG:
        table: dict[str, int] = {}
        for b in range(256):
            try:
                c = bytes([b]).decode(name)
            except UnicodeDecodeError:
                c = chr(b)
            table.setdefault(c, b)
        out[name] = table
    return out


def _decodes(b: int) -> bool:
    try:
        bytes([b]).decode(RIGHT)
    except UnicodeDecodeError:
        return False
    return True


class Chains:
    """Candidates for runs of non-ASCII characters, remembered by run."""

    def __init__(self) -> None:
        self.maps = byte_maps()
        self.memo: dict[str, list[tuple[str, str]]] = {}
        self.swaps = {name: {c: bytes([b]).decode(RIGHT) for c, b in table.items() if _decodes(b)} for name, table in self.maps.items() if name not in ("latin-1", RIGHT)}
        self.swap_memo: dict[str, list[tuple[str, str]]] = {}

    def exchanged(self, run: str) -> list[tuple[str, str]]:
        """(exchange, restored run) for each single-byte encoding that single-byte text may have been read in."""
        known = self.swap_memo.get(run)
        if known is None:
            found: dict[str, str] = {}
            for name, table in self.swaps.items():
                t = "".join(table.get(c, "") for c in run)
                if len(t) == len(run) and t != run:
                    found.setdefault(t, f"{RIGHT}/{name}")
            known = [(c, t) for t, c in found.items()]
            if len(self.swap_memo) > 200_000:
                self.swap_memo.clear()
            self.swap_memo[run] = known
        return known

    def step(self, run: str) -> list[tuple[str, str]]:
        """(encoding, decoded) for each encoding in which the run's bytes are valid UTF-8."""
        out = []
        for name, table in self.maps.items():
            try:
                decoded = bytes([table[c] for c in run]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if all(b[1] != decoded for b in out):
                out.append((name, decoded))
        return out

    def candidates(self, run: str) -> list[tuple[str, str]]:
        """(chain, restored run), after one to STEPS steps; one character at either end may be sound already."""
        known = self.memo.get(run)
        if known is not None:
            return known
        found: dict[str, str] = {}
        for i, j in product((0, 1), (0, 1)):
            core = run[i : len(run) - j]
            if len(core) < 2 or (found and (i or j)):
                continue
            front = [("", core)]
            for _ in range(STEPS):
                front = [(f"{chain}>{name}" if chain else name, t) for chain, text in front if len(text) > 1 for name, t in self.step(text)]
                for chain, t in front:
                    found.setdefault(run[:i] + t + run[len(run) - j :], chain)
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[run] = [(c, t) for t, c in found.items()]
        return self.memo[run]

    def clean(self, text: str) -> bool:
        """Whether nothing in the text is lost and no chain applies to any run."""
        return LOSS not in text and not any(self.candidates(r) for r in set(RUN.findall(text)))


def windows(text: str) -> Iterator[str]:
    """Each run with two characters on either side."""
    for m in RUN.finditer(text):
        yield text[max(0, m.start() - 2) : m.end() + 2]


class Model:
    """An interpolated trigram model of characters around non-ASCII runs."""

    def __init__(self, trigrams: dict[str, int]):
        self.tri = trigrams
        self.bi: Counter[str] = Counter()
        self.uni: Counter[str] = Counter()
        self.context: Counter[str] = Counter()
        for t, n in trigrams.items():
            self.context[t[:2]] += n
            self.bi[t[1:]] += n
            self.uni[t[2]] += n
        self.before: Counter[str] = Counter()
        for b, n in self.bi.items():
            self.before[b[0]] += n
        self.total = max(1, sum(self.uni.values()))
        self.memo: dict[str, float] = {}

    def score(self, s: str) -> float:
        """Log-likelihood of the characters of `s` after its first two."""
        known = self.memo.get(s)
        if known is None:
            known = 0.0
            for k in range(2, len(s)):
                t = s[k - 2 : k + 1]
                known += math.log(
                    0.6 * self.tri.get(t, 0) / (self.context[t[:2]] + 0.5) + 0.3 * self.bi[t[1:]] / (self.before[t[1]] + 0.5) + 0.09 * self.uni[t[2]] / self.total + 1e-7
                )
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[s] = known
        return known

    def knows(self, run: str) -> bool:
        """Whether each non-ASCII character of the run was seen in clean records."""
        return all(c in self.uni for c in run if c > "\x7f")


def restore(text: str, chains: Chains, model: Model, margin: float = MARGIN) -> tuple[str, list[str]]:
    """(text with its garbled runs restored, their chains)."""
    used: list[str] = []

    def fix(m: re.Match[str]) -> str:
        run = m[0]
        left, right = text[max(0, m.start() - 2) : m.start()].rjust(2), text[m.end() : m.end() + 2]
        stands = model.score(left + run + right)
        best, chain, at = run, "", stands + margin
        for c, t in chains.candidates(run):
            if model.knows(t) and (s := model.score(left + t + right)) > at:
                best, chain, at = t, c, s
        if not chain and stands < -SWAP_MARGIN:
            at = stands + max(margin, SWAP_MARGIN)
            for c, t in chains.exchanged(run):
                if model.knows(t) and (s := model.score(left + t + right)) > at:
                    best, chain, at = t, c, s
        if chain:
            used.append(chain)
        return best

    return RUN.sub(fix, text), used


_CHAINS: list[Chains] = []


def _chains() -> Chains:
    if not _CHAINS:
        _CHAINS.append(Chains())
    return _CHAINS[0]


def train(docs: DataFrame, text: str = "text", size: int = MODEL_SIZE) -> dict[str, int]:
    """Trigram counts over the windows of all clean records, the most frequent `size` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, seen = _chains(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if chains.clean(t):
                    for w in windows(t):
                        w = w.rjust(3)
                        seen.update(w[k : k + 3] for k in range(len(w) - 2))
            if len(seen) > 500_000:
                yield _counts(seen)
                seen = Counter()
        yield _counts(seen)

    rows = docs.select(F.col(text).alias("t")).where(F.regexp_like("t", F.lit(r"[^\x00-\x7f]")))
    counts = rows.mapInArrow(count, "tri string, n bigint").groupBy("tri").agg(F.sum("n").alias("n"))
    kept = counts.orderBy(F.desc("n"), "tri").limit(size).toArrow()
    return dict(zip(kept.column("tri").to_pylist(), kept.column("n").to_pylist()))


def _counts(seen: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["tri", "n"])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """(key, restored, n_restored, n_lost, chains) for each garbled record of `docs`.

    `restored` is null if nothing could be restored; n_lost counts replacement characters.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    model = spark.sparkContext.broadcast(train(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = _chains()
        m = Model(model.value)
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lost = t.count(LOSS)
                fixed, used = restore(t, chains, m, margin)
                if lost or used:
                    rows.append((k, fixed if used else None, len(used), lost, " ".join(sorted(set(used)))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string()))], [key, "restored", "n_restored", "n_lost", "chains"])

    rows = docs.select(F.col(key), F.col(text).alias("__t")).where(F.regexp_like("__t", F.lit(r"[^\x00-\x7f]")))
    return rows.mapInArrow(run, f"`{key}` {kind}, restored string, n_restored int, n_lost int, chains string")
