"""Secret scans: patterns, and a guess-cost estimate for values that stand in a credential context.

Method: values that follow a credential word (``pwd:``, ``client_secret =``, ``Bearer``, ``user:pass@``) are
segmented at minimum cost into dictionary words, dates, repeats, keyboard walks and brute-force spans by
dynamic programming; the sum of the segments' log10 guesses is the guess cost, and a value at or above
``min_guesses`` is a secret. Plain patterns (assignments, access keys, long hex runs) are found everywhere.

The segmentation is the true minimum over all segments from any start to any end. A repeat or walk costs the
log of its length, so the best start of one that ends at a place can change as it grows; of two starts the
earlier one gains on the later one for ever, so a stack of starts with the lengths at which each overtakes the
next gives every minimum in constant time on average. The programme is linear in the value.

The word ranks are an argument without a default: ``RANK``, the words of ``COMMON`` alone, or ``COMMON`` and the whole
words of a public vocabulary in order of rank (``vocabulary_ranks``), which the driver reads and broadcasts (at most
``MAX_WORDS``). A vocabulary file that is missing is an error, so that no machine judges by another dictionary.

A value follows a mark (``pwd: x``, ``secret_key=x``), or a space alone (``bearer x``). After a space, a value of letters
alone is taken as prose ("auth certificates") and never judged; after a mark it is.

Defined results: null text is empty and has no spans; whole texts are scanned, however long; rows are
independent, so ties, repeated rows, null ids and empty tables need no care; extra columns stay, but those
with the names of results are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_fields

#: Kinds in the order that breaks ties between spans of the same start.
KINDS = ("assign", "access", "hex", "guess")
MIN_GUESSES = 10.0

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Values after a mark, after a space alone, and in a URL.
CONTEXT = re.compile(
    r"""(?i:pwd|passphrase|credentials?|private_?key|access_?key|secret_?key|auth|authorization|bearer|passw(?:or)?d\x20is|client_?id|password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9!@#$%^&*+/_.=-]{8,})"""
    r"""|(?i:pwd|passphrase|credentials?|private_?key|access_?key|secret_?key|auth|authorization|bearer|passw(?:or)?d\x20is|client_?id)["']?\x20+["']?([A-Za-z0-9!@#$%^&*+/_.=-]{8,})"""
    r"""|://[A-Za-z0-9._-]+:([^\s:/@"'<>]{6,})@""",
    re.A,
)
SPACED = 2
#: A text without any of these (in lower case) has no credential context.
HINTS_ASSIGN = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HINTS_CONTEXT = (b"pwd", b"passphrase", b"credential", b"key", b"auth", b"bearer", b"passw", b"client", b"secret", b"token", b"://")

# Common password words by rank (public lists of the most used passwords and English words).
COMMON = (
    "password 123456 12345678 qwerty abc123 letmein monkey dragon master admin welcome login princess sunshine shadow "
    "football baseball superman batman trustno1 hello secret token changeme default example test testing user guest root "
    "summer winter spring autumn love money house school family friend happy orange banana apple computer internet server "
    "database account private public access key pass word the and you that this with have from they will your what about "
    "which when make like time just know take people into year good some could them see other than then now look only come "
    "over think also back after use two how our work first well way even new want because any these give day most"
).split()
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.](?:0[1-9]|1[0-2])[-/.](?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
JOIN = math.log10(2)
MAX_WORDS = 100_000


class Ranks(dict):
    """Word to rank; knows the length of its longest word."""

    @cached_property
    def longest(self) -> int:
        return max(map(len, self), default=0)


def _ranks(words: list[str]) -> Ranks:
    return Ranks((w, i + 1) for i, w in enumerate(dict.fromkeys(words)))


RANK = _ranks(COMMON)


#: The vocabulary of the registered query and of the pipeline.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def vocabulary_ranks(path: str = VOCABULARY, limit: int = MAX_WORDS) -> Ranks:
    """``COMMON``, then the whole words of three and more letters of a byte-level BPE vocabulary (lines of a token in
    base64 and its rank), in order of rank, in lower case."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    words = [t[1:].decode("ascii").lower() for t in tokens if len(t) > 3 and t[:1] == b" " and t[1:].isalpha() and t.isascii()]
    return Ranks(itertools.islice(_ranks([*COMMON, *words]).items(), limit))


def _steps() -> list[dict[str, str]]:
    """For each kind of run, which character follows which: the same one, the next and the one before by code, and the
    neighbour on the keyboard along a row and down both diagonals of keys, each way."""
    keys = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
    at = {v: k for k, v in keys.items()}
    ways = [(0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1)]
    return [{c: at[r + a, i + b] for c, (r, i) in keys.items() if (r + a, i + b) in at} for a, b in ways]


_KEYS = _steps()


def follows(a: str, b: str) -> list[bool]:
    """For each kind of run, whether ``b`` continues it after ``a``."""
    return [a == b, ord(b) - ord(a) == 1, ord(a) - ord(b) == 1, *(k.get(a) == b for k in _KEYS)]


def segment_cost(value: str, low: str, i: int, j: int, rank: Ranks) -> float:
    """The cheapest single segment that covers ``value[i:j]``: a word costs its rank (doubled if not in lower case), a
    date 365 * 119, a year 119, a repeat or a walk of three and more its 95 starts times its length, a brute-force
    character 10."""
    cost = float(j - i)
    if (r := rank.get(low[i:j])) is not None:
        cost = min(cost, math.log10(r * (1 if value[i:j] == low[i:j] else 2)))
    if DATE.fullmatch(value, i, j):
        cost = min(cost, math.log10(119 * 365))
    if YEAR.fullmatch(value, i, j):
        cost = min(cost, math.log10(119))
    if j - i >= 3 and any(map(all, zip(*(follows(low[k - 1], low[k]) for k in range(i + 1, j)), strict=True))):
        cost = min(cost, math.log10(95 * (j - i)))
    return cost


class _Run:
    """Starts of runs of one kind that may still be the best, the best one last."""

    __slots__ = ("first", "starts")

    def __init__(self) -> None:
        self.first, self.starts = 0, []

    @staticmethod
    def _overtakes(i: int, f: float, k: int, g: float) -> float:
        """The end from which start ``i`` (at cost ``f``) is no dearer than the later start ``k`` (at ``g``)."""
        if g <= f:
            return math.inf
        if g - f > 300:
            return 0.0
        r = 10.0 ** (g - f)
        return (r * k - i) / (r - 1)

    def add(self, i: int, f: float) -> None:
        s = self.starts
        if s:
            self.best(i + 3)
        if s and f + math.log10(3) >= s[-1][1] + math.log10(i + 3 - s[-1][0]):
            return
        while len(s) > 1 and self._overtakes(*s[-2], *s[-1]) <= self._overtakes(*s[-1], i, f):
            s.pop()
        s.append((i, f))

    def best(self, j: int) -> float:
        s = self.starts
        while len(s) > 1 and s[-2][1] + math.log10(j - s[-2][0]) <= s[-1][1] + math.log10(j - s[-1][0]):
            s.pop()
        return s[-1][1] + math.log10(95 * (j - s[-1][0]))


def guess_cost(value: str, rank: Ranks = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` into segments of ``segment_cost`` needs; each
    further segment costs a factor of 2."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
    here, brute = [0.0] * (n + 1), 0.0  # cost of a prefix with the price of going on; cost if its end is brute force
    runs = [_Run() for _ in range(len(_KEYS) + 3)]
    best = 0.0
    for j in range(1, n + 1):
        brute = (min(brute, here[j - 1]) if j > 1 else 0.0) + 1.0
        best = brute
        for i in range(max(0, j - rank.longest), j):
            if (r := rank.get(low[i:j])) is not None:
                best = min(best, here[i] + math.log10(r * (1 if value[i:j] == low[i:j] else 2)))
        if value[j - 1] in "0123456789":
            if j >= 4 and YEAR.fullmatch(value, j - 4, j):
                best = min(best, here[j - 4] + math.log10(119))
            for i in range(max(0, j - 10), j - 7):
                if DATE.fullmatch(value, i, j):
                    best = min(best, here[i] + math.log10(119 * 365))
        if j > 1:
            for run, go in zip(runs, follows(low[j - 2], low[j - 1]), strict=True):
                if not go:
                    run.first = j - 1
                    run.starts.clear()
                elif j - 3 >= run.first:
                    run.add(j - 3, here[j - 3])
                    best = min(best, run.best(j))
        here[j] = best + JOIN
    return best


def find_spans(text: str | None, min_guesses: float = MIN_GUESSES, rank: Ranks = RANK) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all secrets in code points, by start and then kind."""
    if not text:
        return []
    low = text.encode("utf-8", "surrogatepass").lower()
    out = []
    if any(h in low for h in HINTS_ASSIGN):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    if any(h in low for h in HINTS_CONTEXT):
        at = 0
        while m := CONTEXT.search(text, at):
            g = m.lastindex
            value, at = m[g].rstrip(".,"), m.end()
            # A plain word after a space is prose ("bearer certificates").
            if not (g == SPACED and value.isalpha()) and guess_cost(value, rank) >= min_guesses:
                out.append((m.start(g), "guess", m.start(g) + len(value)))
            else:  # the value may be a credential word itself
                at = m.start(g)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def digest(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str | None:
    """``text`` with every span replaced; spans that touch or overlap become one mark."""
    if not spans:
        return text
    out, at, last = [], 0, -1
    for a, _, b in spans:
        if a > last:
            out += [text[at:a], mark]
        at = last = max(last, b)
    return "".join([*out, text[at:]])


def _sent(docs: DataFrame, rank: Ranks):
    """The word ranks as a broadcast: at most ``MAX_WORDS`` words."""
    if len(rank) > MAX_WORDS:
        raise ValueError(f"{len(rank)} words are more than are broadcast ({MAX_WORDS})")
    return docs.sparkSession.sparkContext.broadcast(rank)


def scan_secrets(docs: DataFrame, rank: Ranks, *, text_col: str = "text", min_guesses: float = MIN_GUESSES, prefix: str = "secret_") -> DataFrame:
    """``docs`` with ``<prefix>spans`` array<struct<start, kind, end>> and ``<prefix>redacted`` text, which replace
    columns of these names. ``rank`` gives the ranks of words."""
    kind = "struct<spans: array<struct<start: bigint, kind: string, end: bigint>>, redacted: string>"
    sent = _sent(docs, rank)

    @F.pandas_udf(kind)
    def scan(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in column:
            rows = []
            for t in texts:
                spans = find_spans(t, min_guesses, sent.value)
                rows.append(([{"start": a, "kind": k, "end": b} for a, k, b in spans], redact(t, spans)))
            yield pd.DataFrame(rows, columns=["spans", "redacted"])

    return with_fields(small_batches(docs), scan(F.col(text_col)), {f"{prefix}spans": "spans", f"{prefix}redacted": "redacted"})


def secret_report(docs: DataFrame, rank: Ranks, *, id_col: str = "doc_id", text_col: str = "text", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, ``base_sha256`` of the pattern spans and all ``spans``."""
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    sent = _sent(docs, rank)

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ': ') for x in schema.split(', '))}>")
    def report(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in column:
            rows = []
            for t in texts:
                spans = find_spans(t, min_guesses, sent.value)
                base = [s for s in spans if s[1] != "guess"]
                n = [sum(s[1] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return small_batches(docs).select(F.col(id_col).alias("doc_id"), report(F.col(text_col)).alias("r")).select("doc_id", "r.*")
