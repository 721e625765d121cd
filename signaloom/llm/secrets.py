"""Secrets in whole texts: three fixed patterns, and random strings found by a token-efficiency test.

Base kinds, leftmost and non-overlapping each: ``assign`` (a password, token or key set to a value of 6 or more
characters), ``access`` (AKIA..., 20 or more) and ``hex`` (24 or more hexadecimal digits). The method adds ``random``: a
stretch of 20 or more key characters that a byte-pair vocabulary needs a token for every 1.8 characters or fewer to write.
Words and names take far fewer tokens, so a key is found behind a path, a host or a name as well as alone, whatever
characters it is of. Base spans, digests of known lengths and UUIDs are left out first, and the stretches are looked for
in what is between them. All offsets are code points, end exclusive.

Every token is worth ``1.8 - its characters``, so a stretch is dense when its worth is 0 or more. Separators, and parts
between separators that are one token, are worth as much as a token of two characters at most: dotted numbers are not
dense. Of each run the stretch of the highest worth is taken, then those before and after it. Words at its ends that the
vocabulary writes well are no part of it, short tokens of the same part beside it are.

A null text counts as empty and has no spans. Runs of any length are judged whole; tokens are taken from windows of 4,096
characters. Rows are independent: repeated rows give the same spans.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .token_counts import rank_encoding

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # the same as all runs, with the short ones dropped
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
# End of fixed values.

KINDS = ("assign", "access", "hex", "random")
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
PART = re.compile("[A-Za-z0-9]+|[+/_.=-]+")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
DIGEST_OR_UUID = re.compile(
    "(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|([0-9a-f]{32,}|[0-9A-F]{32,}))(?![A-Za-z0-9])"
)
WINDOW = 4096
CHARACTERS_PER_TOKEN = 1.8
SHORT_TOKEN = 3

SPANS = "array<struct<kind:string,start:long,stop:long,value:string>>"
Span = tuple[str, int, int, str]


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end(), m[0]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found + [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]


def known_spans(text: str) -> list[tuple[int, int]]:
    """UUIDs, and parts that are digests of a known length."""
    found = DIGEST_OR_UUID.finditer(text)
    return [m.span() for m in found if m[1] is None or len(m[1]) in DIGEST_LENGTHS]


def _between(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a range without the ranges taken, which are in order."""
    for a, b in taken:
        if b <= start:
            continue
        if a >= end:
            break
        if a > start:
            yield start, a
        start = b
    if start < end:
        yield start, end


def _best(worth: list[float], at: list[int], i: int, j: int) -> tuple[int, int] | None:
    """The tokens from i to j of the highest worth, 0 at least, with ``LEAST`` characters or more."""
    sums = [0.0]
    for k in range(i, j):
        sums.append(sums[-1] + worth[k])
    best, found, low, k = -1e-9, None, 0, 0
    for end in range(i, j + 1):
        while k <= end - i and at[end] - at[i + k] >= LEAST:
            low = k if sums[k] < sums[low] or k == 0 else low
            k += 1
        if k and sums[end - i] - sums[low] > best:
            best, found = sums[end - i] - sums[low], (i + low, end)
    return found


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


class SecretScanner:
    def __init__(self, ranks: bytes, pattern: str, characters_per_token: float = CHARACTERS_PER_TOKEN):
        self.encoding, self.least = rank_encoding(ranks, pattern), characters_per_token
        self.length = {rank: len(token) for token, rank in self.encoding._mergeable_ranks.items()}

    def _written_well(self, piece: str, tokens: int) -> bool:
        """Whether a piece at an end of a stretch is no part of it: separators, and words."""
        return not piece.isalnum() or len(piece) > max(SHORT_TOKEN, self.least * tokens)

    def dense(self, run: str) -> Iterator[tuple[int, int]]:
        """Places of the dense stretches of a run of key characters."""
        at, worth, part = [0], [], []  # per token: place, worth, number of its part
        for number, m in enumerate(PART.finditer(run)):
            pieces = [m[0][k : k + WINDOW] for k in range(0, len(m[0]), WINDOW)]
            sizes = [self.length[t] for p in pieces for t in self.encoding.encode_ordinary(p)]
            whole = len(sizes) == 1 or not m[0].isalnum()
            worth += [self.least - (max(n, 2) if whole else n) for n in sizes]
            part += [number] * len(sizes)
            for n in sizes:
                at.append(at[-1] + n)
        todo = [(0, len(worth))]
        while todo:
            i, j = todo.pop()
            found = _best(worth, at, i, j) if at[j] - at[i] >= LEAST else None
            if not found:
                continue
            start, end = found
            while start > i and part[start - 1] == part[start] and at[start] - at[start - 1] <= SHORT_TOKEN:
                start -= 1
            while end < j and part[end] == part[end - 1] and at[end + 1] - at[end] <= SHORT_TOKEN:
                end += 1
            todo += [(i, start), (end, j)]
            while start < end and (after := bisect.bisect_right(part, part[start], start, end)) < end:
                if not self._written_well(run[at[start] : at[after]], after - start):
                    break
                start = after
            while start < end and (before := bisect.bisect_left(part, part[end - 1], start, end)) > start:
                if not self._written_well(run[at[before] : at[end]], end - before):
                    break
                end = before
            if at[end] - at[start] >= LEAST:
                yield at[start], at[end]

    def random_spans(self, text: str, taken: list[tuple[int, int]] = ()) -> list[Span]:
        """Dense stretches outside the ranges taken, of digests and of UUIDs."""
        out, barriers = [], None
        for m in CANDIDATE.finditer(text):
            if barriers is None:
                barriers, reach = [], 0
                for a, b in sorted([*taken, *known_spans(text)]):
                    if b > reach:
                        barriers.append((max(a, reach), b))
                        reach = b
            for a, b in _between(m.start(), m.end(), barriers):
                if b - a >= LEAST:
                    out += [("random", a + i, a + j, text[a + i : a + j]) for i, j in self.dense(text[a:b])]
        return _ordered(out)

    def spans(self, text: str | None) -> list[Span]:
        """Base spans and the random strings beside them, by start, then kind."""
        base = base_spans(text or "")
        return _ordered(base + self.random_spans(text or "", [(a, b) for _, a, b, _ in base]))


def secrets_of(spark: SparkSession, ranks: bytes, pattern: str, text: Column) -> Column:
    """Array of all spans of a text column; ``ranks`` is the content of a vocabulary file of fixed size."""
    shared = spark.sparkContext.broadcast((ranks, pattern))

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = SecretScanner(*shared.value)
        for texts in batches:
            yield pd.Series(
                [[{"kind": k, "start": a, "stop": b, "value": v} for k, a, b, v in own.spans(t)] for t in texts], dtype=object
            )

    return scan.asNondeterministic()(text)


def spans_of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of the spans in order, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
