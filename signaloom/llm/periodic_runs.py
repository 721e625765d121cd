"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no neighbouring word extends,
here of at least ``max(24, 3 q)`` words. Each text is taken on its own, in these steps:

1. A run has 16 words in a row that come again q words later, and such pairs of passages cover it. Stretches that passages of 16 words
   occurring twice do not cover hold no run and are left out; what is left is looked at again by itself until nothing changes.
2. Re-Pair turns the word ids of a stretch into a grammar: the pair of neighbours that occurs most often becomes a new
   symbol, until no pair occurs twice. The remaining sequence is joined pairwise to one balanced tree.
3. A run crosses the boundary of the smallest nonterminal that holds it. Per nonterminal, once: wherever the five words around its
   boundary occur again within it, q words off, equal words are counted to both sides, up to its ends.
4. What was found in a nonterminal is moved to all its places in the text; stretches of the same period that overlap by a
   period are merged, and those whose period is a multiple of a smaller one go.

Work grows with the length of the text (times its logarithm at most). Texts without repeated passages cost little more than their words.
Null and empty texts have no words and no runs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import mix, utf8

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words of a passage that every run repeats, and of the passage around a boundary; both follow from the two numbers above.
PASSAGE, AROUND = 16, 5
RESULT = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>"
)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _passages(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each passage of ``size`` words; equal passages have equal numbers (and rarely others have too)."""
    out, width = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    have = out
    power = np.uint64(0x9E3779B97F4A7C15)
    while width < size:
        step = min(width, size - width)
        out = mix(have[: len(have) - step] * power + have[step:]) if step == width else mix(
            have[: len(have) - step] * power + have[step:] + np.uint64(step)
        )
        have, width = out, width + step
    return out


def _repeated(ids: np.ndarray) -> list[tuple[int, int]]:
    """The stretches that passages occurring twice cover, each (start, end)."""
    if len(ids) < LEAST_WORDS:
        return []
    numbers = _passages(ids, PASSAGE)
    order = np.argsort(numbers, kind="stable")
    same = numbers[order[1:]] == numbers[order[:-1]]
    twice = np.zeros(len(numbers), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return []
    starts = np.flatnonzero(twice)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + PASSAGE, -1)
    covered = np.concatenate(([0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]))
    steps = np.diff(covered)
    ends = zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True)
    return [(s, e) for s, e in ends if e - s >= LEAST_WORDS]


def candidate_stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches outside of which no run has a word."""
    open_, done = [(0, len(ids))], []
    while open_:
        lo, hi = open_.pop()
        parts = _repeated(ids[lo:hi])
        if parts == [(0, hi - lo)]:
            done.append((lo, hi))
        else:
            open_ += [(lo + s, lo + e) for s, e in parts]
    return sorted(done)


class Grammar(NamedTuple):
    """Rules (left, right) of the symbols from ``first`` on, where each first occurs, and the rest (symbol, place)."""

    first: int
    rules: list[tuple[int, int]]
    places: list[int]
    sequence: list[int]
    starts: list[int]


def re_pair(ids: list[int]) -> Grammar:
    """Replace the most frequent pair of neighbours by a new symbol until none occurs twice; ties: the smaller pair."""
    n = len(ids)
    symbol = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    first = top = max(ids, default=-1) + 1
    rules: list[tuple[int, int]] = []
    places: list[int] = []
    where: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        where.setdefault((ids[i], ids[i + 1]), []).append(i)
    # counts are upper bounds and are made true when a pair comes up
    heap = [(-len(at), pair) for pair, at in where.items() if len(at) > 1]
    heapq.heapify(heap)
    while heap:
        claimed, pair = heapq.heappop(heap)
        left, right = pair
        valid, still, free = [], [], -1
        for i in where.get(pair, ()):
            if symbol[i] == left:
                j = after[i]
                if j < n and symbol[j] == right:
                    still.append(i)
                    if i >= free:
                        valid.append(i)
                        free = after[j]
        if len(valid) < -claimed:
            where[pair] = still
            if len(valid) > 1:
                heapq.heappush(heap, (-len(valid), pair))
            continue
        if len(valid) < 2:
            continue
        del where[pair]
        rules.append(pair)
        places.append(valid[0])
        fresh: dict[tuple[int, int], list[int]] = {}
        for i in valid:
            j = after[i]
            k = after[j]
            symbol[i], symbol[j] = top, -1
            after[i] = k
            if k < n:
                before[k] = i
                fresh.setdefault((top, symbol[k]), []).append(i)
            h = before[i]
            if h >= 0:
                fresh.setdefault((symbol[h], top), []).append(h)
        for new, at in fresh.items():
            if len(at) > 1:
                at = sorted(set(at))
                where[new] = at
                heapq.heappush(heap, (-len(at), new))
        top += 1
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = after[i]
    return Grammar(first, rules, places, [symbol[i] for i in starts], starts)


def _lengths(grammar: Grammar) -> list[int]:
    out: list[int] = []
    first = grammar.first
    for left, right in grammar.rules:
        out.append((out[left - first] if left >= first else 1) + (out[right - first] if right >= first else 1))
    return out


def _equal_ahead(ids: np.ndarray, i: int, q: int, end: int) -> int:
    """How many words from i on equal the word q later, which lies before ``end``."""
    at, step = i, 32
    while at + q < end:
        upto = min(at + step, end - q)
        differ = ids[at:upto] != ids[at + q : upto + q]
        if differ.any():
            return at + int(differ.argmax()) - i
        at, step = upto, step * 4
    return at - i


def _equal_behind(ids: np.ndarray, i: int, q: int, start: int) -> int:
    """How many words up to i, going back to ``start``, equal the word q later."""
    at, step = i + 1, 32
    while at > start:
        down = max(at - step, start)
        differ = ids[down:at] != ids[down + q : at + q]
        if differ.any():
            return i + 1 - (down + len(differ) - int(differ[::-1].argmax()))
        at, step = down, step * 4
    return i + 1 - at


class Boundaries:
    """The runs across a boundary within a span of the words, by the other places of the passages at the boundary."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        numbers = _passages(ids, AROUND)
        order = np.argsort(numbers, kind="stable")
        group = np.concatenate(([0], np.cumsum(numbers[order[1:]] != numbers[order[:-1]])))
        self.order = order
        self.group = np.empty(len(order), np.int64)
        self.group[order] = group
        self.bounds = np.searchsorted(group, np.arange(group[-1] + 2))
        gap = np.full(len(ids), len(ids), np.int64)
        gap[: len(order)][order[:-1]] = np.where(group[1:] == group[:-1], order[1:] - order[:-1], len(ids))
        self.to_next = gap
        gap = np.full(len(ids), len(ids), np.int64)
        gap[: len(order)][order[1:]] = np.where(group[1:] == group[:-1], order[1:] - order[:-1], len(ids))
        self.to_last = gap

    def hopeful(self, middles: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Whether a passage at the boundary comes again near enough for a run within so many words."""
        most = spans // LEAST_PERIODS
        return (spans >= LEAST_WORDS) & (
            (self.to_next[middles - 1] <= most) | (self.to_last[np.maximum(middles - AROUND + 1, 0)] <= most)
        )

    def _places(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Where the passage of place i occurs from ``lo`` up to, not with, ``hi``."""
        g = self.group[i]
        places = self.order[self.bounds[g] : self.bounds[g + 1]]
        return places[np.searchsorted(places, lo) : np.searchsorted(places, hi)]

    def runs(self, lo: int, middle: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, period) of those with enough words and periods; not all periods are the smallest."""
        most = (hi - lo) // LEAST_PERIODS
        ahead, behind = middle - 1, middle - AROUND + 1
        if ahead + AROUND <= hi:  # at least half of the run lies behind the boundary
            periods = self._places(ahead, ahead + 1, min(ahead + most, hi - AROUND) + 1) - ahead
            yield from self._grown(periods, lo, hi, lambda q: ahead, lambda q, s, e: ahead + q + AROUND <= e)
        if behind >= lo:  # at least half lies before it
            periods = behind - self._places(behind, max(lo, behind - most), behind)[::-1]
            yield from self._grown(periods, lo, hi, lambda q: middle - q, lambda q, s, e: behind - q >= s)

    def _grown(
        self, periods: np.ndarray, lo: int, hi: int, at: Callable[[int], int], within: Callable[[np.ndarray, int, int], np.ndarray],
    ) -> Iterator[tuple[int, int, int]]:
        k = 0
        while k < len(periods):
            q = int(periods[k])
            k += 1
            i = at(q)
            start = i + 1 - _equal_behind(self.ids, i, q, lo)
            end = i + _equal_ahead(self.ids, i, q, hi) + q
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                yield start, end, q
                # multiples of q within this run only find it again
                rest = periods[k:]
                periods, k = rest[(rest % q != 0) | ~within(rest, start, end)], 0


def _grammar_runs(ids: np.ndarray) -> set[tuple[int, int, int]]:
    """Maximal (start, end, period), not all of smallest period, of one stretch."""
    grammar = re_pair(ids.tolist())
    lengths = _lengths(grammar)
    first, rules = grammar.first, grammar.rules
    size = [lengths[s - first] if s >= first else 1 for s in range(first, first + len(rules))]
    at = Boundaries(ids)
    found: list[tuple[int, int, int]] = []
    # the joined sequence: every node occurs once
    starts = np.array([*grammar.starts, len(ids)], np.int64)
    while len(starts) > 2:
        pairs = (len(starts) - 1) // 2
        lo, middle, hi = starts[0 : 2 * pairs : 2], starts[1 : 2 * pairs : 2], starts[2 : 2 * pairs + 1 : 2]
        hope = at.hopeful(middle, hi - lo)
        for a, b, c in zip(lo[hope].tolist(), middle[hope].tolist(), hi[hope].tolist(), strict=True):
            found += at.runs(a, b, c)
        starts = np.concatenate((starts[0 : 2 * pairs + 1 : 2], starts[2 * pairs + 1 :]))
    # the rules: runs relative to the symbol, once each
    own: dict[int, list[tuple[int, int, int]]] = {}
    if rules:
        spans = np.array(size, np.int64)
        lows = np.array(grammar.places, np.int64)
        lefts = np.array([lengths[a - first] if a >= first else 1 for a, _ in rules], np.int64)
        for x in np.flatnonzero(at.hopeful(lows + lefts, spans)).tolist():
            lo = int(lows[x])
            runs = [(s - lo, e - lo, q) for s, e, q in at.runs(lo, lo + int(lefts[x]), lo + int(spans[x]))]
            if runs:
                own[x] = runs
    if own:
        # symbols with runs of their own or below, and all their places, parents before children
        needed = [False] * len(rules)
        for x, (a, b) in enumerate(rules):
            needed[x] = x in own or (a >= first and needed[a - first]) or (b >= first and needed[b - first])
        places: dict[int, list[int]] = {}
        for s, i in zip(grammar.sequence, grammar.starts, strict=True):
            if s >= first and needed[s - first]:
                places.setdefault(s - first, []).append(i)
        for x in range(len(rules) - 1, -1, -1):
            here = places.pop(x, None)
            if here is None:
                continue
            found += ((i + s, i + e, q) for s, e, q in own.get(x, ()) for i in here)
            a, b = rules[x]
            if a >= first and needed[a - first]:
                places.setdefault(a - first, []).extend(here)
            if b >= first and needed[b - first]:
                shift = lengths[a - first] if a >= first else 1
                places.setdefault(b - first, []).extend([i + shift for i in here])
    return merged(found)


def merged(stretches: list[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Stretches (start, end, period) of one period that overlap by a period, as one."""
    out: set[tuple[int, int, int]] = set()
    held: tuple[int, int, int] | None = None
    for s, e, q in sorted(set(stretches), key=lambda x: (x[2], x[0], x[1])):
        if held and held[2] == q and s + q <= held[1]:
            held = (held[0], max(held[1], e), q)
        else:
            if held:
                out.add(held)
            held = (s, e, q)
    if held:
        out.add(held)
    return out


def _smallest(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether the q words from ``start`` are no repetition of a shorter piece."""
    rest, d = q, 2
    while rest > 1:
        if d * d > rest:
            d = rest
        if rest % d == 0:
            p = q // d
            if np.array_equal(ids[start : start + q - p], ids[start + p : start + q]):
                return False
            while rest % d == 0:
                rest //= d
        d += 1
    return True


def find_runs(words: list[bytes]) -> list[Run]:
    """All runs of the words, by start, then period."""
    if len(words) < LEAST_WORDS:
        return []
    rough = np.fromiter(map(hash, words), np.int64, len(words))
    out = []
    for lo, hi in candidate_stretches(rough.view(np.uint64)):
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words[lo:hi]], np.int64)
        out += [Run(lo + s, e - s, q) for s, e, q in _grammar_runs(ids) if _smallest(ids, s, q)]
    return sorted(out, key=lambda r: (r.start, r.period))


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, exactly; ties: the smallest start, then period."""
    best: Run | None = None
    for r in runs:
        if best is None:
            best = r
            continue
        one, two = r.length * best.period, best.length * r.period
        if one > two or (one == two and (r.start, r.period) < (best.start, best.period)):
            best = r
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def report(words: list[bytes]) -> tuple:
    """One row of :data:`RESULT`."""
    runs = find_runs(words)
    best = strongest(runs)
    listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
    return (
        len(runs), *((best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4),
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
        [r._asdict() for r in runs],
    )


def text_words(text: str | None) -> list[bytes]:
    """Whatever stands between spaces, tabs and line breaks."""
    return utf8(text).split()


def runs_of(text: Column, *more: Column, change: Callable[..., list[bytes]] | None = None) -> Column:
    """The :data:`RESULT` of each text; ``change(words, *more)`` may rewrite its words first."""

    @F.pandas_udf(RESULT)
    def found(texts: pd.Series, *others: pd.Series) -> pd.DataFrame:
        rows = []
        for text, *values in zip(texts, *others, strict=True):
            words = text_words(text)
            rows.append(report(change(words, *values) if change else words))
        names = [f.split(" ")[0] for f in RESULT.split(", runs ")[0].split(", ")] + ["runs"]
        out = pd.DataFrame(rows, columns=names)
        for name in names[:5]:
            out[name] = out[name].astype("Int64")
        return out

    return found.asNondeterministic()(text, *more)
