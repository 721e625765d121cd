"""Benchmark passages in documents: one Aho-Corasick automaton over the windows of all benchmark items.

Words are lower-case (A-Z) runs of digits, ASCII letters and characters beyond ASCII. A window is 13 consecutive words of
an item; an item of fewer words, but not none, is one window. Every word of the benchmark gets a character of its own, so
a document becomes a text of one character per word and is scanned once; positions in it are word numbers, which lead
back to offsets in the original text. A word inside any occurrence of a window is hit. A document is contaminated when at
least one word is hit, and at least one in 20.

Null and empty texts have no words and are never contaminated. Items without words have no window. Items without an id
mark words, but are not listed. Repeated items and rows change nothing. An automaton holds at most ``BLOCK_WINDOWS``
windows and their numbers, a fixed size to broadcast; a larger benchmark is dealt into blocks, each scanned against all
documents. Which items have a window is a written table, so that many items may share one: a document's items are
joined to the numbers of its windows, once for all documents with the same ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaloom.operators.hubs import salted_join
from signaloom.session import cut_lineage

from .common import column, free_name, words_of

WINDOW = 13
#: Windows of one automaton, about 13 small nodes each.
BLOCK_WINDOWS = 200_000
#: Words hit, as a share of all, from which a document is contaminated: one in so many.
ONE_IN = 20
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_OTHER = "\x01"

#: Counts, numbers of the windows that occur, and the hit stretches as word numbers and as offsets in the text (end exclusive).
FOUND = (
    "n_words long, n_hit long, windows array<long>, words array<struct<start:long,stop:long>>, "
    "spans array<struct<start:long,stop:long>>"
)
FIELDS = ["n_words", "n_hit", "windows", "words", "spans"]
Windows = list[tuple[bytes, int]]


def item_windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def benchmark_windows(benchmark: DataFrame, id_column: str, text_column: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(``window, number``) of each distinct window, and (``number, item``) of the items that have it; both are written."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, i) for i, t in zip(batch["item"], batch["text"], strict=True) for w in sorted(item_windows(t, size))]
            yield pd.DataFrame(rows, columns=["window", "item"])

    items = benchmark.select(
        column(benchmark, id_column).cast("string").alias("item"), column(benchmark, text_column).alias("text")
    )
    cuts = cut_lineage(items.mapInPandas(cut, "window binary, item string").distinct(), "cuts")
    windows = cut_lineage(cuts.select("window").distinct().withColumn("number", F.monotonically_increasing_id()), "windows")
    holders = cuts.filter("item is not null").join(windows, "window").select("number", "item")
    return windows, cut_lineage(holders, "holders")


class Scanner:
    """The automaton of one block of windows."""

    def __init__(self, windows: Windows):
        points = (p for p in range(2, 0x110000) if not 0xD800 <= p < 0xE000)
        self.letters: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for window, number in windows:
            words = window.split()
            for word in words:
                if word not in self.letters:
                    self.letters[word] = chr(next(points))
            self.automaton.add_word("".join(map(self.letters.__getitem__, words)), (len(words), number))
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: str | None, earlier=(), stretches=()) -> dict:
        """What :data:`FOUND` describes, on top of the windows and word stretches that earlier blocks gave."""
        words = words_of(text)
        letters, found, hit = self.letters, {int(n) for n in earlier}, bytearray(len(words))
        for x in stretches:
            hit[x["start"] : x["stop"]] = b"\x01" * (x["stop"] - x["start"])
        coded = "".join([letters.get(w, _OTHER) for w in words])
        for last, (n, number) in self.automaton.iter(coded) if letters else ():
            hit[last - n + 1 : last + 1] = b"\x01" * n
            found.add(number)
        runs = [m.span() for m in re.finditer(b"\x01+", hit)]
        places = [m.span() for m in _WORD.finditer(text)] if runs else []
        return {
            "n_words": len(words), "n_hit": sum(hit), "windows": sorted(found),
            "words": [{"start": a, "stop": b} for a, b in runs],
            "spans": [{"start": places[a][0], "stop": places[b - 1][1]} for a, b in runs],
        }


def _scan_column(docs: DataFrame, windows: Windows, text: Column, earlier: Column | None) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Scanner(shared.value)
        for texts in batches:
            yield pd.DataFrame([own.scan(t) for t in texts], columns=FIELDS)

    @F.pandas_udf(FOUND)
    def scan_on(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        own = Scanner(shared.value)
        for texts, before in batches:
            rows = zip(texts, before["windows"], before["words"], strict=True)
            yield pd.DataFrame([own.scan(*row) for row in rows], columns=FIELDS)

    return scan.asNondeterministic()(text) if earlier is None else scan_on.asNondeterministic()(text, earlier)


def scan_windows(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", size: int = WINDOW, block_windows: int = BLOCK_WINDOWS, name: str = "found",
) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a struct column ``name`` of :data:`FOUND` for the whole text of each row, and the items of each window number.

    With more than one block, each block's pass is written to the shared folder before the next begins, so a task never
    holds two automata.
    """
    windows, holders = benchmark_windows(benchmark, item_column, item_text_column, size)
    blocks = max(1, math.ceil(windows.count() / block_windows))
    for k in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        block = [(bytes(r["window"]), r["number"]) for r in part.toLocalIterator()]
        found = _scan_column(docs, block, column(docs, text_column), column(docs, name) if k else None)
        docs = docs.withColumn(name, found)
        if k < blocks - 1:
            docs = cut_lineage(docs, "scanned")
    return docs, holders


def with_items(scanned: DataFrame, holders: DataFrame, name: str = "found") -> DataFrame:
    """What :func:`scan_windows` gave, with ``items``, ids as sorted text, in place of the window numbers.

    ``scanned`` is written first: leave out the columns that are not needed, the text above all. Documents that hold the same
    windows are one in the join.
    """
    key, items = free_name(scanned, "key"), free_name(scanned, "items")
    numbers = F.col(f"{name}.windows")
    same = F.when(F.size(numbers) > 0, F.sha2(F.array_join(numbers.cast("array<string>"), ","), 256))
    scanned = cut_lineage(scanned.withColumn(key, same), "scanned")
    sets = scanned.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_of")).agg(F.first(numbers).alias("numbers"))
    each = sets.select("_of", F.explode("numbers").alias("number")).join(holders, "number")
    lists = each.groupBy(F.col("_of").alias(key)).agg(F.sort_array(F.collect_set("item")).alias(items))
    # documents without a window have no key and are spread; windows that very many documents hold are salted
    joined = salted_join(scanned, lists, [key], "left")
    listed = F.coalesce(F.col(items), F.array().cast("array<string>")).alias("items")
    fields = [listed if f == "windows" else F.col(f"{name}.{f}") for f in FIELDS]
    return joined.select(*[F.struct(*fields).alias(c) if c == name else column(joined, c) for c in scanned.columns if c != key])


def scan_documents(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", name: str = "found", **options) -> DataFrame:
    """``docs`` with a struct column ``name``: ``n_words, n_hit, items, words, spans`` for the whole text of each row."""
    return with_items(*scan_windows(docs, benchmark, text_column, name=name, **options), name)


def contaminated(found: str) -> Column:
    """Whether a struct column of :data:`FOUND` marks a contaminated document."""
    n_hit = F.col(f"{found}.n_hit")
    return (n_hit > 0) & (n_hit * ONE_IN >= F.col(f"{found}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    name = free_name(docs, "found")
    scanned, _ = scan_windows(docs, benchmark, text_column, name=name, **options)
    return scanned.filter(~contaminated(name)).drop(name)
