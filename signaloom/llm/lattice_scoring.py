"""Log-probability of texts under a unigram model of subword pieces, summed over all segmentations.

A text is its words (runs without white space, A-Z in lower case) and one end. A word is a path through the lattice of
vocabulary pieces over its characters, the word mark in front; its probability is the sum over all paths, worked out by
the forward recursion in log space. A character that no piece writes is spelled by its byte pieces, so every text has a
probability. Pieces never cross white space, so a text's log-probability is a sum over its words and each distinct word
is worked out once.

The vocabulary and its scores exist already and are not trained. The scores of a byte-pair vocabulary are ranks; they
become weights by Zipf's law, and weight all segmentations of the training words once. The expected piece counts, over
all words of all training rows, with the weights as a prior, are the model (``rounds=0`` keeps the weights themselves).
The base score beside it is a word unigram with add-one smoothing.

Null counts as the empty text, which is one end. A null id counts as the empty text in the split. Counts cover every row;
repeated rows count each time. Very long texts and words are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaloom.session import cut_lineage

from .common import column, utf8

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MARK = "▁"
ZIPF_SHIFT = 2.7
#: Weight of the prior, in pieces.
PRIOR_PIECES = 1000.0
#: The most frequent words, a fixed number, are broadcast; all others are joined.
HEAD_WORDS = 100_000
FLUSH_WORDS = 300_000
LN10 = math.log(10)


@dataclass(frozen=True)
class Pieces:
    """Pieces of a vocabulary, in order of id, with natural log-probabilities; ``bytes_at`` the ids of 256 byte pieces."""

    texts: list[str]
    log_p: np.ndarray
    bytes_at: list[int]
    end: int

    @classmethod
    def load(cls, model_path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        rank = np.array([-model.get_score(k) for k in range(n)])
        usual = np.array([not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)) for k in range(n)])
        rank[~usual | (rank > n)] = n
        rank[model.eos_id()] = 1
        weight = 1 / (rank + ZIPF_SHIFT)
        weight[model.unk_id()] = 0
        texts = [model.id_to_piece(k) if usual[k] else "" for k in range(n)]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        with np.errstate(divide="ignore"):
            return cls(texts, np.log(weight / weight.sum()), byte_ids, model.eos_id())

    def with_counts(self, expected: np.ndarray) -> Pieces:
        """The model of expected piece counts, with these probabilities as a prior."""
        p = expected + PRIOR_PIECES * np.exp(self.log_p)
        with np.errstate(divide="ignore"):
            return Pieces(self.texts, np.log(p / p.sum()), self.bytes_at, self.end)


Edge = tuple[int, tuple[int, ...], float]


class Lattice:
    """Pieces in a trie: a node maps a character to the next node, and "" to the piece that ends there."""

    def __init__(self, pieces: Pieces):
        self.log_p = pieces.log_p.tolist()
        self.bytes_at = pieces.bytes_at
        self.root: dict = {}
        for k, piece in enumerate(pieces.texts):
            if piece:
                node = self.root
                for letter in piece:
                    node = node.setdefault(letter, {})
                node[""] = ((k,), self.log_p[k])

    def _spelled(self, letter: str) -> tuple[tuple[int, ...], float]:
        ids = tuple(self.bytes_at[b] for b in utf8(letter))
        return ids, sum(self.log_p[k] for k in ids)

    def _leaving(self, text: str, start: int):
        """(end, (pieces, log-probability)) of the edges that leave a position."""
        node = self.root.get(text[start])
        if node is None or "" not in node:
            yield start + 1, self._spelled(text[start])
        stop = start + 1
        while node is not None:
            piece = node.get("")
            if piece:
                yield stop, piece
            if stop == len(text):
                break
            node = node.get(text[stop])
            stop += 1

    @staticmethod
    def _total(terms: list[float]) -> float:
        if len(terms) == 1:
            return terms[0]
        top = max(terms)
        return top + math.log(sum([math.exp(x - top) for x in terms]))

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the sum over all segmentations."""
        text = MARK + word
        arriving: list[list[float]] = [[] for _ in text] + [[]]
        arriving[0].append(0.0)
        for start in range(len(text)):
            alpha = self._total(arriving[start])
            for stop, (_, lp) in self._leaving(text, start):
                arriving[stop].append(alpha + lp)
        return self._total(arriving[-1])

    def add_expected(self, word: str, times: float, counts: list[float]) -> None:
        """Add the expected number of uses of each piece in ``times`` occurrences of the word."""
        text = MARK + word
        arriving: list[list] = [[] for _ in text] + [[]]
        alpha = [0.0] * len(arriving)
        for start in range(len(text)):
            if start:
                alpha[start] = self._total([x for x, _, _ in arriving[start]])
            for stop, (used, lp) in self._leaving(text, start):
                arriving[stop].append((alpha[start] + lp, start, used))
        alpha[-1] = self._total([x for x, _, _ in arriving[-1]])
        share = [0.0] * len(arriving)  # expected passes through a position
        share[-1] = float(times)
        for stop in range(len(text), 0, -1):
            if share[stop]:
                for x, start, used in arriving[stop]:
                    part = share[stop] * math.exp(x - alpha[stop])
                    share[start] += part
                    for k in used:
                        counts[k] += part


def text_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(LOWER).split()


def word_counts(docs: DataFrame, text: Column, training: Column) -> DataFrame:
    """(``word, c``): every word of every row, and its count in the training rows (0 where it occurs elsewhere only)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text, training in zip(batch["text"], batch["training"], strict=True):
                words = text_words(text)
                if training:
                    held.update(words)
                else:
                    for w in words:
                        held[w] += 0
                if len(held) >= FLUSH_WORDS:
                    yield from _word_frames(held)
                    held.clear()
        yield from _word_frames(held)

    rows = docs.select(text.alias("text"), training.alias("training")).mapInPandas(count, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def _word_frames(held: Counter) -> Iterator[pd.DataFrame]:
    words = list(held)
    for k in range(0, len(words), 50_000):
        part = words[k : k + 50_000]
        yield pd.DataFrame({"word": part, "c": [held[w] for w in part]})


def _spelled(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def expected_pieces(words: DataFrame, pieces: Pieces) -> np.ndarray:
    """Expected uses of each piece over all training occurrences of all words; one row per piece reaches the driver."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, held = Lattice(shared.value), [0.0] * len(shared.value.texts)
        for batch in batches:
            for word, c in zip(batch["word"], batch["c"], strict=True):
                lattice.add_expected(_spelled(word), c, held)
        counts = np.array(held)
        used = np.nonzero(counts)[0]
        yield pd.DataFrame({"piece": used, "n": counts[used]})

    parts = words.filter("c > 0").mapInPandas(expect, "piece long, n double")
    summed = parts.groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(pieces.texts))
    out[summed["piece"].to_numpy(dtype=int)] = summed["n"]
    return out


def scored_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` with ``lp``, the natural log-probability of the word."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(shared.value)
        for batch in batches:
            yield pd.Series([lattice.log_probability(_spelled(w)) for w in batch], dtype=float)

    return words.withColumn("lp", score.asNondeterministic()("word"))


PARTIAL = "n_words long, known long, base double, lp double, tail array<struct<word:binary,n:long>>"


def score_texts(
    docs: DataFrame, pieces: Pieces, training: Column, id_column: str = "doc_id", text_column: str = "text",
    rounds: int = 1, head_words: int = HEAD_WORDS,
) -> DataFrame:
    """(id, ``training, n_tokens, n_known, train_tokens, base_score, score``) per row, scores as log10.

    ``training`` is a condition on the columns of ``docs``. A text's frequent words are looked up in the broadcast head;
    its other words go through a join with the table of all words, which holds nothing hot.
    """
    text = column(docs, text_column)
    words = cut_lineage(word_counts(docs, text, training), "words")
    n_rows = docs.filter(training).count()
    totals = words.filter("c > 0").agg(F.sum("c"), F.count("*")).first()
    train_tokens, distinct = (totals[0] or 0) + n_rows, totals[1] + (n_rows > 0)
    below = math.log10(train_tokens + distinct + 1)
    for _ in range(rounds):
        expected = expected_pieces(words, pieces)
        expected[pieces.end] += n_rows
        pieces = pieces.with_counts(expected)
    table = cut_lineage(scored_words(words, pieces), "scored-words")
    head = table.orderBy(F.desc("c"), "word").limit(head_words).toPandas()
    known = {bytes(w): (c > 0, math.log10(c + 1), lp) for w, c, lp in head.itertuples(index=False)}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf(PARTIAL)
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                found = Counter(text_words(text))
                n_known, base, lp, tail = 0, 0.0, 0.0, []
                for word, n in found.items():
                    hit = own.get(word)
                    if hit is None:
                        tail.append({"word": word, "n": n})
                    else:
                        n_known += n * hit[0]
                        base += n * hit[1]
                        lp += n * hit[2]
                rows.append((found.total(), n_known, base, lp, tail))
            yield pd.DataFrame(rows, columns=["n_words", "known", "base", "lp", "tail"])

    partial = docs.select(column(docs, id_column).alias("id"), training.alias("training"), look_up.asNondeterministic()(text).alias("x"))
    rows = cut_lineage(partial.select("id", "training", "x.*").withColumn("row", F.monotonically_increasing_id()), "partial")
    tails = rows.select("row", F.inline("tail")).join(table, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("tail_base"), F.sum(F.col("n") * F.col("lp")).alias("tail_lp"),
    )
    end_base, end_lp = math.log10(n_rows + 1), float(pieces.log_p[pieces.end])
    zero = F.lit(0.0)
    n_tokens = F.col("n_words") + 1
    return rows.drop("tail").join(tails, "row", "left").select(
        F.col("id").alias(id_column), "training", n_tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + int(n_rows > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero) + end_base - n_tokens * below).alias("base_score"),
        ((F.col("lp") + F.coalesce("tail_lp", zero) + end_lp) / LN10).alias("score"),
    )
