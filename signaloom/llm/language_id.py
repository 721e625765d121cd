"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Letters (with their combining marks) count in lower case, everything else is a word break. The model is one matrix of
log-probabilities, n-gram buckets by languages, of a size fixed by the two parameters; it is broadcast, and each batch of
texts is scored as a sparse product: the rows of its n-grams, summed text by text, some n-grams and languages at a time.

A text that is null or has no letter gets ``und`` and score 0; so does every text when no labelled row was given. Texts
are scored whole, very long ones in pieces that are added up. Ties go to the language that sorts first.

The score is a posterior over the known languages, which goes to 1 with the length of any text, junk too. Whether a text
is of a language at all is told by its fit, the mean log-probability of its n-grams: it must not be more than ``MARGIN``
below a low quantile of the labelled rows, each judged by the counts of the others.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 16
SMOOTHING = 0.1
#: At most about so many rows of each language are used to fit.
ROWS_PER_LANGUAGE = 25_000
#: A model matrix larger than this is refused, because it is broadcast.
MATRIX_MB = 256
PIECE = 1 << 20
#: So many n-grams are held at once (or those of one piece), and so many of their log-probabilities (or those of one language):
#: a task needs no more memory besides its batch, however long the texts and however many the languages.
AT_ONCE = 1 << 18
CELLS = 1 << 20
#: A text fits its language when its mean log-probability is no more than MARGIN (nats an n-gram) below this quantile.
LEAST_QUANTILE = 0.01
MARGIN = 1.5

RESULT = "lang_pred string, score double, fits boolean"


@lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: what it counts as (a space for word breaks), and whether it is a letter."""
    folded, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            folded[c], letter[c] = ord(ch.lower()[0]), True
        elif unicodedata.category(ch)[0] == "M":
            folded[c] = c
    return folded, letter


def ngram_buckets(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of the folded text, piece by piece; nothing for a text without letters."""
    folded, letter = _folding()
    before = np.full(1, 32, np.uint32)
    begun = False
    for start in range(0, len(text), PIECE):
        points = np.frombuffer(text[start : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = folded[points]
        if not begun and not letter[points].any():
            continue  # word breaks and stray marks before the first letter
        begun = True
        codes = np.concatenate([before, codes, np.full(int(start + PIECE >= len(text)), 32, np.uint32)])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        fresh = len(before) if start else 0  # n-grams that end before this were counted with the last piece
        wide = codes.astype(np.uint64)
        for n in orders:
            if len(wide) < n:
                continue
            key = np.full(len(wide) - n + 1, n, np.uint64)
            for k in range(n):
                key = (key * np.uint64(0x100000001B3)) ^ wide[k : len(wide) - n + 1 + k]
            first = max(0, fresh - n + 1)
            yield ((key[first:] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
        before = codes[-(max(orders) - 1) or len(codes) :]


def gathered(
    texts: Iterable[str | None], orders: tuple[int, ...], bits: int, at_once: int | None = None
) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """The n-grams of texts, about ``at_once`` at a time: bucket numbers, where each piece begins, the text it is of."""
    most = at_once or AT_ONCE
    ids: list[np.ndarray] = []
    begins: list[int] = []
    owners: list[int] = []
    held = 0
    for row, text in enumerate(texts):
        for piece in ngram_buckets(text or "", orders, bits):
            if not len(piece):
                continue
            if held and held + len(piece) > most:
                yield np.concatenate(ids), begins, owners
                ids, begins, owners, held = [], [], [], 0
            ids.append(piece)
            begins.append(held)
            owners.append(row)
            held += len(piece)
    if ids:
        yield np.concatenate(ids), begins, owners


def ngram_counts(texts: Iterable[str | None], orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS) -> np.ndarray:
    """How often each bucket occurs in all texts together."""
    counts = np.zeros(1 << bits, np.int64)
    for ids, _, _ in gathered(texts, orders, bits, max(AT_ONCE, 1 << bits)):
        counts += np.bincount(ids, minlength=1 << bits)
    return counts


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, log-probabilities
    priors: np.ndarray
    orders: tuple[int, ...] = ORDERS
    bits: int = BUCKET_BITS
    least_fit: np.ndarray | None = None  # per language, where it was asked for

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods, texts by languages, and the number of n-grams of each text."""
        out, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for ids, begins, owners in gathered(texts, self.orders, self.bits):
            np.add.at(n, owners, np.diff([*begins, len(ids)]))
            step = max(1, CELLS // len(ids))
            for k in range(0, len(self.languages), step):
                sums = np.add.reduceat(self.weights[:, k : k + step][ids], begins, axis=0, dtype=np.float64)
                np.add.at(out[:, k : k + step], owners, sums)
        return out, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text: the language, its posterior, and whether the text fits it."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        likelihood, n = self.sums(texts)
        known = n > 0
        joint = self.priors + likelihood
        best, place = joint.max(axis=1), joint.argmax(axis=1)
        share = 1 / np.exp(joint[known] - best[known, None]).sum(axis=1)
        score = np.zeros(len(texts))
        score[known] = share
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(place, known, strict=True)]
        fits = known.copy()
        if self.least_fit is not None:
            fits &= likelihood[np.arange(len(texts)), place] >= self.least_fit[place] * n
        return names, score, fits

    def fit_by_others(self, text: str | None, k: int, size: float, smoothing: float) -> float:
        """Mean log-probability in language k of a text that was fitted on, by the counts of all others.

        ``size`` is the sum of the language's counts.
        """
        if len(text or "") * len(self.orders) > AT_ONCE:
            counts = ngram_counts([text], self.orders, self.bits)
            bucket = np.flatnonzero(counts)
            own = counts[bucket]
        else:
            pieces = list(ngram_buckets(text or "", self.orders, self.bits))
            bucket, own = np.unique(np.concatenate(pieces or [np.zeros(0, np.int32)]), return_counts=True)
        n = int(own.sum())
        if not n:
            return np.nan
        whole = size + smoothing * (1 << self.bits)
        others = np.maximum(np.rint(np.exp(self.weights[bucket, k].astype(float)) * whole - smoothing) - own, 0)
        return float((own * np.log((others + smoothing) / (whole - n))).sum() / n)


def drawn_rows(labelled: DataFrame, sizes: dict[str, int], rows_per_language: int) -> DataFrame:
    """The rows (``text, lang, id``) to fit on: about ``rows_per_language`` of each language, by a hash of id and text."""
    share = F.lit(1.0)
    for name, size in sizes.items():
        if size > rows_per_language:
            share = F.when(F.col("lang") == name, rows_per_language / size).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.coalesce("text", F.lit(""))), F.lit(1 << 20)) / (1 << 20)
    return labelled.filter(draw < share).select("text", "lang")


def fit_language_model(
    rows: DataFrame, text_column: str = "text", language_column: str = "lang", orders: tuple[int, ...] = ORDERS,
    bits: int = BUCKET_BITS, smoothing: float = SMOOTHING, rows_per_language: int = ROWS_PER_LANGUAGE,
    least_quantile: float | None = None, id_column: str | None = None,
) -> LanguageModel:
    """Fit on rows with a language. Priors come from all of them, n-gram counts from a sample of each language.

    The sample takes rows by a hash of id and text, with a share per language that gives about ``rows_per_language``; the
    id is used for nothing else. Without an id column all copies of a text are taken or left together.
    With ``least_quantile`` the rows of the sample also tell how well a text must fit.
    """
    own = F.lit(None).cast("string") if id_column is None else column(rows, id_column)
    labelled = rows.select(
        column(rows, text_column).alias("text"), column(rows, language_column).alias("lang"), own.alias("id")
    )
    labelled = labelled.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if len(languages) * 8 << bits > MATRIX_MB << 20:
        raise ValueError(f"{len(languages)} languages by 2^{bits} buckets exceed {MATRIX_MB} MB: use fewer bits")
    priors = np.log(np.array([sizes[x] for x in languages], float) / max(1, sum(sizes.values())))
    number = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(number), 1 << bits), np.int64)
        for batch in batches:
            for name, group in batch.groupby("lang"):
                counts[number[name]] += ngram_counts(group["text"], orders, bits)
        k, bucket = np.nonzero(counts)
        yield pd.DataFrame({"k": k.astype(np.int32), "bucket": bucket.astype(np.int32), "n": counts[k, bucket]})

    counts = np.zeros((1 << bits, len(languages)))
    sample = drawn_rows(labelled, sizes, rows_per_language)
    if languages:
        parts = sample.mapInPandas(count, "k int, bucket int, n long")
        summed = parts.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[summed["bucket"], summed["k"]] = summed["n"]
    in_all = counts.sum(axis=0)
    weights = np.log((counts + smoothing) / (in_all + smoothing * (1 << bits)))
    model = LanguageModel(languages, weights.astype(np.float32), priors, orders, bits)
    if languages and least_quantile is not None:
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                k = batch["lang"].map(number).to_numpy(np.int32)
                fit = [shared.value.fit_by_others(t, x, in_all[x], smoothing) for t, x in zip(batch["text"], k, strict=True)]
                yield pd.DataFrame({"k": k, "fit": np.array(fit, float)})

        fits = sample.mapInPandas(judge, "k int, fit double").filter(~F.isnan("fit"))
        model.least_fit = np.full(len(languages), -np.inf)
        for r in fits.groupBy("k").agg(F.percentile_approx("fit", least_quantile).alias("low")).collect():
            model.least_fit[r["k"]] = r["low"] - MARGIN
    return model


def language_of(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """Struct ``lang_pred, score, fits`` of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            names, score, fits = own.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": score, "fits": fits})

    return predict.asNondeterministic()(text)
