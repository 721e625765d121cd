"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed word list and of words learned from the labels, in plain and in disguised
spelling; how near they stand to a second person; shares of capitals, punctuation, symbols, and long repeats. Trees and
calibration are Spark ML's, fitted on a bounded sample of the labelled training rows (calibration on a fifth that the
trees never saw), and applied to every row.

Null counts as the empty text, which gets features of 0 and a score like any other. Rows without a label, with a null id
or a null label are not learned from; of an id with several labels the largest counts. Without both labels in the sample
every score is the share of toxic rows in it (0 if there are none).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaloom.session import cut_lineage

from .common import column, free_name

# Common insults and second-person words.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers trash garbage scum clown pathetic worthless disgusting "
    "useless ugly imbecile jerk pig filth vermin freak dumm idioten trottel abschaum arschloch dreck imbécile crétin "
    "stupide connard ordure débile estúpido estúpida imbécil idiota basura asqueroso inútil".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine sie ihr euch tu te toi ton ta tes vous votre vos tú usted ti "
    "tus vosotros".split()
)
# End of fixed values.
LEET = str.maketrans("013457@$!|", "oieastasil")

#: At most about so many labelled rows are learned from.
SAMPLE_ROWS = 40_000
#: Learned words: at most so many, each in this share of the toxic rows at least, and toxic this often.
LEARNED_WORDS, LEARNED_SUPPORT, LEARNED_PURITY = 200, 0.02, 0.9
NEAR = 5
LONGEST_DISGUISE = 40
TREES, DEPTH, STEP = 20, 4, 0.3

_WORD = re.compile(r"[^\W\d_]+")
_JOIN = re.compile(r"[^\w]|_")
_REPEAT = re.compile(r"([^\W\d_])\1{3,}")
FEATURES = (
    "insult_density", "insults", "learned_density", "learned", "disguised_density", "near_second_person",
    "second_person_density", "capitals", "capital_words", "exclamations", "punctuation", "symbols", "repeats", "log_words",
)


def _disguised(text: str, lexicon: frozenset[str]) -> int:
    """Words with digits or marks inside that spell a listed word; very long ones cannot."""
    found = 0
    for token in text.split():
        core = token.strip(".,;:!?'\"()-*")
        if core.isalpha() or not core or len(core) > LONGEST_DISGUISE:
            continue
        core = core.lower()
        found += _JOIN.sub("", core.translate(LEET)) in lexicon or _JOIN.sub("", core) in lexicon
    return found


def features(text: str | None, learned: frozenset[str] = frozenset()) -> list[float]:
    """The values of :data:`FEATURES`; rates are per word or per character of the whole text."""
    text = text or ""
    raw = _WORD.findall(text)
    words = [w.lower() for w in raw]
    n, chars = max(1, len(words)), max(1, len(text))
    insults = [k for k, w in enumerate(words) if w in INSULTS]
    own = [k for k, w in enumerate(words) if w in learned]
    second = np.array([k for k, w in enumerate(words) if w in SECOND_PERSON])
    listed = np.array(sorted({*insults, *own}))
    near = 0.0
    if len(second) and len(listed):
        place = np.searchsorted(second, listed)
        gap = np.minimum(
            np.abs(listed - second[np.minimum(place, len(second) - 1)]), np.abs(listed - second[np.maximum(place - 1, 0)])
        )
        near = float((gap <= NEAR).sum())
    disguised = _disguised(text, INSULTS | learned if learned else INSULTS)
    letters = max(1, sum(map(len, raw)))
    shaped = [w for w in raw if not w.islower()]
    upper = sum(sum(map(str.isupper, w)) for w in shaped)
    spaces = len(text) - sum(map(len, text.split()))
    marks = sum(text.count(c) for c in ".,;:!?'\"()-")
    others = len(text) - spaces - marks - letters
    return [
        len(insults) / n, float(len(insults)), len(own) / n, float(len(own)), disguised / n, near / n, len(second) / n,
        upper / letters, sum(1 for w in shaped if len(w) > 1 and w.isupper()) / n, text.count("!") / chars, marks / chars,
        max(0, others) / chars, len(_REPEAT.findall(text)) / n, math.log1p(len(words)),
    ]


def feature_column(docs: DataFrame, text: Column, learned: frozenset[str]) -> Column:
    """Array of doubles; the learned words are a list of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("array<double>")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = shared.value
        for texts in batches:
            yield pd.Series([features(t, words) for t in texts], dtype=object)

    return compute.asNondeterministic()(text)


@dataclass
class ToxicityModel:
    learned: frozenset[str]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    rate: float

    def score(self, docs: DataFrame, text_column: str, name: str = "score") -> DataFrame:
        """``docs`` with the calibrated probability as ``name``."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.rate))
        held = free_name(docs, "x")
        vector = array_to_vector(feature_column(docs, column(docs, text_column), self.learned))
        rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias(held), vector.alias("features"))
        scored = self.curve.transform(_raw(self.trees, rows))
        probability = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated")))
        return scored.select(f"{held}.*", probability.alias(name))


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])


def labelled_sample(labels: DataFrame, id_column: str, label_column: str, train: Column, rows: int) -> DataFrame:
    """(``id, label``) of about ``rows`` labelled ids at most, taken by a hash of the id."""
    own = labels.filter(train).select(column(labels, id_column).alias("id"), column(labels, label_column).alias("label"))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    share = min(1.0, rows / max(1, own.count()))
    return own.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))


def learned_words(sample: DataFrame) -> frozenset[str]:
    """Words of the sample (``text, label``, one row per text) that almost only toxic rows hold."""

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({w.lower() for w in _WORD.findall(t)}) for t in texts], dtype=object)

    toxic = sample.filter("label = 1").count()
    held = sample.select("label", F.explode(words("text")).alias("word")).groupBy("word")
    rated = held.agg(F.sum("label").alias("bad"), F.count("*").alias("n")).filter(
        (F.col("bad") >= max(5, LEARNED_SUPPORT * toxic)) & (F.col("bad") >= LEARNED_PURITY * F.col("n"))
    )
    return frozenset(r["word"] for r in rated.orderBy(F.desc("bad"), "word").limit(LEARNED_WORDS).collect())


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", sample_rows: int = SAMPLE_ROWS, trees: int = TREES,
) -> ToxicityModel:
    """Fit on the labelled rows that ``train``, a condition on the columns of ``labels``, lets through.

    The sampled ids are few by construction, so they are broadcast to the documents.
    """
    ids = F.broadcast(cut_lineage(labelled_sample(labels, id_column, label_column, train, sample_rows), "labelled"))
    own = docs.select(column(docs, id_column).alias("id"), F.coalesce(column(docs, text_column), F.lit("")).alias("text"))
    texts = own.join(ids, "id").groupBy("text").agg(F.max("label").cast("double").alias("label"))
    sample = cut_lineage(texts, "sample")
    total = sample.agg(F.count("*"), F.sum("label")).first()
    rate = (total[1] or 0.0) / max(1, total[0])
    if not 0 < rate < 1:
        return ToxicityModel(frozenset(), None, None, rate)
    learned = learned_words(sample)
    fold = F.crc32(F.col("text").cast("binary")) % 5
    vector = feature_column(sample, F.col("text"), learned)
    rows = cut_lineage(sample.select("label", fold.alias("fold"), vector.alias("x")), "features")
    rows = rows.select("label", "fold", array_to_vector("x").alias("features"))
    fit, held = rows.filter("fold <> 0"), rows.filter("fold = 0")
    if fit.select("label").distinct().count() < 2 or held.isEmpty():
        fit = held = rows
    model = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=trees, maxDepth=DEPTH, stepSize=STEP, subsamplingRate=0.8, seed=7,
    ).fit(fit)
    curve = IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="calibrated").fit(
        _raw(model, held).select("label", "raw")
    )
    return ToxicityModel(learned, model, curve, rate)
