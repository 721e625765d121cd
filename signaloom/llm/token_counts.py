"""Token counts through a digest cache: only contents that were never counted are encoded.

The cache is a Parquet table (content digest, tokenizer digest, count) that only grows. Documents are joined to it by the
SHA-256 of their content; contents without a count are made distinct, encoded, and appended; a second join reads every
count back. The tokenizer digest covers the vocabulary file and the library's version, so counts of another tokenizer are
never used. Content is normalised only where that cannot change a count: null becomes the empty text (0 tokens).

Texts are counted whole. A cache has one writer at a time. Repeated rows get the same count each, an empty table none.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signaloom.session import cut_lineage

from .common import column

#: Folder of the tokenizer files; only the driver reads it.
TOKENIZERS = os.environ.get("TOKENIZER_DIR") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
#: Pre-tokenisation pattern of the byte-level vocabulary, a fixed value.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = "content_digest string, tokenizer_digest string, n_tokens long"
#: Beyond these code points the two libraries may know different versions of Unicode.
_FOREIGN = re.compile("[^\x00-ɏ]")
_LONG_BLANK = re.compile(r"\s{1000}")
LONG_WORD = 1000


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary: the file of the tokenizers library, and the same as ranks with their pattern."""

    definition: str
    ranks: bytes = b""
    pattern: str = ""

    @classmethod
    def load(cls, definition_path: str, ranks_path: str | None = None, pattern: str = "") -> Vocabulary:
        """Read on the driver and sent to the tasks: a vocabulary file has a fixed size of a few MB."""
        with open(definition_path, encoding="utf-8") as f:
            definition = f.read()
        ranks = b""
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = f.read()
        return cls(definition, ranks, pattern)

    @property
    def digest(self) -> str:
        import tokenizers

        return hashlib.sha256(f"tokenizers {tokenizers.__version__}\n{self.definition}".encode()).hexdigest()


def rank_encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


class Counter:
    """Counts as the tokenizers library gives them, without added special tokens.

    Where ranks are given, ordinary texts go through the quicker rank encoder, which gives the same tokens for them; texts
    that hold the string of a special token, a character beyond Latin script or a run of 1,000 characters without (or of)
    white space go through the library itself.
    """

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(vocabulary.definition)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = rank_encoding(vocabulary.ranks, vocabulary.pattern) if vocabulary.ranks else None
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def ordinary(self, text: str) -> bool:
        return not (
            self.fast is None or _FOREIGN.search(text) or any(s in text for s in self.special)
            or max(map(len, text.split()), default=0) >= LONG_WORD or _LONG_BLANK.search(text)
        )

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.ordinary(text):
            return len(self.fast.encode_ordinary(text))
        return len(self.slow.encode_batch_fast([text], add_special_tokens=False)[0])


@lru_cache(maxsize=1)
def _counter_of(vocabulary: Vocabulary) -> Counter:
    return Counter(vocabulary)


def counting_udf(spark, vocabulary: Vocabulary):
    """A function column text -> number of tokens, without a cache."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _counter_of(shared.value)
        for texts in batches:
            yield pd.Series([own.count(t) for t in texts], dtype="int64")

    return count.asNondeterministic()


def byte_vocabulary() -> Vocabulary:
    return Vocabulary.load(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_PATTERN)


def text_lengths(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ``n_tokens``) of every row's whole text and a separator token, written once."""
    count = counting_udf(docs.sparkSession, byte_vocabulary())
    counted = docs.select(column(docs, id_column).alias(id_column), (count(column(docs, text_column)) + 1).alias("n_tokens"))
    return cut_lineage(counted, "lengths")


def open_cache(spark, path: str) -> DataFrame:
    """The cache table at ``path``, which is created empty where there is none."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def count_tokens(
    docs: DataFrame, vocabulary: Vocabulary, cache_path: str, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, ``n_bytes``, ``n_tokens``) of every row, after the missing counts were appended to the cache.

    A digest that two writers added at once, or a task that was run again, is in the cache more than once and counts once.
    """
    spark = docs.sparkSession
    text = F.coalesce(column(docs, text_column), F.lit(""))
    rows = docs.select(
        column(docs, id_column).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("content_digest"), text.alias("text"),
    )
    own = F.col("tokenizer_digest") == vocabulary.digest
    known = open_cache(spark, cache_path).filter(own).select("content_digest")
    contents = rows.groupBy("content_digest").agg(F.first("text").alias("text"))
    count = counting_udf(spark, vocabulary)
    fresh = contents.join(known, "content_digest", "left_anti").select(
        "content_digest", F.lit(vocabulary.digest).alias("tokenizer_digest"), count("text").alias("n_tokens")
    )
    fresh.write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE).parquet(cache_path).filter(own).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))
    return rows.select("id", "n_bytes", "content_digest").join(counts, "content_digest").select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens"
    )
