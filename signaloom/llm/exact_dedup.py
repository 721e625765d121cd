"""Exact duplicates by skew-safe combining: local, then salted, then global, each on the full text.

Texts are equal when they are identical after every run of white space (space, tab to carriage return) is replaced by
one space. A null text counts as empty. Of equal texts the smallest id stays, a null id only where there is no other.
Rows that repeat both text and id are one document: all of them are marked as kept, and :func:`drop_duplicates` returns
one of them. Other columns are never looked at, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaloom.session import cut_lineage

from .common import column, free_name

SALTS = 16
WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def distinct_contents(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(``dg, content, keep, n``) of rows (``dg, content, id``); contents are compared in full, not by digest.

    Each task folds its own copies before anything moves, the tasks' rows of one content meet in ``salts`` groups, and
    one row per group goes on to the global merge. No task gets more rows of a content than there are tasks.
    """
    local = rows.withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("dg", "content", "salt").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return salted.groupBy("dg", "content").agg(F.min("id").alias("keep"), F.sum("n").alias("n"))


def _rows(docs: DataFrame, id_column: str, text_column: str, digest_of: Callable[[Column], Column]) -> DataFrame:
    content = normalised(column(docs, text_column))
    return docs.select(column(docs, id_column).alias("id"), digest_of(content).alias("dg"), content.alias("content"))


def _winners(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The distinct contents, and the columns by which a row finds its content.

    The merge has compared full texts, so where it found one content for every digest, rows can find theirs by digest
    and no text has to move again. If two contents do share a digest, rows are matched by text as well.
    """
    contents = distinct_contents(rows)
    heads = cut_lineage(contents.select("dg", "keep", "n"), "contents")
    if heads.groupBy("dg").count().filter("count > 1").isEmpty():
        return heads, ["dg"]
    return contents, ["dg", "content"]


def label_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest_of: Callable[[Column], Column] = digest,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and the digest as ``text_digest``.

    Both sides of the last join are plain scans, so Spark can split the task of a content with very many copies.
    """
    rows = _rows(docs, id_column, text_column, digest_of)
    winners, on = _winners(rows)
    found = rows.select("id", *on).join(winners.select(*on, "keep", "n"), on)
    return found.select(
        F.col("id").alias(id_column), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("dg").alias("text_digest"),
    )


def drop_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest_of: Callable[[Column], Column] = digest,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows look for their content by digest and id together, so the copies of one text do not meet in one task.
    """
    winners, on = _winners(_rows(docs, id_column, text_column, digest_of))
    dg, content = free_name(docs, "dg"), free_name(docs, "content")
    own = normalised(column(docs, text_column))
    marked = docs.withColumns({dg: digest_of(own)} | ({content: own} if "content" in on else {}))
    names = {"dg": dg, "content": content}
    single = marked.dropDuplicates([names[k] for k in on] + [id_column])
    kept = winners.select(*[F.col(k).alias(f"w_{k}") for k in on], F.col("keep").alias("w_keep"))
    if set(kept.columns) & set(single.columns):
        kept = kept.toDF(*[free_name(single, c) for c in kept.columns])
    same = column(single, id_column).eqNullSafe(kept[kept.columns[-1]])
    for k, other in zip(on, kept.columns, strict=False):
        same = same & (single[names[k]] == kept[other])
    return single.join(kept, same, "left_semi").select(*[column(single, c) for c in docs.columns])
