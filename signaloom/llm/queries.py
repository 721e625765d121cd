"""The registered queries of the text operators, and their check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from signaloom.session import cut_lineage, fresh_path

from . import (
    conversation_trie, decontaminate, exact_dedup, language_id, lattice_scoring, line_dedup, near_dedup, packing,
    periodic_runs, secrets, sharding, toxicity,
)
from .common import number_of, read_table, remainder
from .token_counts import BYTE_PATTERN, TOKENIZERS, byte_vocabulary, count_tokens, text_lengths

TOKEN_LIMIT = 1024


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with a separator token each, in bins of the permitted lengths."""
    lengths = text_lengths(read_table(spark, sf_dir, "documents"))
    return packing.pack(lengths, "doc_id", "n_tokens")


def _line_report(marked: DataFrame) -> DataFrame:
    gone = F.array_join(F.transform("dropped", lambda n: n.cast("string")), ",")
    return line_dedup.line_report(marked).withColumn("kept_lines", F.col("n_lines") - F.size("dropped")).withColumn(
        "dropped_sha256", sha256(gone)
    ).drop("dropped")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, exact and near copies of earlier lines, links of its lines, and which lines go; at one edit,
    which is what its check SQL says."""
    return _line_report(line_dedup.mark_lines(read_table(spark, sf_dir, "documents"), edits=1))


def op2_line_dedup_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with edits that grow with the length of a line."""
    return _line_report(line_dedup.mark_lines(read_table(spark, sf_dir, "documents")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        found = secrets.secrets_of(spark, f.read(), BYTE_PATTERN, docs["text"])
    scanned = docs.select("doc_id", found.alias("found"))
    base = F.filter("found", lambda s: s["kind"] != "random")
    return scanned.select(
        "doc_id", *[secrets.spans_of_kind("found", k).alias(f"n_{k}") for k in secrets.KINDS], sha256(secrets.span_digest(base)).alias("base_sha256"), secrets.span_digest(F.col("found")).alias("spans")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = exact_dedup.label_duplicates(read_table(spark, sf_dir, "documents"))
    return labelled.withColumnRenamed("text_digest", "text_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of a query starts empty; a job that runs again passes the path of its own."""
    cache = fresh_path(spark, "token-cache")
    counted = count_tokens(read_table(spark, sf_dir, "documents"), byte_vocabulary(), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = remainder(docs["doc_id"], 5) == 0
    model = language_id.fit_language_model(docs.filter(~held_out), id_column="doc_id")
    found = language_id.language_of(spark, model, docs["text"])
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.label_near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = remainder(docs["doc_id"], 7) == 2
    pieces = lattice_scoring.Pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    scored = lattice_scoring.score_texts(docs, pieces, ~held_out)
    return scored.withColumn("held_out", ~F.col("training")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    scanned, holders = decontaminate.scan_windows(docs.select("doc_id", "text"), benchmark)
    scanned = decontaminate.with_items(scanned.drop("text"), holders)
    return scanned.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        sha256(F.array_join("found.items", ",")).alias("items_sha256"), decontaminate.contaminated("found").alias("contaminated"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels, remainder(labels["doc_id"], 5) != 0)
    scored = model.score(docs.select("doc_id", "text"), "text")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv``) and their turns (``conv, depth, id, points``), each led by the first turns of the one whose
    number ends in two zeros."""
    first = F.expr("conv - conv % 100")
    led = number_of(F.col("conv")) % 6
    convs = cut_lineage(turns.select("conv").distinct().select("conv", first.alias("base"), led.alias("led")), "conversations")
    heads = cut_lineage(turns.filter((F.col("conv") % 100 == 0) & (F.col("place") <= 5)).withColumnRenamed("conv", "base"), "heads")
    lengths = heads.groupBy("base").agg(F.count("*").alias("n"))
    taken = convs.join(lengths, "base", "left").select("conv", "led", F.least("led", F.coalesce("n", F.lit(0))).alias("taken"))
    lead = convs.join(heads, "base").filter("place <= led").select("conv", F.col("place").alias("depth"), "id", "points")
    own = turns.join(cut_lineage(taken, "taken"), "conv").filter("place > led")
    own = own.select("conv", (F.col("place") - F.col("led") + F.col("taken")).alias("depth"), "id", "points")
    return convs.select("conv"), cut_lineage(lead.unionByName(own), "rebuilt")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered_turns(read_table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*rebuilt(turns))


def with_period(words: list[bytes], number: int) -> list[bytes]:
    """The words, every tenth number's repeated from some word on with some period."""
    g, n = number // 10, len(words)
    if number % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = periodic_runs.runs_of(docs["text"], number_of(docs["doc_id"]), change=with_period)
    return docs.select("doc_id", found.alias("found")).select(
        "doc_id", *[f"found.{c}" for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")]
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards; the map of a query starts anew, a job that runs again passes the path of its own."""
    placed = sharding.shard_records(read_table(spark, sf_dir, "documents"), fresh_path(spark, "slot-map"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "vslot", "map_version",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_line_dedup, op2_line_dedup_by_length, op3_secret_scan, op4_exact_dedup, op5_token_counts,
        op6_language_id, op7_minhash_near_dedup, op8_lm_scoring, op9_decontamination, op10_toxicity, op11_conversation_trie,
        op12_periodic_runs, op13_sharding, pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": r"""
        with occ as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as no
            from documents
        ),
        lines as (
            select line, min(row(doc_id is null, doc_id, no)) as place, length(line) as n, row_number() over () as k
            from occ where regexp_matches(line, '[^\x20\x09-\x0D]') group by line
        ),
        long as (select * from lines where n >= 20),
        halves as (
            select k, line, n, n as of_n, 'left' as side, substr(line, 1, n // 2) as part from long
            union all select k, line, n, n, 'right', substr(line, n // 2 + 1) from long
            union all select k, line, n, n - 1, 'left', substr(line, 1, (n - 1) // 2) from long
            union all select k, line, n, n - 1, 'right', substr(line, (n - 1) // 2 + 2) from long
        ),
        pairs as (
            select distinct a.k as ka, b.k as kb, a.line as one, b.line as two
            from halves a join halves b on a.of_n = b.of_n and a.side = b.side and a.part = b.part
            where a.n = a.of_n and (b.n > a.n or (b.n = a.n and a.k < b.k))
        ),
        common as (
            select ka, kb, one, two,
                   len(list_filter(range(1, length(one) + 1), lambda i: substr(one, 1, i) = substr(two, 1, i))) as ahead,
                   len(list_filter(range(1, length(one) + 1), lambda i: right(one, i) = right(two, i))) as behind
            from pairs
        ),
        linked as (select ka, kb from common where ahead + behind >= length(two) - 1),
        ends as (select ka as k, kb as o from linked union all select kb, ka from linked),
        near as (
            select e.k, count(*) as n_links, min(l.place) as earliest from ends e join lines l on l.k = e.o group by e.k
        ),
        marked as (
            select o.doc_id, o.no, l.line is not null and row(o.doc_id is null, o.doc_id, o.no) <> l.place as exact,
                   coalesce(x.earliest < l.place, false) as later, coalesce(x.n_links, 0) as n_links
            from occ o left join lines l on l.line = o.line left join near x on x.k = l.k
        )
        select doc_id, count(*) as n_lines, count(*) filter (exact) as n_exact,
               count(*) filter (later and not exact) as n_near, cast(sum(n_links) as bigint) as n_links,
               count(*) filter (not exact and not later) as kept_lines,
               sha256(coalesce(string_agg(cast(no as varchar), ',' order by no) filter (exact or later), '')) as dropped_sha256
        from marked group by doc_id
    """,
    "op4_exact_dedup": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as content from documents)
        select doc_id, min(doc_id) over (partition by content) as keep_id, count(*) over (partition by content) as group_size,
               doc_id = min(doc_id) over (partition by content) as kept, sha256(content) as text_sha256
        from d
    """,
    "op9_decontamination": r"""
        with d as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from documents
        ),
        b as (
            select item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from benchmark
        ),
        windows as (
            select distinct item_id, least(len(w), 13) as n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') as words
            from b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as t(p) where len(w) > 0
        ),
        sizes as (select distinct n from windows),
        places as (
            select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as words
            from d, sizes, unnest(range(1, len(w) - n + 2)) as t(p)
        ),
        found as (select distinct doc_id, p, n, item_id from places join windows using (n, words)),
        hits as (
            select doc_id, count(distinct q) as n_hit from found, unnest(range(p, p + n)) as t(q) group by doc_id
        ),
        items as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
            from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
        )
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join hits using (doc_id) left join items using (doc_id)
    """,
    "op11_conversation_trie": r"""
        with t as (
            select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
                   row_number() over (
                       partition by conv_id order by turn nulls first, coalesce(role, ''),
                       sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
                   ) as place
            from conversations where conv_id is not null
        ),
        own as (select c, list({'role': role, 'text': text} order by place) as turns from t group by c),
        led as (
            select c, turns, (4294967295 - list_reduce(
                list_prepend(4294967295::bigint, list_transform(string_split(cast(c as varchar), ''), lambda x: ascii(x)::bigint)),
                lambda a, b: list_reduce(
                    list_prepend(xor(a, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))
                )
            )) % 6 as h
            from own
        ),
        rebuilt as (
            select l.c, list_concat(coalesce(b.turns, [])[1 : l.h], l.turns[l.h + 1 :]) as s
            from led l left join own b on b.c = l.c - l.c % 100
        ),
        starts as (select c, s, unnest(range(0, len(s) + 1)) as d from rebuilt),
        nodes as (
            select d, s[1 : d] as path, count(*) as n, min(c) as least,
                   string_agg(cast(c as varchar), ',' order by c) filter (len(s) = d) as ends
            from starts group by all
        ),
        children as (select d - 1 as d, path[1 : d - 1] as path, count(*) as k from nodes where d > 0 group by all),
        whole as (
            select n.d, n.path, n.n, n.least, coalesce(k.k, 0) as k, sha256(coalesce(n.ends, '')) as ends,
                   case when n.d > 0 then (n.n - 1) * length(n.path[n.d].text) else 0 end as saved
            from nodes n left join children k on k.d = n.d and k.path = n.path
        ),
        ups as (select path, k, saved, unnest(range(0, d + 1)) as up from whole),
        below as (
            select up as d, path[1 : up] as path, count(*) filter (k = 0) as leaves, sum(saved) as saved from ups group by all
        )
        select w.least as conv_id, cast(w.d as bigint) as depth, p.least as parent_conv_id, w.n as n_convs, w.k as n_children,
               b.leaves as n_leaves, cast(b.saved as bigint) as saved_tokens, w.ends as ends_sha256
        from whole w join below b on b.d = w.d and b.path = w.path
        left join nodes p on p.d = w.d - 1 and p.path = w.path[1 : w.d - 1]
    """,
}
