"""A prefix tree of conversations: every distinct sequence of first turns is a node.

A turn's id is a digest of its role and text, 16 bytes wide and read big-endian; a conversation's key is its turns' ids
one after another. Keys go into adaptive radix trees (:mod:`radix_tree`); only depths where a whole turn ends are nodes.

Keys are cut into blocks of ``BLOCK`` turns. A block is known by its anchor, a fingerprint of all turns before it, which
leads its key; so conversations of any length are rows of bounded size, and blocks meet only those with the same past.
Equal blocks are folded to one row first, however many conversations share them. Sorted by range, the rows then fill
trees of at most one Arrow batch each. A node that several trees hold comes out of each with partial sums, and these are
added up on Spark. No task ever holds a group, only a stretch of the sorted keys.

Sums over subtrees need no second pass over the tree. With a node's smallest member as its owner, the nodes that a
conversation owns are the end of its path. What lies below a node is then a sum over its members of figures that each
conversation knows of itself (the code points ahead of it, those of its own nodes, whether it owns the leaf at its end), so
the same trees add them up once the owners are known.

Turns without a conversation id belong to none and are left out. A null role or text counts as empty. Turns order by
``turn``, null first; ties by role, then by the digest of role and text, so that they may be dealt to several tasks. Repeated
turns stay repeated. Extra columns play no part. An empty table has no conversations and no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaloom.operators.timeline import carry_along, following, running
from signaloom.session import cut_lineage

from .common import column
from .radix_tree import RadixTree

#: Turns of a block, bytes of a turn id, and 32-bit parts of an anchor.
BLOCK, WIDTH, LANES = 64, 16, 4
#: Conversation ids that are joined to one text before the digest of a node's ends is fed with them.
ENDS_RANGE = 4096
ROOT = "00" * WIDTH
NODE = (
    "node binary, parent binary, depth long, points long, ahead long, n long, one long, two long, conv long, value long, inner boolean"
)


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn, as hexadecimal digits."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH)


def numbered_turns(
    turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """Written rows (``conv, place, id, points``): each turn's place in its conversation from 1, id and code points.

    Sorted by range, so a conversation of any length is spread; places are counted within a range and carried on.
    """
    role, text = column(turns, role_column), column(turns, text_column)
    rows = turns.filter(column(turns, id_column).isNotNull()).select(
        column(turns, id_column).cast("long").alias("conv"), column(turns, turn_column).alias("turn"),
        F.substring(F.coalesce(role, F.lit("")), 1, 64).alias("role"), turn_id(role, text).alias("id"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("points"),
    )
    order = ["conv", "turn", "role", "id"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    laid = cut_lineage(laid.select("conv", "id", "points", "at", F.shiftright("at", 33).alias("part")), "laid")
    parts = laid.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by conv order by part rows between unbounded preceding and 1 preceding), 0)")
    parts = parts.withColumn("before", before).select("conv", "part", "first", "before")
    place = F.col("before") + F.col("at") - F.col("first") + 1
    return cut_lineage(laid.join(parts, ["conv", "part"]).select("conv", place.alias("place"), "id", "points"), "numbered")


def _lanes(block_turn: tuple[str, str]) -> list[Column]:
    """Four numbers below 2**32 of a turn and its depth; their sums tell sequences of turns apart."""
    out = []
    for seed in range(LANES // 2):
        h = F.xxhash64(F.lit(seed), *[F.col(c) for c in block_turn])
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return out


def _anchor(sums: list[Column]) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.pmod(s, F.lit(1 << 32))), 8, "0") for s in sums]))


def conversation_blocks(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Written blocks (``conv, block, anchor, key, points, next, deeper, left``) of turns (``conv, depth, id, points``).

    ``next`` is the anchor after a full block, ``left`` the code points from the block's start to the conversation's end. A
    conversation without turns has one empty block.
    """
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("long").alias("block")
    rows = turns.select("conv", "depth", "id", "points", block, *[c.alias(f"l{k}") for k, c in enumerate(_lanes(("depth", "id")))])
    held = rows.groupBy("conv", "block").agg(
        F.sort_array(F.collect_list(F.struct("depth", "id", "points"))).alias("turns"),
        *[F.sum(f"l{k}").alias(f"l{k}") for k in range(LANES)],
    )
    empty = conversations.select("conv").join(turns.select("conv"), "conv", "left_anti").select(
        "conv", F.lit(0).cast("long").alias("block"), F.array().cast(held.schema["turns"].dataType).alias("turns"),
        *[F.lit(0).cast("long").alias(f"l{k}") for k in range(LANES)],
    )
    held = held.unionByName(empty).select(
        "conv", "block", F.unhex(F.array_join("turns.id", "")).alias("key"), F.col("turns.points").alias("points"),
        F.aggregate("turns.points", F.lit(0).cast("long"), lambda a, b: a + b).alias("whole"), *[f"l{k}" for k in range(LANES)],
    )
    held = cut_lineage(held, "blocks")
    slab = 1 << 20
    sums = {f"s{k}": running("sum", F.col(f"l{k}"), inclusive=False) for k in range(LANES)}
    walked = carry_along(held, ["conv"], ["block"], slab, deeper=following(F.lit(True)), **sums)
    walked = cut_lineage(walked, "walked")
    walked = carry_along(walked, ["conv"], ["block"], slab, reverse=True, left=running("sum", F.col("whole")))
    full = F.length("key") == BLOCK * WIDTH
    before = [F.coalesce(F.col(f"s{k}"), F.lit(0)) for k in range(LANES)]
    after = [b + F.col(f"l{k}") for k, b in enumerate(before)]
    return cut_lineage(walked.select(
        "conv", "block", _anchor(before).alias("anchor"), "key", "points", F.when(full, _anchor(after)).alias("next"),
        F.coalesce("deeper", F.lit(False)).alias("deeper"), "left",
    ), "anchored")


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:WIDTH]


def tree_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes, as :data:`NODE`, of distinct rows (anchor, key, block, points, next, deeper, n, one, two, conv, value)."""
    tree = RadixTree()
    keys = [a + k for a, k in zip(rows["anchor"], rows["key"], strict=True)]
    for i, key in enumerate(keys):
        tree.insert(key, i)
    block, points, after, deeper = (rows[c].tolist() for c in ("block", "points", "next", "deeper"))
    n, one, two, conv, value = (rows[c].tolist() for c in ("n", "one", "two", "conv", "value"))
    prefix_sums: dict[int, list[int]] = {}
    sums: dict[int, tuple] = {}
    out = []

    def named(i: int, depth: int) -> bytes | None:
        m = depth // WIDTH - 1
        if m <= 0:
            return keys[i][:WIDTH] if m == 0 else None
        return after[i] if m == BLOCK else _digest(keys[i][:depth])

    for node, start, end in tree.walk():
        i = node.row
        parts = [sums.pop(id(child)) for child in node.children()]
        if i is not None:
            parts.append((n[i], one[i], two[i], (conv[i], value[i]), i))
        if not parts:
            continue  # the root of an empty tree
        total = (*(sum(p[k] for p in parts) for k in range(3)), min(p[3] for p in parts), parts[0][4])
        sums[id(node)] = total
        some = total[4]
        branches = len(parts) > (i is not None)
        for depth in range((start // WIDTH + 1) * WIDTH, end + 1, WIDTH):
            m = depth // WIDTH - 1
            if m == 0 and block[some]:
                continue  # the block before has this node
            inner = depth < end or branches or bool(deeper[i])
            if some not in prefix_sums:
                at, ahead = 0, [0]
                for p in points[some]:
                    at += p
                    ahead.append(at)
                prefix_sums[some] = ahead
            ahead = prefix_sums[some]
            own, before = (ahead[m] - ahead[m - 1], ahead[m - 1]) if m else (0, 0)
            out.append((
                named(some, depth), named(some, depth - WIDTH) if m else None, block[some] * BLOCK + m, own, before,
                *total[:3], *total[3], inner,
            ))
    return pd.DataFrame(out, columns=[f.split()[0] for f in NODE.split(", ")])


def trie(blocks: DataFrame, one: Column, two: Column) -> DataFrame:
    """Every node once, as :data:`NODE`: members, the sums of ``one`` and ``two`` over them, the smallest, and its ``one``."""
    named = blocks.select("anchor", "key", "block", "points", "next", "deeper", "conv", one.alias("one"), two.alias("two"))
    folded = named.groupBy("anchor", "key").agg(
        F.first("block").alias("block"), F.first("points").alias("points"), F.first("next").alias("next"),
        F.max("deeper").alias("deeper"), F.count("*").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"),
        F.min(F.struct("conv", F.col("one").alias("value"))).alias("least"),
    ).select("anchor", "key", "block", "points", "next", "deeper", "n", "one", "two", "least.*")
    laid = folded.repartitionByRange("anchor", "key").sortWithinPartitions("anchor", "key")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield tree_nodes(rows)

    parts = cut_lineage(laid.mapInPandas(grow, NODE), "parts")
    merged = parts.groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("parent", "depth", "points", "ahead")],
        *[F.sum(c).alias(c) for c in ("n", "one", "two")], F.min(F.struct("conv", "value")).alias("least"), F.max("inner").alias("inner"),
    )
    return merged.select("node", "parent", "depth", "points", "ahead", "n", "one", "two", "least.*", "inner")


def end_digests(blocks: DataFrame) -> DataFrame:
    """(``node, ends_sha256``) of the nodes where conversations end: the digest of their ids, rising, comma-joined.

    A digest is fed in order, so the ids of one node pass through one task; they come there as joined texts of ranges of ids, a
    few at a time, and are never held together.
    """
    size = F.length("key")
    last = F.when(size == 0, F.col("anchor")).when(size == BLOCK * WIDTH, F.col("next")).otherwise(
        F.unhex(F.substring(F.sha2(F.concat("anchor", "key"), 256), 1, 2 * WIDTH))
    )
    ends = blocks.filter(~F.col("deeper")).select(last.alias("node"), "conv")
    ranges = ends.groupBy("node", F.floor(F.col("conv") / ENDS_RANGE).alias("range")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    joined = ranges.select("node", "range", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))
    laid = cut_lineage(joined, "ends").repartition("node").sortWithinPartitions("node", "range")

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for rows in batches:
            out = []
            for here, ids in zip(rows["node"], rows["ids"], strict=True):
                if here == node:
                    digest.update(b",")
                else:
                    if digest:
                        out.append((node, digest.hexdigest()))
                    node, digest = here, hashlib.sha256()
                digest.update(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if digest:
            yield pd.DataFrame([(node, digest.hexdigest())], columns=["node", "ends_sha256"])

    return laid.mapInPandas(digested, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of conversations (``conv``) with turns (``conv, depth, id, points``; depths from 1 without gaps).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    blocks = conversation_blocks(conversations, turns)
    none = F.lit(0).cast("long")
    nodes = cut_lineage(trie(blocks, F.col("left"), none), "nodes")
    owned = nodes.groupBy("conv").agg(
        F.sum("points").alias("owned"), F.max(F.when(F.col("inner"), 0).otherwise(1)).cast("long").alias("leaf")
    )
    known = blocks.join(cut_lineage(owned, "owned"), "conv", "left")
    below = trie(known, F.coalesce("owned", none), F.coalesce("leaf", none)).select(
        "node", F.col("one").alias("distinct"), F.col("value").alias("of_owner"), F.col("two").alias("n_leaves")
    )
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    all_points = F.col("one") - F.col("n") * F.col("ahead")
    distinct_points = F.col("distinct") - F.col("of_owner") + F.col("value") - F.col("ahead")
    tables = [cut_lineage(below, "below"), cut_lineage(children, "children"), cut_lineage(end_digests(blocks), "digests")]
    whole = reduce(lambda a, b: a.join(b, "node", "left"), tables, nodes).join(parents, "parent", "left")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.coalesce("n_children", none).alias("n_children"), "n_leaves", (all_points - distinct_points).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
