"""The prefix tree of conversations against plain dictionaries."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from signaloom.llm import conversation_trie, queries
from signaloom.llm.radix_tree import Node, Node4, Node16, Node48, Node256, RadixTree

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHING = ("conv", "place", "id", "points", "node", "depth", "part", "at", "first")


def plain_order(rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]

    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out[c].append(((turn is not None, turn or 0, role, digest(role, text)), (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in out.items()}


def plain_rebuilt(rows):
    own = plain_order(rows)
    led = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - int(math.fmod(c, 100)), [])[: led[c]] + turns[led[c] :] for c, turns in own.items()}


def plain_nodes(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1]) if path else 0
    return Counter(
        (
            min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        )
        for path, who in members.items()
    )


def run(spark, rows, tmp_path):
    table = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        table = table.withColumn(name, F.lit("c"))
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    return Counter(tuple(r) for r in queries.op11_conversation_trie(spark, str(tmp_path)).collect())


def made(rnd, conversations, longest, texts):
    for c in conversations:
        for turn in range(rnd.randint(1, longest)):
            yield c, turn if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]), rnd.choice(texts)


def test_odd_conversations(spark, tmp_path):
    rows = [
        (0, 0, "user", "a"), (0, 1, None, None), (0, None, "system", "é"), (0, 1, None, None), (None, 0, "user", "a"), (7, 5, "user", "x" * 50_000),
        (7, 5, "user", "x" * 50_000), (107, 0, "user", "a"), (107, 1, "user", ""), (-3, 0, "user", "a"), (2**40, 0, "user", "a"), (300, None, None, None),
    ]
    rows += [(c, 0, "user", "a") for c in range(1, 30)]
    assert run(spark, rows, tmp_path) == plain_nodes(plain_rebuilt(rows))


def test_no_conversations(spark, tmp_path):
    assert not run(spark, [], tmp_path)


def test_made_conversations(spark, tmp_path):
    """Many share their first turns, some are longer than a block and part ways beyond one."""
    rnd = random.Random(3)
    rows = list(made(rnd, range(400), 6, ["a", "b", "é" * 40, None]))
    common = [(t, "user", f"turn {t % 7}") for t in range(200)]
    for c, length in ((500, 200), (501, 130), (502, 64), (503, 128), (504, 129), (505, 65), (600, 200), (601, 199)):
        rows += [(c, t, role, text) for t, role, text in common[:length]]
        rows += [(c, length + k, "user", f"own {c % 2}") for k in range(c % 3)]
    rows += [(c, 0, "system", "common") for c in range(1000, 1300)]
    assert run(spark, rows, tmp_path) == plain_nodes(plain_rebuilt(rows))


def test_partial_trees_add_up(spark, tmp_path):
    """Trees of five keys each give the same nodes as large ones."""
    rnd = random.Random(4)
    rows = list(made(rnd, range(300), 5, ["a", "b"]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert run(spark, rows, tmp_path) == plain_nodes(plain_rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_places_across_ranges(spark):
    """One conversation with most rows, over many ranges."""
    turns = spark.range(5000).selectExpr("if(id < 4500, 1, id) as conv_id", "5000 - id as turn", "'user' as role", "string(id) as text")
    rows = conversation_trie.numbered_turns(turns.repartition(16)).collect()
    assert sorted(r["place"] for r in rows if r["conv"] == 1) == list(range(1, 4501))
    assert all(r["place"] == 1 for r in rows if r["conv"] != 1)


@pytest.mark.parametrize("width", [1, 2])
def test_radix_tree(width):
    rnd = random.Random(width)
    for alphabet in (2, 5, 40, 60, 256):
        keys = list({bytes(rnd.randrange(alphabet) for _ in range(width * rnd.randint(0, 4))) for _ in range(400)})
        tree = RadixTree()
        for i, key in enumerate(keys):
            tree.insert(key, i)
        held, below, kinds = set(), {}, set()
        for node, _, end in tree.walk():
            count = sum(below.pop(id(c)) for c in node.children()) + (node.row is not None)
            below[id(node)] = count
            kinds.add(type(node))
            if node.row is not None:
                held.add(node.row)
                assert len(keys[node.row]) == end
            children = sum(1 for _ in node.children())
            assert children <= node.room and [b for b, _ in node.items()] == sorted({b for b, _ in node.items()})
        assert held == set(range(len(keys))) and count == len(keys)
        if alphabet == 256 and width == 1:
            assert {Node, Node256} <= kinds
        if alphabet == 40:
            assert kinds & {Node48, Node16, Node4}
