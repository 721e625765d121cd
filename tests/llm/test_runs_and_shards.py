"""Periodic runs against a plain search, shards against their law."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from signaloom.llm import periodic_runs, queries, sharding
from signaloom.llm.periodic_runs import Run, find_runs, re_pair
from signaloom.session import fresh_path

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q):
                smaller = any(q % p == 0 and words[i : i + q - p] == words[i + p : i + q] for p in range(1, q))
                out += [] if smaller else [Run(i, length, q)]
            i = j + 1
    return sorted(out, key=lambda r: (r.start, r.period))


def repetitive(rnd):
    out, size = [], rnd.choice([30, 80, 200])
    while len(out) < size:
        unit = [b"%d" % rnd.randint(0, rnd.choice([1, 2, 3, 20])) for _ in range(rnd.randint(1, 25))]
        out += (unit * 40)[: rnd.randint(1, 7 * len(unit) + 30)]
        if rnd.random() < 0.2:
            out += out[rnd.randint(0, len(out) - 1) :][:60]
    return out


def test_runs_of_made_words():
    rnd = random.Random(5)
    for words in [repetitive(rnd) for _ in range(600)] + [[], [b"a"] * 23, [b"a"] * 24, [b"a", b"b"] * 60 + [b"c"] + [b"a", b"b"] * 60]:
        assert find_runs(words) == plain_runs(words)
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    assert find_runs(b) == plain_runs(b)


def test_grammar_spells_the_words():
    rnd = random.Random(6)
    for _ in range(60):
        ids = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 90))]
        grammar = re_pair(ids)

        def spell(s):
            if s < grammar.first:
                return [s]
            a, b = grammar.rules[s - grammar.first]
            return spell(a) + spell(b)

        assert [w for s in grammar.sequence for w in spell(s)] == ids
        assert all(ids[i : i + len(spell(grammar.first + x))] == spell(grammar.first + x) for x, i in enumerate(grammar.places))
        pairs = Counter()
        last = None
        for i, pair in enumerate(zip(grammar.sequence, grammar.sequence[1:])):
            if last != (pair, i - 1):
                pairs[pair] += 1
                last = pair, i
        assert all(n == 1 for n in pairs.values())


def test_long_periodic_texts():
    assert find_runs([b"w"] * 300_000) == [Run(0, 300_000, 1)]
    assert find_runs([b"%d" % (i % 20_000) for i in range(200_000)]) == [Run(0, 200_000, 20_000)]


def plain_row(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", text or "") if w]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for r in runs for i in range(r.start + r.period, r.start + r.length)}
    best = min(runs, key=lambda r: (-r.length / r.period, r.start, r.period), default=None)
    return (
        doc_id, len(runs), *((best.start, best.length, best.period, 1000 * best.length // best.period) if best else [None] * 4),
        hashlib.sha256("".join(f"{r.start},{r.length},{r.period}\n" for r in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def key(row):
    return tuple((v is None, v) for v in row)


def test_runs_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter(F.length("text") < 4000).collect()
    short = {r["doc_id"] for r in docs}
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, SF_DIR).collect() if r["doc_id"] in short), key=key)
    assert got == sorted((plain_row(r["doc_id"], r["text"]) for r in docs), key=key)
    assert sum(r[1] for r in got) > 0


@pytest.fixture(scope="module", params=["odd", "empty"])
def odd(request, spark, tmp_path_factory):
    rows = [
        (1, "a b " * 30, "x"), (1, "a b " * 30, "x"), (2, None, "x"), (3, "", None), (None, "y " * 40, "x"), (None, None, None),
        (4, "é ü " * 30, "x"), (5, "w " * 20000, "x"), (5, "other", "x"),
    ]
    table = spark.createDataFrame(rows if request.param == "odd" else [], "doc_id long, text string, n_runs string")
    for name in ("size", "shard", "vslot", "row", "id", "hash", "found", "slot"):
        table = table.withColumn(name, F.lit("c"))
    path = str(tmp_path_factory.mktemp(request.param))
    table.write.parquet(f"{path}/documents.parquet")
    return path, [r[:2] for r in rows] if request.param == "odd" else []


def test_runs_of_odd_tables(spark, odd):
    path, rows = odd
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, path).collect()), key=key)
    assert got == sorted((plain_row(*r) for r in rows), key=key)


def check_shards(rows, texts):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts
    )
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards_of_odd_tables(spark, odd):
    path, rows = odd
    check_shards(queries.op13_sharding(spark, path).collect(), rows)


def test_shards_hold_near_equal_bytes(spark):
    sf_dir = SF_DIR.replace("0.001", "0.1")
    rows = queries.op13_sharding(spark, sf_dir).collect()
    check_shards(rows, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 16
    assert max(load.values()) <= 1.002 * mean and min(load.values()) >= 0.998 * mean


def test_one_record_repeated_is_spread(spark):
    """A third of all rows are one record; the shards are near equal all the same."""
    docs = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, repeat('hot', 50), repeat('c', int(id % 200))) as text"
    )
    load = Counter()
    for r in sharding.shard_records(docs, fresh_path(spark, "map")).collect():
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 16
    assert max(load.values()) <= 1.01 * mean and min(load.values()) >= 0.99 * mean


def test_map_versions(spark):
    """A run on the same records moves nothing; a further shard takes slots only into itself; old versions stay."""
    path = fresh_path(spark, "map")
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    one = {r["doc_id"]: r["shard"] for r in sharding.shard_records(docs, path).collect()}
    assert sharding.stored_versions(spark, path) == [0, 1]
    two = {r["doc_id"]: r["shard"] for r in sharding.shard_records(docs, path).collect()}
    assert one == two and sharding.stored_versions(spark, path) == [0, 1]
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard_records(docs, path, shards=17).collect()}
    assert all(grown[i] in (one[i], 16) for i in one) and 16 in grown.values()
    fewer = sharding.rebalance(sharding.load_map(spark, path), {s: 1 for s in range(sharding.SLOTS)}, 10)
    counts = Counter(fewer.values())
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) < 20
    assert sharding.load_map(spark, path, 0) == sharding.first_map(sharding.SLOTS, 16)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sharding.store_map(spark, path, {0: 0}, 1)
