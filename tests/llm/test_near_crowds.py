"""Near duplicates where many texts resemble each other without being linked."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from signaloom.llm import near_dedup


def crowd(rnd, size, least, most):
    """Texts edited from one, so that two of them share 0.6 to 0.9 of their shingles, and some pairs nearer still."""
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rnd.choice(vocabulary) for _ in range(300)]
    out = {}
    for c in range(size):
        words = list(out[rnd.choice(list(out))].split()) if out and rnd.random() < 0.3 else list(base)
        for _ in range(rnd.randint(least, most)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        out[c] = " ".join(words)
    return out


def exact_links(rows, threshold=0.8):
    """All linked pairs, from the matrix of which text holds which occurrence of a shingle."""
    ids, held = list(rows), []
    for text in rows.values():
        words, seen = near_dedup.shingle_words(text), Counter()
        held.append(set())
        for k in range(max(1, len(words) - 4)):
            shingle = tuple(words[k : k + 5])
            held[-1].add((shingle, seen[shingle]))
            seen[shingle] += 1
    often = {x: k for k, x in enumerate(x for x, n in Counter(x for h in held for x in h).items() if n > 1)}
    matrix = np.zeros((len(ids), len(often)), np.float32)
    for i, h in enumerate(held):
        matrix[i, [often[x] for x in h if x in often]] = 1
    common = matrix @ matrix.T
    sizes = np.array([len(h) for h in held])
    alike = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    return [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True)]


def classes(rows, links):
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in rows}


@pytest.mark.parametrize(("size", "small"), [(2000, near_dedup.SMALL), (700, 40)])
def test_recall_in_a_crowd(spark, monkeypatch, size, small):
    """Texts at similarities around the threshold, finished in their bands and through narrower buckets: no false link, and
    nearly all links found."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows = crowd(random.Random(8), size, 5, 12)
    links = exact_links(rows)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.label_near_duplicates(frame).collect()}
    want = classes(rows, links)
    found = sum(got[a] == got[b] for a, b in links) / len(links)
    print(f"links {len(links)}, found {found:.4f}, classes {len(set(want.values()))} / {len(set(got.values()))}")
    members = defaultdict(set)
    for i, c in got.items():
        members[c].add(want[i])
    assert all(len(w) == 1 for w in members.values())  # a class never joins what is not linked
    assert found >= 0.97


def test_large_buckets_are_finished(spark, monkeypatch):
    """A link whose texts share one band of two, which holds nearly everyone, is found; tiles of five members meet each other."""
    for name, value in (("SMALL", 4), ("WIDE", 1), ("ROUNDS", 2), ("TILE", 5)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = crowd(random.Random(11), 150, 5, 12)
    signed = near_dedup.sign(pd.Series(list(rows.values())), near_dedup.WORDS, 2, 1, True, near_dedup.WordHasher())
    bands = dict(zip(rows, map(set, signed["bands"]), strict=True))
    links = [(a, b) for a, b in exact_links(rows) if bands[a] & bands[b]]
    assert sum(len(bands[a] & bands[b]) == 1 for a, b in links) > 3
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.label_near_duplicates(frame, bands=2, rows=1).collect()}
    assert got == classes(rows, links)


def test_few_steps(spark, monkeypatch):
    """Classes are worked out from the links of the leaders, then only from new links, and not at all where there are none."""
    asked, once = [], near_dedup.component_labels
    monkeypatch.setattr(near_dedup, "component_labels", lambda edges: asked.append(edges.count()) or once(edges))
    for name, value in (("SMALL", 40), ("WIDE", 2), ("ROUNDS", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = crowd(random.Random(3), 150, 5, 12)
    links = exact_links(rows)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.label_near_duplicates(frame).collect()}
    assert got == classes(rows, links)
    assert all(asked) and sum(asked) <= len(links)  # each link is taken once


@pytest.mark.parametrize(("tile", "batch"), [(7, 3), (1000, 64), (7, 10_000)])
def test_pairs_of_tiles(spark, monkeypatch, tile, batch):
    """Pairs of whole buckets are those that plain loops find, whatever the tiles and the batches of rows."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rnd, full = random.Random(4), np.random.default_rng(4)
        planes, fine = (full.integers(-(2**63), 2**63, (3, near_dedup.PLANES * w)) for w in (1, 12))
        rows = []
        for i in range(90):
            base = rnd.randrange(3)
            signs, share = [], rnd.uniform(0.05, 0.2)
            for x in (planes, fine):
                mine = x[base].copy()
                words = len(mine) // near_dedup.PLANES
                mine[:words] ^= np.packbits(full.random(words * 64) < share).view(np.int64)
                signs.append(mine.tolist())
            bands = [rnd.choice([-5, 5]), rnd.choice([-8, 8])]
            rows += [(key, i, rnd.choice([i, i % 9]), *signs, bands) for key in bands]
        frame = spark.createDataFrame(rows, "key long, rep long, label long, planes array<long>, fine array<long>, bands array<long>")
        buckets = frame.groupBy("key").count().withColumnRenamed("count", "n")
        got = sorted(map(tuple, near_dedup._pairs_within(frame, buckets, 60, 0.8, one_band=True).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def differ(x, y):
        words = len(x) // near_dedup.PLANES
        bits = [0] * words
        for n, (a, b) in enumerate(zip(x, y, strict=True)):
            bits[n % words] |= (a ^ b) & (2**64 - 1)
        return sum(b.bit_count() for b in bits)

    want, met = set(), 0
    for key, i, label, p, f, bands in rows:
        for other, j, their, q, g, theirs in rows:
            if key == other and i < j and label != their and key == min(set(bands) & set(theirs)):
                met += 1
                close = differ(p, q) <= near_dedup.most_differing(60, 0.8) and differ(f, g) <= near_dedup.most_differing(near_dedup.FINE, 0.8)
                want |= {(i, j)} if close else set()
    assert 0 < len(want) < met and got == sorted(want)


@pytest.mark.parametrize("weighted", [True, False])
def test_weights_count(spark, weighted):
    """A text and ten times the text share all shingles, but not their weights."""
    once = " ".join(f"w{k}" for k in range(60))
    frame = spark.createDataFrame([(1, once), (2, " ".join([once] * 10)), (3, once + " and")], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["kept"]) for r in near_dedup.label_near_duplicates(frame, weighted=weighted).collect()}
    many = not weighted and near_dedup.similarity(once, " ".join([once] * 10), weighted=False) >= 0.8
    assert got == ({1: (1, 3, True), 2: (1, 3, False), 3: (1, 3, False)} if many else {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False)})
