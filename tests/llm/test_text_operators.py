"""The text operators against plain loops, on the smallest tables and on hand-made rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import check_queries
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signaloom.llm import (
    common, dart_minhash, decontaminate, exact_dedup, language_id, lattice_scoring, line_dedup, near_dedup, packing, queries,
    secrets, token_counts, toxicity,
)
from signaloom.session import fresh_path

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, dg string, content string, sha string, found string"
ODD = [
    (1, "one two three four five six", "en"), (1, "one two three four five six", "en"), (2, None, None), (3, "", "en"),
    (4, "!!! ...", None), (None, "one  two three\tfour five six", "en"), (5, "word " * 5000, "en"),
    (6, "you idiot " + "é" * 3000, "fr"), (7, "x" * 30000, "en"), (8, "a\n\n  \nb\na", "en"),
]
NAMES = ["op%d" % n for n in range(1, 11)] + ["pipeline"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, "s", 1, "c", "c", "c", "c", "c") for i, t, lang in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module", params=["odd", "empty"])
def odd_dir(request, spark, odd, tmp_path_factory):
    """Tables with nulls, repeats, long texts and clashing columns, and tables without rows."""
    path = str(tmp_path_factory.mktemp(request.param))
    empty = request.param == "empty"
    (odd.limit(0) if empty else odd).write.parquet(f"{path}/documents.parquet")
    bench = spark.createDataFrame([(1, "one two three four five six", "x"), (2, None, "x"), (None, "a b", "x")], "item_id long, text string, found string")
    (bench.limit(0) if empty else bench).write.parquet(f"{path}/benchmark.parquet")
    labels = spark.createDataFrame([(6, 1, 1), (1, 0, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    (labels.limit(0) if empty else labels).write.parquet(f"{path}/labels.parquet")
    return path, 0 if empty else len(ODD)


def named(prefix):
    return next(q for n, q in queries.QUERIES.items() if n == prefix or n.startswith(prefix + "_"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_check(spark, name):
    assert check_queries.compare(queries.QUERIES[name](spark, SF_DIR), check_queries.connect(SF_DIR), queries.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables(spark, odd_dir, name):
    path, rows = odd_dir
    got = named(name)(spark, path).collect()
    if name in ("op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"):
        assert len(got) == rows
    if not rows:
        assert not got


def test_exact_dedup_compares_whole_texts(docs, odd):
    """With a digest of few values, equal digests alone merge nothing."""
    def few(content):
        return F.crc32(content.cast("binary")) % 3

    want = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.label_duplicates(docs).collect()}
    got = exact_dedup.label_duplicates(docs, digest_of=few)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got.collect()} == want
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5, 6, 7, 8]


def base_reference(text):
    spans = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        spans += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[2]) >= 6 else []
    spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(s for _, _, s in sorted(spans))


def test_secrets(spark, texts):
    for r in queries.op3_secret_scan(spark, SF_DIR).collect():
        assert r["base_sha256"] == hashlib.sha256(base_reference(texts[r["doc_id"]] or "").encode()).hexdigest()
    vocabulary = token_counts.byte_vocabulary()
    scanner = secrets.SecretScanner(vocabulary.ranks, vocabulary.pattern)
    key = "zK8qX2vN7pL4wR9tB3mY"
    assert [s[3] for s in scanner.spans(f"é the key {key}, then")] == [key]
    for known in ("d41d8cd98f00b204e9800998ecf8427e", "user_profile_settings_2023", "123e4567-e89b-12d3-a456-426614174000", "9" * 30):
        assert not scanner.random_spans(f"x {known} y")
    assert [s[0] for s in scanner.spans(f"password = {key}")] == ["assign"]


def test_random_keys_behind_names_and_of_letters():
    vocabulary = token_counts.byte_vocabulary()
    scanner = secrets.SecretScanner(vocabulary.ranks, vocabulary.pattern)
    keys = ["zK8qX2vN7pL4wR9tB3mYc6Hd", "QxZkWvTbNmLpRsYhGfJdQcXw", "QxZkWvTbNmLpRsYhGfJd42"]
    for key in keys:
        for before, after in (
            ("", ""), ("api.example.com/v1/users/profile/callback/", ""), ("/home/user/project/config/", "/index.html"),
            ("Authorization=", ""), ("d41d8cd98f00b204e9800998ecf8427e/", ""),
        ):
            text = f"é {before}{key}{after}, then"
            assert [s[1:] for s in scanner.random_spans(text)] == [(2 + len(before), 2 + len(before + key), key)], text
    two = f"{keys[0]}/users/profile/settings/callback/documents/{keys[1]}"
    assert [s[3] for s in scanner.random_spans(two)] == keys[:2]
    for plain in (
        "api.example.com/v1/users/profile/callback/index.html", "1.2.3.4.5.6.7.8.9.10.11.12", "2024-11-30/2024-12-01/report_v2.pdf",
        "internationalization-localization", "org.apache.spark.sql.catalyst.expressions", "-" * 40, "x" * 9000,
    ):
        assert not scanner.random_spans(plain)
    rnd = random.Random(4)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = ["".join(rnd.choice(signs) for _ in range(24)) for _ in range(300)]
    assert sum(any(k in s[3] for s in scanner.random_spans(f"www.example.com/static/{k}")) for k in drawn) > 285


def test_token_counts_and_cache(spark, docs, texts):
    vocabulary = token_counts.byte_vocabulary()
    counter = token_counts.Counter(vocabulary)
    for text in [*texts.values(), "a <|endoftext|> b", "x" * 3000, " " * 3000, "中文 текст"]:
        assert counter.count(text) == (len(counter.slow.encode(text, add_special_tokens=False).ids) if text else 0)
    for c in range(1, 0x250):  # the two libraries agree on every character that the quick one is given
        for text in (f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}", f"{chr(c)} x"):
            assert counter.count(text) == len(counter.slow.encode(text, add_special_tokens=False).ids), hex(c)
    cache = fresh_path(spark, "cache")
    first = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, vocabulary, cache).collect()}
    assert first == {i: counter.count(t) for i, t in texts.items()}
    entries = spark.read.parquet(cache).count()
    assert entries == len(set(texts.values()))
    token_counts.count_tokens(docs, vocabulary, cache).collect()
    assert spark.read.parquet(cache).count() == entries


def test_language_pieces_and_accuracy(spark, docs, monkeypatch):
    text = "Der schöne Text, 12 mal.  " * 40
    whole = np.sort(np.concatenate(list(language_id.ngram_buckets(text))))
    monkeypatch.setattr(language_id, "PIECE", 17)
    assert (np.sort(np.concatenate(list(language_id.ngram_buckets(text)))) == whole).all()
    got = queries.op6_language_id(spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9


def test_copies_of_a_text_are_drawn_apart(spark, monkeypatch):
    """A text that makes most rows of a language is fitted on as often as its share says, not always or never."""
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"),
        F.when(F.col("id") < 3000, "the same text again").otherwise(F.concat(F.lit("a text of number "), "id")).alias("text"),
    )
    drawn, of = [], language_id.drawn_rows
    monkeypatch.setattr(language_id, "drawn_rows", lambda *a: drawn.append(of(*a)) or drawn[-1])
    language_id.fit_language_model(rows, rows_per_language=400, id_column="doc_id")
    copies = drawn[0].filter("text = 'the same text again'").count()
    assert 200 < copies < 400 and 300 < drawn[0].count() < 500


def test_language_stage_rejects_texts_of_no_language(spark, docs):
    rnd = random.Random(8)
    signs = {
        "latin": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыьэюя",
        "cjk": "".join(map(chr, range(0x4E00, 0x5600))), "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    }
    junk = ["".join(rnd.choice(letters) for _ in range(n)) for letters in signs.values() for n in (20, 100, 500, 2000) for _ in range(10)]
    junk += ["".join(rnd.choice("0123456789abcdef") for _ in range(n)) for n in (100, 500, 2000) for _ in range(10)]
    junk += ["Это обычный русский текст о погоде и о дороге домой.", "东京的天气今天很好，我们去公园散步。"]
    rows = spark.createDataFrame([(10**9 + 5 * k, t) for k, t in enumerate(junk)], "doc_id long, text string")
    both = docs.unionByName(rows, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, both, SF_DIR).select("doc_id").collect()}
    clean = {r["doc_id"] for r in docs.filter(F.col("text").rlike("\\p{L}")).select("doc_id").collect()}
    assert kept == clean


def test_dart_signatures_estimate_weighted_jaccard():
    rng, k = np.random.default_rng(1), 2048
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    one, two = rng.integers(0, 4, 300), rng.integers(0, 4, 300)
    owners = np.repeat([0, 1], 300)
    weights = np.concatenate([one, two]).astype(float)
    keep = weights > 0
    signed = dart_minhash.signatures(np.tile(elements, 2)[keep], weights[keep], owners[keep], 2, k)
    truth = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((signed[0] == signed[1]).mean() - truth) < 5 * math.sqrt(truth * (1 - truth) / k)
    alone = dart_minhash.signatures(elements[one > 0], one[one > 0].astype(float), np.zeros((one > 0).sum(), int), 1, k)
    assert (alone[0] == signed[0]).all()


def test_near_dedup_against_all_pairs(spark, texts):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = {i: t for i, t in list(texts.items())[:60]}
    for g in range(4):
        base = [rnd.choice(words) for _ in range(120)]
        for c in range(12):
            edited = list(base)
            for _ in range(rnd.randint(0, 5)):
                edited[rnd.randrange(120)] = rnd.choice(words)
            rows[1000 + 20 * g + c] = " ".join(edited)
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if near_dedup.similarity(rows[a], rows[b]) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.label_near_duplicates(frame).collect()}
    assert got == {i: root(i) for i in rows}
    kept = near_dedup.drop_near_duplicates(frame.union(frame))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(i) for i in rows})


def brute_log_probability(word, ids, log_p):
    text = lattice_scoring.MARK + word
    if not text:
        return 1.0

    def total(rest):
        return 1.0 if not rest else sum(math.exp(log_p[ids[rest[:n]]]) * total(rest[n:]) for n in range(1, len(rest) + 1) if rest[:n] in ids)

    return math.log(total(text))


def test_lattice_sums_all_segmentations():
    pieces = lattice_scoring.Pieces.load(f"{token_counts.TOKENIZERS}/piece_bpe_32k.model")
    lattice = lattice_scoring.Lattice(pieces)
    ids = {t: k for k, t in enumerate(pieces.texts) if t}
    for word in ("the", "thering", "énoncés", "in"):
        assert lattice.log_probability(word) == pytest.approx(brute_log_probability(word, ids, lattice.log_p))
    counts = [0.0] * len(pieces.texts)
    lattice.add_expected("thering", 3, counts)
    assert sum(n * len(pieces.texts[k]) for k, n in enumerate(counts)) == pytest.approx(3 * 8)
    assert lattice.log_probability("\U0001f9ff\x00") > -math.inf


def test_lm_base_scores(spark, texts):
    split = {i: re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in train for w in split[i])
    counts[None] = len(train)
    total, distinct = counts.total(), len(counts)
    for head in (lattice_scoring.HEAD_WORDS, 5):
        lattice_scoring_head = lattice_scoring.score_texts
        docs = common.read_table(spark, SF_DIR, "documents")
        pieces = lattice_scoring.Pieces.load(f"{token_counts.TOKENIZERS}/piece_bpe_32k.model")
        got = lattice_scoring_head(docs, pieces, common.remainder(docs["doc_id"], 7) != 2, head_words=head).collect()
        assert len(got) == len(texts)
        for r in got:
            tokens = [*split[r["doc_id"]], None]
            assert (r["n_tokens"], r["train_tokens"]) == (len(tokens), total)
            assert r["n_known"] == sum(counts[t] > 0 for t in tokens)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens))
            assert -math.inf < r["score"] < 0


def test_decontamination_in_blocks(spark, docs):
    bench = common.read_table(spark, SF_DIR, "benchmark")
    one = decontaminate.scan_documents(docs.select("doc_id", "text"), bench).collect()
    more = decontaminate.scan_documents(docs.select("doc_id", "text"), bench, block_windows=300).collect()
    assert sorted(one, key=lambda r: r["doc_id"]) == sorted(more, key=lambda r: r["doc_id"])
    for r in one:
        for span in r["found"]["spans"]:
            assert common.words_of(r["text"][span["start"] : span["stop"]])


def cheapest(sizes, lengths):
    """The least cost of any packing, by trying every bin for every piece."""
    best = [math.inf]

    def place(k, bins):
        if k == len(sizes):
            best[0] = min(best[0], sum(packing.cost(min(c for c in lengths if c >= b)) for b in bins))
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= max(lengths):
                place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


def naive_best_fit(sizes, lengths):
    bins, placed, rest = [], [], sum(sizes)
    for n in sizes:
        rest -= n
        fits = [(free, -k) for k, (free, _) in enumerate(bins) if free >= n]
        if fits:
            k = -min(fits)[1]
        else:
            k = len(bins)
            bins.append((packing.opening(n, rest, lengths), 0))
        free, used = bins[k]
        placed.append((k, used))
        bins[k] = (free - n, used + n)
    return placed, [used for _, used in bins]


def test_packing_against_all_packings():
    rnd = random.Random(9)
    for _ in range(40):
        sizes = sorted((rnd.randint(1, 4096) for _ in range(rnd.randint(1, 7))), reverse=True)
        placed, final = packing.pack_jointly(sizes)
        got, least = sum(map(packing.cost, final)), cheapest(sizes, packing.LENGTHS)
        assert least - 1e-6 <= got <= 1.35 * least
        tried = [packing.best_fit(sizes, c) for c in ((4096,), (1024, 4096), (512, 2048, 4096))]
        for (mine, used), lengths in zip(tried, ((4096,), (1024, 4096), (512, 2048, 4096)), strict=True):
            other, plain = naive_best_fit(sizes, lengths)
            assert sorted(used) == sorted(plain) and len(mine) == len(other)


def test_packing_of_odd_lengths(spark):
    rows = [(1, 10), (2, None), (3, 0), (4, 9000), (None, 5), (1, 10)]
    frame = spark.createDataFrame(rows, "start long, n long")
    got = packing.pack(frame, "start", "n").collect()
    assert len(got) == 8 and sum(r["length"] for r in got) == 9025
    assert [(r["bin"], r["length"], r["start_"]) for r in got if r["start"] in (2, 3)] == [(None, 0, 0)] * 2


def test_packing_is_whole_and_tight(spark):
    rnd = random.Random(5)
    sizes = sorted((rnd.randint(1, 4096) for _ in range(400)), reverse=True)
    placed, final = packing.pack_jointly(sizes)
    used = defaultdict(list)
    for (b, offset), n in zip(placed, sizes, strict=True):
        used[b].append((offset, offset + n))
    for b, spans in used.items():
        spans.sort()
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert final[b] == min(c for c in packing.LENGTHS if c >= spans[-1][1])
    assert sum(map(packing.cost, final)) <= min(
        sum(packing.cost(min(c for c in packing.LENGTHS if c >= u)) for u in packing.best_fit(sizes, [4096])[1]), 10**12
    )
    table = spark.createDataFrame([(1, 0), (2, 9000), (2, 10), (None, 5)], "doc_id long, n long")
    rows = packing.pack(table, "doc_id", "n", shard_pieces=2).collect()
    assert Counter((r["doc_id"], r["length"], r["bin"] is None) for r in rows) == {
        (1, 0, True): 1, (2, 4096, False): 2, (2, 808, False): 1, (2, 10, False): 1, (None, 5, False): 1,
    }


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_join_finds_every_pair(spark):
    rnd = random.Random(9)
    lines = set()
    for _ in range(12):
        base = "".join(rnd.choice("abé") for _ in range(rnd.randint(6, 12)))
        for _ in range(6):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(text) + 1)
                text[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "é"])
            lines.add("".join(text))
    lines = sorted(x for x in lines if len(x) >= 4)
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    for edits in (1, 2):
        want = sum(distance(a, b) <= edits for n, a in enumerate(lines) for b in lines[n + 1 :])
        assert line_dedup.line_links(frame, edits=edits, least=4).count() == want
    two = spark.createDataFrame([(1, "same line of twenty characters\nx\n\nx"), (2, "same line of twenty charactery\nx")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(two).collect()}
    assert got == {1: "same line of twenty characters\nx\n", 2: ""}
    shared = spark.createDataFrame([(0, "the first line of all"), (1, "the first line of all"), (1, "a text found nowhere else"), (None, "a text found nowhere else"), (1, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in line_dedup.remove_lines(shared).collect())
    assert got == [(False, 0, "the first line of all"), (False, 1, ""), (False, 1, ""), (False, 1, "a text found nowhere else"), (True, 0, "")]


def test_edits_grow_with_the_line(spark):
    """Every pair of the brute-force distance, over lengths where one to ten edits are allowed, and none besides."""
    rnd = random.Random(21)
    lines = set()
    for n in (30, 62, 64, 66, 95, 97, 128, 166, 330):
        for spaced in (True, False):
            base = "".join(rnd.choice("abcdefghié" + "   " * spaced) for _ in range(n))
            for k in range(7):
                text = list(base)
                for at in sorted(rnd.sample(range(n), min(n, k * max(1, n // 32) // 4)), reverse=True):
                    text[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "é", " ", "中"])
                lines.add("".join(text))
    word = "the meeting of the committee was moved to the second tuesday in october because of the repairs to the main hall"
    lines |= {word, word.replace("tuesday", "monday"), "x" * 200, "x" * 195, "x" * 190}
    lines = sorted(x for x in lines if len(x) >= line_dedup.LEAST and x.strip())
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    near = {(a, b) for k, a in enumerate(lines) for b in lines[k + 1 :]
            if abs(len(a) - len(b)) <= 10 and distance(a, b) <= max(1, max(len(a), len(b)) // 32)}
    assert any(distance(a, b) > 3 for a, b in near)
    keyed = frame.select(F.xxhash64("text").alias("h"), "text").collect()
    by_hash = {r["h"]: r["text"] for r in keyed}
    found = [tuple(sorted((by_hash[r["a1"]], by_hash[r["b1"]]))) for r in line_dedup.line_links(frame).collect()]
    assert len(found) == len(set(found)) and set(found) == near


def test_toxicity_features_and_labels(spark):
    row = dict(zip(toxicity.FEATURES, toxicity.features("You are an 1d1ot, you IDIOT!"), strict=True))
    assert row["insults"] == 1 and row["disguised_density"] > 0 and row["near_second_person"] > 0
    assert toxicity.features(None) == toxicity.features("")
    scored = queries.op10_toxicity(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id"
    )
    rates = {r["toxic"]: r["s"] for r in scored.filter("held_out").groupBy("toxic").agg(F.avg("score").alias("s")).collect()}
    assert rates[1] > 0.5 > 0.2 > rates[0]


def test_pipeline_stages_keep_columns_and_clean_rows(spark, docs):
    taken = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, taken, SF_DIR)
        assert kept.columns == docs.columns
        path = fresh_path(spark, "stage")
        kept.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.join(taken, "doc_id", "left_anti").count() == 0
        taken = after
    left = {r["doc_id"]: r["text"] for r in taken.collect()}
    one = {" ".join(t.split()) for t in left.values()}
    assert len(one) == len(left)
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    scanned = decontaminate.scan_documents(taken, bench)
    assert scanned.filter(decontaminate.contaminated("found")).count() == 0
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(left)


def test_token_cache_with_repeated_digests(spark):
    """A cache that two writers filled at once gives every document once."""
    path = fresh_path(spark, "cache")
    docs = spark.createDataFrame([(1, "one two"), (2, None), (1, "one two")], "doc_id long, text string")
    vocabulary = token_counts.byte_vocabulary()
    first = sorted(tuple(r) for r in token_counts.count_tokens(docs, vocabulary, path).collect())
    spark.read.parquet(path).write.mode("append").parquet(path + "-again")
    spark.read.parquet(path + "-again").write.mode("append").parquet(path)
    assert sorted(tuple(r) for r in token_counts.count_tokens(docs, vocabulary, path).collect()) == first and len(first) == 3


def test_items_that_share_windows(spark):
    """A preamble of very many items, items without an id, ids and texts that repeat, and a clashing column."""
    preamble = " ".join(f"p{k}" for k in range(15))
    bench = [(f"i{k}", f"{preamble} q{k}") for k in range(300)] + [(None, "one two three"), ("s", "one two three"), ("s", "one two three"), ("n", None)]
    docs = [(1, f"x {preamble} y", 5), (1, f"x {preamble} q7", 6), (2, f"x {preamble} y", 7), (None, "One, two three.", 8), (3, None, 9), (4, "p0 p1", 10)]
    bench, docs = spark.createDataFrame(bench, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string, items int")
    found = {r["items"]: r["found"] for r in decontaminate.scan_documents(docs, bench).collect()}
    every = sorted(f"i{k}" for k in range(300))
    assert {k: list(f["items"]) for k, f in found.items()} == {5: every, 6: every, 7: every, 8: ["s"], 9: [], 10: []}
    assert {k: (f["n_words"], f["n_hit"]) for k, f in found.items()} == {5: (17, 15), 6: (17, 16), 7: (17, 15), 8: (3, 3), 9: (0, 0), 10: (2, 0)}
    assert sorted(r["items"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [9, 10]
    assert {tuple(r["found"]["items"]) for r in decontaminate.scan_documents(docs, bench.limit(0)).collect()} == {()}
