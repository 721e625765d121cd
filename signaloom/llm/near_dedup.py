"""Near duplicates: DartMinHash signatures, banded joining, exact check, and classes of linked texts.

Two texts are linked when the Jaccard similarity of their five-word shingles is 0.8 or more, each shingle weighted by how often
it occurs (``weighted=False`` compares plain sets); a class is what links connect, its id the smallest id in it. Words are
lower-case (A-Z) runs of digits, ASCII letters and characters beyond ASCII. A text of fewer than five words is one shingle; a text
without words stands for itself as it is; null counts as empty. So equal texts are always in one class.

Texts with the same words are folded to one before anything is joined. Texts that agree in a band share a bucket. The members of
a bucket are compared with its leader, the one whose buckets hold the most texts, exactly; links become classes. Where a bucket
still holds several classes and has at most ``SMALL`` members, everyone is held against everyone. The members of a larger one go on
to narrower buckets: those that also agree in one of the next ``WIDE`` bands, which were not used on the way. There a leader is
compared again, small buckets are finished, and what is still open goes on to the next bands. That finds most links of a large bucket,
not all. So the large buckets that still hold several classes at the end are finished as well: there everyone of another class is held
against everyone by signature, in tiles of bounded size. This is quadratic in such a bucket, in time alone, and leaves out no pair.
Signatures are held against each other as matrices, a group of rows at a time, and classes are worked out anew only among those that
new links join.

Before texts are read, a pair is dropped when its signatures differ in more coordinates than those of a 30,000th of the pairs at
the threshold would; for the narrower buckets this is judged by a second signature of ``FINE`` coordinates. With 30 bands of 6 a
pair at similarity 0.8 shares a bucket with probability 0.9996, and more above, in a crowd or not. Nothing is linked without the
exact check.

Rows that repeat id and text are one document; extra columns play no part. An empty table has no classes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaloom.operators.components import component_labels
from signaloom.session import cut_lineage

from .common import column, free_name, mix, utf8, words_of
from .dart_minhash import PLANES, band_keys, bit_planes, most_differing, signatures

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 6
#: Bands tried for a narrower bucket, members of which all pairs are compared, and rounds of narrowing.
WIDE, SMALL, ROUNDS = 6, 1024, 5
#: Coordinates of the signature that judges the pairs of narrower buckets.
FINE = 720
#: Members of a large bucket that meet as many others in one group of rows.
TILE = 4096
#: Elements worked on at once; pairs of members, by the first and by the second signature.
SLICE = 60_000
PAIRS, FINE_PAIRS = 1 << 20, 1 << 14
SIGNED = "content binary, bands array<long>, planes array<long>"


class WordHasher:
    """64-bit hashes of words, with a table of the latest ones."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, out = self.known, []
        if len(known) > self.most:
            known.clear()
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def shingle_words(text: str | None) -> list[bytes]:
    return words_of(text) or [b"\x00" + utf8(text)]


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    n = max(1, len(words) - size + 1)
    out = np.full(n, len(words) if len(words) < size else 0, np.uint64)
    for k in range(min(size, len(words))):
        out = mix(out * np.uint64(0x100000001B3) + words[k : k + n])
    return out


def signed_slices(lists: Iterable[list[bytes]], size: int, k: int, weighted: bool, hasher: WordHasher, salt: int = 0) -> Iterator[np.ndarray]:
    """Signatures of ``k`` coordinates of lists of words, some texts at a time; another ``salt`` throws other darts."""
    elements: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    held = 0

    def signed() -> np.ndarray:
        owners = np.repeat(np.arange(len(elements)), [len(e) for e in elements])
        return signatures(np.concatenate(elements), np.concatenate(weights), owners, len(elements), k)

    for words in lists:
        found, counts = np.unique(shingle_hashes(hasher(words), size), return_counts=True)
        elements.append(mix(found + np.uint64(salt)) if salt else found)
        weights.append(counts.astype(float) if weighted else np.ones(len(found)))
        held += len(found)
        if held >= SLICE:
            yield signed()
            elements, weights, held = [], [], 0
    if elements:
        yield signed()


def sign(texts: pd.Series, size: int, bands: int, rows: int, weighted: bool, hasher: WordHasher) -> pd.DataFrame:
    """Digest of the words, the band keys and the bit planes of the signature, of each text."""
    contents, keys, planes = [], [], []

    def lists() -> Iterator[list[bytes]]:
        for text in texts:
            words = shingle_words(text)
            contents.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
            yield words

    for signed in signed_slices(lists(), size, bands * rows, weighted, hasher):
        keys.extend(band_keys(signed, bands).view(np.int64).tolist())
        planes.extend(bit_planes(signed).tolist())
    return pd.DataFrame({"content": contents, "bands": keys, "planes": planes})


def fine_planes(text: Column, size: int, weighted: bool) -> Column:
    """Bit planes of the second, longer signature."""

    @F.pandas_udf("array<long>")
    def planes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = WordHasher()
        for texts in batches:
            out: list[list[int]] = []
            for signed in signed_slices(map(shingle_words, texts), size, FINE, weighted, hasher, salt=1):
                out.extend(bit_planes(signed).tolist())
            yield pd.Series(out, dtype=object)

    return planes.asNondeterministic()(text)


def _shingles(text: str | None, size: int) -> Counter:
    words = shingle_words(text)
    return Counter(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def _jaccard(one: Counter, two: Counter, weighted: bool) -> float:
    both = one.keys() & two.keys()
    if not weighted:
        return len(both) / (len(one) + len(two) - len(both))
    n, m = one.total(), two.total()
    common = len(both) if n == len(one) or m == len(two) else sum(min(one[s], two[s]) for s in both)
    return common / (n + m - common)


def similarity(a: str | None, b: str | None, size: int = WORDS, weighted: bool = True) -> float:
    """Jaccard similarity of the texts' shingles."""
    return _jaccard(_shingles(a, size), _shingles(b, size), weighted)


def _sign_rows(docs: DataFrame, id_column: str, text_column: str, size: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    @F.pandas_udf(SIGNED)
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for texts in batches:
            yield sign(texts, size, bands, rows, weighted, hasher)

    text = column(docs, text_column)
    out = docs.select(column(docs, id_column).alias("id"), text_digest(text).alias("sha"), signed.asNondeterministic()(text).alias("x"))
    return out.select("id", "sha", "x.*")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _resemble(k: int, threshold: float, name: str = "planes") -> Column:
    """Whether the signatures of two members (``planes``, ``a_planes``) agree as often as linked texts' would."""
    words = -(-k // 64)
    differ = [
        "bit_count(" + " | ".join(f"({name}[{p * words + w}] ^ a_{name}[{p * words + w}])" for p in range(PLANES)) + ")"
        for w in range(words)
    ]
    return F.expr(f"{' + '.join(differ)} <= {most_differing(k, threshold)}")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, weighted: bool) -> DataFrame:
    """The pairs (``a, b``) with the exact similarity of their texts as ``s``.

    Pairs and texts are written tables, so Spark can split hot keys; texts are never broadcast, at any size.
    """

    @F.pandas_udf("double")
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        out: list[float] = []
        last, held = None, None  # the second join sorts by b, so its text comes again and again
        for x, y in zip(one, two, strict=True):
            if held is None or y != last:
                last, held = y, _shingles(y, size)
            out.append(_jaccard(_shingles(x, size), held, weighted))
        return pd.Series(out, dtype=float)

    first = texts.select(F.col("rep").alias("a"), F.col("text").alias("one"))
    second = texts.select(F.col("rep").alias("b"), F.col("text").alias("two"))
    both = pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b")
    return both.select("a", "b", alike.asNondeterministic()("one", "two").alias("s"))


def _labels(links: DataFrame) -> DataFrame:
    """(``rep, label``) of the texts that links (``a, b``) put in a class, written; the label is one of its texts."""
    found = component_labels(links.select("a", "b"))
    return cut_lineage(found.select(F.col("node").alias("rep"), F.col("component").alias("label")), "labels")


def _joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` where the new ``links`` (``a, b``) join classes, written: only these classes are gone through."""
    ends = links.select("a", "b")
    for end in "ab":
        label = labels.select(F.col("rep").alias(end), F.col("label").alias(f"{end}_label"))
        ends = ends.join(label, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    moved = _labels(ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))).toDF("label", "moved")
    # a text without a class is its own label
    single = moved.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("rep"), F.col("moved").alias("label"))
    known = labels.join(moved, "label", "left").select("rep", F.coalesce("moved", "label").alias("label"))
    return cut_lineage(known.union(single), "labels")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _open_buckets(members: DataFrame, least: int) -> DataFrame:
    """(``key, n, leader``) of the buckets with over ``least`` members and several labels."""
    buckets = members.groupBy("key").agg(
        F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top"),
    )
    return buckets.filter((F.col("n") > least) & (F.col("lo") != F.col("hi"))).select("key", "n", (-F.col("top.minus")).alias("leader"))


def _narrower(members: DataFrame, done: int, bands: int) -> DataFrame:
    """``members`` once for each of the next bands, their keys made of the old key and that band's."""
    band = lambda t: F.pmod(F.col("band") + 1 + done * WIDE + t, F.lit(bands))
    keys = F.array(*[F.xxhash64(F.lit(t), "key", F.element_at("bands", (band(t) + 1).cast("int"))) for t in range(WIDE)])
    return members.select(F.explode(keys).alias("key"), *[c for c in members.columns if c != "key"])


def _differing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many coordinates signatures given as bit planes (last axis) differ; the other axes are broadcast."""
    words = one.shape[-1] // PLANES
    one, two = one.view(np.uint64), two.view(np.uint64)  # bits of negative numbers are not counted as they are
    differ = 0
    for w in range(words):
        bits = one[..., w] ^ two[..., w]
        for p in range(1, PLANES):
            bits |= one[..., p * words + w] ^ two[..., p * words + w]
        differ = differ + np.bitwise_count(bits).astype(np.uint16)
    return differ


def _close_pairs(group: dict[str, np.ndarray], most: int, most_fine: int, one_band: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``rep`` of different labels between the tiles of a group, or within its only one, not told apart by their signatures;
    ``one_band``: those of which the group's key is the smallest band they share."""
    label, planes, fine, bands, rep = (group[c] for c in ("label", "planes", "fine", "bands", "rep"))
    within = group["i"][0] == group["j"][0]
    first, second = (np.flatnonzero(group["own"] == group[c][0]) for c in "ij")
    if not len(second):
        return
    step = max(1, PAIRS // len(second))
    for k in range(0, len(first), step):
        some = first[k : k + step]
        near = label[some, None] != label[None, second]
        if within:
            near &= some[:, None] < second[None, :]
        if not near.any():
            continue
        near &= _differing(planes[some, None], planes[None, second]) <= most
        x, y = np.nonzero(near)
        for n in range(0, len(x), FINE_PAIRS):
            a, b = some[x[n : n + FINE_PAIRS]], second[y[n : n + FINE_PAIRS]]
            close = _differing(fine[a], fine[b]) <= most_fine
            a, b = a[close], b[close]
            if one_band:
                shared = np.where(bands[a] == bands[b], bands[a], np.iinfo(np.int64).max).min(axis=1)
                a, b = a[shared == group["key"][0]], b[shared == group["key"][0]]
            if len(a):
                yield np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])


def _pairs_within(members: DataFrame, buckets: DataFrame, k: int, threshold: float, one_band: bool) -> DataFrame:
    """Pairs (``a, b``) of different labels, not told apart by their signatures, of whole buckets (``key, n``) of any size.

    A bucket is dealt into tiles of about ``TILE`` members; two tiles meet in one group of rows, so no task holds more than that
    at once. ``one_band``: keys are bands, and a pair that shares several is taken in one.
    """
    most, most_fine = most_differing(k, threshold), most_differing(FINE, threshold)
    placed = members.join(buckets.select("key", "n"), "key").withColumn("tiles", F.expr(f"cast(ceil(n / {TILE}) as int)"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    met = placed.withColumn("other", F.expr("explode(sequence(0, tiles - 1))"))
    dealt = met.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label", "planes", "fine", "bands"
    )
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "rep")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            for a, b in _close_pairs(group, most, most_fine, one_band):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(close, "a long, b long").distinct()


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Stretches of rows with the same ``key, i, j`` out of sorted batches, lists as matrices; one stretch is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")]
        starts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in place], axis=0)) + 1
        edges = [0, *starts.tolist(), batch.num_rows]
        if held and any(held[0].column(c)[0].as_py() != x[0] for c, x in zip(("key", "i", "j"), place, strict=True)):
            yield _arrays(held)
            held = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield _arrays(held)
                held = []
    if held:
        yield _arrays(held)


def _arrays(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    out = {}
    for name in held[0].schema.names:
        parts = [b.column(name) for b in held]
        lists = isinstance(parts[0], pa.ListArray)
        out[name] = np.concatenate([(x.flatten() if lists else x).to_numpy(zero_copy_only=False) for x in parts])
        if lists:
            out[name] = out[name].reshape(sum(len(x) for x in parts), -1)
    return out


def _pairs_to_compare(members: DataFrame, buckets: DataFrame, k: int, threshold: float, first: bool, last: bool) -> DataFrame:
    """Pairs (``a, b``) of different labels, not told apart by their signatures: every member of a bucket with its leader, and in
    small buckets (in the ``last`` round in all) everyone with everyone. Where buckets are bands, in the ``first`` round, the leader has
    been compared, and a pair that shares several is taken in one."""
    met = _pairs_within(members, buckets if last else buckets.filter(F.col("n") <= SMALL), k, threshold, one_band=first)
    if first or last:
        return met
    carried = ("rep", "label", "planes", "fine")
    placed = members.join(buckets.filter(F.col("n") > SMALL), "key")
    leaders = placed.filter(F.col("rep") == F.col("leader")).select("key", *[F.col(c).alias(f"a_{c}") for c in carried])
    alike = _resemble(k, threshold) & _resemble(FINE, threshold, "fine")
    led = placed.join(leaders, "key").filter((F.col("label") != F.col("a_label")) & alike)
    return led.select(F.least("rep", "a_rep").alias("a"), F.greatest("rep", "a_rep").alias("b")).union(met).distinct()


def _classes(
    docs: DataFrame, id_column: str, text_column: str, threshold: float, size: int, bands: int, rows: int, weighted: bool,
) -> tuple[DataFrame, DataFrame]:
    """Rows (``id, sha, content``) and the class of each content (``content, label``), both written."""
    signed = cut_lineage(_sign_rows(docs, id_column, text_column, size, bands, rows, weighted), "signed")
    one = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "sha")).alias("one")
    folded = signed.groupBy("content").agg(one, F.first("bands").alias("bands"), F.first("planes").alias("planes"))
    reps = cut_lineage(
        folded.select("content", "one.id", "one.sha", "bands", "planes").withColumn("rep", F.monotonically_increasing_id()), "reps"
    )
    band_rows = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = band_rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    placed = band_rows.join(buckets, "key")
    held = placed.groupBy("rep").agg(F.sum("n").alias("weight"), F.collect_list(F.struct("band", "key")).alias("placed"))
    held = cut_lineage(held, "held")
    members = held.select("rep", "weight", F.inline("placed"))
    first = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top"))
    first = first.select("key", (-F.col("top.minus")).alias("a"))
    wanted = reps.join(held.select("rep"), "rep").select("rep", "id", "sha")
    text = column(docs, text_column)
    own = docs.select(column(docs, id_column).alias("own_id"), text_digest(text).alias("own_sha"), text.alias("text"))
    same = own["own_id"].eqNullSafe(wanted["id"]) & (own["own_sha"] == wanted["sha"])
    found = own.join(wanted.hint("merge"), same).select("rep", "text")
    texts = cut_lineage(found.dropDuplicates(["rep"]), "texts")

    star = members.join(first, "key").filter("rep <> a").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))
    compared = cut_lineage(_verified(cut_lineage(star.distinct(), "pairs"), texts, size, weighted), "compared")
    linked = F.col("s") >= threshold
    labels = _labels(compared.filter(linked))
    named = _labelled(members, labels)
    buckets = cut_lineage(_open_buckets(named, 2), "open")
    crowd = named.join(buckets.select("key"), "key")
    fine = texts.join(crowd.select("rep").distinct(), "rep").select("rep", fine_planes(F.col("text"), size, weighted).alias("fine"))
    crowd = cut_lineage(crowd.join(fine, "rep").join(reps.select("rep", "bands", "planes"), "rep"), "crowd")

    def settled(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All compared pairs and the labels, with these pairs."""
        pairs = cut_lineage(pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return compared, labels
        found = cut_lineage(_verified(pairs, texts, size, weighted), "compared")
        links = found.filter(linked)
        return compared.union(found), labels if links.isEmpty() else _joined_labels(labels, links)

    whole = None
    for done in range(ROUNDS):
        if done:
            buckets = cut_lineage(_open_buckets(crowd, 1), "open")
        if buckets.isEmpty():
            break
        compared, labels = settled(_pairs_to_compare(crowd, buckets, bands * rows, threshold, not done, done == ROUNDS - 1))
        over = buckets.filter(F.col("n") > SMALL).select("key")
        if over.isEmpty():
            break
        large = cut_lineage(_labelled(crowd.drop("label").join(over, "key"), labels), "large")
        whole = large if whole is None else whole
        wide = large.join(_open_buckets(large, SMALL).select("key"), "key")
        crowd = cut_lineage(_narrower(wide, done, bands), "crowd")
    if whole is not None:
        whole = _labelled(whole.drop("label"), labels)
        rest = cut_lineage(_open_buckets(whole, SMALL), "rest")
        if not rest.isEmpty():
            compared, labels = settled(_pairs_within(whole, rest, bands * rows, threshold, one_band=True))
    named = cut_lineage(_labelled(reps.select("content", "rep"), labels).select("content", "label"), "classes")
    return signed.select("id", "sha", "content"), named


def label_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = SIMILARITY, size: int = WORDS,
    bands: int = BANDS, rows: int = ROWS, weighted: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id``, ``class_size`` (rows) and ``kept``, whether it is the class's own."""
    found, classes = _classes(docs, id_column, text_column, threshold, size, bands, rows, weighted)
    labelled = cut_lineage(found.join(classes, "content").select("id", "label"), "labelled")
    sizes = labelled.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    sizes = cut_lineage(sizes, "sizes")
    return labelled.join(sizes, "label").select(
        F.col("id").alias(id_column), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = SIMILARITY, size: int = WORDS,
    bands: int = BANDS, rows: int = ROWS, weighted: bool = True,
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class: the one with the smallest id, with all its columns."""
    found, classes = _classes(docs, id_column, text_column, threshold, size, bands, rows, weighted)
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "sha")).alias("one")
    kept = found.join(classes, "content").groupBy("label").agg(first).select(
        F.col("one.id").alias("kept_id"), F.col("one.sha").alias("kept_sha")
    )
    kept = cut_lineage(kept, "kept")
    sha = free_name(docs, "sha")
    single = docs.withColumn(sha, text_digest(column(docs, text_column))).dropDuplicates([id_column, sha])
    same = column(single, id_column).eqNullSafe(F.col("kept_id")) & (single[sha] == F.col("kept_sha"))
    if {"kept_id", "kept_sha"} & {c.lower() for c in docs.columns}:
        kept = kept.toDF(*[free_name(single, c) for c in kept.columns])
        same = column(single, id_column).eqNullSafe(kept[kept.columns[0]]) & (single[sha] == kept[kept.columns[1]])
    return single.join(kept, same, "left_semi").select(*[column(single, c) for c in docs.columns])
