"""Lines that share a half by the thousand, without being linked."""

import random

from pyspark.sql import functions as F

from signaloom.llm import line_dedup


def crowd(rnd, size):
    """Lines of one first half, lines of one second half, and edits of some of them; the halves differ in many places."""
    ahead, behind = "the same beginning of very many", "and the same end of as many more"
    lines = set()
    for _ in range(size):
        own = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(rnd.choice((29, 30, 31))))
        lines |= {ahead + own, own + behind}
    for line in rnd.sample(sorted(lines), size // 10):
        at = rnd.randrange(len(line) + 1)
        lines |= {line[:at] + line[at + 1 :], line[:at] + "é" + line[at:], line[:at] + "中" + line[at + 1 :]}
    return sorted(lines) + ["x" * n for n in range(20, 60)] + [ahead + c for c in "αβγδεζηθικλμν"]


def one_edit_links(lines):
    """All pairs of lines that one edit separates, by deletions: equal after leaving out a character at the same place, or one at all."""
    by_rest, found = {}, set()
    for line in lines:
        for k in range(len(line)):
            by_rest.setdefault((k, line[:k] + line[k + 1 :]), []).append(line)
    for same in by_rest.values():
        found |= {tuple(sorted((a, b))) for n, a in enumerate(same) for b in same[:n] if a != b}
    whole = set(lines)
    for line in lines:
        found |= {tuple(sorted((line, line[:k] + line[k + 1 :]))) for k in range(len(line)) if line[:k] + line[k + 1 :] in whole}
    return {pair for pair in found if min(map(len, pair)) >= line_dedup.LEAST}


def test_pairs_of_a_crowd_grow_with_its_size(spark, monkeypatch):
    made = []
    checked = line_dedup._checked

    def counting(pairs, *rest):
        made.append(pairs.count())
        return checked(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_checked", counting)
    lines = crowd(random.Random(5), 1000)
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(8)
    of_hash = {r["h"]: r["text"] for r in frame.select(F.xxhash64("text").alias("h"), "text").collect()}
    found = [tuple(sorted((of_hash[r["a1"]], of_hash[r["b1"]]))) for r in line_dedup.line_links(frame, edits=1).collect()]
    want = one_edit_links(lines)
    assert len(want) > 500 and len(found) == len(set(found)) and set(found) == want
    assert made and made[0] < 3 * len(lines)
