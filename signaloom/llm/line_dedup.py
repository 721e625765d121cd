"""Duplicate and near-duplicate lines by an edit join on shared substrings, in DataFrame operations only.

A text is split at line feeds. Lines that are equal count as one line; two lines of ``LEAST`` characters or more are linked
when few enough insertions, deletions or substitutions of characters lead from one to the other: one for every
``CHARACTERS_PER_EDIT`` characters of the longer line, and one at least (``edits`` gives a fixed number instead).

Where one or a fixed number is allowed, each line is cut into ``edits + 1`` segments: of two linked lines, at least one
segment of the shorter occurs in the longer near its own place. So lines are indexed by (length, segment number, segment),
probe the lengths up to ``edits`` below their own at the few places that can matter, and the pairs found are checked on
their texts by a bit-parallel automaton over the band of 2 * edits + 1 diagonals. Where one edit is allowed and a segment is
that of many lines, the rest of these lines is cut further before any pairs are made.

The places to probe grow with the cube of the edits, so longer lines are joined by marked substrings. Whether the ``GRAM``
characters at a place are marked is told by the ``REACH`` characters before it alone: the last is no letter, or all are
letters. Of the segments of the longer line one is whole in the shorter, and each holds a marked substring; so the longer
is indexed by one of each segment, the shorter probes with all of its own. Pairs whose lengths or counts of letters differ
by more than the edits can explain are left out, the others are checked by the banded edit distance of Spark.

A line goes when the same line, or a linked one, occurs earlier, in order of (id, line number); a null id comes last. Lines
of white space only always stay and have no links. Null counts as the empty text, which is one empty line. Rows that share
an id are taken as one text's lines at the same places. Lines are told apart by 128 bits of hashes; texts of any length
are read whole, and extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaloom.session import cut_lineage

from .common import column, free_name

LEAST = 20
CHARACTERS_PER_EDIT = 32
REACH, GRAM = 10, 11  # together no more than the shortest segment of a line that is allowed two edits
LETTERS = "eanitors"
LINE = ("h1", "h2")
#: So many lines that agree outside a window are compared with each other; the window of more is cut into so many.
CROWD, CUTS = 6, 16


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    lines = F.split(F.coalesce(column(docs, text_column), F.lit("")), "\n")
    rows = docs.select(column(docs, id_column).alias("id"), F.posexplode(lines).alias("no", "line"))
    return rows.withColumns({"n": F.length("line"), "h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(2), F.col("line"))})


def written(line: Column) -> Column:
    """Whether a line has more than white space."""
    return line.rlike("[^\\x20\\x09-\\x0D]")


def _keys(line: str, length: str, edits: int) -> Column:
    """Array of (``key``, ``kind``): 0 for the own segments, 1 for other places in lines of the own length, 2 for shorter.

    Segment i of a line of n characters runs from ``i * n div parts`` to the start of the next.
    """
    parts, out = edits + 1, []
    for less in range(edits + 1):
        n = f"({length} - {less})"
        for i in range(parts):
            start, end = f"({n} * {i} div {parts})", f"({n} * {i + 1} div {parts})"
            for shift in range(-edits, edits + 1):
                # multi-match-aware: what is left of the segment can use up i edits, what is right of it edits - i
                if abs(shift) > i or abs(shift - less) > edits - i:
                    continue
                kind = 2 if less else 0 if shift == 0 else 1
                part = f"substring({line}, cast({start} + {shift + 1} as int), cast({end} - {start} as int))"
                fits = f"{start} + {shift} >= 0 and {end} + {shift} <= {length}"
                out.append(f"if({fits}, named_struct('key', xxhash64({n}, {i}, {part}), 'kind', {kind}), null)")
    return F.expr(f"array_compact(array({', '.join(out)}))")


def code_points(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), F.ascii))


def within_edits(one: Column, two: Column, edits: int) -> Column:
    """Whether the edit distance of two texts, given as arrays of code points, is at most ``edits``.

    After j characters of ``two``, bit o + edits of ``r<d>`` says that its first j characters and the first j + o of
    ``one`` are within d edits: one integer per number of edits holds the whole band of diagonals.
    """
    width = (1 << (2 * edits + 1)) - 1
    start = F.struct(*[F.lit(((1 << (d + 1)) - 1) << edits).cast("int").alias(f"r{d}") for d in range(edits + 1)])

    def step(state: Column, at: Column) -> Column:
        match = F.lit(0)
        for o in range(-edits, edits + 1):
            same = F.coalesce(F.get(one, at["j"] + o) == at["c"], F.lit(False))
            match = match + F.when(same, 1 << (o + edits)).otherwise(0)
        new: list[Column] = []
        for d in range(edits + 1):
            bits = state[f"r{d}"].bitwiseAND(match)
            if d:
                old = state[f"r{d - 1}"]
                bits = bits.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(bits.bitwiseAND(F.lit(width)))
        return F.struct(*[bits.cast("int").alias(f"r{d}") for d, bits in enumerate(new)])

    gap = F.size(one) - F.size(two)
    steps = F.transform(two, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
    final = F.aggregate(steps, start, step, lambda s: s[f"r{edits}"])
    place = F.greatest(F.lit(0), gap + edits).cast("int")
    return (F.abs(gap) <= edits) & (F.call_function("shiftright", final, place).bitwiseAND(F.lit(1)) == 1)


def _links_of_few(lines: DataFrame, edits: int) -> DataFrame:
    """Links of lines by their segments, for a small number of edits."""
    # copies of a line fold within each task, before the rows of a segment meet
    rows = lines.select(*LINE, F.inline(_keys("line", "n", edits))).groupBy("key", *LINE).agg(F.min("kind").alias("kind"))
    pairs = cut_lineage(_pairs(rows).distinct(), "pairs")
    wanted = pairs.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).union(pairs.select("b1", "b2")).distinct()
    return _checked(pairs, _texts(lines, wanted), edits)


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of rows (``key, h1, h2, kind``) of the same key: index rows, of kind 0, with all."""
    index = rows.filter("kind = 0").select("key", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    probe = rows.select("key", F.col("h1").alias("b1"), F.col("h2").alias("b2"), "kind")
    once = F.expr("if(kind = 2, a1 <> b1 or a2 <> b2, a1 < b1 or (a1 = b1 and a2 < b2))")
    return index.join(probe, "key").filter(once).select("a1", "a2", "b1", "b2")


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    found = lines.select(*LINE, "line").groupBy(*LINE).agg(F.first("line").alias("line"))
    found = found.join(wanted.hint("merge"), list(LINE), "left_semi")
    return cut_lineage(found.withColumn("points", code_points(F.col("line"))), "texts")


def _checked(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    points = texts.select(*LINE, "points")
    one, two = points.toDF("a1", "a2", "one"), points.toDF("b1", "b2", "two")
    both = pairs.join(one.hint("merge"), ["a1", "a2"]).join(two.hint("merge"), ["b1", "b2"])
    return both.filter(within_edits(F.col("one"), F.col("two"), edits)).select("a1", "a2", "b1", "b2")


def _window_key(length: str, start: str, end: str, less: str, line: str, last: str) -> str:
    """All of a line but a window, which is ``less`` characters longer than in the shorter line of ``length`` characters."""
    ahead, behind = f"substring({line}, 1, {start})", f"substring({line}, {end} + {less} + 1)"
    return f"xxhash64({length}, {start}, {end}, {last}, {ahead}, {behind})"


def _windows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``members``, how many share the key, of the keys that can give a pair."""
    counted = rows.groupBy("key").agg(F.count("*").alias("members"), F.count_if(F.col("kind") == 0).alias("owners"))
    counted = cut_lineage(counted.filter("members > 1 and owners > 0").select("key", "members"), "counted")
    return cut_lineage(rows.join(counted, "key"), "windows")


def _links_of_one(lines: DataFrame) -> DataFrame:
    """Links of lines by one edit.

    Lines that agree in a half differ in the other one only, the window. Where over ``CROWD`` lines do, the window is cut into ``CUTS``, and
    lines meet when they agree outside one of these; so on, until few do, or the window is one character, or none with a character
    put in, where all are linked. One edit lies in a window of every cut, so this loses no link.
    """
    halves = []
    for less in (0, 1):
        for start, end in ((f"((n - {less}) div 2)", f"(n - {less})"), ("0", f"((n - {less}) div 2)")):
            key = _window_key(f"(n - {less})", f"cast({start} as int)", f"cast({end} as int)", str(less), "line", "false")
            halves.append(f"named_struct('key', {key}, 'kind', {2 * less}, 'start', cast({start} as int), 'end', cast({end} as int))")
    rows = lines.select(*LINE, F.expr(f"inline(array({', '.join(halves)}))"))
    rows = rows.groupBy("key", *LINE).agg(*[F.min(c).alias(c) for c in ("kind", "start", "end")]).withColumn("last", F.lit(False))
    rows = _windows(cut_lineage(rows, "halves"))
    texts = _texts(lines, rows.select(*LINE).distinct())
    pairs = []
    while True:
        done = F.col("last") | (F.col("members") <= CROWD)
        pairs.append(_pairs(rows.filter(done)))
        crowd = rows.filter(~done)
        if crowd.isEmpty():
            break
        crowd = crowd.select(*LINE, "kind", "start", "end").join(texts.select(*LINE, "line"), list(LINE))
        step = f"cast(ceil((end - start) / {CUTS}) as int)"
        wide = f"transform(sequence(start, end - 1, {step}), x -> named_struct('start', x, 'end', cast(least(end, x + {step}) as int), 'last', false))"
        none = "transform(array(start, end), x -> named_struct('start', x, 'end', x, 'last', true))"
        one = "array(named_struct('start', start, 'end', end, 'last', true))"
        narrow = F.expr(f"if(end - start > 1, {wide}, if(kind = 0, concat({one}, {none}), {none}))")
        cut = crowd.select(*LINE, "kind", "line", F.inline(narrow))
        key = _window_key("(length(line) - kind div 2)", "start", "end", "cast(kind div 2 as int)", "line", "last")
        cut = cut.select(F.expr(key).alias("key"), *LINE, "kind", "start", "end", "last")
        rows = _windows(cut_lineage(cut, "cut"))
    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more)
    return _checked(cut_lineage(found.distinct(), "pairs"), texts, 1)


def _allowed(length: str) -> str:
    return f"cast(greatest(1, {length} div {CHARACTERS_PER_EDIT}) as int)"


def _size_class(length: str) -> str:
    """Of two lines that can be linked, the shorter is in the class of the longer or the one before."""
    return f"cast(floor(ln({length}) / ln({CHARACTERS_PER_EDIT / (CHARACTERS_PER_EDIT - 1)})) as int)"


def _letter_counts(line: str) -> Column:
    """How often each of eight letters occurs, modulo 256, in the bytes of one number."""
    counts = [f"(octet_length({line}) - octet_length(replace({line}, '{c}', '')))" for c in LETTERS]
    return F.expr(" | ".join(f"shiftleft(cast({c} & 255 as bigint), {8 * k})" for k, c in enumerate(counts)))


def _count_distance(one: str, two: str) -> str:
    """At most the sum of the differences of the letter counts; an edit changes that by two at most."""
    def byte(x: str, k: int) -> str:
        return f"(shiftright({x}, {8 * k}) & 255)"

    apart = [f"abs({byte(one, k)} - {byte(two, k)})" for k in range(len(LETTERS))]
    return " + ".join(f"least({d}, 256 - {d})" for d in apart)


def _links_by_length(lines: DataFrame) -> DataFrame:
    """Links whose longer line is allowed two edits or more."""
    shortest = 2 * CHARACTERS_PER_EDIT
    wide = lines.filter(F.col("n") >= shortest - 2).groupBy(*LINE).agg(F.first("n").alias("n"), F.first("line").alias("line"))
    wide = wide.withColumns({"id": F.monotonically_increasing_id(), "counts": _letter_counts("line")})
    wide = cut_lineage(wide, "wide-lines")
    cut = f"(n div ({_allowed('n')} + 1))"
    # per segment: the first place of a marked substring that its own characters tell
    first = rf"regexp_extract(substring(line, cast(i * {cut} + 1 as int), cast({cut} as int)), r'(?s)\A(?:.{{1,{REACH}}}?(?<=\P{{L}})|.{{{REACH}}})(.{{{GRAM}}})', 1)"
    segments = F.expr(f"array_distinct(transform(sequence(0, {_allowed('n')}), i -> {first}))")
    marked = F.expr(rf"array_distinct(regexp_extract_all(line, r'(?s)(?:(?<=\P{{L}})|(?<=\p{{L}}{{{REACH}}}))(?=(.{{{GRAM}}}))', 1))")
    index = wide.filter(F.col("n") >= shortest).select("id", "n", "counts", F.explode(segments).alias("gram"))
    own = F.expr(_size_class("n"))
    index = index.select("id", "n", "counts", "gram", F.explode(F.array(own, own - 1)).alias("size"))
    probe = wide.select("id", "n", "counts", F.explode(marked).alias("gram"), own.alias("size"))
    key = F.xxhash64("size", "gram").alias("key")
    index = index.select(key, F.col("id").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    probe = probe.select(key, F.col("id").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    near = F.expr(f"(nb < na or (nb = na and a < b)) and na - nb <= {_allowed('na')}")
    alike = F.expr(f"{_count_distance('ca', 'cb')} <= 2 * {_allowed('na')}")
    pairs = cut_lineage(index.join(probe, "key").filter(near & alike).select("a", "b").distinct(), "wide-pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = cut_lineage(wide.join(ends.hint("merge"), "id", "left_semi").select("id", *LINE, "n", "line"), "wide-texts")
    one, two = texts.toDF("a", "a1", "a2", "na", "one"), texts.select("id", *LINE, "line").toDF("b", "b1", "b2", "two")
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return both.filter(F.expr(f"levenshtein(one, two, {_allowed('na')}) >= 0")).select("a1", "a2", "b1", "b2")


def line_links(docs: DataFrame, text_column: str = "text", edits: int | None = None, least: int = LEAST) -> DataFrame:
    """(``a1, a2, b1, b2``): hashes of the linked pairs of different lines, each pair once.

    ``edits`` is the same number for all lines; without it the number grows with the length.
    """
    lines = _lines(docs, docs.columns[0], text_column).filter((F.col("n") >= least) & written(F.col("line")))
    if edits is not None:
        return _links_of_one(lines) if edits == 1 else _links_of_few(lines, edits)
    return _links_of_one(lines.filter(F.col("n") < 2 * CHARACTERS_PER_EDIT)).union(_links_by_length(lines))


def mark_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", edits: int | None = None, least: int = LEAST,
) -> DataFrame:
    """One row per line: ``id, no, exact, near, n_links``; ``exact`` or ``near`` says why the line goes."""
    rows = _lines(docs, id_column, text_column).select("id", "no", *LINE, written(F.col("line")).alias("full"))
    rows = cut_lineage(rows, "lines")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("no").alias("no"))
    lines = rows.filter("full").groupBy(*LINE).agg(F.min(place).alias("place"))
    links = cut_lineage(line_links(docs, text_column, edits, least), "links")
    ends = links.toDF("h1", "h2", "o1", "o2").union(links.select("b1", "b2", "a1", "a2"))
    other = lines.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("place").alias("other"))
    linked = ends.join(other, ["o1", "o2"]).groupBy(*LINE).agg(F.count("*").alias("n_links"), F.min("other").alias("other"))
    table = lines.join(linked, list(LINE), "left").select(
        *LINE, "place", F.coalesce(F.col("other") < F.col("place"), F.lit(False)).alias("later"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    table = cut_lineage(table, "distinct-lines")
    # two written tables, so Spark can split the task of a line with very many copies
    met = rows.filter("full").join(table, list(LINE))
    exact = ~(place.eqNullSafe(F.col("place")))
    full = met.select("id", "no", exact.alias("exact"), (F.col("later") & ~exact).alias("near"), "n_links")
    blank = rows.filter("not full").select("id", "no", F.lit(False), F.lit(False), F.lit(0).cast("long"))
    return full.union(blank)


def line_report(marked: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per id: ``n_lines, n_exact, n_near, n_links`` and ``dropped``, the numbers of the lines that go."""
    goes = F.col("exact") | F.col("near")
    return marked.groupBy(F.col("id").alias(id_column)).agg(
        F.count("*").alias("n_lines"), F.count_if("exact").alias("n_exact"), F.count_if("near").alias("n_near"),
        F.sum("n_links").alias("n_links"), F.sort_array(F.collect_list(F.when(goes, F.col("no")))).alias("dropped"),
    )


def remove_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", edits: int | None = None, least: int = LEAST,
) -> DataFrame:
    """``docs`` without the lines that go; texts that lose none are as they were, null included.

    Different texts that share an id are texts of their own, in the order of their digests; rows that repeat id and text are one.
    """
    gone, key = free_name(docs, "gone"), free_name(docs, "key")
    identity, text = column(docs, id_column), column(docs, text_column)
    of_row = F.struct(identity.isNull().alias("none"), identity.alias("id"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("sha"))
    keyed = docs.withColumn(key, of_row)
    report = line_report(mark_lines(keyed, key, text_column, edits, least), "id").filter(F.size("dropped") > 0)
    report = report.select(F.col("id").alias(free_name(keyed, "of")), F.col("dropped").alias(gone))
    joined = keyed.join(report, keyed[key].eqNullSafe(report[report.columns[0]]), "left")
    text = column(joined, text_column)
    kept = F.filter(F.split(text, "\n"), lambda _, no: ~F.array_contains(F.col(gone), no))
    new = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[new.alias(c) if c == text_column else column(joined, c) for c in docs.columns])
