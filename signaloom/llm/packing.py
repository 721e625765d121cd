"""Best-fit packing into bins of several permitted sequence lengths.

Texts are cut into pieces of the largest length; pieces go, longest first, into the fullest bin that still takes them.
Where none does, a new bin opens in the size of least cost per token it can expect to hold, given the tokens still to be
packed. This is done for every choice of sizes that may be opened; every bin then shrinks to the smallest permitted length
that holds its contents, and the choice of least total cost stays.

The cost of a bin is ``length * (1 + length / ATTENTION)``: linear work plus attention over the whole sequence.

Pieces are dealt by a hash of their id and number into shards of about ``SHARD_PIECES``, each packed on its own in one
task; a shard never grows with the input, and only (id, piece, length) move, never texts. A text of length 0, or of no known
length, has one piece of length 0 without a bin. Every piece of every row comes back once; rows that repeat an id are told apart by a row
number. Ties in length go by id, then piece.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

LENGTHS = (512, 1024, 2048, 4096)
#: Length at which attention costs as much as the linear work.
ATTENTION = 8192
SHARD_PIECES = 20_000
COLUMNS = ("id", "piece", "start", "length", "bin", "bin_length", "offset")


def cost(length: int) -> float:
    return length * (1 + length / ATTENTION)


class _Space:
    """Open bins by free space: the fullest one that takes a piece is one bit search away."""

    def __init__(self) -> None:
        self.bins: dict[int, list[int]] = {}
        self.bits = 0

    def put(self, free: int, number: int) -> None:
        self.bins.setdefault(free, []).append(number)
        self.bits |= 1 << free

    def take(self, least: int) -> tuple[int, int] | None:
        rest = self.bits >> least
        if not rest:
            return None
        free = least + (rest & -rest).bit_length() - 1
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        return free, number


def opening(piece: int, rest: int, lengths: Sequence[int]) -> int:
    """The size to open for ``piece`` when ``rest`` tokens follow: least cost per token it will hold, then the smallest."""
    return min((c for c in lengths if c >= piece), key=lambda c: (cost(c) / min(c, piece + rest), c))


def best_fit(sizes: Sequence[int], lengths: Sequence[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each piece, sizes falling, and the tokens in each bin."""
    space, used, placed = _Space(), [], []
    rest = sum(sizes)
    for n in sizes:
        rest -= n
        found = space.take(n)
        if found is None:
            found = opening(n, rest, lengths), len(used)
            used.append(0)
        free, number = found
        placed.append((number, used[number]))
        used[number] += n
        if free > n:
            space.put(free - n, number)
    return placed, used


def pack_jointly(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[tuple[int, int]], list[int]]:
    """The cheapest packing over every choice of sizes to open: (bin, offset) per piece, and each bin's final length."""
    trials = [c for k in range(1, len(lengths) + 1) for c in combinations(sorted(lengths), k) if c[-1] >= max(sizes, default=0)]
    packed = []
    for order, trial in enumerate(trials):
        placed, used = best_fit(sizes, trial)
        final = [min(c for c in lengths if c >= u) for u in used]
        packed.append((sum(map(cost, final)), order, placed, final))
    return min(packed)[2:]


def pack(
    lengths_table: DataFrame, id_column: str, length_column: str, lengths: Sequence[int] = LENGTHS,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: id, ``piece, start, length, bin, bin_length, offset``; ``bin`` is null for an empty text.

    ``lengths_table`` holds an id and a length per text; it should be a written table, because it is read twice. Where the id
    column has the name of a result column, the latter gets an underscore.
    """
    largest = max(lengths)
    length = F.coalesce(column(lengths_table, length_column).cast("long"), F.lit(0))
    rows = lengths_table.select(column(lengths_table, id_column).alias("id"), length.alias("n"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    last = F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "id", "row", "piece", (F.col("piece") * largest).alias("start"),
        F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).alias("length"),
    )
    count = rows.select((last + 1).alias("k")).agg(F.sum("k")).first()[0] or 0
    shards = max(1, math.ceil(count / shard_pieces))
    sizes = list(lengths)

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "row", "piece"], ascending=[False, True, True, True])
        full = group[group["length"] > 0]
        placed, final = pack_jointly([int(n) for n in full["length"]], sizes)
        group = group.assign(bin=None, bin_length=None, offset=None)[list(COLUMNS)].astype(object)
        if len(full):
            group.loc[full.index, "bin"] = [f"{key[0]}-{b}" for b, _ in placed]
            group.loc[full.index, "bin_length"] = [final[b] for b, _ in placed]
            group.loc[full.index, "offset"] = [o for _, o in placed]
        return group

    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, piece long, start long, length long, bin string, bin_length long, offset long"
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "row", "piece"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(fill, schema)
    return packed.toDF(id_column, *[f"{c}_" if c.lower() == id_column.lower() else c for c in COLUMNS[1:]])
