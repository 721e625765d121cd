"""Entity resolution: rows that share any identifier belong together, transitively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import cut_lineage
from .hubs import HUB_ROWS, salted_join


def key_rows(rows: DataFrame, row_id: str, keys: dict[str, Column]) -> DataFrame:
    """Long table (row id, ``key_type``, ``key_value``) of the non-NULL keys of every row.

    Two entries may share a key type by the part of the name before ``/``: ``{"teid/s1u": .., "teid/s5u": ..}``.
    """
    entries = F.array(
        *[
            F.struct(F.lit(name.split("/")[0]).alias("key_type"), value.cast("string").alias("key_value"))
            for name, value in keys.items()
        ]
    )
    known = F.filter(entries, lambda e: e["key_value"].isNotNull() & (e["key_value"] != ""))
    return rows.select(row_id, F.inline(F.array_distinct(known)))


def bounded_in_time(value: Column, ts: Column, valid_within_seconds: int) -> Column:
    """Key that only joins rows of the same period, for identifiers that are handed out again later."""
    period = F.floor(F.unix_micros(ts) / F.lit(valid_within_seconds * 1_000_000))
    return F.when(value.isNotNull(), F.concat_ws("@", value.cast("string"), period.cast("string")))


def without_listed(keyed: DataFrame, listed: DataFrame) -> DataFrame:
    """Keys other than the (``key_type, key_value``) in ``listed``: a list of infrastructure addresses, not a count."""
    return keyed.join(listed.select("key_type", "key_value").distinct(), ["key_type", "key_value"], "left_anti")


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``node``, ``component``) for every node of the undirected ``edges`` (a, b); the component is a BIGINT.

    Alternates two star operations (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014), which
    needs a logarithmic number of rounds on long chains too. Nodes are numbered first, by a hash without a join or,
    should two of them share one, by distinct numbers, so that every round moves and aggregates 8-byte integers. Nodes that are
    BIGINT are their own numbers. Every neighbour minimum is pre-aggregated before the shuffle and joined back
    with hub nodes salted. Raises rather than return labels that are not final.
    """
    if all(isinstance(edges.schema[c].dataType, LongType) for c in "ab"):
        current = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        stars, roots = _stars(cut_lineage(current, "edges"), max_rounds)
        return stars.unionByName(roots).withColumnRenamed("id", "node")
    named = cut_lineage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    nodes = named.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Written once: the numbers stay the same for every later reader.
    numbers = cut_lineage(nodes.withColumn("id", _hashed("node")), "nodes")
    total, told_apart = numbers.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    ends = named.select(_hashed("a").alias("x"), _hashed("b").alias("y"))
    if told_apart < total:
        numbers, ends = _numbered(named, nodes)
    current = cut_lineage(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    stars, roots = _stars(current, max_rounds)
    return numbers.join(stars.unionByName(roots), "id").select("node", "component")


def _stars(current: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(``id, component``) of the nodes of ``current`` (u > v), those that are not the smallest of their component, and those that are."""
    total = None
    for _ in range(max_rounds):
        edge_count, centres, degree, nodes = _extent(current)
        total = nodes if total is None else total  # star steps keep every node
        tasks = _tasks(current.sparkSession, edge_count)
        # Every component has at least one centre, and at least total - edges components exist: when both numbers
        # meet, each component is a star around its smallest node.
        if edge_count + centres == total:
            stars = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return stars, current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().coalesce(tasks)
        # no node has more edges after the first star than before, so this holds for both
        salted = degree >= HUB_DEGREE
        both_ways = current.select(_ends(("u", "v"), ("v", "u")))
        large = _star(both_ways, smaller_only=False, salted=salted)
        current = cut_lineage(_star(large, smaller_only=True, salted=salted).distinct().coalesce(tasks), "edges")
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _tasks(spark: SparkSession, rows: int) -> int:
    """In how many tasks narrow rows are written: a small graph fills few of the shuffle's partitions, and each makes a file."""
    return max(spark.sparkContext.defaultParallelism, rows // TASK_ROWS)


def _extent(edges: DataFrame) -> tuple[int, int, int, int]:
    """How many edges and centres there are, how many edges the node with most of them has, and how many nodes there are."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.lit(n).alias("_v")) for n, c in enumerate("uv")])))
    nodes = ends.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_v"))
    found = nodes.agg(F.sum("_v"), F.count_if(F.col("_v") > 0), F.max("_n"), F.count(F.lit(1))).first()
    return tuple(n or 0 for n in found)


def _hashed(node: str) -> Column:
    """A number of 63 bits, 0 or more; two nodes may share it."""
    return F.xxhash64(node).bitwiseAND(F.lit((1 << 63) - 1))


def _numbered(named: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``node, id``) with a number of its own for each node, and the edges (``x, y``) by these numbers."""
    numbers = cut_lineage(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    salted = named.count() >= HUB_DEGREE
    ends = named
    for end, number in (("a", "x"), ("b", "y")):
        per_node = numbers.select(F.col("node").alias(end), F.col("id").alias(number))
        ends = salted_join(ends, per_node, [end], hub_rows=HUB_DEGREE) if salted else ends.join(per_node, end)
    return numbers, ends.select("x", "y")


def _ends(*pairs: tuple[str, str]) -> Column:
    """Rows (u, v) out of pairs of columns, in one pass over the input."""
    return F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs]))


def _star(edges: DataFrame, smaller_only: bool, salted: bool) -> DataFrame:
    """Connect the neighbours of each node (``smaller_only``: and the node itself) to its smallest neighbour.

    ``salted`` spreads the edges of hub nodes in the join back; without hubs the edges are shuffled once for both steps.
    """
    edges = edges if salted else edges.repartition("u")
    lowest = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
    if salted:
        hubs = lowest.filter(F.col("_n") >= HUB_DEGREE).select("u")
        joined = salted_join(edges, lowest.drop("_n"), ["u"], hubs=hubs)
    else:
        joined = edges.join(lowest.drop("_n"), "u")
    if smaller_only:
        # u > v on every edge here: the smaller neighbours move to the minimum, and so does the node.
        return joined.select(_ends(("v", "m"), ("u", "m"))).filter("u <> v")
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


#: Edges a task writes, on the mean, at least, unless there are as many tasks as cores.
TASK_ROWS = 100_000
#: Nodes with at least this many edges are salted in the join back.
HUB_DEGREE = 1_000_000


def key_nodes(keys: dict[str, Column]) -> Column:
    """ARRAY of the row's known identifiers as ``type:value`` texts; see :func:`key_rows` for the names."""
    texts = [
        F.when(value.cast("string") != "", F.concat(F.lit(name.split("/")[0] + ":"), value.cast("string")))
        for name, value in keys.items()
    ]
    return F.array_distinct(F.array_compact(F.array(*texts)))


def nodes_of(keyed: DataFrame, row_id: str) -> DataFrame:
    """(row id, ``nodes``) back out of a long key table, for use after :func:`without_listed`."""
    node = F.concat_ws(":", "key_type", "key_value")
    return keyed.groupBy(row_id).agg(F.collect_set(node).alias("nodes"))


def merge_by_keys(rows: DataFrame, nodes: str, row_id: str, name: str = "session_id", max_rounds: int = 60) -> DataFrame:
    """``rows`` with ``name``: rows sharing any identifier, transitively, get the same id - the smallest row id.

    The components are worked out on identifiers, not on rows: a row contributes edges from its smallest
    identifier to its others, and equal edges are folded before the shuffle, so the graph grows with distinct
    identifiers. Rows then pick up the label through their smallest identifier, in the only join that moves
    whole rows. Rows without any identifier are left out; ``nodes`` is dropped.
    """
    known = rows.filter(F.size(nodes) > 0).withColumn("_anchor", F.array_min(nodes))
    pairs = known.select(F.col("_anchor").alias("a"), F.explode(nodes).alias("b"))
    labels = component_labels(pairs, max_rounds).withColumnRenamed("node", "_anchor")
    # One row per identifier from here on: the smallest row id of each anchor, then of each component.
    anchors = known.groupBy("_anchor").agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    labelled = anchors.join(labels, "_anchor", "left").withColumn(
        "_root", F.coalesce(F.col("component").cast("string"), F.concat(F.lit("="), "_anchor"))
    )
    labelled = cut_lineage(labelled.select("_anchor", "_root", "_first", "_rows"), "anchors")
    sizes = labelled.agg(F.max("_rows"), F.count(F.lit(1))).first()
    ids = labelled.groupBy("_root").agg(F.min("_first").alias(name))
    few = (sizes[1] or 0) < HUB_ROWS
    named = labelled.join(ids, "_root") if few else salted_join(labelled, ids, ["_root"])
    found = known.drop(nodes)
    if (sizes[0] or 0) < HUB_ROWS:
        return found.join(named.select("_anchor", name), "_anchor").drop("_anchor")
    hubs = labelled.filter(F.col("_rows") >= HUB_ROWS).select("_anchor")
    return salted_join(found, named.select("_anchor", name), ["_anchor"], hubs=hubs).drop("_anchor")


def merge_touched(
    new_rows: DataFrame, known: DataFrame, row_id: str, nodes: str, name: str = "session_id"
) -> tuple[DataFrame, DataFrame]:
    """One online step: the identifiers of the new rows with their sessions (``node``, ``name``), and what became of the row ids
    and sessions that take part (``_old``, ``_new``).

    ``known`` is (``node``, ``name``): the session of each identifier seen so far, of which only those in the new rows are used.
    """
    touched = new_rows.select(row_id, F.explode(nodes).alias("node")).join(known, "node", "left")
    # Numbers (rows of this batch, sessions of before) and identifiers are the two sorts of nodes.
    identifier, number = F.concat(F.lit("~"), F.col("node")), lambda c: F.concat(F.lit("#"), F.col(c).cast("string"))
    edges = touched.select(identifier.alias("a"), number(row_id).alias("b")).unionByName(
        touched.filter(F.col(name).isNotNull()).select(identifier.alias("a"), number(name).alias("b"))
    )
    labels = component_labels(edges)
    body = F.expr("substring(node, 2)")
    numbers = labels.filter("node like '#%'").select("component", body.cast("bigint").alias("_old"))
    ids = numbers.groupBy("component").agg(F.min("_old").alias(name))
    fresh = labels.filter("node like '~%'").select("component", body.alias("node")).join(ids, "component").select("node", name)
    return fresh, numbers.join(ids, "component").select("_old", F.col(name).alias("_new"))


def merge_by_keys_incremental(
    new_rows: DataFrame, known: DataFrame, row_id: str, nodes: str, name: str = "session_id"
) -> tuple[DataFrame, DataFrame]:
    """One online step on whole tables: (new known table, remap of session ids that were merged away)."""
    fresh, renamed = merge_touched(new_rows, known, row_id, nodes, name)
    kept = known.join(fresh.select("node"), "node", "left_anti")
    moved = kept.join(renamed, kept[name] == renamed["_old"], "left").select("node", F.coalesce("_new", name).alias(name))
    return moved.unionByName(fresh), renamed.filter("_old <> _new").select(F.col("_old").alias("merged_id"), F.col("_new").alias(name))
