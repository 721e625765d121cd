"""Equi-joins against one-row-per-key tables when a single key may hold much of the big side."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this many rows is spread over SALTS tasks.
HUB_ROWS = 5_000_000
SALTS = 64


def hub_keys(facts: DataFrame, on: Sequence[str], hub_rows: int | None = None) -> DataFrame:
    """Keys holding at least ``hub_rows`` rows: never more than row count / ``hub_rows`` of them."""
    hub_rows = HUB_ROWS if hub_rows is None else hub_rows
    return facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= hub_rows).select(*on)


def salted_join(
    facts: DataFrame,
    per_key: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hubs: DataFrame | None = None,
    hub_rows: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``facts`` (many rows per key) with ``per_key`` (one row per key).

    Rows of hub keys get a salt from their own content (so a repeated task gives the same one) and the key's single
    row is repeated once per salt, so a hub spreads over ``salts`` tasks. Rows that are equal in every column share a
    salt: let ``facts`` carry a row id. Rows with a NULL key match nothing and are spread as well. Other keys keep salt 0 and are not repeated. No broadcast hint: Spark
    broadcasts the hub list only when its measured size is under the threshold.
    """
    on = list(on)
    hubs = (hub_keys(facts, on, hub_rows) if hubs is None else hubs).withColumn("_hub", F.lit(True))
    hashable = [f.name for f in facts.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    spread = F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")
    keyless = reduce(or_, [F.col(c).isNull() for c in on])
    salted = facts.join(hubs, on, "left").withColumn("_salt", F.when(F.col("_hub") | keyless, spread).otherwise(0)).drop("_hub")
    copies = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = per_key.join(hubs, on, "left").withColumn("_salt", F.explode(copies)).drop("_hub")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
