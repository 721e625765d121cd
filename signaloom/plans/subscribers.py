"""Subscriber registry queries: people out of identity observations, their values, child tables and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sessions as S
from ..operators import subscribers as R
from ..operators import tunnels as T
from ..session import cut_lineage
from .bindings import bound, check
from .registry import register

#: A temporary identifier that was not seen for ten days has been handed on.
VALID_WITHIN = 864_000
#: How sure an observation is, by where it comes from.
CONFIDENCE = "CASE source WHEN 'signup' THEN 1.0 WHEN 'view' THEN 0.9 WHEN 'click' THEN 0.6 ELSE 0.5 END"
IDENTIFIERS = ("imsi", "msisdn", "imei", "guti", "tmsi", "ipv4", "ipv6", "tunnel")
CHILDREN = ("pdu_session", "ue_ids", "call_id", "icid")

_MERGED = f"""WITH RECURSIVE hk AS (SELECT obs_id, ts AS t0, imsi, unnest(list_distinct(['tmsi:' || tmsi, 'guti:' || guti, 'tmsi:' || split_part(guti, '-', 4), 'ipv4:' || ipv4,
    'ipv6:' || array_to_string(string_split(ipv6, ':')[1:4], ':'), 'tunnel:' || tunnel])) AS key FROM observations),
  hw AS (SELECT *, last_value(imsi IGNORE NULLS) OVER (PARTITION BY key ORDER BY t0, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder,
    lag(t0) OVER (PARTITION BY key ORDER BY t0, obs_id) AS prev FROM hk WHERE key IS NOT NULL),
  ht AS (SELECT *, CAST(sum(CASE WHEN coalesce(imsi <> holder, false) OR coalesce(t0 - prev > {VALID_WITHIN * 1_000_000}, false) THEN 1 ELSE 0 END)
    OVER (PARTITION BY key ORDER BY t0, obs_id) AS BIGINT) AS tenure FROM hw),
  kn AS (SELECT obs_id, key || '#' || tenure AS node FROM ht
    UNION SELECT obs_id, node FROM (SELECT obs_id, unnest(['imsi:' || imsi, 'msisdn:' || msisdn, 'imei:' || imei]) AS node FROM observations) WHERE node IS NOT NULL),
  anchor AS (SELECT obs_id, min(node) AS a FROM kn GROUP BY 1),
  e1 AS (SELECT DISTINCT a.a, k.node AS b FROM anchor a JOIN kn k USING (obs_id) WHERE a.a <> k.node), e AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
  walk(node, seen) AS (SELECT DISTINCT node, node FROM kn UNION SELECT w.node, e.b FROM walk w JOIN e ON w.seen = e.a),
  root AS (SELECT node, min(seen) AS root FROM walk GROUP BY 1), mr AS (SELECT a.obs_id, r.root FROM anchor a JOIN root r ON a.a = r.node),
  ids AS (SELECT root, min(obs_id) AS subscriber_id FROM mr GROUP BY 1),
  su AS (SELECT o.*, subscriber_id FROM observations o JOIN mr USING (obs_id) JOIN ids USING (root)),
  vals AS (SELECT subscriber_id, attribute, value, max(c) AS confidence, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS observations
    FROM (SELECT subscriber_id, ts, CAST({CONFIDENCE} AS DOUBLE) AS c, unnest([{", ".join(f"'{a}'" for a in IDENTIFIERS)}]) AS attribute,
      unnest([{", ".join(f"CAST({a} AS VARCHAR)" for a in IDENTIFIERS)}]) AS value FROM su) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
  best AS (SELECT subscriber_id, """ + ", ".join(
    f"min_by(value, (-confidence, first_seen, value)) FILTER (attribute = '{a}') AS {a}, max(confidence) FILTER (attribute = '{a}') AS {a}_confidence" for a in R.PERMANENT
) + ", " + ", ".join(f"count(*) FILTER (attribute = '{a}') AS {a}_values" for a in ("guti", "ipv4", "ipv6", "tunnel")) + """ FROM vals GROUP BY 1),
  seen AS (SELECT subscriber_id, """ + ", ".join(
    f"max_by({a}, (ts, obs_id)) FILTER ({a} IS NOT NULL) AS current_{a}" for a in ("guti", "tmsi", "ipv4", "ipv6")
) + """, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS observations FROM su GROUP BY 1),
  people AS (SELECT *, round(CASE WHEN imsi IS NULL THEN 0 ELSE 0.3 END + CASE WHEN msisdn IS NULL THEN 0 ELSE 0.3 END + CASE WHEN imei IS NULL THEN 0 ELSE 0.2 END
    + CASE WHEN ipv4_values + ipv6_values + tunnel_values > 0 THEN 0.2 ELSE 0 END, 3) AS completeness, coalesce('imsi:' || imsi, 'msisdn:' || msisdn, 'imei:' || imei) AS primary_key
    FROM seen JOIN best USING (subscriber_id))"""

_BEARERS = """,
  owner AS (SELECT g.frame_number, coalesce(i.subscriber_id, m.subscriber_id) AS subscriber_id FROM gtp g
    LEFT JOIN (SELECT imsi, min(subscriber_id) AS subscriber_id FROM su GROUP BY 1) i ON g.imsi = i.imsi
    LEFT JOIN (SELECT msisdn, min(subscriber_id) AS subscriber_id FROM su GROUP BY 1) m ON g.msisdn = m.msisdn),
  br AS (SELECT subscriber_id, teid, ebi, max_by(qci, (ts, frame_number)) AS qci, min(ts) AS created_ts, max(ts) FILTER (message_type <> 36) AS used,
    max(ts) FILTER (message_type = 36) AS removed FROM gtp JOIN owner USING (frame_number) WHERE subscriber_id IS NOT NULL GROUP BY 1, 2, 3),
  bt AS (SELECT subscriber_id, teid, ebi, qci, created_ts, CASE WHEN removed >= coalesce(used, removed) THEN removed END AS deleted_ts,
    NOT coalesce(removed >= coalesce(used, removed), false) AS active FROM br)"""


def _people_check(body: str, *more: str) -> str:
    """The bindings first, then the recursive tables."""
    return check(_MERGED.replace("WITH RECURSIVE ", "WITH ", 1) + body, "observations", *more, recursive=True)


def _merged(spark, sf) -> tuple[DataFrame, DataFrame]:
    return R.merge_subscribers(bound(spark, sf, "observations"), "obs_id", "ts", VALID_WITHIN)


def _values(merged: DataFrame) -> DataFrame:
    return cut_lineage(R.attribute_values(merged, IDENTIFIERS, F.expr(CONFIDENCE), "ts"), "values")


def _people(merged: DataFrame) -> DataFrame:
    return R.subscriber_table(merged, _values(merged), "ts", "obs_id").withColumn("completeness", F.round("completeness", 3))


def _bearers(spark, sf, registry: DataFrame) -> DataFrame:
    gtp = bound(spark, sf, "gtp").select("frame_number", "ts", "teid", "ebi", "qci", "imsi", "msisdn", (F.col("message_type") == T.DELETE_REQUEST).alias("removes"))
    keys = [F.concat(F.lit("imsi:"), "imsi"), F.concat(F.lit("msisdn:"), "msisdn")]
    owners = R.resolve(gtp, "frame_number", "ts", keys, registry)
    return R.bearer_table(gtp, owners, "frame_number", ["ts", "frame_number"])


@register("subscribers", _people_check(" SELECT * FROM people"))
def _(spark, sf):
    return _people(_merged(spark, sf)[0])


@register("subscriber_attributes", _people_check(" SELECT * FROM vals"))
def _(spark, sf):
    return _values(_merged(spark, sf)[0])


@register(
    "subscriber_children",
    _people_check(
        f""" SELECT DISTINCT * FROM (SELECT subscriber_id, unnest([{", ".join(f"'{a}'" for a in CHILDREN)}]) AS attribute,
        unnest([{", ".join(f"CAST({a} AS VARCHAR)" for a in CHILDREN)}]) AS value FROM su) WHERE value IS NOT NULL"""
    ),
)
def _(spark, sf):
    """PDU sessions, radio ids, call ids and charging ids of each person."""
    merged = _merged(spark, sf)[0]
    return R.attribute_values(merged, CHILDREN, F.lit(1.0), "ts").select("subscriber_id", "attribute", "value")


@register("subscriber_bearers", _people_check(_BEARERS + " SELECT * FROM bt", "gtp"))
def _(spark, sf):
    return _bearers(spark, sf, _merged(spark, sf)[1])


@register(
    "subscriber_keys",
    _people_check(
        """, fo AS (SELECT key, tenure, min((t0, obs_id)) AS f FROM ht GROUP BY 1, 2)
        SELECT key, valid_from, min(subscriber_id) AS subscriber_id FROM (
          SELECT key, CASE WHEN tenure = 0 THEN 0 ELSE f[1] END AS valid_from, subscriber_id FROM fo JOIN su ON su.obs_id = f[2]
          UNION ALL SELECT DISTINCT unnest(['imsi:' || imsi, 'msisdn:' || msisdn, 'imei:' || imei]), 0, subscriber_id FROM su) WHERE key IS NOT NULL GROUP BY 1, 2"""
    ),
)
def _(spark, sf):
    """From when on each identifier belonged to whom."""
    return _merged(spark, sf)[1]


@register(
    "subscriber_coverage",
    _people_check(
        _BEARERS + """ SELECT count(*) AS subscribers, count(imsi) AS with_imsi, count(msisdn) AS with_msisdn, count(imei) AS with_imei, count(current_guti) AS with_guti,
        count(*) FILTER (ipv4_values + ipv6_values > 0) AS with_address, count(*) FILTER (tunnel_values > 0) AS with_tunnel,
        count(*) FILTER (subscriber_id IN (SELECT subscriber_id FROM bt WHERE active)) AS with_active_bearer FROM people""",
        "gtp",
    ),
)
def _(spark, sf):
    merged, registry = _merged(spark, sf)
    return R.coverage(_people(merged), _bearers(spark, sf, registry))


@register(
    "stale_subscribers",
    _people_check(" SELECT subscriber_id, primary_key, last_seen FROM people WHERE last_seen < epoch_us(TIMESTAMP '2024-01-30 12:00:00')"),
)
def _(spark, sf):
    people = _people(_merged(spark, sf)[0]).select("subscriber_id", "primary_key", "last_seen")
    return S.not_seen_since(people, "last_seen", F.expr("TIMESTAMP '2024-01-30 12:00:00'"))
