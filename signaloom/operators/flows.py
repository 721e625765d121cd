"""Call flows: every SIP session with the legs of other protocols that belong to it, lookups and counts.

A leg (a Diameter, GTP or NAS session, a media stream) names its party by an address, a number, a subscriber or a
charging id. One claim takes legs of all kinds: a call is repeated once per key of its parties, keys carry their sort as a prefix, and
each leg goes to the earliest-starting call that shares a key with it, the surest sort of key first. NAS legs only know
the subscriber, whom a GTP leg may have told, so they are claimed after the others. SIP sessions other than calls
are flows of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import once
from ..functions.identifiers import party_address
from ..functions.phones import phone_number
from ..session import cut_lineage
from .asof import earliest_claim
from .calls import CALL_TYPES, LEG_TOLERANCE
from .hubs import salted_join
from .timeline import Slab, carry_along, fit_slab, row_number

#: Sorts of party keys and how sure they are; a number counts the same by its national form and by its last digits.
KEY_SORTS = {"icid": 1, "imsi": 2, "number": 3, "ending": 3, "address": 4}
#: Fixed value: numbers that agree in so many last digits are the same.
SUFFIX_DIGITS = 9
# Kinds of flow of the SIP sessions that are no calls.
RESIDUAL_TYPES = {"REGISTRATION": "IMS_REGISTRATION", "SMS_MESSAGE": "MO_SMS"}
VOICE_FLOWS = ("MO_VOICE_CALL", "MT_VOICE_CALL", "VOICE_CALL_FORWARDING", "CONFERENCE_CALL")
VIDEO_FLOWS = ("MO_VIDEO_CALL", "MT_VIDEO_CALL")
DIAMETER_KINDS = ("Gx", "Rx", "Cx", "Sh")
#: The columns a flow names its parties by.
PARTIES = ("caller", "callee", "forward_target")

LEG_COLUMNS = (
    "leg_id", "kind", "start_ts", "end_ts", "keys", "imsi", "number", "messages", "loss_rate", "jitter_ms", "mos",
)


def number_keys(number: Column) -> list[Column]:
    """The keys two texts of one number share: its national form, and its last digits where it has enough."""
    keys = _number_key_pair(number)
    return [keys["number"], keys["ending"]]


def _number_key_pair(number: Column) -> Column:
    def keys(parsed: Column) -> Column:
        digits = parsed["digits"]
        ending = F.when(F.length(digits) >= SUFFIX_DIGITS, F.substring(digits, -SUFFIX_DIGITS, SUFFIX_DIGITS))
        national = F.when(digits != "", parsed["national"])
        return F.struct(F.concat(F.lit("number:"), national).alias("number"), F.concat(F.lit("ending:"), ending).alias("ending"))

    return once(phone_number(number), keys)


def number_key_list(number: Column) -> Column:
    """The known ones of :func:`number_keys`, with the number read once."""
    return once(_number_key_pair(number), lambda k: key_list(k["number"], k["ending"]))


def address_key(address: Column) -> Column:
    return F.concat(F.lit("address:"), party_address(address))


def imsi_key(imsi: Column) -> Column:
    return F.concat(F.lit("imsi:"), F.when(imsi != "", imsi))


def icid_key(icid: Column) -> Column:
    return F.concat(F.lit("icid:"), F.when(icid != "", icid))


def key_list(*keys: Column) -> Column:
    """The keys that are known, each once."""
    return F.array_distinct(F.array_compact(F.array(*keys)))


def key_rank(key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in KEY_SORTS.items() for x in pair])[F.substring_index(key, ":", 1)]


def legs_of(
    sessions: DataFrame, leg_id: Column, kind: Column, keys: Column, imsi: Column | None = None, number: Column | None = None,
    messages: str | Column = "messages", media: bool = False,
) -> DataFrame:
    """Sessions of one protocol in the one shape that claims take (:data:`LEG_COLUMNS`); ``kind`` is one of LEG_TOLERANCE."""
    none = F.lit(None)
    quality = [F.col(c).cast("double").alias(c) if media else none.cast("double").alias(c) for c in ("loss_rate", "jitter_ms", "mos")]
    count = F.col(messages) if isinstance(messages, str) else messages
    return sessions.select(
        leg_id.cast("string").alias("leg_id"), kind.alias("kind"), "start_ts", "end_ts", keys.alias("keys"),
        (none if imsi is None else imsi).cast("string").alias("imsi"), (none if number is None else number).cast("string").alias("number"),
        count.cast("bigint").alias("messages"), *quality,
    )


def flow_id(call_id: Column, start: Column, residual: Column) -> Column:
    """Start in seconds with six places, a mark, and the call id."""
    seconds = F.format_string("%d.%06d", F.floor(F.unix_micros(start) / 1_000_000), F.pmod(F.unix_micros(start), F.lit(1_000_000)))
    return F.concat(seconds, F.when(residual, "_V_SIP_").otherwise("_V_"), call_id)


def flow_type(kind: Column, forward: Column) -> Column:
    """Forwarding before video before voice; what is no call, by what it is."""
    out = F.when(kind.isin(*CALL_TYPES), F.when(forward.isNotNull(), "VOICE_CALL_FORWARDING").when(kind == "VIDEO_CALL", "MO_VIDEO_CALL").otherwise("MO_VOICE_CALL"))
    for session_type, name in RESIDUAL_TYPES.items():
        out = out.when(kind == session_type, name)
    return out.otherwise("UNKNOWN")


def calls_with_subscribers(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Calls with ``caller_imsi, callee_imsi, forward_imsi``, by the number each party goes by.

    ``registry`` has ``number`` and ``imsi``; the smallest of the subscribers that share a number's national form counts. The
    calls are exploded to one row per party, so this is one join whatever the number of parties.
    """
    # A registry states the same number many times over: each is read once, with the one subscriber that can count.
    numbers = registry.filter("imsi <> ''").groupBy("number").agg(F.min("imsi").alias("imsi"))
    named = numbers.select(F.explode(number_key_list(F.col("number"))).alias("_key"), "imsi")
    of_key = named.groupBy("_key").agg(F.min("imsi").alias("_imsi"))
    parties = F.array(*[F.struct(F.lit(p).alias("party"), F.col(p).alias("number")) for p in PARTIES])
    asked = calls.select("call_id", F.inline(parties)).filter("number <> ''")
    asked = asked.select("call_id", "party", F.posexplode(number_key_list(F.col("number"))).alias("_place", "_key"))
    found = salted_join(asked, of_key, ["_key"]).groupBy("call_id").agg(
        *[F.min_by("_imsi", F.when(F.col("party") == p, F.col("_place"))).alias(f"{p.split('_')[0]}_imsi") for p in PARTIES]
    )
    return calls.join(found, "call_id", "left")


def claim(calls: DataFrame, keys: Column, legs: DataFrame, slab: Slab = None) -> DataFrame:
    """(``leg_id, call_id``): each leg with the call that claims it, legs of all kinds in one pass.

    ``keys`` are those of a call's parties. A leg must begin within the call, widened by the tolerance of its kind; a media leg
    only has to overlap. Of the calls that share a key, the surest sort of key wins, then the earliest start, then the lowest id.
    """
    parties = calls.select("call_id", "start_ts", "end_ts", F.explode(keys).alias("key"))
    seconds = F.create_map(*[F.lit(x) for pair in LEG_TOLERANCE.items() for x in pair])[F.col("kind")]
    keyed = legs.select(
        "leg_id", "kind", F.col("start_ts").alias("_s"), F.when(F.col("kind") == "RTP", F.col("end_ts")).otherwise(F.col("start_ts")).alias("_e"),
        F.explode("keys").alias("key"),
    )
    return earliest_claim(
        keyed, parties, ["key"], "leg_id", "_s", "_e", "call_id", "start_ts", "end_ts", seconds.cast("bigint") * 1_000_000, slab,
        rank=key_rank(F.col("key")),
    )


def subscribers_told_by_legs(calls: DataFrame, claimed: DataFrame, legs: DataFrame) -> DataFrame:
    """Calls whose unknown subscribers are filled in from claimed GTP legs of the same number, the earliest first."""
    told = legs.filter("kind = 'GTP' and imsi <> '' and number <> ''").select(
        "leg_id", F.col("start_ts").alias("_at"), F.col("imsi").alias("_imsi"), number_key_list(F.col("number")).alias("_keys")
    )
    numbers = calls.select("call_id", *[number_key_list(F.col(p)).alias(f"_{p}") for p in PARTIES])
    met = claimed.select("leg_id", "call_id").join(told, "leg_id").join(numbers, "call_id")
    first = met.groupBy("call_id").agg(*[
        F.min_by("_imsi", F.when(F.arrays_overlap(F.col(f"_{p}"), F.col("_keys")), F.struct("_at", "leg_id"))).alias(f"_told_{p}") for p in PARTIES
    ])
    filled = {f"{p.split('_')[0]}_imsi": F.coalesce(F.col(f"{p.split('_')[0]}_imsi"), F.col(f"_told_{p}")) for p in PARTIES}
    return calls.join(first, "call_id", "left").withColumns(filled).drop(*[f"_told_{p}" for p in PARTIES])


def party_keys() -> Column:
    """The keys of a call's parties that legs other than NAS may name."""
    others = key_list(icid_key(F.col("icid")), *[address_key(F.col(c)) for c in ("caller_ip", "callee_ip")])
    return F.array_union(F.concat(number_key_list(F.col("caller")), number_key_list(F.col("callee"))), others)


def assemble(
    sessions: DataFrame, legs: DataFrame, registry: DataFrame, slab: Slab = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flows, (``leg_id, call_id, kind``) of the legs they claimed, and all legs; all three are written.

    ``sessions`` are SIP sessions with ``forward_target`` (null: none) and, where known, ``icid``; ``legs`` as :func:`legs_of`.
    """
    legs = cut_lineage(legs.select(*LEG_COLUMNS), "legs")
    known = cut_lineage(_with_icid(sessions), "sip_sessions")
    # one width for both claims: what the heaviest key of any leg needs
    slab = fit_slab(legs.select(F.explode("keys").alias("key"), "start_ts"), ["key"], "start_ts") if slab is None else slab
    is_call = F.col("session_type").isin(*CALL_TYPES)
    calls = cut_lineage(calls_with_subscribers(known.filter(is_call), registry), "calls")
    first = claim(calls, party_keys(), legs.filter("kind <> 'NAS'"), slab)
    first = cut_lineage(first, "claimed")
    calls = cut_lineage(subscribers_told_by_legs(calls, first, legs), "told_calls")
    subscribers = key_list(*[imsi_key(F.col(c)) for c in ("caller_imsi", "callee_imsi")])
    second = claim(calls, subscribers, legs.filter("kind = 'NAS'"), slab)
    claimed = cut_lineage(first.unionByName(second).join(legs.select("leg_id", "kind"), "leg_id"), "all_claimed")
    residual = known.filter(~is_call).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name in ("caller", "callee", "caller_ip", "callee_ip", "forward_target") else f.name for f in known.schema.fields]
    )
    flows = calls.unionByName(residual, allowMissingColumns=True)
    flows = flows.withColumn("flow_type", flow_type(F.col("session_type"), F.col("forward_target")))
    flows = flows.withColumn("flow_id", flow_id(F.col("call_id"), F.col("start_ts"), ~is_call))
    return cut_lineage(with_leg_totals(flows, claimed, legs), "flows"), claimed, legs


def _with_icid(sessions: DataFrame) -> DataFrame:
    return sessions if "icid" in sessions.columns else sessions.withColumn("icid", F.lit(None).cast("string"))


def ratings(sessions: DataFrame, streams: DataFrame, slab: Slab = None) -> DataFrame:
    """(``call_id, mos``): every SIP session with the worst rating of the media streams it claims, as :func:`assemble` has it.

    Each leg is claimed for itself, and a stream by no subscriber that another leg tells: so streams alone give the same ratings.
    """
    streams = cut_lineage(streams.filter("kind = 'RTP'").select(*LEG_COLUMNS), "streams")
    known = cut_lineage(_with_icid(sessions), "sip_sessions")
    slab = fit_slab(streams.select(F.explode("keys").alias("key"), "start_ts"), ["key"], "start_ts") if slab is None else slab
    claimed = claim(known.filter(F.col("session_type").isin(*CALL_TYPES)), party_keys(), streams, slab)
    return with_leg_totals(known, claimed, streams).select("call_id", "mos")


def with_leg_totals(flows: DataFrame, claimed: DataFrame, legs: DataFrame) -> DataFrame:
    """Flows with legs per kind, messages per protocol, and the worst loss and rating and mean jitter of their streams."""
    media = F.col("kind") == "RTP"
    per_call = claimed.select("leg_id", "call_id").join(legs, "leg_id").groupBy("call_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k.lower()}_legs") for k in LEG_TOLERANCE],
        F.sum(F.when(F.col("kind").isin(*DIAMETER_KINDS), F.col("messages"))).alias("diameter_messages"),
        *[F.sum(F.when(F.col("kind") == k, F.col("messages"))).alias(n) for k, n in (("GTP", "gtp_messages"), ("NAS", "nas_messages"), ("RTP", "rtp_packets"))],
        F.max(F.when(media & (F.col("loss_rate") > 0), F.col("loss_rate") * 100.0)).alias("max_loss_percent"),
        F.avg(F.when(media & (F.col("jitter_ms") > 0), F.col("jitter_ms"))).alias("jitter_ms"),
        F.min(F.when(media & (F.col("mos") > 0), F.col("mos"))).alias("mos"),
    )
    counts = [f"{k.lower()}_legs" for k in LEG_TOLERANCE] + ["diameter_messages", "gtp_messages", "nas_messages", "rtp_packets"]
    return flows.withColumnRenamed("messages", "sip_messages").join(per_call, "call_id", "left").na.fill(0, counts)


def leg_times(claimed: DataFrame, legs: DataFrame) -> DataFrame:
    """Per call, when its first leg of each kind began and, if it went on, ended, in the columns that a call's diagram shows."""
    place = F.struct("start_ts", "leg_id")
    each = claimed.select("leg_id", "call_id").join(legs.select("leg_id", "kind", "start_ts", "end_ts"), "leg_id")
    names = {"Rx": ("rx_request_ts", "rx_answer_ts"), "Gx": ("gx_request_ts", "gx_answer_ts"), "GTP": ("bearer_request_ts", "bearer_response_ts")}
    first = [F.min_by("start_ts", F.when(F.col("kind") == k, place)).alias(begin) for k, (begin, _) in names.items()]
    last = [
        F.min_by(F.when(F.col("end_ts") > F.col("start_ts"), F.col("end_ts")), F.when(F.col("kind") == k, place)).alias(end) for k, (_, end) in names.items()
    ]
    return each.groupBy("call_id").agg(*first, *last, F.min(F.when(F.col("kind") == "RTP", F.col("start_ts"))).alias("media_ts"))


def flow_frames(flows: DataFrame, sip: DataFrame, claimed: DataFrame, leg_frames: DataFrame) -> DataFrame:
    """Child table (``flow_id, protocol, frame_number``): the frames of a flow's SIP messages and of its legs.

    ``sip`` has call_id and frame_number, ``leg_frames`` leg_id, protocol and frame_number.
    """
    names = flows.select("call_id", "flow_id")
    own = sip.select("call_id", F.lit("SIP").alias("protocol"), "frame_number")
    of_legs = salted_join(leg_frames, claimed.select("leg_id", "call_id"), ["leg_id"]).select("call_id", "protocol", "frame_number")
    return salted_join(own.unionByName(of_legs), names, ["call_id"]).select("flow_id", "protocol", "frame_number").distinct()


def flows_by_id(flows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Flows whose id is listed in ``wanted`` (``flow_id``)."""
    return flows.join(wanted.select("flow_id").distinct(), "flow_id", "left_semi")


def flows_by_number(flows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Flows of listed numbers (``number``) with the ``number`` asked for: caller, callee or target of a forwarding.

    Numbers are compared by all their digits, however they are written; each flow comes once per number.
    """
    digits = lambda c: once(phone_number(c)["digits"], lambda d: F.when(d != "", d))
    asked = wanted.select("number", digits(F.col("number")).alias("_digits")).distinct()
    ends = flows.withColumn("_digits", F.explode(key_list(*[digits(F.col(p)) for p in PARTIES])))
    return ends.join(asked, "_digits").drop("_digits")


def flows_by_subscriber(flows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Flows of listed subscribers (``imsi``), each once per subscriber."""
    ends = flows.withColumn("imsi", F.explode(key_list(*[F.col(f"{p.split('_')[0]}_imsi") for p in PARTIES])))
    return ends.join(wanted.select("imsi").distinct(), "imsi")


def flows_by_frame(flows: DataFrame, frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Flows that hold a listed frame (``frame_number``), with the frame and its protocol."""
    hit = frames.join(wanted.select("frame_number").distinct(), "frame_number")
    return flows.join(hit, "flow_id")


def voice_flows(flows: DataFrame) -> DataFrame:
    return flows.filter(F.col("flow_type").isin(*VOICE_FLOWS))


def video_flows(flows: DataFrame) -> DataFrame:
    return flows.filter(F.col("flow_type").isin(*VIDEO_FLOWS))


def flow_counts(flows: DataFrame, legs: DataFrame, claimed: DataFrame) -> DataFrame:
    """(``what, n``): flows in total and by type, and the legs of each kind that no call claimed."""
    in_total = flows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("flows").alias("what"), "n")
    by_type = flows.groupBy(F.concat(F.lit("flows "), "flow_type").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    left = legs.join(claimed.select("leg_id"), "leg_id", "left_anti")
    by_kind = left.groupBy(F.concat(F.lit("unclaimed "), "kind").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return in_total.unionByName(by_type).unionByName(by_kind)


def flow_documents(flows: DataFrame, legs: DataFrame, claimed: DataFrame, part_legs: int = 1000, slab: Slab = None) -> DataFrame:
    """(``flow_id, part, document``): each flow as JSON with its legs, so many to a document; further legs follow in parts."""
    of_flow = claimed.select("leg_id", "call_id").join(legs, "leg_id")
    numbered = carry_along(of_flow, ["call_id"], ["start_ts", "leg_id"], slab, _n=row_number())
    entry = F.struct("_n", F.struct("leg_id", "kind", "start_ts", "end_ts", "imsi", "number", "messages", "loss_rate", "jitter_ms", "mos").alias("leg"))
    parts = numbered.groupBy("call_id", F.floor((F.col("_n") - 1) / part_legs).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["leg"]).alias("legs")
    )
    head = [c for c in flows.columns if c != "legs"]
    whole = flows.join(parts, "call_id", "left").withColumn("part", F.coalesce("part", F.lit(0)).cast("bigint"))
    first = F.struct(*head, "part", "legs")
    rest = F.struct("flow_id", "part", "legs")
    return whole.select("flow_id", "part", F.when(F.col("part") == 0, F.to_json(first)).otherwise(F.to_json(rest)).alias("document"))
