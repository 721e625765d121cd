"""Key merging, hub handling, matching and identifiers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from signaloom.functions import identifiers, phones
from signaloom.operators import components, hubs
from signaloom.operators import matching as M


def union_find(data):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for row, nodes in data:
        for node in nodes:
            a, b = find(("row", row)), find(node)
            if a != b:
                parent[a] = b
    groups = {}
    for row, nodes in data:
        if nodes:
            groups.setdefault(find(("row", row)), []).append(row)
    return {row: min(rows) for rows in groups.values() for row in rows}


def random_rows(seed, rows=250, keys=170):
    rng = random.Random(seed)
    return [(i, [f"n{rng.randrange(keys)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))]) for i in range(rows)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("salted", [False, True])
def test_merge_by_keys(spark, monkeypatch, seed, salted):
    if salted:
        # Thresholds low enough that the salted joins run on every round.
        monkeypatch.setattr(components, "HUB_DEGREE", 2)
        monkeypatch.setattr(components, "HUB_ROWS", 2)
        monkeypatch.setattr(hubs, "HUB_ROWS", 2)
    data = random_rows(seed)
    df = spark.createDataFrame(data, "id bigint, nodes array<string>")
    got = components.merge_by_keys(df, "nodes", "id")
    assert {r.id: r.session_id for r in got.collect()} == union_find(data)


def test_merge_does_not_depend_on_row_order(spark):
    data = random_rows(7, 120, 90)
    shuffled = random.Random(1).sample(data, len(data))
    results = [
        {(r.id, r.session_id) for r in components.merge_by_keys(spark.createDataFrame(d, "id bigint, nodes array<string>"), "nodes", "id").collect()}
        for d in (data, shuffled)
    ]
    assert results[0] == results[1]


def test_long_chain_and_unfinished_labels(spark):
    chain = [(i, [f"k{i:04d}", f"k{i + 1:04d}"]) for i in range(300)]
    df = spark.createDataFrame(chain, "id bigint, nodes array<string>")
    assert {r.session_id for r in components.merge_by_keys(df, "nodes", "id").collect()} == {0}
    with pytest.raises(RuntimeError):
        components.merge_by_keys(df, "nodes", "id", max_rounds=1)


def test_incremental_merge_equals_batch(spark):
    data = random_rows(3, 150, 120)
    known = spark.createDataFrame([], "node string, session_id bigint")
    for part in (data[:50], data[50:100], data[100:]):
        rows = spark.createDataFrame(part, "id bigint, nodes array<string>").filter(F.size("nodes") > 0)
        known, _remap = components.merge_by_keys_incremental(rows, known, "id", "nodes")
        known = known.persist()
    expected = union_find(data)
    by_node = {r.node: r.session_id for r in known.collect()}
    assert {row: by_node[nodes[0]] for row, nodes in data if nodes} == expected


def test_merge_by_phone(spark):
    """A SIP row with an asserted number and a Diameter row with the same number form one session."""
    rows = spark.createDataFrame([(1, "1234567890", "call-1"), (2, "1234567890", None), (3, None, None)], "id bigint, msisdn string, icid string")
    nodes = components.key_nodes({"msisdn": F.col("msisdn"), "icid": F.col("icid")})
    got = components.merge_by_keys(rows.withColumn("nodes", nodes), "nodes", "id").collect()
    assert {r.id: r.session_id for r in got} == {1: 1, 2: 1}


def test_only_listed_keys_go(spark):
    schema = "id bigint, key_type string, key_value string"
    keyed = spark.createDataFrame([(i, "ip", "server") for i in range(5)] + [(i, "imsi", "x") for i in range(9)], schema)
    kept = components.without_listed(keyed, spark.createDataFrame([(0, "ip", "server")], schema))
    assert {r.key_value for r in kept.collect()} == {"x"} and kept.count() == 9


def test_salted_join_keeps_every_row(spark):
    facts = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1), ("none", 2)], "k string, v int")
    facts = facts.withColumn("tags", F.create_map(F.lit("a"), F.col("v")))
    dims = spark.createDataFrame([("hot", "H"), ("cold", "C"), ("unused", "U")], "k string, d string")
    got = hubs.salted_join(facts, dims, ["k"], "left", hub_rows=50, salts=4)
    assert sorted((r.k, r.v, r.d) for r in got.collect() if r.k != "hot") == [("cold", 1, "C"), ("none", 2, None)]
    assert sum(r.d == "H" for r in got.collect()) == 200


PHONES = [
    ("sip:+14155551234@ims.example.com;user=phone", "14155551234", "1", "4155551234"),
    ("sip:4155551234@ims.example.com", "4155551234", "", "4155551234"),
    ("tel:+1 (415) 555-1234", "14155551234", "1", "4155551234"),
    ("04155551234", "04155551234", "", "4155551234"),
    ("sip:+905321234567@domain", "905321234567", "90", "5321234567"),
    ("tel:+44-20-7946-0958", "442079460958", "44", "2079460958"),
    ("msisdn-35312345", "35312345", "353", "12345"),
    ("tel:0000", "0000", "", "0"),
    ("sip:alice@host7", "7", "", "7"),
]


def test_phone_numbers(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHONES)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", phones.phone_number("t").alias("p")).collect()}
    for i, (_, digits, country, national) in enumerate(PHONES):
        assert (got[i].digits, got[i].country, got[i].national, got[i].international) == (digits, country, national, digits), PHONES[i]


def test_subscriber_and_device_numbers(spark):
    df = spark.createDataFrame(
        [("imsi-310260123456789",), ("234151234567890@realm",), ("123",), ("199260123456789",)], "t string"
    ).select("t", identifiers.imsi("t").alias("s"))
    got = {r.t: (r.s.mcc, r.s.mnc, r.s.msin) if r.s else None for r in df.collect()}
    assert got == {
        "imsi-310260123456789": ("310", "260", "123456789"), "234151234567890@realm": ("234", "15", "1234567890"),
        "123": None, "199260123456789": None,
    }
    devices = spark.createDataFrame([("imei:490154203237518",), ("490154203237517",), ("49015420323751",), ("4901542032375101",), ("7",)], "t string")
    found = {r.t: (r.d.imei, r.d.check_ok, r.d.imeisv) if r.d else None for r in devices.select("t", identifiers.imei("t").alias("d")).collect()}
    assert found["imei:490154203237518"] == ("49015420323751", True, None)
    assert found["490154203237517"] == ("49015420323751", False, None)
    assert found["4901542032375101"] == ("49015420323751", None, "4901542032375101")
    assert found["49015420323751"] == ("49015420323751", None, None) and found["7"] is None


def test_number_matches_equal_pairwise_rule(spark):
    rng = random.Random(5)
    texts = ["+1415555" + str(rng.randrange(100, 130)) + "7" for _ in range(12)] + ["4155551", "5551117", "0415555110", "tel:+90532" + "4155551107"]
    df = spark.createDataFrame([(t if ":" in t else "tel:" + t,) for t in texts], "t string").select(phones.phone_number("t").alias("phone"))
    parsed = {r.phone.digits: r.phone for r in df.collect()}

    def matches(a, b):
        same_end = len(a.digits) >= 9 and len(b.digits) >= 9 and a.digits[-9:] == b.digits[-9:]
        held = len(a.national) > 6 and len(b.national) > 6 and (a.national in b.national or b.national in a.national)
        return a.national == b.national or a.international == b.international or same_end or held

    expected = {(a, b) for a, b in itertools.product(parsed, parsed) if matches(parsed[a], parsed[b])}
    got = M.number_matches(df, df, containment=True).collect()
    assert {(r.probe, r.number) for r in got} == expected
    assert len(got) == len(expected)


def identity(**given):
    names = ("imsi", "imei", "mcc", "mnc", "mme_group_id", "tmsi", "digits", "national", "international", "ipv4", "ipv6", "apn", "teid")
    return tuple(given.get(n) for n in names)


IDENTITY = (
    "imsi string, imei string, mcc string, mnc string, mme_group_id int, tmsi bigint, digits string, national string, "
    "international string, ipv4 string, ipv6 string, apn string, teid bigint"
)
CASES = [
    (dict(imsi="1"), dict(imsi="1"), 1.0, 1.0),
    (dict(imei="35000000000001"), dict(imei="35000000000002"), 0.3, 0.3),
    (dict(mcc="310", mnc="260", tmsi=5), dict(mcc="310", mnc="260", tmsi=5), 1.0, 1.0),
    (dict(mcc="310", mnc="260", mme_group_id=2, tmsi=5), dict(mcc="310", mnc="260", mme_group_id=2, tmsi=6), 0.4, 0.4),
    (dict(national="4155551234", international="14155551234", digits="14155551234"),
     dict(national="4155551234", international="4155551234", digits="4155551234"), 0.95, 0.95),
    (dict(national="1112345678", international="1112345678", digits="1112345678"),
     dict(national="2222345678", international="2222345678", digits="2222345678"), 0.6, 0.6),
    (dict(ipv4="10.0.0.1", apn="ims"), dict(ipv4="10.0.0.1", apn="ims"), 0.9, 0.9),
    (dict(ipv4="10.0.0.1", apn="ims"), dict(ipv4="10.0.0.1", apn="internet"), 0.75, 0.75),
    (dict(ipv6="2001:db8:1:2:0:0:0:1"), dict(ipv6="2001:db8:1:2:0:0:0:9"), 0.5, 0.5),
    (dict(imei="35000000000001", teid=7), dict(imei="35000000000002", teid=7), 0.3, 0.85),
    (dict(imsi="1"), dict(imsi="2"), 0.0, 0.0),
]


def test_identity_scores_and_registry(spark):
    pairs = spark.createDataFrame(
        [(i, identity(**a), identity(**b)) for i, (a, b, _, _) in enumerate(CASES)], f"i int, l struct<{IDENTITY}>, r struct<{IDENTITY}>".replace(" string", ":string").replace(" int,", ":int,").replace(" bigint", ":bigint").replace("i:int,", "i int,")
    )
    cascade, best = M.identity_score("l", "r")
    got = {r.i: (round(r.c, 6), round(r.b, 6)) for r in pairs.select("i", cascade.alias("c"), best.alias("b")).collect()}
    assert got == {i: (c[2], c[3]) for i, c in enumerate(CASES)}
    # One pair at a time, a registry of one entity gives the same cascade and best score.
    for i, (a, b, first, top) in enumerate(CASES):
        probes = spark.createDataFrame([(1, *identity(**a))], "probe_id int, " + IDENTITY)
        registry = spark.createDataFrame([(9, *identity(**b))], "entity_id int, " + IDENTITY)
        for flag, score in ((True, first), (False, top)):
            found = M.match_registry(probes, registry, "probe_id", "entity_id", cascade=flag).collect()
            assert [round(r.score, 6) for r in found] == ([score] if score else []), (i, flag)


@pytest.mark.parametrize("hub_rows", [None, 1])
def test_registry_takes_the_best_of_all_ways(spark, hub_rows):
    model = "35000000000001", "35000000000002"
    entities = [
        (1, identity(imei=model[0])), (2, identity(national="4155551234", digits="14155551234", international="14155551234")),
        (3, identity(ipv4="10.0.0.3", ipv6="2001:db8:1:2:0:0:0:1")), (3, identity(ipv4="10.0.0.4", teid=5)), (4, identity(national="2125550000000")),
        (5, identity(ipv6="2001:db8:9:9:0:0:0:1", apn="ims")),
    ]
    wanted = [
        (11, identity(imei=model[1], national="4155551234", digits="14155551234", international="14155551234"), (2, "msisdn", "EXACT")),
        (12, identity(ipv4="10.9.9.9", ipv6="2001:db8:1:2:0:0:0:1"), (3, "ip", "HIGH")),
        (13, identity(teid=5), (3, "teid", "HIGH")),
        (14, identity(national="25550000000"), (4, "msisdn_contained", "HIGH")),
        (15, identity(ipv6="2001:db8:9:9:0:0:0:7", apn="ims"), (5, "ip_apn", "HIGH")),
        (16, identity(imsi="9"), None),
    ]
    registry = spark.createDataFrame([(i, *who) for i, who in entities], "entity_id int, " + IDENTITY)
    probes = spark.createDataFrame([(i, *who) for i, who, _ in wanted], "probe_id int, " + IDENTITY)
    found = M.match_registry(probes, registry, "probe_id", "entity_id", hub_rows=hub_rows).collect()
    assert {r.probe_id: (r.entity_id, r.how, r.confidence) for r in found} == {i: hit for i, _, hit in wanted if hit}


@pytest.mark.parametrize("hub_rows", [None, 1])
def test_address_owners(spark, hub_rows):
    schema = "id int, v4 string, v6 string"
    owners = spark.createDataFrame([("b", "10.0.0.1", None), ("a", None, "2001:db8:1:2:0:0:0:1"), ("c", None, "2001:db8:1:2:0:0:0:9")], "who string, v4 string, v6 string")
    rows = spark.createDataFrame([(1, "10.0.0.1", None), (2, None, "2001:db8:1:2:5:5:5:5"), (3, "10.0.0.1", "2001:db8:1:2:0:0:0:1"), (4, None, None), (5, "10.9.9.9", None)], schema)
    found = M.address_owners(rows, owners, ("v4", "v6"), "who", hub_rows=hub_rows).collect()
    assert {r.id: (r.who, r.matches) for r in found} == {1: ("b", 1), 2: ("a", 2), 3: ("a", 3), 4: (None, 0), 5: (None, 0)}


def test_many_edges_without_a_hub_are_not_salted(spark, monkeypatch):
    """Salting is for nodes with very many edges, not for graphs that have many in all; nodes that share a hash stay apart."""
    def refuse(*args, **kwargs):
        raise AssertionError("salted")

    monkeypatch.setattr(components, "HUB_DEGREE", 10)
    monkeypatch.setattr(components, "salted_join", refuse)
    pairs = [(f"n{k}", f"n{k + 1}") for k in range(40) if k % 10 != 9]
    edges = spark.createDataFrame(pairs, "a string, b string")

    def groups():
        found = {}
        for r in components.component_labels(edges).collect():
            found.setdefault(r["component"], set()).add(r["node"])
        return sorted(map(sorted, found.values()))

    want = sorted(sorted(f"n{k}" for k in range(10 * g, 10 * g + 10)) for g in range(4))
    assert groups() == want
    monkeypatch.setattr(components, "HUB_DEGREE", 1_000_000)
    monkeypatch.setattr(components, "_hashed", lambda node: F.pmod(F.xxhash64(node), F.lit(7)))
    assert groups() == want


def test_components_of_numbers(spark, monkeypatch):
    """BIGINT nodes are not numbered: labels are their smallest nodes, negative ones too, with and without hubs."""
    pairs = [(k, k + 1) for k in range(-40, 40) if k % 20 != 19] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, None)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = {k: k // 20 * 20 for k in range(-40, 40)} | dict.fromkeys(range(100, 160), 100)
    monkeypatch.setattr(components, "_hashed", None)
    for hub in (1_000_000, 10):
        monkeypatch.setattr(components, "HUB_DEGREE", hub)
        assert {r["node"]: r["component"] for r in components.component_labels(edges).collect()} == want
