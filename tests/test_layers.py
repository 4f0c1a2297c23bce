from pyspark.sql import functions as F

import tidewire
from tidewire.functions import layers, text

INNER = bytes.fromhex("45000028000000004006000001020304050607080FA0005000000007000000005012000000000000")
MAC = bytes(range(12))


def kinds(data, first="eth"):
    return [(x["kind"], x["offset"], x["header_len"], x["total_len"], x["next_pt"]) for x in layers.layers(data, first)]


def test_layers_cut_at_every_byte():
    outer = bytes.fromhex("4500004400000000202F00000A000001C0A80102")
    frame = MAC + b"\x81\x00\xe0\x07\x08\x00" + outer + bytes.fromhex("20006558DEADBEEF") + MAC + b"\x08\x00" + INNER
    whole = kinds(frame)
    assert [k for k, *_ in whole] == ["eth", "vlan", "ipv4", "gre", "eth", "ipv4", "tcp"]
    for n in range(len(frame)):
        got = kinds(frame[:n])
        assert got == whole[: len(got)] and (len(got) == len(whole) or n < whole[len(got)][1] + whole[len(got)][2])
    by = {x["kind"]: dict(x["fields"]) for x in layers.layers(frame)}
    assert by["vlan"] == {"vlan_id": "7", "priority": "7"} and by["gre"] == {"key": str(0xDEADBEEF)} and by["tcp"]["flags"] == "18" and by["ipv4"]["src"] == "1.2.3.4"


def test_ends_of_chains():
    ip6 = bytes.fromhex("6000000000141140") + bytes(15) + b"\x01" + bytes(15) + b"\x02"
    assert kinds(ip6 + bytes.fromhex("00350868001400003210FFFF"), "ip") == [("ipv6", 0, 40, 60, 17), ("udp", 40, 8, 20, 0)]
    fragment = bytearray(INNER)
    fragment[7] = 9
    assert [k for k, *_ in kinds(bytes(fragment), "ip")] == ["ipv4"]
    assert kinds(bytes.fromhex("49000000000000004006") + bytes(10), "ip") == [] == kinds(b"") == kinds(b"\x12" * 9, "pppoe")
    gtp = bytes.fromhex("3001000400000001")
    assert kinds(gtp + INNER, "gtp") == [("gtp", 0, 8, 12, 0)]


def test_rows(spark):
    frames = spark.createDataFrame([("a", MAC + b"\x08\x00" + INNER, 1), ("b", None, 2), ("c", b"", 3)], "k string, kind binary, n int")
    got = layers.layer_rows(frames, "k", "kind").orderBy("n").collect()
    assert [(r.k, r.n, r.kind, r.offset) for r in got] == [("a", 0, "eth", 0), ("a", 1, "ipv4", 14), ("a", 2, "tcp", 34)]
    assert layers.layer_rows(frames.limit(0), "k", "kind").count() == 0


def test_arguments(spark):
    rows = [(" a\tb  c ", b"\x02\0\0\0ab\0c"), ("", b"\x02\0\0\0ab\0"), (None, None), (" ", b"\x01\0\0\0x"), ("x", b"\x01\0\0\0"), ("y", b"\x03\0\0\0a\0\0\0"), ("z", b"\0\0\0\xff\xff"), ("z", b"\0\0\0\0a")]
    df = spark.createDataFrame(rows, "s string, d binary").select(text.arguments(F.col("s")).alias("a"), text.packed_arguments(F.col("d")).alias("p"), text.type_name(F.col("d")).alias("t"))
    got = df.collect()
    assert [r.a for r in got][:5] == [["a", "b", "c"], None, None, None, ["x"]]
    assert [r.p for r in got] == [["ab", "c"], None, None, ["x"], None, ["a", "", ""], None, None]
    assert {r.t for r in got} == {"binary"} and tidewire.__version__
