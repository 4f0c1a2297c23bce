import datetime
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidewire.sources import captures
from tidewire.sources.files import read_pcap


def frame(src, dst, protocol, ports, vlan=False, body=b""):
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 40 + len(body), 0, 0, 64, protocol, 0) + bytes(src) + bytes(dst)
    return bytes(12) + (b"\x81\x00\x00\x07" if vlan else b"") + b"\x08\x00" + ip + struct.pack(">HH", *ports) + bytes(16) + body


def capture(packets, order="<", magic=0xA1B2C3D4):
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack(order + "IIII", t // 1000000, t % 1000000, len(d), len(d)) + d for t, d in packets)


def packets(n, seed=1):
    r = random.Random(seed)
    kinds = [b"", bytes(200), r.randbytes(300), capture([(5, b"abcdef"), (6, b"x" * 40)])[24:], capture([(1, b"y")] * 30)[24:]]
    return [(1_600_000_000_000_000 + 1000 * i, frame((10, 0, 0, i % 5), (10, 0, 1, i % 7), (6, 17)[i % 2], (1000 + i % 9, 80), i % 3 == 0, r.choice(kinds))) for i in range(n)]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tail", [b"", bytes(5), struct.pack("<IIII", 1, 1, 500, 500) + bytes(90)])
def test_ranges_give_the_records_of_the_whole_file(spark, tmp_path, order, tail):
    """Payloads of zeros, of noise and of records; small ranges, so that many begin inside a packet."""
    want = packets(3000)
    content = capture(want, order) + tail
    (tmp_path / "a.pcap").write_bytes(content)
    for split in (50_000, 333_333):
        got = captures.read_captures(spark, str(tmp_path), ("offset", "ts", "data"), split)
        assert got.rdd.getNumPartitions() == -(-len(content) // split)
        rows = got.select(F.unix_micros("ts").alias("us"), "data").collect()
        assert [(r.us, bytes(r.data)) for r in rows] == want


def test_a_file_far_larger_than_what_is_searched(spark, tmp_path):
    want = packets(60_000, seed=2)
    (tmp_path / "b.pcap").write_bytes(capture(want))
    got = captures.read_captures(spark, str(tmp_path / "b.pcap"), split_bytes=700_000)
    whole = read_pcap(spark, str(tmp_path / "b.pcap"))
    assert got.count() == whole.count() == 60_000
    assert got.exceptAll(whole).count() == 0 and got.rdd.getNumPartitions() > 15


def test_ranges_that_cannot_be_proved_fail(spark, tmp_path):
    """A record over the longest: its insides cannot be told from headers, which no split may pass over in silence."""
    inside = capture([(1, b"z" * 100)] * 6000)[24:]
    (tmp_path / "c.pcap").write_bytes(capture([(1, b"a" * 50), (2, inside), (3, b"b" * 60)]))
    with pytest.raises(Exception, match="ambiguous"):
        captures.read_captures(spark, str(tmp_path), split_bytes=300_000).count()
    assert captures.read_captures(spark, str(tmp_path), split_bytes=0).count() == 3


def test_conditions(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(packets(500)))
    (tmp_path / ".hidden").write_bytes(b"nothing")
    start = datetime.datetime(2020, 9, 13, 12, 26, 40, 100_000, tzinfo=datetime.timezone.utc)

    def ports(conditions):
        rows = captures.read_captures(spark, str(tmp_path), ("src_port",), 50_000, conditions)
        return sorted(r.src_port - 1000 for r in rows.collect())

    some = [("protocol", "=", 17), ("src", "=", "10.0.0.3"), ("src_port", "!=", 1001), ("ts", ">=", start)]
    assert ports(some) == sorted(i % 9 for i in range(100, 500) if i % 2 and i % 5 == 3 and i % 9 != 1)
    assert ports([some[:2], [("src_port", "in", [1001, 1002])]]) == sorted(i % 9 for i in range(500) if i % 9 in (1, 2) or i % 2 and i % 5 == 3)
    both = captures.read_captures(spark, str(tmp_path), ("src_port", "protocol"))  # one DataFrame, several filters of Spark's
    assert both.where("protocol = 17").count() == 250 and both.where("src_port is null").count() == 0
    assert both.where("src_port in (1001, 1002) or protocol = 6").count() == sum(1 for i in range(500) if i % 9 in (1, 2) or i % 2 == 0)
    with pytest.raises(Exception, match="condition data"):
        ports([("data", "=", "x")])


def test_no_ports_and_odd_files(spark, tmp_path):
    odd = [b"", b"abc", bytes(12) + b"\x08\x06" + bytes(28), frame((1, 2, 3, 4), (5, 6, 7, 8), 1, (0, 0)), bytes(12) + b"\x86\xdd\x60" + bytes(5) + b"\x11" + bytes(33) + b"\x00\x35\x00\x36"]
    (tmp_path / "a.pcap").write_bytes(capture([(i, d) for i, d in enumerate(odd)], magic=0xA1B23C4D))
    (tmp_path / "b.pcap").write_bytes(b"")
    (tmp_path / "c.pcap").write_bytes(b"\xd4\xc3")
    rows = captures.read_captures(spark, str(tmp_path), ("ether_type", "protocol", "src", "dst_port")).collect()
    assert [tuple(r) for r in rows] == [(None,) * 4, (None,) * 4, (0x806, None, None, None), (0x800, 1, "1.2.3.4", None), (0x86DD, 17, "::", 54)]
    (tmp_path / "d.pcap").write_bytes(b"no capture file, but long enough")
    with pytest.raises(Exception, match="no capture file"):
        captures.read_captures(spark, str(tmp_path)).count()


def test_written_files_come_back(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    df = spark.range(1000).select(F.timestamp_micros(F.col("id") * 1500 + 1).alias("ts"), F.encode(F.concat(F.lit("packet "), "id"), "UTF-8").alias("data"), (F.col("id") % 100).alias("len"))
    odd = spark.createDataFrame([(None, bytearray(b"q"), None), (None, None, 5)], "ts timestamp, data binary, len long")
    captures.write_captures(df.repartition(3), folder)
    captures.write_captures(odd.repartition(1), folder)
    got = captures.read_captures(spark, folder, split_bytes=5000)
    want = df.select("ts", F.octet_length("data").cast("long").alias("caplen"), F.greatest("len", F.octet_length("data")).cast("long").alias("len"), "data")
    assert got.where("caplen > 1").exceptAll(want).count() == 0 and got.count() == 1001
    assert got.where("caplen = 1").select("ts", "data").first() == (spark.sql("select timestamp_micros(0)").first()[0], b"q")
    captures.write_captures(df.limit(7), folder, "overwrite")
    assert captures.read_captures(spark, folder).count() == 7
    with pytest.raises(Exception, match="needs the columns"):
        captures.write_captures(df.drop("data"), folder)


def test_small_files_share_batches():
    import pyarrow as pa

    from tidewire.sources.files import packet_batches

    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    made = [head + struct.pack("<IIII", i, 7, 4, 9) + struct.pack("<I", i) for i in range(10_000)]
    made[5000:5000] = [head, b"", made[0] + made[1][24:-1]]  # no record, no header, a record that is cut off
    large = head + 3 * (struct.pack("<IIII", 1, 0, 5 << 20, 5 << 20) + bytes(5 << 20))
    files = [pa.RecordBatch.from_pydict({"content": made[i : i + 3000]}) for i in range(0, len(made), 3000)]
    got = list(packet_batches(iter([*files, pa.RecordBatch.from_pydict({"content": [large]})])))
    assert [len(b) for b in got] == [4096, 4096, 10_001 - 2 * 4096 + 2, 1]
    want = [*range(5000), 0, *range(5000, 10_000)]
    us, data = ([v for b in got for v in b.column(c).to_pylist()] for c in ("us", "data"))
    assert us[:10_001] == [i * 1_000_000 + 7 for i in want] and data[:10_001] == [struct.pack("<I", i) for i in want]
