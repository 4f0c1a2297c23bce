import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidewire.functions import binary, text, wire
from tidewire.operators import lookup
from tidewire.plans.template import FUNCTIONS, Template, TemplateError
from tidewire.sources import files
from tidewire.streaming import flows

CASES = [
    [b"GET / HTTP/1.1\r\nContent-Length: 0\r\n\r\n"],
    [b"POST /a HTTP/1.1\r\nContent-Length: 10\r\n\r\n0123456789"],
    [b"POST /a HTTP/1.1\r\nContent-Length: 20\r\n\r\n0123456789", b"0123456789"],
    [b"POST /a HTTP/1.1\r\nContent-Length: 30\r\n\r\n0123456789", b"0123456789", b"0123456789"],
    [b"GET /a", b"bc HTTP/1.1\r\nCookie: x=", b"1\r\n\r\n"],
    [b"POST / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\na\r\n0123456789\r\n", b"14\r\n01234567890123456789\r\n0\r\n\r\n"],
    [b"POST / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n1", b"4\r\n0123456789", b"0123456789\r\n0\r\n\r\n"],
]


@pytest.mark.parametrize("chunks", CASES)
def test_http(chunks):
    for i in range(1, len(chunks)):
        assert wire.http_decode(b"".join(chunks[:i]))["status"] == wire.MORE
    assert wire.http_decode(b"".join(chunks))["status"] == wire.OK


def test_http_details():
    assert wire.http_decode(b"nonsense\r\n\r\n")["status"] == wire.ERROR
    assert wire.http_decode(b"HTTP/1.1 204 None\r\n\r\n")["body"] is None
    assert wire.http_decode(b"HTTP/1.1 200 OK\r\n\r\nrest")["body"] == b"rest"
    got = wire.http_decode(b"GET http://a.b/c?d HTTP/1.1\r\nX-Own: 1\r\n\r\n")
    assert (got["headers"], got["uri"]) == ({"host": "a.b"}, "/c?d")
    raw = b"some text" * 9
    deflate = zlib.compressobj(wbits=-15)
    assert binary.inflate(deflate.compress(raw) + deflate.flush(), "deflate") == raw
    assert binary.inflate(zlib.compress(zlib.compress(raw)), "deflate, deflate") == raw


def test_tlv_radius_uncap():
    entries = [(1, (0x1234).to_bytes(2, "little")), (2, (0x56789012).to_bytes(4, "little"))]
    for inclusive in (False, True):
        data = wire.tlv_encode(entries, inclusive=inclusive)
        assert wire.tlv_decode(data, inclusive=inclusive) == entries
    assert wire.tlv_decode(wire.tlv_encode(entries)[:-1]) == entries[:1]
    assert wire.radius_decode(b"\x01\x01\x00\x16" + bytes(16) + b"\x01\x01") == []
    assert wire.chain(b"short") == []


def test_hashes_and_ciphers():
    assert binary.xor_bytes(b"123", b"aaaa") == b"PSR"
    assert binary.xor_bytes(binary.xor_bytes(b"payload", b"key", 2), b"key", 2) == b"payload"
    # published test values of MurmurHash3 x86_32
    assert binary.murmur3_32(b"") == 0 and binary.murmur3_32(b"", 1) == 0x514E28B7
    assert binary.murmur3_32(b"Hello, world!", 0x9747B28C) == 0x24884CBA
    assert binary.murmur3_x64_128(b"") == (0, 0)
    assert "%016x%016x" % binary.murmur3_x64_128(b"The quick brown fox jumps over the lazy dog") == "e34bbc7bbc071b6c7a433ca9c49a9347"
    cipher = binary.ZipCipher(b"secret").encrypt(b"rules and more rules")
    assert binary.ZipCipher(b"secret").decrypt(cipher) == b"rules and more rules" != cipher
    assert binary.random_sequence(1, 10000)[-1] == 1043618065  # the published check of the minimal standard
    assert binary.normal_uri("HTTP://Www.B.com/abc/../bcde/def") == "http://www.b.com/bcde/def"


def test_uri_and_numbers(spark):
    one = spark.createDataFrame([("http://ana:key1@Shop.example.com:8080/abc/../bcde/def?a=1&b=2#about", "0x10", "2K", "010", "x", "1.2.3.4", "1.2.3.400")], "u string, a string, b string, c string, d string, e string, f string")
    r = one.select(text.uri_struct(F.col("u")).alias("u"), *[text.cast_suffix(F.col(c)).alias(c) for c in "abcd"], text.ip_number(F.col("e")).alias("e"), text.ip_number(F.col("f")).alias("f"),
                   binary.uri_resolve_col(F.col("u"), F.lit("bcd.html?a=3")).alias("r")).first()
    assert tuple(r.u) == ("http", "ana:key1", "shop.example.com", 8080, "/bcde/def", "a=1&b=2", "about")
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (16, 2048, 8, None, 0x01020304, None)
    assert r.r.endswith("/bcde/bcd.html?a=3")
    data = "010034127856341290"
    b = spark.createDataFrame([(bytearray.fromhex(data),)], "b binary").select(text.unsigned_le(F.col("b"), 2, 2).alias("le"), text.unsigned_be(F.col("b"), 2, 2).alias("be")).first()
    assert (b.le, b.be) == (0x1234, 0x3412)


def test_template(spark):
    names = {n: F.lit(n) for n in ("SrcIP", "DstIP", "Host")}
    t = Template(names, FUNCTIONS)
    one = spark.range(1)
    assert one.select(t.column("abcdef")).first()[0] == "abcdef"
    assert one.select(t.column("a${Host}${SrcIP},${Upper(x){<${DstIP}>}}!")).first()[0] == "aHostSrcIP,<DSTIP>!"
    for bad in ("abcdef${", "${abcdef}", "bac${SHA1({}}", "${MD5()}}", "${MD55(){}}"):
        with pytest.raises(TemplateError):
            t.column(bad)


def test_ranges(spark, tmp_path):
    (tmp_path / "ips.txt").write_text("# ranges\n1.51.112.0\t1.51.112.255\tAS\tCN\t340000\t1\t2\n139.122.224.0\t139.122.233.2\tAS\tHK\t810000\t1\t2\n10.0.0.0\t\n0.0.0.0\t0.255.255.255\tAS\tCN\t5\t1\t2\n")
    ranges = files.read_ip_ranges(spark, str(tmp_path / "ips.txt"))
    lookup.check_ranges(ranges)
    ips = spark.createDataFrame([("1.51.112.1",), ("139.122.224.0",), ("139.122.233.2",), ("140.1.2.3",), (None,)], "ip string").withColumn("n", text.ip_number(F.col("ip")))
    got = {r.ip: r.province for r in lookup.range_lookup(ips, "n", ranges, "left").collect()}
    assert got == {"1.51.112.1": 340000, "139.122.224.0": 810000, "139.122.233.2": 810000, "140.1.2.3": None, None: None}
    wide = lookup.range_lookup(ips, "n", ranges, wide=1).collect()
    assert len(wide) == 3
    with pytest.raises(ValueError):
        lookup.check_ranges(ranges.unionAll(ranges))


def test_files(spark, tmp_path):
    (tmp_path / "a.conf").write_text("# c\na 1\nb = two words\n@include b.conf\n")
    (tmp_path / "b.conf").write_text("a 3\n")
    assert files.read_properties(str(tmp_path / "a.conf")) == {"a": "3", "b": "two words"}
    record = b"payload"
    (tmp_path / "x.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + (struct.pack("<IIII", 1, 5, 7, 9) + record) * 3)
    packets = files.read_pcap(spark, str(tmp_path / "x.pcap"))
    assert packets.count() == 3 and bytes(packets.first().data) == record
    assert files.capture_stats(packets).first().bytes == 21


def test_captures_of_a_hot_key_are_cut(spark):
    record = F.concat(F.lit("00" * 8 + "0400000004000000"), F.lpad(F.hex("id"), 8, "0"))
    made = files.captures(spark.range(0, 1000, 1, 3).select(F.lit(7).alias("user"), record.alias("record")), "user", 4)
    sizes = [(len(r.content) - 24) // 20 for r in made.collect()]
    assert max(sizes) == 16 and sum(sizes) == 1000
    assert sorted(int.from_bytes(r.data, "big") for r in files.split_captures(made).collect()) == list(range(1000))


def test_captures_are_one_file_a_key(spark):
    """Keys of few records have one file each wherever their rows stand; hot keys among them are cut, null is a key."""
    record = F.concat(F.lit("00" * 8 + "0400000004000000"), F.lpad(F.hex("id"), 8, "0"))
    rows = spark.range(0, 1000, 1, 3).select(F.when(F.col("id") % 50 > 0, F.col("id") % 50).alias("user"), record.alias("record"))
    made = files.captures(rows, "user", 5).collect()
    assert len(made) == 50 and {len(r.content) for r in made} == {24 + 20 * 20}
    hot = files.captures(rows.unionAll(rows.withColumn("user", F.when(F.col("user") > 25, 7))), "user", 5)
    sizes = {}
    for r in hot.collect():
        sizes.setdefault(r.user, []).append((len(r.content) - 24) // 20)
    assert {k: sum(v) for k, v in sizes.items()} == {None: 540, 7: 500} | {k: 20 for k in range(1, 50) if k != 7}
    assert max(map(max, sizes.values())) <= 32 and all(len(v) == 1 for k, v in sizes.items() if k not in (None, 7))
    assert sorted(int.from_bytes(r.data, "big") for r in files.split_captures(hot).collect()) == sorted([*range(1000)] * 2)


def test_crc_mix(spark):
    # "abc" and "a" by hand: the table-driven CRC from 0 without inversions, then the shifts one after the other
    assert binary.crc_mix(b"") == 0 and binary.crc_mix(b"abc") == 3116679333
    texts = ["", "a", "abc", "Customer#000000001", "é日本", "x" * 300]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "s string").select("s", binary.crc_mix_col(F.col("s")).alias("x")).collect()
    assert {r.s: r.x for r in rows} == {t: binary.crc_mix(t.encode()) for t in texts} | {None: None}


def test_paths_and_broken_rows(spark):
    cases = {"/a/./b/../c": "/a/c", "/..": "/", "/a/..": "/", "/a/b/.": "/a/b/", "/": "/", "/a//b": "/a//b", "/../../x": "/x"}
    rows = spark.createDataFrame([(f"http://h{k}", v) for k, v in cases.items()], "u string, want string").select(text.uri_struct(F.col("u"))["path"].alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    data = [(zlib.compress(b"ok"), "deflate"), (b"broken", "gzip"), (b"x", "unknown"), (None, "gzip"), (b"plain", None)]
    got = spark.createDataFrame(data, "d binary, e string").select(binary.inflate_col("d", "e").alias("x")).collect()
    assert [r.x and bytes(r.x) for r in got] == [b"ok", None, None, None, b"plain"]
    with pytest.raises(ValueError):
        text.format_time(F.lit(0), "%q")
    hexes = spark.createDataFrame([("4142",), ("414",), ("zz",), ("",)], "h string").select(text.hex_bytes(F.col("h")).alias("b")).collect()
    assert [r.b and bytes(r.b) for r in hexes] == [b"AB", None, None, bytearray()]


def test_streaming_gives_up_with_a_row(spark, tmp_path):
    """A NUL is data; a flow of too many chunks gives a row; a larger bound lets it through."""
    rows = [("nul", 0, "a\x00", False), ("nul", 1, "b\x00", True), *(("long", i, "x", i == 39) for i in range(40) if i != 5)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "flow string, seq int, chunk string, last boolean").coalesce(1).write.json(src)
    for bound, want in ((20, [("long", None, 39), ("nul", "a\x00b\x00", 2)]), (100, [("nul", "a\x00b\x00", 2)])):
        stream = spark.readStream.schema("flow string, seq int, chunk string, last boolean").json(src)
        name = f"given_up_{bound}"
        q = flows.reassemble_stream(stream, max_chunks=bound).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(tuple(r) for r in spark.table(name).collect()) == want


def test_streaming(spark, tmp_path):
    rows = [("a", 1, "lo", False), ("b", 0, "x", True), ("a", 0, "hel", False), ("a", 2, "!", True)]
    src = str(tmp_path / "in")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "flow string, seq int, chunk string, last boolean").coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema("flow string, seq int, chunk string, last boolean").option("maxFilesPerTrigger", 1).json(src)
    q = flows.reassemble_stream(stream).writeStream.format("memory").queryName("whole").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("whole").collect()) == [("a", "hello!", 3), ("b", "x", 1)]


def test_publish(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    seen = {}
    flows.publish(df, {"one": ("json", ["id", "v"], lambda d: seen.update(one=d.count())), "two": ("csv", ["v"], lambda d: seen.update(two=d.count()))})
    assert seen == {"one": 2, "two": 1}
    dated = df.withColumn("payload", F.lit("x")).withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    flows.write_rolling(dated, str(tmp_path / "out"), "ts", "yyyy-MM-dd_HH")
    assert spark.read.text(str(tmp_path / "out")).where("period = '2024-01-02_03'").count() == 2
