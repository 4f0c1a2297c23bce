import gzip
import struct

import pytest
from pyspark.sql import functions as F

from tidewire.functions import binary, text
from tidewire.operators import ordered
from tidewire.sources import files


def test_murmur3_x86_128():
    assert binary.murmur3_x86_128(b"") == (0, 0, 0, 0)
    record = b"I will not buy this record, it is scratched."
    assert "%016x%016x" % binary.murmur3_x64_128(record) == "c382657f9a06c49d4a71fdc6d9b0d48f"
    assert "%08x%08x%08x%08x" % binary.murmur3_x86_128(record.replace(b"record", b"tobacconist's")) == "9b5b7ba2ef3f7866889adeaf00f3f98e"


@pytest.mark.parametrize("big", [True, False])
def test_numbers_in_buffers(spark, big):
    order = ">" if big else "<"
    doubles = [0.0, -0.0, 1.0, -2.5, 0.1, 1e300, -1e-300, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf")]
    floats = [0.0, 1.5, -3.25, 1e-45, 3.4028234663852886e38, 16777217.0]
    longs = [0, -1, 2**63 - 1, -(2**63), 1234567890123]
    got = spark.createDataFrame([(struct.pack(order + "d", x),) for x in doubles], "b binary").select(text.floating(F.col("b"), 0, 8, big)).collect()
    assert [struct.pack("d", r[0]) for r in got] == [struct.pack("d", x) for x in doubles]
    got = spark.createDataFrame([(b"." + struct.pack(order + "f", x),) for x in floats], "b binary").select(text.floating(F.col("b"), 1, 4, big)).collect()
    assert [r[0] for r in got] == [struct.unpack("f", struct.pack("f", x))[0] for x in floats]
    df = spark.createDataFrame([(x, struct.pack(order + "q", x)) for x in longs], "n long, b binary")
    got = df.select("n", "b", text.signed(F.col("b"), 0, 8, big).alias("r"), text.number_bytes(F.col("n"), 8, big).alias("p")).collect()
    assert all(r.n == r.r and bytes(r.b) == bytes(r.p) for r in got)
    nan = spark.createDataFrame([(struct.pack(order + "f", float("nan")),)], "b binary").select(text.floating(F.col("b"), 0, 4, big)).first()[0]
    assert nan != nan
    for n, code in ((1, "b"), (2, "h"), (4, "i")):
        df = spark.createDataFrame([(struct.pack(order + code, -7),), (b"",), (None,)], "b binary")
        assert [r[0] for r in df.select(text.signed(F.col("b"), 0, n, big)).collect()] == [-7, None, None]
    sized = spark.createDataFrame([(struct.pack(order + "H", 2) + b"abc",), (struct.pack(order + "H", 4) + b"abc",), (b"\x00",), (struct.pack(order + "H", 0),)], "b binary")
    assert [None if r[0] is None else bytes(r[0]) for r in sized.select(text.sized_bytes(F.col("b"), 0, 2, big)).collect()] == [b"ab", None, None, b""]


def test_lines_and_nth(spark, tmp_path):
    (tmp_path / "plain.gz").write_bytes(b"a\r\nb\n\nc")
    (tmp_path / "packed.txt").write_bytes(gzip.compress(b"x\ny\n"))
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "broken").write_bytes(b"\x1f\x8b123")
    got = sorted((r.path.rsplit("/", 1)[1], r.line or "-") for r in files.read_lines(spark, str(tmp_path)).collect())
    assert got == [("broken", "-"), ("packed.txt", "x"), ("packed.txt", "y"), ("plain.gz", "-"), ("plain.gz", "a"), ("plain.gz", "b"), ("plain.gz", "c")]
    df = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert sorted(r.k for r in ordered.without_nth(df, ["k"], 1).collect()) == [1, 3]
    assert ordered.without_nth(df, ["k"], 3).count() == 3


def test_gzip_of_nothing_has_no_line(spark, tmp_path):
    for name, data in {"nothing.gz": b"", "newline.gz": b"\n", "one.gz": b"a\n"}.items():
        (tmp_path / name).write_bytes(gzip.compress(data))
    (tmp_path / "broken.gz").write_bytes(gzip.compress(b"abc" * 99)[:20])
    got = sorted((r.path.rsplit("/", 1)[1], "-" if r.line is None else r.line) for r in files.read_lines(spark, str(tmp_path)).collect())
    assert got == [("broken.gz", "-"), ("newline.gz", ""), ("one.gz", "a")]
