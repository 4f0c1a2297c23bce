import pytest

from tests.test_functions import CASES
from tidewire.functions import wire
from tidewire.streaming import flows


@pytest.mark.parametrize("chunks", CASES)
def test_cases_split_at_every_byte(chunks):
    whole = b"".join(chunks)
    want = wire.http_decode(whole)
    assert want["status"] == wire.OK and want["error"] is None
    for cut in range(1, len(whole)):
        m = wire.http_feed(wire.http_start(), whole[:cut])
        assert wire.http_result(m)["status"] == wire.MORE
        assert wire.http_result(wire.http_feed(m, whole[cut:])) == want
    m = wire.http_start()
    for i in range(len(whole)):
        wire.http_feed(m, whole[i : i + 1])
    assert wire.http_result(m) == want and m["rest"] == b""


@pytest.mark.parametrize(
    "data, error",
    [
        (b"FETCH / HTTP/1.1\r\n", "METHOD"), (b"no-method-at-all", "METHOD"), (b"GET /\r\n", "VERSION"), (b"GET / HTTP/2.0\r\n", "VERSION"), (b"HTTP/3.0 200 OK\r\n", "VERSION"),
        (b"HTTP/1.1 20 OK\r\n", "STATUS"), (b"HTTP/1.1 200\r\n", "STATUS"), (b"GET / HTTP/1.1\r\nno colon\r\n", "CRLF"), (b"GET / HTTP/1.1\r\nContent-Length: x\r\n\r\n", "CONTENT_VAR"),
        (b"GET / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n", "CHUNK_SIZE"), (b"GET / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n1\r\nabc", "CRLF"),
    ],
)
def test_errors(data, error):
    got = wire.http_decode(data)
    assert (got["status"], got["error"]) == (wire.ERROR, error)


def test_framing_of_answers():
    answer = b"HTTP/1.1 200 OK\r\n\r\nbody"
    assert wire.http_decode(answer, request_method="HEAD")["body"] is None
    assert wire.http_decode(answer, request_method="CONNECT")["body"] is None
    assert wire.http_decode(answer.replace(b"200", b"404"), request_method="CONNECT")["body"] == b"body"
    assert wire.http_result(wire.http_feed(wire.http_start(), answer))["status"] == wire.MORE
    small = b"POST / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n" + b"1\r\nx\r\n" * 200_000 + b"0\r\nTrailer: 1\r\n\r\n"
    assert len(wire.http_decode(small)["body"]) == 200_000


def test_stream(spark, tmp_path):
    two = b"".join(CASES[1]) + b"".join(CASES[6])
    rows = [("two", i, two[i : i + 5]) for i in range(0, len(two), 5)]
    rows = [(f, i // 5, c) for f, i, c in rows]
    rows = rows[:4] + rows[4:][::-1] + rows[2:3]  # out of turn, one twice
    rows += [("bad", 0, b"FETCH /"), ("bad", 1, b" HTTP/1.1\r\n"), ("bad", 2, b"GET / HTTP/1.1\r\n\r\n"), ("open", 0, b"GET / HTTP/1.1\r\nHost: h"), ("none", 0, None), ("lost", 0, b"GET ")]
    rows += [("lost", i, b"x") for i in range(2, 60)] + [("nul", 0, b"POST / HTTP/1.1\r\nContent-Length: 3\r\n\r\n\x00\xff\x00")]
    src = str(tmp_path / "in")
    for part in (rows[:9], rows[9:30], rows[30:]):
        spark.createDataFrame(part, "flow string, seq int, chunk binary").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("flow string, seq int, chunk binary").option("maxFilesPerTrigger", 1).parquet(src)
    q = flows.decode_http_stream(stream, max_chunks=50).writeStream.format("memory").queryName("http").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.flow, r.n): r for r in spark.table("http").collect()}
    assert set(got) == {("two", 0), ("two", 1), ("bad", 0), ("lost", 0), ("nul", 0)}
    assert bytes(got["two", 0].body) == b"0123456789" and bytes(got["two", 1].body) == b"0123456789" * 2
    assert got["two", 1].headers == {"transfer-encoding": "chunked"} and got["two", 1].uri == "/"
    assert bytes(got["nul", 0].body) == b"\x00\xff\x00"
    assert (got["bad", 0].status, got["bad", 0].error, got["lost", 0].error) == ("ERROR", "METHOD", "OUT_OF_BUF")
