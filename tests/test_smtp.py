import time

import pytest

from tidewire.functions import smtp, wire
from tidewire.streaming import flows

SESSION = (
    b"EHLO client.example\r\nAUTH LOGIN\r\nbWU=\r\nc2VjcmV0\r\nMAIL FROM:<me@x.org>\r\nRCPT TO:<a@y.org>\r\nNOOP\r\nrcpt to: <b@y.org> \r\nDATA\r\n"
    b"Subject: one;\r\n  two;\r\n three\r\nX-Unknown: 1;\r\n folded\r\nDate: today \r\nno field\r\nFrom: me\r\n not folded\r\n\r\nfirst\r\n.second\r\n..\r\n.\r\n"
)
WANT = {
    "status": "OK", "hello": "client.example", "user": "bWU=", "password": "c2VjcmV0", "sender": "me@x.org", "recipient": "b@y.org", "recipients": ["a@y.org", "b@y.org"],
    "subject": "one;\r\ntwo;\r\nthree", "headers": {"subject": "one;\r\ntwo;\r\nthree", "date": "today", "from": "me"}, "body": b"first\r\n.second\r\n..", "error": None,
}


def test_session_cut_at_every_byte():
    assert smtp.smtp_decode(SESSION) == WANT
    for cut in range(1, len(SESSION)):
        m = smtp.smtp_feed(smtp.smtp_start(), SESSION[:cut])
        assert smtp.smtp_result(m)["status"] == wire.MORE
        assert smtp.smtp_result(smtp.smtp_feed(m, SESSION[cut:])) == WANT
    m = smtp.smtp_start()
    for i in range(len(SESSION)):
        smtp.smtp_feed(m, SESSION[i : i + 1])
    assert smtp.smtp_result(m) == WANT and m["rest"] == b""


def test_next_mail_and_empty_bodies():
    m = smtp.smtp_feed(smtp.smtp_start(), b"HELO h\r\nMAIL FROM:<1>\r\nDATA\r\n\r\n.\r\nMAIL FROM:<2>\r\nRCPT TO:<r>\r\nDATA\r\nSubject: s\r\n\r\n\r\n.\r\nQUIT\r\n")
    one = smtp.smtp_result(m)
    two = smtp.smtp_feed(smtp.smtp_next(m), b"")
    assert (one["sender"], one["body"], one["status"]) == ("1", b"", "OK")
    got = smtp.smtp_result(two)
    assert (got["hello"], got["sender"], got["recipient"], got["subject"], got["body"]) == ("h", "2", "r", "s", b"")
    assert smtp.smtp_feed(smtp.smtp_next(two), b"")["phase"] == "command"


@pytest.mark.parametrize(
    "data, error",
    [(b"250 OK\r\n", "TYPE"), (b"220-host\r\n", "TYPE"), (b"MAIL me\r\n", "MAIL"), (b"RCPT\r\n", "RCPT"), (b"EHLO " + b"x" * 70_000, "OUT_OF_BUF"), (b"EHLO " + b"x" * 70_000 + b"\r\n", "OUT_OF_BUF"),
     (b"DATA\r\nSubject: a;\r\n" + b" more;\r\n" * 20_000, "OUT_OF_BUF")],
)
def test_errors(data, error):
    for step in (len(data), 1000):
        m = smtp.smtp_start()
        for i in range(0, len(data), step):
            smtp.smtp_feed(m, data[i : i + step])
        assert (smtp.smtp_result(m)["status"], m["error"]) == ("ERROR", error)


def test_bounds_of_lines():
    exact = b"GET /" + b"x" * (wire.LINE - 14) + b" HTTP/1.1"
    assert len(exact) == wire.LINE
    for line, want in ((exact, "OK"), (exact + b" ", "ERROR")):
        for step in (7, 10**6):
            m, data = wire.http_start(), line + b"\r\n\r\n"
            for i in range(0, len(data), step):
                wire.http_feed(m, data[i : i + step])
            assert wire.http_result(m)["status"] == want
    began, m = time.process_time(), wire.http_start()
    for _ in range(8000):
        wire.http_feed(m, b"GET " + b"y" * 1000)
    assert m["error"] == "OUT_OF_BUF" and m["rest"] == b"" and time.process_time() - began < 2
    began, m = time.process_time(), smtp.smtp_feed(smtp.smtp_start(), b"DATA\r\n\r\n")
    for _ in range(8000):
        smtp.smtp_feed(m, b"\r\n." + b"y" * 1000)
    assert len(m["rest"]) < 5 and time.process_time() - began < 2


def streamed(spark, tmp_path, name, rows, schema, build):
    src = str(tmp_path / name)
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream(spark, tmp_path):
    two = SESSION + b"MAIL FROM:<2>\r\nDATA\r\n\r\nhi\r\n.\r\nQUIT\r\n"
    rows = [("two", i // 9, two[i : i + 9]) for i in range(0, len(two), 9)]
    rows = rows[:5] + rows[5:][::-1] + rows[3:4] + [("two", None, b"x"), ("two", 3, None), ("bad", 0, b"RC"), ("bad", 1, b"PT\r\nEHLO x\r\n"), ("nul", 0, None), ("open", 0, b"EHLO h\r\n")]
    got = {(r.flow, r.n): r for r in streamed(spark, tmp_path, "smtp", (rows[:9], rows[9:20], rows[20:]), "flow string, seq int, chunk binary", flows.decode_smtp_stream)}
    assert set(got) == {("two", 0), ("two", 1), ("bad", 0)}
    assert {k: bytes(v) if k == "body" else v for k, v in got["two", 0].asDict().items() if k in WANT} == WANT
    assert (got["two", 1].user, got["two", 1].sender, bytes(got["two", 1].body), got["bad", 0].error) == ("bWU=", "2", b"hi", "RCPT")


def test_reassembly_takes_null_chunks_for_none(spark, tmp_path):
    schema = "flow string, seq int, chunk string, last boolean"
    parts = [[("a", 0, None, False), ("a", 1, "b", None), ("n", None, "x", True)], [("a", 2, "c", True), ("z", 0, None, True)], [("a", 0, "a", False)]]
    assert {tuple(r) for r in streamed(spark, tmp_path, "whole_nulls", parts, schema, flows.reassemble_stream)} == {("a", "abc", 3)}
