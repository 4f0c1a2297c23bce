"""The client's side of SMTP sessions: a machine that reads on by any number of bytes.

Commands are taken in any case and order: the greeting, AUTH (the two lines after it are user and password, left as they are),
sender, recipients, DATA; other commands are skipped. In the mail's header a line goes on only after a semicolon; the fields of
``SMTP_FIELDS`` are kept. The body ends at a line that is a single dot. What follows belongs to the next mail.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidewire.functions.wire import ERROR, LINE, MORE, OK, struct_type

#: The fields of a mail's header that are kept.
SMTP_FIELDS = ("user-agent", "date", "subject", "from", "to", "message-id", "thread-topic", "mime-version", "content-type")
END = b"\r\n.\r\n"


def smtp_start() -> dict:
    """A session of which nothing is read yet, as plain values."""
    return {"phase": "command", "rest": b"", "last": None, "error": None, "hello": None, "user": None, "password": None, "sender": None, "recipients": [], "headers": {}, "parts": None}


def smtp_feed(m: dict, data: bytes, fields: tuple[str, ...] = SMTP_FIELDS, most: int = LINE) -> dict:
    """Read on by the next bytes; ``rest`` holds an unfinished line or end mark, and what follows a whole mail. Errors have names:
    TYPE (an answer of a server), MAIL and RCPT (without an address), OUT_OF_BUF (a line or header field of over ``most`` bytes)."""
    data, at = m["rest"] + data, 0
    while m["phase"] not in ("done", "error"):
        if m["phase"] == "body":
            end = data.find(END, at)
            stop = end if end >= 0 else max(at, len(data) - len(END) + 1)
            m["parts"].append(data[at:stop])
            at = stop
            if end < 0:
                break
            at, m["phase"] = end + len(END), "done"
            continue
        end = data.find(b"\r\n", at)
        if (end if end >= 0 else len(data) - 1) - at > most:
            m["phase"], m["error"] = "error", "OUT_OF_BUF"
            break
        if end < 0:
            break
        line, at = data[at:end].decode("latin-1").strip(" \t"), end + 2
        if m["phase"] == "command":
            _command(m, line)
        elif m["phase"] in ("user", "password"):
            m[m["phase"]] = line
            m["phase"] = "password" if m["phase"] == "user" else "command"
        elif line:
            _header(m, line, fields, most)
        else:  # the line end before the dot may be the one that ends the header
            m["phase"], m["parts"], at = "body", [], at - 2
    if m["phase"] == "error":
        at = len(data)
    m["rest"] = data[at:]
    return m


def _command(m: dict, line: str) -> None:
    upper = line.upper()
    if upper[:5] in ("HELO ", "EHLO ") or upper in ("HELO", "EHLO"):
        m["hello"] = line[5:].strip(" \t")
    elif upper.startswith("AUTH"):
        m["phase"] = "user"
    elif upper.startswith("MAIL"):
        if upper.startswith("MAIL FROM:"):
            m["sender"] = line[10:].strip(" \t<>")
        else:
            m["phase"], m["error"] = "error", "MAIL"
    elif upper.startswith("RCPT"):
        if upper.startswith("RCPT TO:"):
            m["recipients"].append(line[8:].strip(" \t<>"))
        else:
            m["phase"], m["error"] = "error", "RCPT"
    elif upper == "DATA":
        m["phase"] = "header"
    elif upper == "RSET":
        m["sender"], m["recipients"] = None, []
    elif len(line) >= 3 and line[:3].isdigit() and line[3:4] in ("", " ", "-"):
        m["phase"], m["error"] = "error", "TYPE"


def _header(m: dict, line: str, fields: tuple[str, ...], most: int) -> None:
    """``last`` is the field that goes on: its name, or an empty one for a field that is not kept."""
    if m["last"] is not None:
        name, value = m["last"], line
        if name:
            value = m["headers"][name] + "\r\n" + line
    else:
        name, colon, value = line.partition(":")
        name, value = name.strip(" \t").lower(), value.strip(" \t")
        name = name if colon and name in fields else ""
    if name:
        m["headers"][name] = value
        if len(value) > most:
            m["phase"], m["error"] = "error", "OUT_OF_BUF"
    m["last"] = name if value.endswith(";") else None


def smtp_result(m: dict) -> dict:
    """status OK, MORE (bytes are missing) or ERROR; of several recipients ``recipient`` is the last."""
    out = {k: m[k] for k in ("hello", "user", "password", "sender", "recipients", "headers", "error")}
    body = None if m["parts"] is None else b"".join(m["parts"])[2:]
    status = OK if m["phase"] == "done" else ERROR if m["error"] else MORE
    return {"status": status, "recipient": m["recipients"][-1] if m["recipients"] else None, "subject": m["headers"].get("subject"), "body": body} | out


def smtp_next(m: dict) -> dict:
    """After a whole mail: the next one of the session, by the same client and user."""
    return smtp_start() | {k: m[k] for k in ("hello", "user", "password", "rest")}


def smtp_decode(data: bytes, fields: tuple[str, ...] = SMTP_FIELDS) -> dict:
    """The first mail of a session."""
    return smtp_result(smtp_feed(smtp_start(), data, fields))


SMTP_TYPE = struct_type(
    status=T.StringType(), hello=T.StringType(), user=T.StringType(), password=T.StringType(), sender=T.StringType(), recipient=T.StringType(),
    recipients=T.ArrayType(T.StringType()), subject=T.StringType(), headers=T.MapType(T.StringType(), T.StringType()), body=T.BinaryType(), error=T.StringType(),
)


@pandas_udf(SMTP_TYPE)
def smtp_col(data: pd.Series) -> pd.DataFrame:
    """The first mail of each session; a null session is an empty one."""
    rows = [smtp_decode(bytes(d) if d is not None else b"") for d in data]
    return pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in SMTP_TYPE.names})
