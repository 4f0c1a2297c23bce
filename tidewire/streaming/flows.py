"""Streaming: reassembly of messages from chunks, first-seen filters, rule refresh, multi-sink publishing."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.functions import smtp, wire
from tidewire.operators.ordered import within_keys
from tidewire.plans.rules import RuleError, RuleSet


def reassemble(chunks: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """Messages of a batch table of chunks, joined in order: (keys, message, chunks)."""
    return chunks.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, data))), lambda c: c[data]), "").alias("message"), F.count(F.lit(1)).alias("chunks")
    )


def placed(chunks: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """(keys, order, data, offset, in_order): each chunk of a batch table with its place in its message, in bytes.

    For messages of any length: their chunks never meet in one task, so they can be written or searched in place.
    ``order`` counts from 0; of repeated chunks the smallest stays, a chunk without an order or data is none, and behind
    a gap ``in_order`` is false (and the offset counts the bytes that are there).
    """
    rows = chunks.where(F.col(order).isNotNull() & F.col(data).isNotNull())
    own = rows.groupBy(F.struct(*keys).alias("_flow"), F.col(order).alias("_seq")).agg(F.min(data).alias("_data"))
    sized = own.withColumn("_bytes", F.octet_length("_data"))
    found = within_keys(sized, "_flow", ["_seq"], "_bytes", "_rank", "_previous", "_bytes", "_offset")
    return found.select("_flow.*", F.col("_seq").alias(order), F.col("_data").alias(data), F.col("_offset").alias("offset"), (F.col("_rank") == F.col("_seq")).alias("in_order"))


def _extend(max_chunks: int, timeout_ms: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Chunks in order of seq; a chunk marked last ends the message."""
        seqs, texts, last = state.get if state.exists else ([], [], None)
        held = dict(zip(seqs, texts))

        def row(message: str | None, chunks: int) -> pd.DataFrame:
            state.remove()
            return pd.DataFrame({"flow": [key[0]], "message": pd.Series([message], dtype=object), "chunks": [chunks]})

        if state.hasTimedOut:
            yield row(None, len(held))
            return
        for f in frames:
            known = f[f["seq"].notna()]
            held.update((int(s), c) for s, c in zip(known["seq"], known["chunk"]) if c is not None)
            ends = known.loc[known["last"].fillna(False).astype(bool), "seq"]
            last = int(ends.iloc[-1]) if len(ends) else last
        if last is not None and all(i in held for i in range(last + 1)):
            yield row("".join(held[i] for i in range(last + 1)), last + 1)
        elif len(held) > max_chunks:
            yield row(None, len(held))
        else:
            state.update((list(held), list(held.values()), last))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)

    return run


def reassemble_stream(chunks: DataFrame, max_chunks: int = 1024, timeout_ms: int | None = None) -> DataFrame:
    """Whole messages (flow, message, chunks) of a stream of (flow, seq, chunk, last).

    A chunk that is null, or has no seq, is none: a message waits until its place is filled. A flow that holds more than ``max_chunks`` chunks without being whole, or none for ``timeout_ms``, is given up: its
    row has a null message and the number of chunks held; what comes later begins a new message.
    """
    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("flow").applyInPandasWithState(
        _extend(max_chunks, timeout_ms), "flow string, message string, chunks int", "seqs array<int>, texts array<string>, last int", "append", kind
    )


@dataclass(frozen=True)
class Protocol:
    """A decoder's functions and the values of an unfinished message, as columns of state."""

    start: Callable[[], dict]
    feed: Callable[[dict, bytes], dict]
    next: Callable[[dict], dict]
    result: Callable[[dict, bool], dict]
    idle: str  # the phase in which no message has begun
    plain: dict[str, str]
    lists: tuple[str, ...]
    type: T.StructType

    @property
    def state(self) -> str:
        """A message in the middle of its decoding, with the chunks that came before their turn."""
        own = [f"{n} {kind}" for n, kind in self.plain.items()] + [f"{n} array<string>" for n in self.lists]
        return ", ".join(["n int, next int", *own, "names array<string>, values array<string>, body binary, seqs array<int>, chunks array<binary>"])


HTTP = Protocol(
    wire.http_start, wire.http_feed, lambda m: wire.http_start() | {"rest": m["rest"]}, wire.http_result, "start",
    {"phase": "string", "rest": "binary", "left": "long"} | {n: "string" for n in ("last", "request_method", "error", "method", "uri", "version")} | {"code": "int", "reason": "string"}, (), wire.HTTP_TYPE,
)
SMTP = Protocol(
    smtp.smtp_start, smtp.smtp_feed, smtp.smtp_next, lambda m, closed: smtp.smtp_result(m), "command",
    {"phase": "string", "rest": "binary"} | {n: "string" for n in ("last", "error", "hello", "user", "password", "sender")}, ("recipients",), smtp.SMTP_TYPE,
)


def _decode(protocol: Protocol, max_chunks: int, timeout_ms: int | None):
    plain, lists = list(protocol.plain), protocol.lists

    def load(state: GroupState) -> tuple[int, int, dict, dict]:
        if not state.exists:
            return 0, 0, protocol.start(), {}
        n, after, *rest = state.get
        names, values, body, seqs, chunks = rest[len(plain) + len(lists) :]
        m = dict(zip(plain, rest)) | {k: list(v) for k, v in zip(lists, rest[len(plain) :])}
        m |= {"rest": bytes(m["rest"]), "headers": dict(zip(names, values)), "parts": None if body is None else [bytes(body)]}
        return n, after, m, dict(zip(seqs, map(bytes, chunks)))

    def save(state: GroupState, n: int, after: int, m: dict, held: dict) -> None:
        body = None if m["parts"] is None else b"".join(m["parts"])
        state.update((n, after, *(m[k] for k in (*plain, *lists)), list(m["headers"]), list(m["headers"].values()), body, list(held), list(held.values())))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, after, m, held = load(state)
        out = []

        def emit(closed: bool = False) -> None:
            out.append({"flow": key[0], "n": n + len(out)} | protocol.result(m, closed))

        if state.hasTimedOut:
            if not m["error"] and m["phase"] != protocol.idle:
                emit(closed=True)
            state.remove()
        else:
            for f in frames:
                held.update((int(s), bytes(c)) for s, c in zip(f["seq"], f["chunk"]) if not pd.isna(s) and s >= after and c is not None)
            while after in held and not m["error"]:
                protocol.feed(m, held.pop(after))
                after += 1
                while m["phase"] == "done":
                    emit()
                    m = protocol.feed(protocol.next(m), b"")
                if m["error"]:
                    emit()
            if len(held) > max_chunks and not m["error"]:
                m["error"], m["phase"] = "OUT_OF_BUF", "error"
                emit()
            if m["error"]:  # what still comes of the connection is not read
                m, held = protocol.start() | {"phase": "error", "error": m["error"]}, {}
            save(state, n + len(out), after, m, held)
        if out:
            columns = {k: pd.Series([r[k] for r in out], dtype="Int32" if k == "code" else object) for k in protocol.type.names}
            yield pd.DataFrame({"flow": [r["flow"] for r in out], "n": [r["n"] for r in out]} | columns)

    return run


def _decode_stream(protocol: Protocol, chunks: DataFrame, max_chunks: int, timeout_ms: int | None) -> DataFrame:
    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in protocol.type)
    return chunks.select("flow", "seq", "chunk").groupBy("flow").applyInPandasWithState(
        _decode(protocol, max_chunks, timeout_ms), f"flow string, n int, {names}", protocol.state, "append", kind
    )


def decode_http_stream(chunks: DataFrame, max_chunks: int = 1024, timeout_ms: int | None = None) -> DataFrame:
    """The messages (flow, n from 0, fields of ``wire.HTTP_TYPE``) of connections that come as chunks (flow, seq from 0,
    chunk binary), decoded as they come: the state holds the message under way, not the bytes that were read.

    Chunks may come out of turn and repeatedly; a null chunk is none. After an error, or with more than ``max_chunks``
    waiting for one that is missing (error OUT_OF_BUF), the rest of the connection is not read. A connection silent for
    ``timeout_ms`` is closed: its unfinished message comes as MORE, or as OK if its body goes on to the end.
    """
    return _decode_stream(HTTP, chunks, max_chunks, timeout_ms)


def decode_smtp_stream(chunks: DataFrame, max_chunks: int = 1024, timeout_ms: int | None = None) -> DataFrame:
    """The mails (flow, n from 0, fields of ``smtp.SMTP_TYPE``) of clients' sides of SMTP sessions, as ``decode_http_stream``."""
    return _decode_stream(SMTP, chunks, max_chunks, timeout_ms)


def first_seen_stream(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def match_batches(rules: RuleSet, fields: Callable[[DataFrame], dict[str, Column]], write: Callable[[DataFrame, int], None]):
    """A foreachBatch function: rules that changed are compiled anew between batches, never within one. Where a changed
    source is missing or wrong, a warning says so at every batch and the rules of before go on."""

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            rules.check()
        except (RuleError, OSError) as e:
            logging.getLogger(__name__).warning("rules not renewed: %s", e)
        write(batch.withColumn("sources", rules.matched_ids(fields(batch))), batch_id)

    return run


# --- publishing ------------------------------------------------------------------------------------------
CODECS: dict[str, Callable[[DataFrame, list[str]], Column]] = {}


def register_codec(name: str, make: Callable[[DataFrame, list[str]], Column]) -> None:
    CODECS[name] = make


register_codec("json", lambda df, cols: F.to_json(F.struct(*cols)))
register_codec("csv", lambda df, cols: F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def encoded(df: DataFrame, codec: str, columns: list[str]) -> DataFrame:
    """``payload`` by a codec; empty payloads are left out."""
    return df.withColumn("payload", CODECS[codec](df, columns)).where("payload <> ''")


def publish(df: DataFrame, sinks: dict[str, tuple[str, list[str], Callable[[DataFrame], None]]]) -> None:
    """Write a batch to every sink (codec, columns, writer)."""
    for codec, columns, write in sinks.values():
        write(encoded(df, codec, columns))


def write_rolling(df: DataFrame, path: str, ts: str, pattern: str, codec: str = "gzip", files: int = 8, max_rows: int = 0) -> None:
    """Text files by period: a folder for each value of the time pattern, of at most ``files`` files at a time (so that a
    busy period is dealt to as many tasks), each rolled after ``max_rows`` rows (0: never)."""
    rows = df.withColumn("period", F.date_format(ts, pattern)).select("period", F.col("payload").alias("value"))
    rows = rows.repartition("period", F.pmod(F.xxhash64("value"), F.lit(files)))
    rows.write.mode("append").partitionBy("period").option("compression", codec).option("maxRecordsPerFile", max_rows).text(path)


def publish_counters(df: DataFrame, output: Column, payload: Column, failed: Column) -> DataFrame:
    """ok, error, bytes_ok and bytes_error of each output."""
    size = F.octet_length(payload)
    return df.where(payload.isNotNull() & (payload != "")).groupBy(output.alias("output")).agg(
        F.sum((~failed).cast("long")).alias("ok"), F.sum(failed.cast("long")).alias("error"),
        F.sum(F.when(~failed, size).otherwise(0)).alias("bytes_ok"), F.sum(F.when(failed, size).otherwise(0)).alias("bytes_error"),
    )


def apply_modules(df: DataFrame, modules: list[tuple[str, Callable[[DataFrame], DataFrame]]], enabled: dict[str, bool]) -> DataFrame:
    """The enabled transforms, in order (a module is on unless it is switched off)."""
    for name, step in modules:
        if enabled.get(name, True):
            df = df.transform(step)
    return df
