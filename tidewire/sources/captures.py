"""Capture files as a Spark data source: ``spark.read.format("capture")``, ``df.write.format("capture")``.

Reading: a partition is a byte range (option ``splitBytes``, 64 MB; 0: whole files), so one large file is many tasks' work. A
record belongs to the range that its header begins in. Records carry no marker, so a range finds its first header from
sizes: it looks from some bytes ahead of the range (more than the longest record) for a chain of headers that can follow
one another, and such a chain meets the true one within a record. No guess is left unproved: a task goes on to the first
header past its range and compares it with what its successor will begin at. Each range's beginning is so proved by the one
before it, the first by the file's header; where they differ (records over 256 KB, records of no length, damaged
files, payloads that look like records), the job fails with the place and asks for ``splitBytes`` 0.

Columns: any of those of ``COLUMNS``, chosen by ``.schema(...)``; only those asked for are decoded. Packets that fail the
``conditions`` (a capture filter) never become rows; a null meets none. They are an option of the read, not Spark's filters
pushed down: Spark 4.1 keeps what was pushed in the loaded relation, and a second query over one DataFrame met the
first one's filters (seen here). A packet that is no IP has null addresses, and one without ports null ports; a file's last record is left out if it is cut off. Files whose first bytes
are of no capture are an error; files without a whole header are empty; names that begin with ``.`` or ``_`` are passed over.

Writing takes ``ts`` and ``data`` (and ``len``, where the packet was longer), a file a task; files get their names when all
tasks are done. Null times are the epoch, null data have no record. Paths are those that pyarrow opens (local, hdfs, s3, gs).
"""

from __future__ import annotations

import datetime
import ipaddress
import json
import operator
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

#: Fixed values of the format: the magic numbers (microseconds, nanoseconds), header sizes, the longest record.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
FILE_HEAD, HEAD, LONGEST = 24, 16, 262144
#: Headers in a row that make a chain, unless the file ends before.
CHAIN = 16
_BATCH = 4096

COLUMNS = "path string, offset long, ts timestamp, caplen long, len long, data binary, ether_type int, protocol int, src string, dst string, src_port int, dst_port int"
_FLOW = ("ether_type", "protocol", "src", "dst", "src_port", "dst_port")
_ARROW = {"path": pa.string(), "offset": pa.int64(), "ts": pa.timestamp("us", "UTC"), "caplen": pa.int64(), "len": pa.int64(), "data": pa.binary(),
          "ether_type": pa.int32(), "protocol": pa.int32(), "src": pa.string(), "dst": pa.string(), "src_port": pa.int32(), "dst_port": pa.int32()}


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = urlsplit(path).path
    return pafs.FileSystem.from_uri(path)


@dataclass
class Range(ds.InputPartition):
    path: str
    size: int
    start: int
    end: int


def flow(data: bytes) -> tuple[int | None, int | None, str | None, str | None, int | None, int | None]:
    """(EtherType behind VLAN tags, IP protocol, source, destination, ports); null from where it cannot be read."""
    at = 12
    while data[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
        at += 4
    if len(data) < at + 2:
        return (None,) * 6
    kind = int.from_bytes(data[at : at + 2], "big")
    ip = data[at + 2 :]
    if kind == 0x0800 and len(ip) >= 20 and ip[0] >> 4 == 4:
        size, protocol, ends = (ip[0] & 15) * 4, ip[9], (ip[12:16], ip[16:20])
        later = int.from_bytes(ip[6:8], "big") & 0x1FFF  # a later fragment has no ports
    elif kind == 0x86DD and len(ip) >= 40 and ip[0] >> 4 == 6:
        size, protocol, ends, later = 40, ip[6], (ip[8:24], ip[24:40]), 0
    else:
        return kind, None, None, None, None, None
    src, dst = (str(ipaddress.ip_address(e)) for e in ends)
    if protocol in (6, 17, 132) and not later and len(ip) >= size + 4:
        return kind, protocol, src, dst, *struct.unpack(">HH", ip[size : size + 4])
    return kind, protocol, src, dst, None, None


class Capture:
    """One open file: its format, and the places of its records."""

    def __init__(self, file: BinaryIO, size: int, path: str):
        self.file, self.size = file, size
        head = file.read(FILE_HEAD)
        if size >= FILE_HEAD and head[:4] not in MAGIC:
            raise ValueError(f"{path} is no capture file")
        self.order, self.fraction = MAGIC.get(head[:4], ("<", 1))
        self.buffer, self.at = b"", 0

    def bytes_at(self, at: int, n: int) -> bytes:
        """n bytes from a place (fewer at the file's end), through a buffer that moves on with them."""
        if at < self.at or at + n > self.at + len(self.buffer):
            self.file.seek(at)
            self.at, self.buffer = at, self.file.read(max(n, 1 << 20))
        return self.buffer[at - self.at : at - self.at + n]

    def records(self, at: int, end: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(place, seconds, fraction, captured length, length) of the records whose headers begin before ``end``; the
        generator's value is the place behind them (the file's size where no whole record is left)."""
        while at < end:
            if at + HEAD > self.size:
                return self.size
            sec, part, caplen, length = struct.unpack(self.order + "IIII", self.bytes_at(at, HEAD))
            if at + HEAD + caplen > self.size:
                return self.size
            yield at, sec, part, caplen, length
            at += HEAD + caplen
        return at if at + HEAD <= self.size and self._whole(at) else self.size

    def _whole(self, at: int) -> bool:
        return at + HEAD + struct.unpack(self.order + "I", self.bytes_at(at + 8, 4))[0] <= self.size

    def first_from(self, start: int) -> int:
        """The first header at or behind a place, as far as sizes tell; the same for every caller."""
        if start <= FILE_HEAD:
            return FILE_HEAD
        low = max(FILE_HEAD, start - LONGEST - HEAD)
        near = self.bytes_at(low, min(self.size, start + LONGEST + HEAD) - low)
        dead: set[int] = set()  # places of chains that broke: each is walked once
        for i in [0] if low == FILE_HEAD else self._plausible(near):
            seen, at, behind, n = [], low + i, 0, 0
            while behind == 0 or (n < CHAIN and behind):
                if at in dead:
                    break
                if at + HEAD > self.size:  # the file ends: with the last record, or within it
                    return behind or self.size
                sec, part, caplen, length = struct.unpack(self.order + "IIII", self.bytes_at(at, HEAD))
                if low > FILE_HEAD and not self._may_be(part, caplen, length):
                    break
                if at + HEAD + caplen > self.size:
                    return behind or self.size
                if at >= start and not behind:
                    behind = at
                    if low == FILE_HEAD:
                        return behind
                seen.append(at)
                at, n = at + HEAD + caplen, n + 1
            else:
                return behind
            dead.update(seen)
        return self.size

    def _may_be(self, part: int, caplen: int, length: int) -> bool:
        return part < 1_000_000 * self.fraction and 0 < length and caplen <= min(length, LONGEST) and length < 1 << 24

    def _plausible(self, near: bytes) -> Iterator[int]:
        """Places in some bytes that a header could stand at."""
        b = np.frombuffer(near, np.uint8).astype(np.int64)
        if len(b) < HEAD:
            return iter(())
        turn = (0, 1, 2, 3) if self.order == "<" else (3, 2, 1, 0)
        words = sum(b[i : len(b) - 3 + i] << (8 * t) for i, t in enumerate(turn))
        n = len(b) - HEAD + 1
        part, caplen, length = (words[k : k + n] for k in (4, 8, 12))
        good = (part < 1_000_000 * self.fraction) & (length > 0) & (caplen <= np.minimum(length, LONGEST)) & (length < 1 << 24)
        return iter(np.flatnonzero(good).tolist())


_COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b}
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)

#: (column, comparison, value); all conditions of one inner list hold for a packet, or all of another one.
Condition = tuple[str, str, object]


def _plain(value: object) -> object:
    """A condition's value as it is compared: times as microseconds (without a zone: of the driver's)."""
    if isinstance(value, datetime.datetime):
        return (value.astimezone(datetime.timezone.utc) - _EPOCH) // datetime.timedelta(microseconds=1)
    return [_plain(v) for v in value] if isinstance(value, (list, tuple, set)) else value


class CaptureReader(ds.DataSourceReader):
    def __init__(self, path: str, split: int, columns: list[str], either: list[list[Condition]]):
        self.path, self.split, self.columns, self.either = path, split, columns, either
        for name, sign, _ in (c for every in either for c in every):
            if name not in _ARROW or name == "data" or sign not in _COMPARE:
                raise ValueError(f"condition {name} {sign}")

    def partitions(self) -> list[Range]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else sorted(store.get_file_info(pafs.FileSelector(path)), key=lambda f: f.path)
        out = []
        for f in files:
            if f.is_file and f.size and f.base_name[:1] not in "._":
                step = self.split or f.size
                out += [Range(f.path, f.size, i, min(i + step, f.size)) for i in range(0, f.size, step)]
        return out or [Range("", 0, 0, 0)]

    def _passes(self, row: dict[str, object]) -> bool:
        return not self.either or any(all(row[name] is not None and _COMPARE[sign](row[name], value) for name, sign, value in every) for every in self.either)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as file:
            capture = Capture(file, partition.size, partition.path)
            rows: list[dict[str, object]] = []
            held = 0
            asked = {*self.columns, *(c[0] for every in self.either for c in every)}
            records = capture.records(capture.first_from(partition.start), partition.end)
            behind = None
            while behind is None:
                try:
                    at, sec, part, caplen, length = next(records)
                except StopIteration as stop:
                    behind = stop.value
                    break
                row: dict[str, object] = {"path": partition.path, "offset": at, "ts": sec * 1_000_000 + part // capture.fraction, "caplen": caplen, "len": length}
                if not asked.isdisjoint(("data", *_FLOW)):
                    row["data"] = capture.bytes_at(at + HEAD, caplen)
                    if not asked.isdisjoint(_FLOW):
                        row.update(zip(_FLOW, flow(row["data"])))
                if self._passes(row):
                    rows.append(row)
                    held += caplen
                    if len(rows) == _BATCH or held > 1 << 23:
                        yield self._batch(rows)
                        rows, held = [], 0
            if rows:
                yield self._batch(rows)
            if partition.end < partition.size and capture.first_from(partition.end) != behind:
                raise ValueError(f"{partition.path}: the records about byte {partition.end} are ambiguous; read with splitBytes 0")

    def _batch(self, rows: list[dict[str, object]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _ARROW[c]) for c in self.columns], names=self.columns)


@dataclass
class Written(ds.WriterCommitMessage):
    name: str | None


class CaptureWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        if missing := {"ts", "data"} - set(columns):
            raise ValueError(f"a capture needs the columns {sorted(missing)}")
        self.path, self.columns, self.overwrite = path, columns, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.pcap"
        n = 0
        with store.open_output_stream(f"{folder}/.{name}") as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, LONGEST, 1))
            for b in iterator:
                data = b.column("data").to_pylist()
                times = b.column("ts").cast(pa.int64()).to_pylist()
                lengths = b.column("len").to_pylist() if "len" in self.columns else [None] * len(data)
                for t, d, length in zip(times, data, lengths):
                    if d is not None:
                        sec, micros = divmod(t or 0, 1_000_000)
                        out.write(struct.pack("<IIII", sec, micros, len(d), max(len(d), length or 0)) + d)
                        n += 1
        if not n:
            store.delete_file(f"{folder}/.{name}")
        return Written(name if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        names = {m.name for m in messages if m and m.name}
        if self.overwrite:
            for f in store.get_file_info(pafs.FileSelector(folder)):
                if f.is_file and f.base_name.endswith(".pcap") and f.base_name.lstrip(".") not in names:
                    store.delete_file(f.path)
        for name in sorted(names):
            store.move(f"{folder}/.{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m and m.name and store.get_file_info(f"{folder}/.{m.name}").is_file:
                store.delete_file(f"{folder}/.{m.name}")


class CaptureSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> CaptureReader:
        columns = schema.fieldNames()
        if unknown := [c for c in columns if c not in _ARROW]:
            raise ValueError(f"a capture has no columns {unknown}")
        return CaptureReader(self.options["path"], int(self.options.get("splitBytes", str(1 << 26))), columns, json.loads(self.options.get("conditions", "[]")))

    def writer(self, schema: StructType, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


def read_captures(
    spark: SparkSession, path: str, columns: Iterable[str] = ("ts", "caplen", "len", "data"), split_bytes: int = 1 << 26, conditions: list[Condition] | list[list[Condition]] = []
) -> DataFrame:
    """The packets of a capture file or of those of a folder, by byte ranges, as far as they meet the conditions: a list of
    which all must hold, or a list of such lists of which one must."""
    register(spark)
    kinds = dict(c.split(" ") for c in COLUMNS.split(", "))
    either = [conditions] if conditions and isinstance(conditions[0], tuple) else conditions
    plain = json.dumps([[(name, sign, _plain(value)) for name, sign, value in every] for every in either])
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return spark.read.format("capture").schema(schema).option("splitBytes", split_bytes).option("conditions", plain).load(path)


def write_captures(packets: DataFrame, path: str, mode: str = "append") -> None:
    register(packets.sparkSession)
    packets.write.format("capture").mode(mode).save(path)
