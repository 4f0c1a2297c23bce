"""Publishing to several outputs in one pass: formats, splits, rolled files, counts, and outputs that only count.

An output's ``format`` is ``codec:rest`` (``json:a,b``, ``csv:a,b``, ``template:${A} ...``); its ``name`` renders to a file by
strftime letters, ``#`` (the split, 0 to ``split`` - 1), and its rolls: a new file begins where the rendered name changes, at
minutes that are a multiple of ``minutes``, when ``seconds`` have gone by since the file's first row, or once it holds ``size``
bytes (with none of the three: at each minute). Times are those of the rows, so a run over old rows gives the same files.

Rows are formatted once for all outputs, dealt by file and split, sorted by time, and rolled as they stream by; a busy file
is dealt to more tasks by a larger ``split``. Outputs without a name are counted and not written.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewire.plans.template import FUNCTIONS, Template
from tidewire.streaming.flows import CODECS


@dataclass(frozen=True)
class Output:
    id: str
    format: str = ""
    name: str = ""
    split: int = 1
    minutes: int = 0
    seconds: float = 0
    size: int = 0


FORMATS: dict[str, Callable[[DataFrame, str], Column]] = {}


def register_format(codec: str, make: Callable[[DataFrame, str], Column]) -> None:
    """``make(rows, rest of the format)`` gives the payload; a null or empty payload is not published."""
    FORMATS[codec] = make


def _columns(df: DataFrame, rest: str) -> list[str]:
    return [c.strip() for c in rest.split(",")] if rest.strip() else df.columns


register_format("json", lambda df, rest: CODECS["json"](df, _columns(df, rest)))
register_format("csv", lambda df, rest: CODECS["csv"](df, _columns(df, rest)))
register_format("template", lambda df, rest: Template({c: F.col(c) for c in df.columns}, FUNCTIONS).column(rest))


def payload(df: DataFrame, text: str) -> Column:
    """The payload of a format ``codec:rest``."""
    found = re.match(r"([a-z0-9]+):", text)
    if not found or found[1] not in FORMATS:
        raise ValueError(f"no codec in the format {text!r}")
    return FORMATS[found[1]](df, text[found.end() :])


def outputs_of(properties: dict[str, str], id: str) -> list[Output]:
    """Outputs by ``<id>.file_format``, ``file_name`` (after ``|`` options ``ctime=``, ``rtime=``, ``rsize=``) and ``file_split``.

    Without a format and a name of a file there is one output that only counts.
    """
    get = lambda key: properties.get(f"{id}.{key}", "").strip()
    name, *options = get("file_name").split("|")
    if not (get("file_format") and name):
        return [Output(id, get("file_format"))]
    rolls = dict(re.findall(r"(ctime|rtime|rsize)=([0-9.]+)", "|".join(options)))
    return [Output(id, get("file_format"), name, int(get("file_split") or 1), int(rolls.get("ctime", 0)), float(rolls.get("rtime", 0)), int(rolls.get("rsize", 0)))]


#: Strftime letters as date patterns.
LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD"}


def rendered(name: str, ts: Column, split: Column) -> Column:
    """The file name of a row."""
    parts = re.split(r"(%[YmdHMSj]|#)", name)
    return F.concat(*[split.cast("string") if p == "#" else F.date_format(ts, LETTERS[p[1]]) if re.fullmatch("%[YmdHMSj]", p) else F.lit(p) for p in parts if p])


def formatted(df: DataFrame, outputs: list[Output], ts: str) -> DataFrame:
    """(output, file, calendar, at, payload): every row once for each output that has a payload for it; file is null for one that only counts."""
    at = F.col(ts)
    cells = []
    for o in outputs:
        made = payload(df, o.format) if o.format else F.lit("-")
        deal = F.pmod(F.xxhash64(made, at), F.lit(o.split)).cast("int")
        file = rendered(o.name, at, deal) if o.name else F.lit(None).cast("string")
        step = 60 * (o.minutes or (0 if o.seconds or o.size else 1))
        calendar = F.floor(F.unix_seconds(at) / step) if step else F.lit(0).cast("long")
        cells.append(F.struct(F.lit(o.id).alias("output"), file.alias("file"), deal.alias("split"), calendar.cast("long").alias("calendar"), F.unix_micros(at).alias("at"), made.alias("payload")))
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("payload is not null and payload <> ''")


def _rolling(limits: dict[str, tuple[float, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, roll, first, size = None, 0, 0, 0
        for b in batches:
            rolls = []
            for output, file, split, calendar, at, text in zip(*(b.column(n).to_pylist() for n in ("output", "file", "split", "calendar", "at", "payload"))):
                seconds, most = limits[output]
                own = (output, file, split)
                if own != (key[:3] if key else None):
                    key, roll, first, size = (*own, calendar), 0, at, 0
                elif calendar != key[3] or (seconds and at - first >= seconds * 1e6) or (most and size >= most):
                    key, roll, first, size = (*own, calendar), roll + 1, at, 0
                size += len(text.encode()) + 1
                rolls.append(roll)
            yield pa.RecordBatch.from_arrays([b.column("output"), b.column("file"), b.column("split"), pa.array(rolls, pa.int64()), b.column("payload")], names=["output", "file", "split", "roll", "payload"])

    return run


def rolled(rows: DataFrame, outputs: list[Output]) -> DataFrame:
    """(output, file, split, roll, payload) of formatted rows: ``roll`` counts the files of one name and split from 0."""
    limits = {o.id: (o.seconds, o.size) for o in outputs}
    dealt = rows.where("file is not null").repartition("output", "file", "split").sortWithinPartitions("output", "file", "split", "at", "payload")
    return dealt.mapInArrow(_rolling(limits), "output string, file string, split int, roll long, payload string")


def publish_outputs(df: DataFrame, outputs: list[Output], path: str, ts: str, compression: str = "gzip") -> dict[str, tuple[int, int]]:
    """Write a batch to all outputs and return (payloads, bytes) of each. The folder ``path``, which is replaced, holds output=/file=/split=/roll=."""
    seen = Observation()
    counts = []
    for o in outputs:
        own = F.col("output") == o.id
        counts += [F.sum(F.when(own, 1).otherwise(0)).alias(f"n_{o.id}"), F.sum(F.when(own, F.octet_length("payload")).otherwise(0)).alias(f"b_{o.id}")]
    rows = formatted(df, outputs, ts).observe(seen, *counts)
    if any(o.name for o in outputs):
        found = rolled(rows, outputs).withColumnRenamed("payload", "value")
        found.write.mode("overwrite").partitionBy("output", "file", "split", "roll").option("compression", compression).text(path)
    else:
        rows.write.format("noop").mode("overwrite").save()
    return {o.id: (seen.get[f"n_{o.id}"] or 0, seen.get[f"b_{o.id}"] or 0) for o in outputs}


def publish_batches(outputs: list[Output], path: str, ts: str, report: Callable[[int, dict[str, tuple[int, int]]], None]):
    """A foreachBatch function that publishes each batch under its own folder (written whole, so a batch that is done again replaces it)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/batch={batch_id}"
        seen = publish_outputs(batch, outputs, folder, ts)
        report(batch_id, seen)

    return run
