import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.streaming import outputs, timers
from tidewire.streaming.outputs import Output

START = datetime.datetime(2024, 5, 1, 10, 58, 30)


def events(spark, n=400, step=7):
    rows = [(i, START + datetime.timedelta(seconds=step * i), "x" * (i % 40) if i % 9 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id int, ts timestamp, text string").repartition(3)


def brute(rows, o):
    """Files of one output: (file, roll) -> payloads, rows in order of time."""
    out, state = {}, {}
    for ts, text in rows:
        file = ts.strftime(o.name)
        step = 60 * (o.minutes or (0 if o.seconds or o.size else 1))
        calendar = int(ts.replace(tzinfo=datetime.timezone.utc).timestamp() // step) if step else 0
        s = state.get(file)
        if s is None:
            s = state[file] = [0, calendar, ts, 0]
        elif s[1] != calendar or (o.seconds and (ts - s[2]).total_seconds() >= o.seconds) or (o.size and s[3] >= o.size):
            s[:] = [s[0] + 1, calendar, ts, 0]
        s[3] += len(text) + 1
        out.setdefault((file, s[0]), []).append(text)
    return out


@pytest.mark.parametrize("o", [Output("o", "csv:text", "f-%Y%m%d_%H"), Output("o", "csv:text", "f-%H%M", minutes=5), Output("o", "csv:text", "f-%d", minutes=10), Output("o", "csv:text", "f-%H", seconds=50), Output("o", "csv:text", "f-%Y", size=300), Output("o", "csv:text", "f-%Y%j", seconds=90, size=200)], ids=str)
def test_rolls(spark, tmp_path, o):
    df = events(spark)
    seen = outputs.publish_outputs(df, [o, Output("count", "json:")], str(tmp_path / "out"), "ts")
    rows = sorted((r.ts, r.text) for r in df.where("text <> ''").collect())
    got = {}
    for r in spark.read.text(str(tmp_path / "out")).collect():
        got.setdefault((r.file, r.roll), []).append(r.value)
    want = brute(rows, o)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert seen["o"] == (len(rows), sum(len(t) for _, t in rows)) and seen["count"][0] == 400


def test_splits_and_only_counting(spark, tmp_path):
    df = events(spark)
    o = Output("o", "template:${id}:${MD5(){${text}}}", "part-#", 4, size=10**9)
    assert outputs.publish_outputs(df, [o], str(tmp_path / "out"), "ts", "none")["o"][0] == 400
    got = spark.read.text(str(tmp_path / "out"))
    assert {r.file for r in got.select("file").distinct().collect()} == {f"part-{i}" for i in range(4)} and got.count() == 400
    assert outputs.publish_outputs(df, [Output("s", "csv:id")], str(tmp_path / "none"), "ts") == {"s": (400, 10 + 180 + 900)} and not (tmp_path / "none").exists()
    assert outputs.publish_outputs(df.limit(0), [Output("s", "csv:id"), o], str(tmp_path / "empty"), "ts") == {"s": (0, 0), "o": (0, 0)}
    with pytest.raises(ValueError):
        outputs.payload(df, "id,text")


def test_configuration():
    props = {"a.file_format": "csv:id", "a.file_name": "f-%H-#|ctime=5|rsize=100", "a.file_split": "3", "b.file_format": "csv:id", "c.file_name": "f"}
    assert outputs.outputs_of(props, "a") == [Output("a", "csv:id", "f-%H-#", 3, 5, 0, 100)]
    assert outputs.outputs_of(props, "b") == [Output("b", "csv:id")] and outputs.outputs_of(props, "c") == outputs.outputs_of({}, "c") == [Output("c")]


def test_publishing_a_stream(spark, tmp_path):
    src, seen = str(tmp_path / "in"), {}
    for i in range(2):
        events(spark, 60).withColumn("id", F.col("id") + 60 * i).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id int, ts timestamp, text string").option("maxFilesPerTrigger", 1).parquet(src)
    outs = [Output("o", "csv:id", "f-%H", seconds=60), Output("s", "json:id")]
    run = outputs.publish_batches(outs, str(tmp_path / "out"), "ts", lambda i, counts: seen.update({i: counts}))
    stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert {k: v["o"][0] for k, v in seen.items()} == {0: 60, 1: 60} and all(v["s"][0] == 60 for v in seen.values())
    got = spark.read.text(str(tmp_path / "out"))
    assert sorted(int(r.value) for r in got.collect()) == list(range(120)) and got.where("batch = 1").count() == 60


def test_timers(spark, tmp_path):
    at = lambda s: START + datetime.timedelta(seconds=s)
    ms = lambda s: int(at(s).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    batches = [
        [("a", ms(30), "x", at(0)), ("a", ms(10), "y", at(0)), ("a", ms(10), "w", at(1)), ("b", ms(20), "z", at(2)), ("a", None, "none", at(0))],
        [("b", ms(500), "far", at(25))],
        [("a", ms(5), "past", at(26)), ("c", ms(40), "c", at(45))],
        [("d", ms(900), "d", at(100))],
        [("d", ms(901), "e", at(101))],
    ]
    src, schema = str(tmp_path / "in"), "key string, due_ms long, item string, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
        q = timers.due_items(stream, "ts", "0 seconds").writeStream.foreachBatch(lambda d, i: seen.append([tuple(r) for r in d.collect()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    rows = [r for b in seen for r in b]
    assert [r for r in rows if r[0] == "a"] == [("a", ms(5), "past", True), ("a", ms(10), "w", False), ("a", ms(10), "y", False), ("a", ms(30), "x", False)]
    assert [r[1:3] for r in rows if r[0] in "bc"] == [(ms(20), "z"), (ms(40), "c")] and not [r for r in rows if r[0] == "d"]


def test_files_of_times_in_the_last_half_millisecond_of_a_quarter(spark, tmp_path):
    """The SQL rounds times to milliseconds, so its quarters begin half a millisecond early (and end late before 1970)."""
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidewire.queries import ORACLES, QUERIES

    from .oracle import differences

    at = [datetime.datetime(y, 1, 1, h, m) + datetime.timedelta(microseconds=us) for y in (1969, 1970, 2024) for h in (0, 1) for m in (0, 15, 30, 45) for us in (-501, -500, -499, -1, 0, 1, 499, 500, 501)]
    rows = {"event_id": range(len(at)), "ts": pa.array(at, pa.timestamp("us")), "user_id": [7] * len(at), "event_type": ["view"] * len(at)}
    pq.write_table(pa.table(rows), tmp_path / "events.parquet")
    assert not differences(spark, QUERIES["output_files"], ORACLES["output_files"], str(tmp_path))
