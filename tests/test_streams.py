import random
import time

import pandas as pd
import pytest
from pyspark.sql.types import LongType, StructField, StructType

from lanewise.operators import errors
from lanewise.streaming import log, ordered
from lanewise.streaming.channel import Channel

SCHEMA = StructType([StructField("seq", LongType()), StructField("v", LongType())])


def test_a_reader_takes_no_more_than_its_quantum(tmp_path):
    at = str(tmp_path / "log")
    end = log.Log(at, SCHEMA)
    for k in range(7):
        assert end.append([(k, k), (k, -k)]) == k
    reader = log.LogReader(at, SCHEMA, 3)
    assert reader.initialOffset() == {"segment": 0} and reader.latestOffset() == {"segment": 3} == reader.latestOffset()
    parts = reader.partitions({"segment": 0}, {"segment": 3})
    assert [p.number for p in parts] == [0, 1, 2] and [b.to_pylist() for p in parts for b in reader.read(p)][1] == [{"seq": 1, "v": 1}, {"seq": 1, "v": -1}]
    assert reader.latestOffset() == {"segment": 6}
    # Another process, which has not been told what was given, goes on from there.
    again = log.LogReader(at, SCHEMA, 2)
    assert again.latestOffset() == {"segment": 5}
    reader.commit({"segment": 3})
    assert log.segments(end.fs, end.at) == [3, 4, 5, 6] and log.Log(at, SCHEMA).next == 7
    assert end.handled(2) == 4 and end.handled(2) == 0 and end.handled(9) == 10
    for k in range(3, 7):
        reader.commit({"segment": k + 1})
    assert log.Log(at, SCHEMA).next >= 3 and reader.latestOffset()["segment"] >= 3


def test_a_restart_gives_no_message_twice(spark, tmp_path):
    def opened(f=lambda df: df, **more):
        return Channel(spark, str(tmp_path / "in"), "seq long, v long", f, str(tmp_path / "checkpoint"), **more)

    one = opened()
    one.send_batch([(1, 1), (2, 2)])
    assert one.recv_batch(5, 60) == [(1, 1), (2, 2)]
    one.running.join(60)  # the stream rests once there is nothing to do
    assert not one.running.is_alive()
    one.send((3, 3))  # sent, but never received: the process goes
    two = opened()
    assert two.send((4, 4)) is None
    assert [two.recv(60), two.recv(60)] == [(3, 3), (4, 4)]
    two.close()
    assert two.recv(60) is errors.CLOSED


def test_sends_are_bounded_and_immediate(spark, tmp_path):
    def slow(df):
        time.sleep(3)
        return df

    c = Channel(spark, str(tmp_path / "in"), "seq long, v long", slow, str(tmp_path / "checkpoint"), capacity=5, quantum=10)
    c.send((0, 0))
    c.begin()
    began = time.monotonic()
    assert [c.send((k, k)) for k in range(1, 7)] == [None] * 4 + [errors.FULL] * 2 and time.monotonic() - began < 1
    got = []
    while len(got) < 5:
        got += c.recv_batch(5, 60)
    assert got == [(k, k) for k in range(5)] and c.info()["sent"] == 0


def frame(rows):
    return pd.DataFrame(rows, columns=["seq", "v", "last"])


def test_what_comes_out():
    out, rest, done = ordered.let_out(frame([(3, "d", False), (1, "b", False), (0, "a", False), (1, "again", False)]), "seq", "last", 0)
    assert out["v"].tolist() == ["a", "b"] and rest["v"].tolist() == ["d"] and not done
    out, rest, done = ordered.let_out(frame([(0, "old", False), (5, "x", False)]), "seq", "last", 4)
    assert out.empty and rest["seq"].tolist() == [5] and not done
    out, rest, done = ordered.let_out(frame([(4, "a", False), (5, "end", True), (6, "late", False)]), "seq", "last", 4)
    assert out["v"].tolist() == ["a", "end"] and rest.empty and done


def run(spark, tmp_path, files, name, **more):
    at = tmp_path / name
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "channel string, seq long, v string, last boolean").coalesce(1).write.mode("append").parquet(str(at / "in"))
        time.sleep(0.05 * (k + 1 < len(files)))
    stream = spark.readStream.schema("channel string, seq long, v string, last boolean").option("maxFilesPerTrigger", 1).parquet(str(at / "in"))
    out = ordered.in_order(stream, closes="last", **more)
    out.writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(str(at / "out")).collect())


def test_channels_come_out_in_order(spark, tmp_path):
    g = random.Random(3)
    sent = [(c, k, f"{c}{k}", False) for c, n in (("a", 30), ("b", 1), ("c", 0), ("d", 12)) for k in range(n)]
    ends = [("a", 30, None, True), ("b", 1, None, True), ("c", 0, None, True)]  # d stays open
    rows = [*sent, *ends, *g.sample(sent, 10), ("b", 7, "after the end", False)]
    g.shuffle(rows)
    files = [rows[k::4] for k in range(4)]
    got = run(spark, tmp_path, files, "all")
    want = [(c, k + 1, "message", k, v, False) for c, k, v, _ in sent] + [(c, k + 1, "closed", k, None, True) for c, k, _, _ in ends]
    assert got == sorted(want)
    # What waits behind a gap stays, also over a restart.
    assert run(spark, tmp_path, [[("x", 2, "2", False), ("x", 0, "0", False)]], "gap") == [("x", 1, "message", 0, "0", False)]
    assert run(spark, tmp_path, [[("x", 1, "1", False)]], "gap") == [("x", k + 1, "message", k, str(k), False) for k in range(3)]


def test_a_wait_that_takes_too_long(spark, tmp_path):
    at = tmp_path / "slow"
    schema = "channel string, seq long, v string"
    spark.createDataFrame([("x", 1, "1"), ("x", 0, "0"), ("x", 3, "3")], schema).coalesce(1).write.parquet(str(at / "in"))
    out = ordered.in_order(spark.readStream.schema(schema).parquet(str(at / "in")), timeout=500)
    query = out.writeStream.format("memory").queryName("slow_channel").option("checkpointLocation", str(at / "checkpoint")).trigger(processingTime="200 milliseconds").start()
    try:
        limit = time.monotonic() + 60
        while time.monotonic() < limit and spark.table("slow_channel").where("kind = 'timeout'").count() == 0:
            time.sleep(0.2)
        spark.createDataFrame([("x", 2, "2")], schema).coalesce(1).write.mode("append").parquet(str(at / "in"))
        while time.monotonic() < limit and spark.table("slow_channel").count() < 5:
            time.sleep(0.2)
        rows = sorted(tuple(r) for r in spark.table("slow_channel").collect())[:5]
        assert rows == [("x", 1, "message", 0, "0"), ("x", 2, "message", 1, "1"), ("x", 3, "timeout", 2, None), ("x", 4, "message", 2, "2"), ("x", 5, "message", 3, "3")]
    finally:
        query.stop()


def test_tables_are_not_streams(spark):
    with pytest.raises(errors.EngineError):
        ordered.in_order(spark.createDataFrame([("a", 0)], "channel string, seq long"))
