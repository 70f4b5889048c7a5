import asyncio
import time

import pytest
from pyspark.sql import functions as F

from lanewise.functions import codec
from lanewise.functions.codec import NA_INT, NA_LOGICAL, NA_TEXT, Attributed, BadStream, Failure, Vector
from lanewise.operators import slices, tasks
from lanewise.operators.errors import TIMEOUT, Cancelled, EngineError, NotPortable, WorkerDied

FACTOR = Attributed(Vector("int", [1, None]), {"levels": Vector("text", ["x", "y"]), "class": "factor"})
VALUES = [
    None, True, NA_LOGICAL, 0, -1, (1 << 63) - 1, NA_INT, 0.5, float("inf"), 1 + 2j, "", "é", NA_TEXT, b"\0\1", [], [None, [1, "a"]], {}, {"a": {"b": [b""]}},
    Vector("logical", [True, None]), Vector("int", []), Vector("real", [0.5]), Vector("complex", [1j]), Vector("raw", [0, 255]), Vector("text", ["a", None]), Vector("int64", [1 << 40, None]), FACTOR,
    Attributed(Vector("real", [1.0] * 6), {"dim": Vector("int", [2, 3])}), Attributed([Vector("real", [1.0, 2.0]), FACTOR], {"names": Vector("text", ["a", "b"]), "class": "data.frame"}), Failure("E", "boom", "", 3), Failure("E", "boom"),
]


def test_round_trip_and_bytes():
    for v in VALUES:
        assert codec.read(codec.write(v)) == v
    for v, said in [(None, "490100"), (NA_LOGICAL, "49010102"), (1, "4901020100000000000000"), ("a", "4901040100000061"), (Failure("E", "b"), "4901110000010000004501000000" + "62" + "00000000")]:
        assert codec.write(v).hex() == said


def test_every_cut_and_tail_is_refused():
    for v in VALUES:
        raw = codec.write(v)
        for k in range(len(raw)):
            with pytest.raises(BadStream):
                codec.read(raw[:k])
        with pytest.raises(BadStream):
            codec.read(raw + b"\0")


@pytest.mark.parametrize("said", ["490200", "49010103", "490113016d", "49011200", "49010401000000ff", "4901040000008f", "49010cffffffffffffff7f", "49010d0200000000000000010000006100" + "010000006100", "49011102000000", "49010c01" + "00" * 7 + "11"])
def test_bad_streams(said):
    with pytest.raises(BadStream):
        codec.read(bytes.fromhex(said))


@pytest.mark.parametrize("v", [object(), 1 << 63, {1: 2}, [Failure("E", "b")], Vector("real", [None]), Vector("int", [1 << 40]), Attributed(Vector("int", [3]), {"levels": "x", "class": "factor"}), Attributed(1, {"dim": 2}), Attributed(Vector("real", [0.5]), {"class": "Date"}), Attributed(1.0, {"class": "difftime", "units": "years"})])
def test_declined_with_a_path(v):
    with pytest.raises(NotPortable, match="value"):
        codec.write(v)


def test_depth():
    v = []
    for _ in range(64):
        v = [v]
    assert codec.read(codec.write(v)) == v
    with pytest.raises(NotPortable):
        codec.write([v])


def test_slices_and_lost_slice(spark, tmp_path):
    t = spark.range(1, 101).withColumnRenamed("id", "ix")
    got = slices.map_in_slices(t, 100, lambda s: s.withColumn("v", F.col("ix") * 2), str(tmp_path / "a"), 2, 7)
    assert sorted(map(tuple, got.collect())) == [(k, 2 * k) for k in range(1, 101)]
    assert slices.map_in_slices(t, 0, lambda s: s, str(tmp_path / "b"), 2).count() == 0
    with pytest.raises(WorkerDied) as e:
        slices.map_in_slices(t, 100, lambda s: s.withColumn("v", F.when(F.col("ix") > 60, F.raise_error(F.lit("no"))).otherwise(1)), str(tmp_path / "c"), 2, 10)
    assert (61, 70) in e.value.lost and e.value.lost == sorted(e.value.lost)


def test_trace_dump_and_async(spark):
    pool, seen = tasks.Pool(spark, 2), []
    tasks.trace(pool, lambda event, n: seen.append((n, event)))
    ok, bad = pool.submit(lambda: 5), pool.submit(lambda: 1 / 0)

    async def both():
        assert await tasks.collect_async(ok, 20) == 5
        with pytest.raises(ZeroDivisionError):
            await tasks.collect_async(bad, 20)
        slow = pool.submit(lambda: time.sleep(1))
        assert await tasks.collect_async(slow, 0.05) is TIMEOUT
        assert tasks.cancel(slow)
        with pytest.raises(Cancelled):
            await tasks.collect_async(slow)
        assert await tasks.collect_all_async([pool.submit(lambda: k) for k in "ab"], 20) is not None
        assert (await tasks.collect_any_async([pool.submit(lambda: 7)], 20))[1] == 7

    asyncio.run(both())
    pool.stop()
    state = dict(map(tuple, tasks.dump(tasks.event_frame(pool)).collect()))
    assert (state[1], state[2], state[3]) == ("ok", "err", "cancel") and (1, "submit") in seen
    assert dict(map(tuple, tasks.info(tasks.event_frame(pool)).collect())) == {"ok": 4, "err": 1, "cancel": 1}


# Fixed values of the format: streams of scalars, vectors, nested values, attributes, errors and tasks, by what they hold.
STREAMS = {
    "nil": "490100",
    "false": "49010100",
    "true": "49010101",
    "missing logical": "49010102",
    "zero": "4901020000000000000000",
    "one": "4901020100000000000000",
    "minus one": "490102ffffffffffffffff",
    "the greatest of 32 bits": "490102ffffff7f00000000",
    "the greatest of 64 bits": "490102ffffffffffffff7f",
    "missing whole number": "4901020000000000000080",
    "real zero": "4901030000000000000000",
    "real minus zero": "4901030000000000000080",
    "named reals": "49010f080300000000000000000000000000f03f000000000000004000000000000008400d0100000000000000050000006e616d65730b0300000000000000010000006101000000620100000063",
    "two names, one missing": "49010f07020000000000000001000000020000000d0100000000000000050000006e616d65730b02000000000000000100000061ffffffff",
    "named numbers of 64 bits": "49010f0e0200000000000000010000000000000002000000000000000d0100000000000000050000006e616d65730b020000000000000001000000610100000062",
    "no rows, three columns": "49010f0700000000000000000d01000000000000000300000064696d0702000000000000000000000003000000",
    "one dimension": "49010f080200000000000000000000000000f03f00000000000000400d01000000000000000300000064696d020200000000000000",
    "dates": "49010f08020000000000000000000000008ed24000000000408ed2400d010000000000000005000000636c617373040400000044617465",
    "minutes, one missing": "49010f080200000000000000000000000000f83fa20700000000f07f0d020000000000000005000000636c61737304080000006469666674696d6505000000756e69747304040000006d696e73",
    "error": "49011100000a00000056616c75654572726f7204000000626f6f6d00000000",
    "error of an element": "490111010029000000000000000b000000576f726b65724572726f720e000000656c656d656e74206661696c656400000000",
}
TASKS = {
    "490112030000000200000007000000040a0000006e756d70792e6d65616e0c0100000000000000080300000000000000000000000000f03f000000000000004000000000000008400d0000000000000000": ("numpy.mean", 2.0),
    "490112030100000200000007000000040500000078202b20310c00000000000000000d01000000000000000100000078022900000000000000": ("x + 1", 42),
    "4901120200000003000000070000000408000000626173653a3a70690c00000000000000000d0000000000000000": ("base::pi", None),
}
REFUSED = [
    "4901130561626364", "49011300", "49017f", "490200", "4901020102", "49010000ff", "49010d0100000000000000ffffffff", "49010f0f", "49010f0000", "490106050000000000000000000000", "49010c020000000000000000",
    "49010d020000000000000000", "49010b020000000000000004000000", "49010103", "49010c0100000000000000110000000000000000", "4901110200000000000000000000000000", "49010401000000ff", "490104feffffff",
]
REFUSED_TASKS = [
    "490112020001000000000000000000", "490112026300000000000000000000", "49011202000000000000000000000004000000000c00000000000000000d000000000000000000", "4901120300000002000000070000000401000000660c0000000000000000",
    "4901120300000002000000070000000201000000000000000c00000000000000000d0000000000000000", "490100",
]


@pytest.mark.parametrize("name", STREAMS)
def test_fixed_streams_come_back_byte_by_byte(name):
    raw = bytes.fromhex(STREAMS[name])
    assert codec.write(codec.read(raw)) == raw


@pytest.mark.parametrize("said", REFUSED)
def test_fixed_bad_streams_are_refused(said):
    with pytest.raises(BadStream):
        codec.read(bytes.fromhex(said))


def test_tasks_travel_and_run():
    for said, (code, value) in TASKS.items():
        raw = bytes.fromhex(said)
        task = codec.read_task(raw)
        assert task.code == code and codec.write_task(task) == raw
        with pytest.raises(BadStream):
            codec.read(raw)
        if value is None:
            with pytest.raises(NotPortable):
                codec.run_task(task)
        else:
            assert codec.run_task(task) == value
    call = codec.TaskCall(3, codec.BY_SOURCE, 7, "sum(xs) + n", [], {"xs": [codec.Ref("kept_1"), 2], "n": 3})
    again = codec.read_task(codec.write_task(call))
    assert again == call and codec.run_task(again, {"kept_1": 5}) == 10
    with pytest.raises(EngineError):
        codec.run_task(again)
    with pytest.raises(NotPortable):
        codec.write([codec.Ref("kept_1")])
    for bad in (codec.TaskCall(9, 0, 0, "f"), codec.TaskCall(3, 0, 0, 1), codec.TaskCall(3, 0, 0, "f", [codec.Ref("")])):
        with pytest.raises(NotPortable):
            codec.write_task(bad)


@pytest.mark.parametrize("said", REFUSED_TASKS)
def test_bad_tasks_are_refused(said):
    with pytest.raises(BadStream):
        codec.read_task(bytes.fromhex(said))
