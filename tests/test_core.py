import math
import time

import pyarrow as pa
import pytest

from lanewise.functions import rng
from lanewise.operators import element, errors, geometry, lost, tasks
from lanewise.sources import arrow_io
from lanewise.streaming.channel import Channel


def test_geometry():
    assert geometry.morsel_count(100, 8) == 13 and geometry.morsel_size(10, 1, 3) == 4
    assert [geometry.morsel_span(a, k, 1, 10) for a, k in ((0, 3), (3, 4), (7, 64))] == [(1, 3), (4, 7), (8, 10)]
    assert geometry.stream_window(100, 2) == (64, 4) and geometry.stream_window(1, 2) == (1, 1) and geometry.stream_window(5, 2, n_chunks=10)[0] == 5
    r = geometry.balanced_ranges(100, 64)
    assert r[:3] == [(1, 2), (3, 4), (5, 6)] and r[35][1] == 72 and r[36][0] == 73 and r[-1][1] == 100


def test_geometry_frames_equal_numbers(spark):
    assert [(x["lo"], x["hi"]) for x in geometry.balanced_frame(spark, 17, 5).orderBy("k").collect()] == geometry.balanced_ranges(17, 5)


def test_maps(spark):
    t = spark.createDataFrame([(k, "abcde"[k - 1], k) for k in range(1, 6)], "ix long, name string, x int")
    assert element.collect(element.map_columns(t, lambda x: x * 2)) == [2, 4, 6, 8, 10]
    assert element.collect(element.map_columns(t, lambda x: x > 2, "double")) == [0, 0, 1, 1, 1]
    assert element.collect(element.map_python(t, lambda x: None, "double")) == [None] * 5
    with pytest.raises(errors.TemplateMismatch, match="type 'int'"):
        element.map_columns(t, lambda x: x * 1.5, "int")
    with pytest.raises(errors.EngineError) as e:
        element.collect(element.map_python(t, lambda x: 1 // (x - 3) if x < 5 else 1 // 0, "int"))
    assert e.value.index == 3
    assert element.Prepared(t, lambda x: x + 1).run() == [2, 3, 4, 5, 6]


def test_calls():
    assert element.call("math.sqrt")(16) == 4 and element.call(source="y = x * 2\ny + 1")(20) == 41
    assert element.call(source="y = x")(1) is None
    with pytest.raises(errors.EngineError):
        element.call()
    with pytest.raises(errors.EngineError):
        element.call("sqrt")


def test_lost(spark):
    spans = spark.createDataFrame([(1, 0, 2), (1, 4, 1)], "run long, start long, count long")
    runs = spark.createDataFrame([(1, 6, 1, 10), (2, 3, 4, 10)], "run long, cursor long, size long, n long")
    assert sorted(map(tuple, lost.lost_ranges(spans, runs).collect())) == [(1, 3, 4), (1, 6, 6), (2, 1, 10)]


def test_rng(spark):
    b = rng.base(123)
    assert b == [1806547166, -983674937, 643431772, 1162448557, -959247990, -133913213]
    assert rng.seek(rng.seek(b, 3), 4) == rng.seek(b, 7)
    t = spark.range(1, 31).withColumnRenamed("id", "ix")
    one, many = (sorted((r["ix"], r["state"], r["u"]) for r in rng.streams(t.repartition(n), 42).collect()) for n in (1, 5))
    assert one == many and all(0 < x[2] < 1 for x in one)
    for bad in ("a", 1.5, (1, -1), (1, 0.5), (1, math.inf), (1, 2**53 + 2), (1, 2, 3)):
        with pytest.raises(errors.EngineError):
            rng.check_seed(bad)


def test_tasks(spark):
    pool = tasks.Pool(spark, 2)
    a = pool.submit(lambda n: spark.range(n).count(), n=5)
    assert tasks.collect(a) == 5
    with pytest.raises(errors.EngineError):
        tasks.collect(a)
    slow, fast = pool.submit(lambda: time.sleep(0.5)), pool.submit(lambda: 7)
    assert tasks.collect(slow, 0.01) is errors.TIMEOUT
    assert tasks.collect_any([slow, fast]) == (2, 7)
    bad = pool.submit_batch([lambda: 1, lambda: 1 // 0])
    with pytest.raises(ZeroDivisionError) as e:
        tasks.collect_all(bad)
    assert e.value.index == 2
    b = pool.submit(lambda: time.sleep(0.2))
    assert tasks.cancel(b) and not tasks.cancel(b)
    with pytest.raises(errors.Cancelled):
        tasks.collect(b)
    with tasks.with_pool(pool):
        assert tasks.current_pool() is pool
    assert tasks.current_pool() is None
    pool.stop()
    with pytest.raises(errors.Stopped):
        pool.submit(lambda: 1)


def test_arrow_landing(spark):
    t = pa.table({"a": pa.array([1, None], pa.int8()), "u": pa.array([0, 255], pa.uint8()), "w": pa.array([0, 4294967295], pa.uint32()), "m": pa.array([-(2**31), 5], pa.int32()), "f": pa.array(["x", None]).dictionary_encode()})
    assert arrow_io.read(spark, t).collect()[0].asDict() == {"a": 1, "u": 0, "w": 0.0, "m": None, "f": "x"}
    with pytest.raises(errors.NotPortable):
        arrow_io.land(pa.table({"b": pa.array([b"x"], pa.binary())}))
    assert pa.types.is_large_string(arrow_io.write(spark.createDataFrame([("x",)], "s string")).schema.field("s").type)


def test_channel(spark, tmp_path):
    c = Channel(spark, str(tmp_path / "in"), "seq long, v long", lambda df: df.selectExpr("seq", "v * 2 as v"), str(tmp_path / "ck"), capacity=4)
    assert c.send_batch([(k, k) for k in range(6)]) == 4 and c.send((9, 9)) is errors.FULL
    assert c.recv_batch(3) == [(0, 0), (1, 2), (2, 4)]
    c.close()
    assert c.recv_batch(3) == [(3, 6)] and c.recv_batch(1) is errors.CLOSED and errors.is_sentinel(errors.CLOSED)
