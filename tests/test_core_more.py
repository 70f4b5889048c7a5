import asyncio
import math
import os
import subprocess
import sys
import threading
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanewise.functions import codec, rng
from lanewise.operators import element, errors, lost, slices, tasks, transport
from lanewise.sources import arrow_io
from lanewise.streaming.channel import Channel


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([(k, "abcde"[k - 1], k) for k in range(1, 6)], "ix long, name string, x int")


def test_values_out_of_range_are_their_elements_errors(five):
    for template, value in (("int", 2**40), ("int", -(2**31) - 1), ("bigint", 2**70), ("bigint", -(2**63) - 1)):
        got = element.map_python(five, lambda x, v=value: v if x == 3 else x, template).orderBy("ix").collect()
        assert [r["value"] for r in got] == [1, 2, None, 4, 5] and "out of the range" in got[2]["error"]
    assert element.collect(element.map_python(five, lambda x: 2**31 - 1, "int")) == [2**31 - 1] * 5


def test_templates_of_several_values_and_complex_ones(five):
    m = element.map_python(five, lambda x: {"lo": x, "hi": 2 * x}, "double", size=2)
    assert element.collect(m)[1] == [2.0, 4.0]
    assert {(r["ix"], r["row_name"], r["value"]) for r in element.matrix(m, ["lo", "hi"]).collect()} == {(k, n, v) for k in range(1, 6) for n, v in (("lo", float(k)), ("hi", 2.0 * k))}
    short = element.map_python(five, lambda x: [x] * x, "int", size=2)
    assert element.first_error(short).first()["ix"] == 1
    assert element.collect(element.map_python(five, lambda x: complex(x, -1) if x > 1 else True, "complex")) == [1, 2 - 1j, 3 - 1j, 4 - 1j, 5 - 1j]


def test_values_of_any_kind_travel_as_streams(five):
    m = element.map_python(five, lambda x: [x, "s", None, {"a": 1.5}], "any")
    assert codec.read(bytes(element.collect(m)[2])) == [3, "s", None, {"a": 1.5}]


def test_tables_from_values(spark):
    t = element.from_values(spark, {"a": 1.5, "b": None}, "double")
    assert [tuple(r) for r in t.orderBy("ix").collect()] == [(1, "a", 1.5), (2, "b", None)]
    assert element.collect(element.map_columns(element.from_values(spark, [3, 4]), lambda x: x + 1)) == [4, 5]


def test_seeded_maps_don_t_depend_on_the_deal(spark):
    def draws(x, rng):
        return [rng.normal(), rng.uniform()]

    t = spark.range(1, 41).selectExpr("id as ix", "cast(id as int) as x")
    one, many = (element.collect(element.map_python(t.repartition(n), draws, "double", size=2, seed=42)) for n in (1, 6))
    assert one == many and len({tuple(x) for x in one}) == 40
    late = t.where("ix > 10").selectExpr("ix - 10 as ix", "x")
    assert element.collect(element.map_python(late, draws, "double", size=2, seed=(42, 10))) == one[10:]
    first = rng.Stream(rng.seek(rng.base(42), 3))
    assert one[2] == [first.normal(), first.uniform()]
    with pytest.raises(errors.EngineError):
        element.map_python(t, draws, "double", seed=1.5)


def test_streams_of_numbers():
    state = rng.base(42)
    for ks in ([1, 2, 3, 4, 5, 6, 7], [9], [5, 1, 2**40, 0], list(range(1000, 1300))):
        got = rng.signed_words(rng.many(state, np.array(ks))).T.tolist()
        assert got == [rng.seek(state, k) for k in ks]
    s = rng.Stream(state)
    x = [s.uniform() for _ in range(5000)]
    assert x[0] == rng.uniform(state) and 0 < min(x) and max(x) < 1 and abs(sum(x) / 5000 - 0.5) < 0.02
    n = [s.normal() for _ in range(5000)]
    assert abs(sum(n) / 5000) < 0.05 and abs(sum(v * v for v in n) / 5000 - 1) < 0.1
    assert {s.below(3) for _ in range(100)} == {0, 1, 2}


def test_sources_are_compiled_once(spark):
    f = element.call(source="y = x * 2\ny + 1")
    assert f(20) == 41 and f.ready is not None and f(1) == 3
    import pickle

    again = pickle.loads(pickle.dumps(f))
    assert again.ready is None and again(2) == 5


def test_prepared_maps(spark, five):
    p = element.Prepared(five, lambda x: x + 1, "int")
    assert p.run() == [2, 3, 4, 5, 6] == p.run() and p.stagings == 1
    assert p.run(collect="view").count() == 5 and p.run() == [2, 3, 4, 5, 6] and p.stagings == 2
    other = five.withColumn("x", F.col("x") * 10)
    assert p.run(other) == [11, 21, 31, 41, 51] and p.stagings == 3
    q = element.Prepared(five, lambda x, rng: rng.uniform(), "double", python=True)
    assert q.run(seed=1) == q.run(seed=1) != q.run(seed=2)
    bad = element.Prepared(five, lambda x: 1 // (x - 2), "int", python=True)
    for _ in range(2):
        with pytest.raises(errors.EngineError) as e:
            bad.run()
        assert e.value.index == 2
    assert bad.stagings == 2

    def slow(x):
        time.sleep(3)
        return x

    s = element.Prepared(five, slow, "int", python=True)
    began = time.monotonic()
    assert s.run(timeout=1) is errors.TIMEOUT and time.monotonic() - began < 3
    s.replace(five.limit(1))
    assert s.run() == [1]
    with pytest.raises(errors.EngineError):
        element.Prepared(five, lambda x: x).run(collect="view")
    assert "prepared" in repr(p)


def test_errors_cross_within_a_budget(five):
    class Odd(ValueError):
        pass

    def f(x):
        if x > 2:
            e = Odd(f"bad {x}")
            e.code, e.handle, e.long = 7, object(), "x" * 500
            raise e
        return x

    for budget, kept, dropped in ((4096, {"code", "long"}, ["handle"]), (200, {"code"}, ["handle", "long"])):
        m = element.map_python(five, f, "int", budget=budget)
        assert max(len(r["failure"]) for r in m.where("failure is not null").collect()) <= budget
        with pytest.raises(errors.RemoteError) as e:
            element.collect(m)
        assert e.value.index == 3 and e.value.classes[:2] == ["Odd", "ValueError"] and set(e.value.fields) == kept and e.value.dropped_fields == dropped
    long = transport.restored(transport.flatten(ValueError("m" * 1000), 300))
    assert str(long) == "ValueError: " + "m" * 150
    assert transport.FALLBACK in str(transport.restored(transport.flatten(Odd("m" * 1000), 60)))


def test_the_library_travels_to_workers(tmp_path):
    """A map of a function from this library, started from another folder with the path known to the driver alone."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parent.parent)!r})
from pyspark.sql import SparkSession
from lanewise.operators import element
from lanewise.functions import rng
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
t = s.range(1, 4).selectExpr("id as ix", "cast(id as int) as x")
print(element.collect(element.map_python(t, element.call("math.sqrt"), "double"))[0], rng.streams(t, 1).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=180)
    assert out.stdout.split() == ["1.0", "3"], out.stderr[-800:]


def test_the_session_stays_as_it_is(spark):
    from lanewise import session

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    own = session.with_batches(spark.range(1000).coalesce(1), 100)
    assert own.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] == 100 and spark.conf.get(key) == before
    assert spark.range(1000).coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] == 1000


def test_pools(spark):
    with tasks.local_pool(spark, 1, capacity=2) as pool:
        gate = threading.Event()
        one = pool.submit(gate.wait)
        batch = pool.submit_batch([lambda: 1, lambda: 2, lambda: 3])
        assert len(batch) == 1
        with pytest.raises(errors.SlotsExhausted):
            pool.submit_batch([lambda: 4])
        snap = tasks.snapshot(pool)["tasks"]
        assert snap["running"] + snap["pending"] == 2
        gate.set()
        assert tasks.collect_all([one, *batch]) == [True, 1]
        assert tasks.collect(pool.submit_call("math.hypot", None, 3, 4)) == 5 and tasks.collect(pool.submit_call(None, "x + 1", 4)) == 5
        assert tasks.default_pool() is pool and "pool" in repr(pool) and "task" in repr(one)
    with pytest.raises(errors.Stopped) as e:
        pool.submit_batch([lambda: 1])
    assert e.value.accepted == []
    with pytest.raises(errors.EngineError):
        tasks.default_pool()
    before = tasks.set_default_pool(pool)
    assert tasks.default_pool() is pool and tasks.set_default_pool(before) is pool


def test_nested_tasks_help_one_another(spark):
    with tasks.local_pool(spark, 1) as pool:
        inner = lambda p: tasks.collect(tasks.current_pool().submit(lambda: p * 2))
        outer = lambda: sum(tasks.collect_all([tasks.current_pool().submit(inner, p=p) for p in range(5)]))
        assert tasks.collect(pool.submit(outer), timeout=30) == 20


def test_hard_cancel_interrupts_the_job(spark):
    def slow(batches):
        time.sleep(60)
        yield from batches

    with tasks.local_pool(spark, 1) as pool:
        t = pool.submit(lambda: spark.range(4).mapInArrow(slow, "id long").count())
        time.sleep(3)
        began = time.monotonic()
        assert tasks.cancel(t, hard=True)
        with pytest.raises(errors.Cancelled):
            tasks.collect(t)
    assert time.monotonic() - began < 40


def test_stopped_pools_lose_what_has_not_begun(spark):
    pool = tasks.Pool(spark, 1)
    gate = threading.Event()
    pool.submit(gate.wait)
    late = pool.submit(lambda: 1)
    stopper = threading.Thread(target=pool.stop)
    stopper.start()
    time.sleep(0.3)
    gate.set()
    stopper.join()
    with pytest.raises(errors.Stopped):
        tasks.collect(late)
    assert {r["state"]: r["n"] for r in tasks.info(tasks.event_frame(pool)).collect()}["lost"] == 1


def test_all_lost_slices_are_named(spark, tmp_path):
    t = spark.range(1, 41).selectExpr("id as ix", "id as x")

    def f(df):
        return df.withColumn("x", F.when(F.col("ix").isin(3, 25), F.raise_error(F.lit("gone"))).otherwise(F.col("x")))

    with pytest.raises(errors.WorkerDied) as e:
        slices.map_in_slices(t, 40, f, str(tmp_path / "a"), workers=4, n_chunks=4)
    assert (1, 10) in e.value.lost and set(e.value.lost) <= {(1, 10), (21, 30)}
    assert slices.map_in_slices(t, 40, lambda df: df, str(tmp_path / "b"), 2).count() == 40
    assert slices.map_in_slices(t, 40, lambda df: df, str(tmp_path / "c"), 2, retry=False).count() == 40


def test_labels_of_lost_ranges(spark):
    runs = spark.createDataFrame([(1, [(5, 6), (1, 2)]), (2, [])], "run long, r array<struct<lo:long,hi:long>>")
    assert [r[0] for r in runs.orderBy("run").select(lost.label(F.col("r"))).collect()] == ["1-2, 5-6", "(none)"]


def doubled(df):
    return df.selectExpr("seq", "v * 2 as v")


def channel(spark, tmp_path, f=doubled, **more):
    return Channel(spark, str(tmp_path / "in"), "seq long, v long", f, str(tmp_path / "ck"), **more)


def test_sends_after_close_are_refused(spark, tmp_path):
    c = channel(spark, tmp_path)
    assert c.send((1, 1)) is None
    c.close()
    assert c.send((2, 2)) is errors.CLOSED and c.send_batch([(3, 3)]) is errors.CLOSED and not c.alive()
    assert c.recv() == (1, 2) and c.recv() is errors.CLOSED and c.info()["accepted"] == c.info()["received"] == 1


def test_a_failed_batch_gives_nothing_and_none_is_given_twice(spark, tmp_path):
    def f(df):
        if df.where("v = 13").count():
            raise ValueError("unlucky")
        return doubled(df)

    c = channel(spark, tmp_path, f, capacity=10)
    for k in (1, 2, 13, 4):
        assert c.send((k, k)) is None
    got = [c.recv() for _ in range(3)]
    assert got[:2] == [(1, 2), (2, 4)] and errors.is_remote_error(got[2]) and "unlucky" in str(got[2])
    assert c.recv() is errors.PEER_GONE and c.send((5, 5)) is errors.PEER_GONE and c.recv_batch(5) is errors.PEER_GONE


def test_waits_and_capacity(spark, tmp_path):
    c = channel(spark, tmp_path, capacity=2)
    began = time.monotonic()
    assert c.recv(0.3) is errors.TIMEOUT and 0.25 < time.monotonic() - began < 5 and c.recv(0) is errors.TIMEOUT and c.recv_batch(4) == []
    threading.Timer(0.3, lambda: c.send_batch([(1, 1), (2, 2), (3, 3)])).start()
    assert c.recv(60) == (1, 2) and c.recv_batch(9, 60) == [(2, 4)]


def test_asynchronous_receipt(spark, tmp_path):
    c = channel(spark, tmp_path)

    async def both():
        first, second = asyncio.create_task(c.recv_async(60)), asyncio.create_task(c.recv_batch_async(5, 60))
        await asyncio.sleep(0.2)
        c.send_batch([(k, k) for k in range(3)])
        return await first, await second

    assert asyncio.run(both()) == ((0, 0), [(1, 2), (2, 4)])


def test_handlers(spark, tmp_path):
    c, seen = channel(spark, tmp_path), []
    t = c.recv_handler(seen.append)
    with pytest.raises(errors.EngineError):
        c.recv_handler(seen.append)
    c.send_batch([(1, 1), (2, 2)])
    c.close()
    t.join(60)
    assert seen == [(1, 2), (2, 4), errors.CLOSED]
    bursts = []
    d = Channel(spark, str(tmp_path / "in2"), "seq long, v long", doubled, str(tmp_path / "ck2"))
    d.send_batch([(1, 1), (2, 2)])
    d.close()
    d.recv_handler(bursts.append, batch=True).join(60)
    assert bursts == [[(1, 2), (2, 4)], errors.CLOSED]


def test_arrow_sources_and_vectors(spark):
    batch = pa.record_batch({"a": pa.array([1, None, -(2**31)], pa.int32())})
    for source in (batch, pa.Table.from_batches([batch]), pa.RecordBatchReader.from_batches(batch.schema, [batch]), iter([batch])):
        assert [r["a"] for r in arrow_io.read(spark, source).collect()] == [1, None, None]
    two = pa.chunked_array([pa.array(["b", "a", None]).dictionary_encode(), pa.array(["c", "b"]).dictionary_encode()])
    assert arrow_io.vector(two) == ([1, 2, None, 3, 1], ["b", "a", "c"], False)
    assert arrow_io.levels(pa.table({"f": two, "n": [1, 2, 3, 4, 5]})) == {"f": (["b", "a", "c"], False)}
    ordered = pa.DictionaryArray.from_arrays(pa.array([0, 1], pa.int8()), pa.array(["lo", "hi"]), ordered=True)
    assert arrow_io.vector(ordered) == ([1, 2], ["lo", "hi"], True)
    other = pa.DictionaryArray.from_arrays(pa.array([0, 1], pa.int8()), pa.array(["hi", "lo"]), ordered=True)
    assert arrow_io.vector(pa.chunked_array([ordered, other])) == ([1, 2, 2, 1], ["lo", "hi"], True)
    with pytest.raises(errors.NotPortable, match="'f'"):  # in a frame, as any dictionary whose batches differ
        arrow_io.land(pa.table({"f": pa.chunked_array([ordered, other])}))
    assert arrow_io.vector(pa.array([1, None], pa.int64())) == ([1, None], None, False)
    a = arrow_io.write_vector([1.0, math.nan, None])
    assert a.null_count == 1 and math.isnan(a[1].as_py()) and pa.types.is_large_string(arrow_io.write_vector(["x"]).type)
    with pytest.raises(errors.NotPortable):
        arrow_io.land_frame(spark.createDataFrame([(b"x",)], "b binary"))


def test_levels_over_many_ranges(spark):
    t = spark.range(500).selectExpr("id as ix", "concat('l', id % 90) as x")
    assert [r["level"] for r in arrow_io.factor_levels(t, "ix", "x").orderBy("code").collect()] == [f"l{k}" for k in range(90)]
    assert arrow_io.factor_levels(t.limit(0), "ix", "x").count() == 0
