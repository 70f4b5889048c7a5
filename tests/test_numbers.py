import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import quantiles, rng
from lanewise.operators import element, errors, matrices
from lanewise.sources import arrow_io


def linear(values, p):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    at = p * (len(v) - 1)
    a, b = v[math.floor(at)], v[math.ceil(at)]
    return a if a == b or at == math.floor(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b


@pytest.mark.parametrize("kind", ["uniform", "equal", "steep", "few", "wide", "ends"])
def test_quantiles_equal_a_sort(spark, kind):
    g = random.Random(3)
    values = {
        "uniform": [g.random() for _ in range(3000)], "equal": [2.5] * 500 + [g.random() for _ in range(20)], "steep": [math.exp(g.gauss(0, 30)) for _ in range(2000)] + [0.0] * 50,
        "few": [1.0, 5.0, 5.0], "wide": [-1.7e308, 1.7e308, *[g.uniform(-1e308, 1e308) for _ in range(300)], 5e-324, -5e-324], "ends": [math.inf, -math.inf, math.nan, math.nan, *map(float, range(200))],
    }[kind]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "v double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.7777, 0.99, 1.0]
    got = quantiles.quantiles(df, F.col("v"), probs, bins=8, few=5)
    assert [repr(x) for x in got] == [repr(linear(values, p)) for p in probs]


def test_quantiles_of_nothing(spark):
    assert quantiles.quantiles(spark.createDataFrame([(None,)], "v double"), F.col("v"), [0.5]) == [None]
    with pytest.raises(errors.EngineError):
        quantiles.quantiles(spark.range(3), F.col("id"), [1.5])


def test_native_streams_equal_those_in_numpy(spark):
    ks = [1, 2, 3, 255, 256, 65_537, 123_456_789_012, 2**52]
    t = spark.createDataFrame([(k,) for k in ks], "ix long")
    for seed in (42, (-7, 1000)):
        got = {r["ix"]: (tuple(r["state"]), r["u"]) for r in rng.native_streams(t, seed).collect()}
        want = {r["ix"]: (tuple(r["state"]), r["u"]) for r in rng.streams(t, seed).collect()}
        assert got == want
    plan = rng.native_streams(t, 42)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Exchange hash" not in plan
    with pytest.raises(Exception, match="beyond 16 bits"):
        rng.native_streams(t, 42, bits=16).collect()


def test_whole_numbers_are_equally_likely():
    s = rng.Stream(rng.base(1))
    n = np.bincount([s.below(48) for _ in range(48_000)], minlength=48)
    assert n.min() > 850 and n.max() < 1150 and len(n) == 48
    assert {s.below(1) for _ in range(5)} == {0} and s.below(1 << 40) < 1 << 40 and {s.below(2) for _ in range(50)} == {0, 1}
    with pytest.raises(errors.EngineError):
        s.below(0)
    # Ten bits of a number at a time, those of 1,000 and more drawn again.
    a, b = rng.Stream(rng.base(9)), rng.Stream(rng.base(9))
    for _ in range(300):
        while (k := int(b.uniform() * 65536) % 1024) >= 1000:
            pass
        assert a.below(1000) == k


def test_normals_by_inversion():
    a, b = rng.Stream(rng.base(5)), rng.Stream(rng.base(5))
    for _ in range(100):
        u = int(b.uniform() * 2**27) + b.uniform()
        assert a.normal() == NormalDist().inv_cdf(u / 2**27)


def test_codes_of_several_columns(spark, monkeypatch):
    g = random.Random(2)
    rows = [(k, g.choice(["x", "y", None, "z"]), f"l{g.randrange(300)}", g.choice([None, "only"])) for k in range(2000)]
    df = spark.createDataFrame(rows, "ix long, a string, b string, `c.d` string").repartition(5)
    want = {}
    for name, at in (("a", 1), ("b", 2), ("c.d", 3)):
        for r in sorted(rows):
            if r[at] is not None:
                want.setdefault((name, r[at]), sum(k[0] == name for k in want) + 1)
    for most in (arrow_io.LOOKED_UP, 10):  # one broadcast row of maps, or a join a column
        monkeypatch.setattr(arrow_io, "LOOKED_UP", most)
        coded, levels = arrow_io.encode_columns(df, "ix", ["a", "b", "c.d"])
        assert {(r["column"], r["level"]): r["code"] for r in levels.collect()} == want
        assert sorted(tuple(r) for r in coded.collect()) == [(k, want.get(("a", a)), want.get(("b", b)), want.get(("c.d", c))) for k, a, b, c in rows]
    empty = arrow_io.encode_columns(df.limit(0), "ix", ["a"])
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_batches_that_order_levels_otherwise(spark):
    batches = [(1, 1, "lo"), (1, 2, "mid"), (2, 1, "lo"), (2, 2, "hi"), (3, 1, "mid"), (3, 2, "lo"), (3, 3, "hi"), (4, 1, "mid"), (4, 2, "hi")]
    got = arrow_io.level_conflicts(spark.createDataFrame(batches, "batch long, pos long, level string"))
    assert [tuple(r) for r in got.collect()] == [(3, "lo", "mid")]


def test_matrices(spark):
    t = element.from_values(spark, {f"n{k}": k for k in range(1, 12)}, "int")
    m = matrices.of_map(element.map_columns(t, lambda x: F.array(x, x * x, F.when(x != 3, -x)), "int", 3), 3, ["one", "two", "three"])
    tiles = {(r["row"], r["block"]): (r["first"], r["values"]) for r in m.tiles(4).collect()}
    assert tiles[2, 1] == (5, [25, 36, 49, 64]) and tiles[3, 0] == (1, [-1, -2, None, -4]) and tiles[1, 2] == (9, [9, 10, 11]) and len(tiles) == 9
    flat = [r["value"] for r in m.column_major().orderBy("pos").collect()]
    assert flat == [y for k in range(1, 12) for y in (k, k * k, None if k == 3 else -k)]
    turned = m.transposed()
    assert turned.m == 11 and [r["value"] for r in turned.column_major().orderBy("pos").collect()] == [f(k) for f in (lambda k: k, lambda k: k * k, lambda k: None if k == 3 else -k) for k in range(1, 12)]
    names = {(r["row"], r["col"]): (r["row_name"], r["col_name"]) for r in turned.named().collect()}
    assert names[4, 2] == ("n4", "two") and len(names) == 33
    by = spark.createDataFrame([(k, 1 if k < 3 else 0) for k in range(1, 12)], "col long, w int")
    assert {tuple(r) for r in matrices.product(m, F.col("w"), by).collect()} == {(1, 3), (2, 5), (3, -3)}
    with pytest.raises(errors.TemplateMismatch):
        matrices.of_map(t, 2, ["a"])
    with pytest.raises(Exception, match="template length mismatch at element"):
        matrices.of_map(element.map_columns(t, lambda x: F.array(x)), 2).tiles().collect()
