import random
import time

import pyarrow as pa
import pytest

from lanewise.functions import codec, columnar
from lanewise.operators import errors

CASES = [
    ("int", pa.int32(), [1, None, -5, 2**31 - 1]), ("int", pa.int8(), [1, None, -5]), ("int64", pa.int64(), [None, 2**62, -1]), ("real", pa.float64(), [1.5, float("inf"), -0.0]), ("logical", pa.bool_(), [True, None, False]),
    ("text", pa.string(), ["a", None, "", "é漢😀", "x" * 300]), ("text", pa.large_string(), [None]), ("raw", pa.uint8(), [0, 255, 7]), *[(k, t, []) for k, t in (("int", pa.int32()), ("text", pa.string()), ("raw", pa.uint8()), ("logical", pa.bool_()))],
]


@pytest.mark.parametrize(("kind", "arrow", "values"), CASES)
def test_streams_equal_those_of_values(kind, arrow, values):
    array = pa.array(values, arrow)
    raw = columnar.write_array(array)
    assert raw == codec.write(codec.Vector(kind, values))
    assert columnar.read_array(raw).to_pylist() == values
    # Slices begin inside their buffers.
    if len(values) > 2:
        assert columnar.write_array(array[1:-1]) == codec.write(codec.Vector(kind, values[1:-1]))


def test_not_a_number_stays():
    assert columnar.write_array(pa.array([float("nan"), 1.0])) == codec.write(codec.Vector("real", [float("nan"), 1.0]))


def test_declines_name_the_column():
    for array in (pa.array([1.0, None]), pa.array([1, None], pa.uint8()), pa.array([b"x"]), pa.array([[1]])):
        with pytest.raises(errors.NotPortable, match="price") as e:
            columnar.write_array(array, "price")
        assert e.value.path == "price"


def test_broken_streams():
    g = random.Random(1)
    for kind, arrow, values in CASES:
        raw = columnar.write_array(pa.array(values, arrow))
        for bad in (raw[:-1], raw + b"x", raw[:2], b"", b"\x49\x02" + raw[2:], raw[:2] + bytes((99,)) + raw[3:], raw[:3] + struct_max() + raw[11:]):
            with pytest.raises(codec.BadStream):
                columnar.read_array(bad)
        for _ in range(50):
            bad = bytearray(raw)
            bad[g.randrange(len(bad))] ^= 1 << g.randrange(8)
            try:
                columnar.read_array(bytes(bad)).validate(full=True)
            except codec.BadStream:
                pass


def struct_max():
    return (2**63).to_bytes(8, "little")


def test_frames_there_and_back(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 7 as int) as k", "if(id % 3 = 0, null, concat('t', id)) as s", "id / 3 as x", "id % 2 = 0 as b").repartition(3)
    packed = columnar.pack_columns(df)
    assert packed.where("column = 's'").count() >= 3
    back = columnar.unpack_columns(packed, "id long, k int, s string, x double, b boolean")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_columns_are_far_faster_than_values():
    values = [f"name {k}" if k % 9 else None for k in range(200_000)]
    began = time.perf_counter()
    slow = codec.write(codec.Vector("text", values))
    by_value = time.perf_counter() - began
    array = pa.array(values)
    began = time.perf_counter()
    fast = columnar.write_array(array)
    assert fast == slow and time.perf_counter() - began < by_value / 3
