import json
import os
import subprocess
import sys
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanewise.operators import errors
from lanewise.sources import arrow_files, arrow_io

NS = pa.array([1_700_000_000_123_456_789, None, -3_600_000_000_001], pa.int64())
COLUMNS = {
    "i8": pa.array([1, None, -1], pa.int8()), "u16": pa.array([1, 65535, None], pa.uint16()), "i32": pa.array([-(2**31), 5, None], pa.int32()), "i64": pa.array([-(2**63), 7, None], pa.int64()),
    "u8": pa.array([0, 255, 7], pa.uint8()), "u32": pa.array([0, 4_294_967_295, None], pa.uint32()), "u64": pa.array([1, 2**64 - 1, None], pa.uint64()), "f": pa.array([1.5, None, 2], pa.float32()),
    "ns": NS.cast(pa.timestamp("ns", "UTC")), "wait": pa.array([90, None, 86_400_000_000_000], pa.duration("ns")), "s": pa.array(["x", None, "é"], pa.large_string()), "d": pa.array(["a", "b", None]).dictionary_encode(), "b": pa.array([True, None, False]),
}
WANT = {
    "i8": [1, None, -1], "u16": [1, 65535, None], "i32": [None, 5, None], "i64": [None, 7, None], "u8": [0, 255, 7], "u32": [0.0, 4_294_967_295.0, None], "u64": [Decimal(1), Decimal(2**64 - 1), None], "f": [1.5, None, 2.0],
    "ns": [1_700_000_000_123_456_789 * 1e-9, None, -3_600_000_000_001 * 1e-9], "wait": [90 * 1e-9, None, 86_400.0], "s": ["x", None, "é"], "d": ["a", "b", None], "b": [True, None, False],
}


def put(at, name, table, rows=2):
    os.makedirs(at, exist_ok=True)
    with pa.ipc.new_file(f"{at}/{name}", table.schema, options=pa.ipc.IpcWriteOptions(unify_dictionaries=True)) as f:
        f.write_table(table, max_chunksize=rows)


def test_each_type_lands(spark, tmp_path):
    at = str(tmp_path / "files")
    put(at, "one.arrow", pa.table(COLUMNS))
    df = arrow_files.read_arrow(spark, at)
    assert dict(df.dtypes) == {"i8": "int", "u16": "int", "i32": "int", "i64": "bigint", "u8": "smallint", "u32": "double", "u64": "decimal(20,0)", "f": "double", "ns": "double", "wait": "double", "s": "string", "d": "string", "b": "boolean"}
    rows = [r.asDict() for r in df.collect()]
    assert {c: [r[c] for r in rows] for c in COLUMNS} == WANT
    # The same on the driver.
    assert {c: [r[c] for r in map(lambda r: r.asDict(), arrow_io.read(spark, pa.table(COLUMNS)).collect())] for c in COLUMNS} == WANT


@pytest.mark.parametrize(
    ("column", "why"),
    [(pa.array([None], pa.decimal128(5, 2)), "decimal128"), (pa.array([b"x"], pa.binary()), "binary"), (pa.array([1, 2]).dictionary_encode(), "not text"), (pa.DictionaryArray.from_arrays(pa.array([0], pa.int8()), pa.array([None, "a"])), "missing level"), (pa.array([0], pa.timestamp("us", "x" * 64)), "time zone")],
)
def test_types_without_a_home_decline_by_name(spark, tmp_path, column, why):
    with pytest.raises(errors.NotPortable, match=f"'v'.*{why}") as e:
        arrow_io.land(pa.table({"v": column}))
    assert e.value.path == "v" and e.value.reason and e.value.remedy
    at = str(tmp_path / "files")
    put(at, "one.arrow", pa.table({"v": column}))
    if why in ("decimal128", "binary", "not text"):
        with pytest.raises(Exception, match="'v'"):
            arrow_files.read_arrow(spark, at)


def test_missing_bytes_and_frames_that_decline():
    with pytest.raises(errors.NotPortable, match="'u'"):
        arrow_io.land(pa.table({"u": pa.array([None, 1], pa.uint8())}))
    with pytest.raises(errors.NotPortable, match="without columns"):
        arrow_io.check_frame([])
    with pytest.raises(errors.NotPortable, match="'a'"):
        arrow_io.check_frame(["a", "b", "a"])


def test_tasks_write_and_read(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "files")
    t = spark.range(0, 10_000, 1, 5).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).alias("s"), F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).alias("x"))
    arrow_files.write_arrow(t, at)
    files = [f for f in os.listdir(at) if f.endswith(".arrow")]
    assert len(files) == 5
    with pa.OSFile(f"{at}/{files[0]}") as f:
        assert pa.types.is_large_string(pa.ipc.open_file(f).schema.field("s").type)
    got = arrow_files.read_arrow(spark, at)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, t.collect()))
    # Parts of one file are read by several tasks, each batch once.
    many = str(tmp_path / "many")
    put(many, "one.arrow", pa.table({"v": list(range(1000))}), 7)
    monkeypatch.setattr(arrow_files, "SPLIT", 1000)
    parts = arrow_files.Reader(many, arrow_files.read_arrow(spark, many).schema, None).partitions()
    assert len(parts) > 3
    reader = arrow_files.Reader(many, arrow_files.read_arrow(spark, many).schema, None)
    assert sorted(x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()) == list(range(1000))
    # Appends add up, an overwrite takes the place of all.
    arrow_files.write_arrow(t.limit(10), at)
    assert arrow_files.read_arrow(spark, at).count() == 10_010
    arrow_files.write_arrow(t.where("id < 7"), at, "overwrite")
    assert sorted(r["id"] for r in arrow_files.read_arrow(spark, at, ["id"]).collect()) == list(range(7)) and len([f for f in os.listdir(at) if f.endswith(".arrow")]) <= 5
    assert arrow_files.read_arrow(spark, at, ["s", "id"]).columns == ["s", "id"]


def test_files_that_no_commit_names_are_not_read(spark, tmp_path):
    at = str(tmp_path / "files")
    t = spark.range(100)
    arrow_files.write_arrow(t, at)
    put(at, "lost.arrow", pa.table({"id": pa.array([999], pa.int64())}))
    assert sorted(r["id"] for r in arrow_files.read_arrow(spark, at).collect()) == list(range(100))
    with pytest.raises(Exception, match="broken"):
        arrow_files.write_arrow(t.select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id")), at)
    assert arrow_files.read_arrow(spark, at).count() == 100
    (commit,) = [f for f in os.listdir(f"{at}/_commits") if not f.startswith(".")]
    with open(f"{at}/_commits/{commit}") as f:
        assert json.load(f)["rows"] == 100


LOST = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from lanewise.sources import arrow_files
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.python.worker.faulthandler.enabled", "false").getOrCreate()

def once(batches):
    for k, b in enumerate(batches):
        yield b
        if k == 1 and TaskContext.get().partitionId() == 1 and TaskContext.get().attemptNumber() == 0:
            os._exit(1)

spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
arrow_files.write_arrow(spark.range(0, 3000, 1, 3).mapInArrow(once, "id long"), {at!r})
got = sorted(r[0] for r in arrow_files.read_arrow(spark, {at!r}).collect())
assert got == list(range(3000)), len(got)
print("WHOLE", len([f for f in os.listdir({at!r}) if f.endswith(".arrow")]))
"""


def test_a_lost_task_is_written_again_and_counts_once(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", LOST.format(repo=repo, at=str(tmp_path / "files"))], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert "WHOLE" in out.stdout, out.stderr[-3000:]
