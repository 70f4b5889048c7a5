"""Arrow interchange: how columns land, and how frames leave."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.operators.errors import NotPortable
from lanewise.session import cut

#: Where the widths land.
LANDS = {"int8": "int32", "int16": "int32", "uint16": "int32", "int32": "int32", "uint32": "double", "halffloat": "double", "float": "double", "double": "double", "int64": "int64", "bool": "bool", "string": "string", "large_string": "string", "date32[day]": "date32[day]"}
#: The least whole number of a width stands for a missing value.
LEAST = {"int32": -(2**31), "int64": -(2**63)}
#: Where Spark's own widths land.
COLUMNS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint", "float": "double", "double": "double", "boolean": "boolean", "string": "string", "date": "date"}
#: Seconds in each unit of a duration.
UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


#: Bytes of a time zone's name at most.
ZONE = 63


def landed(c: pa.ChunkedArray | pa.Array, name: str) -> pa.ChunkedArray | pa.Array:
    """The column in the type that it lands in; kinds that have no home decline by the column's name.

    Whole numbers without a sign of 64 bits land as decimals, which hold them all; durations as seconds, and so do times in nanoseconds, which
    the engine's microseconds cannot hold. A dictionary of texts lands as text; see levels for what that leaves out."""
    kind = str(c.type)
    decline = lambda why: NotPortable(f"column '{name}': {why}", path=name, reason=kind, remedy="convert it first")
    if pa.types.is_dictionary(c.type):
        if not (pa.types.is_string(c.type.value_type) or pa.types.is_large_string(c.type.value_type)):
            raise decline("a dictionary of values that are not text has no home here")
        if any(d.dictionary.null_count for d in (c.chunks if isinstance(c, pa.ChunkedArray) else [c])):
            raise decline("a dictionary with a missing level has no home here")
        return c.cast(pa.string())
    if kind == "uint8":
        if c.null_count:
            raise decline("missing values have no home in a column of bytes")
        return c.cast(pa.int16())
    if kind == "uint64":
        return c.cast(pa.decimal128(20, 0))
    if pa.types.is_duration(c.type) or (pa.types.is_timestamp(c.type) and c.type.unit == "ns"):
        return pc.multiply(c.cast(pa.int64()).cast(pa.float64(), safe=False), UNITS[c.type.unit])
    if pa.types.is_timestamp(c.type):
        if len((c.type.tz or "").encode()) > ZONE:
            raise decline(f"a time zone of more than {ZONE} bytes has no home here")
        return c.cast(pa.timestamp("us", c.type.tz))
    if kind not in LANDS:
        raise decline(f"type {kind} has no home here")
    c = c.cast(pa.type_for_alias("float64" if LANDS[kind] == "double" else "date32" if kind.startswith("date32") else LANDS[kind]))
    return pc.if_else(pc.equal(c, pa.scalar(LEAST[kind], c.type)), pa.scalar(None, c.type), c) if kind in LEAST else c


def check_frame(names: list[str]) -> None:
    """A frame has a column, and names that differ."""
    if not names:
        raise NotPortable("a frame without columns has no home here", reason="columns", remedy="send a vector")
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise NotPortable(f"a frame with several columns named '{twice[0]}' has no home here", path=twice[0], reason="names", remedy="name them apart")


def land(table: pa.Table) -> pa.Table:
    """The table with each column in the type it lands in. The least int32 and int64 are missing values."""
    check_frame(table.column_names)
    for n, c in zip(table.column_names, table.columns, strict=True):
        if pa.types.is_dictionary(c.type) and any(not x.dictionary.equals(c.chunks[0].dictionary) for x in c.chunks[1:]):
            raise NotPortable(f"column '{n}': a dictionary whose levels differ across batches has no home in a frame", path=n, reason="levels", remedy="unify the dictionaries")
    return pa.table({n: landed(c, n) for n, c in zip(table.column_names, table.columns, strict=True)})


def read(spark: SparkSession, source: pa.Table | pa.RecordBatch | pa.RecordBatchReader | Iterable[pa.RecordBatch]) -> DataFrame:
    """A frame from a table, a batch, or a stream of batches, which is consumed; the source is on the driver."""
    if isinstance(source, pa.RecordBatch):
        source = pa.Table.from_batches([source])
    elif isinstance(source, pa.RecordBatchReader):
        source = source.read_all()
    elif not isinstance(source, pa.Table):
        source = pa.Table.from_batches(list(source))
    return spark.createDataFrame(land(source))


def vector(array: pa.Array | pa.ChunkedArray) -> tuple[list, list[str] | None, bool]:
    """(values, levels, whether they are ordered) of an array that is no struct. A dictionary gives codes from 1 and its levels, those of all
    batches in the order first seen, an ordered one too. Others have no levels."""
    chunks = array.chunks if isinstance(array, pa.ChunkedArray) else [array]
    if not pa.types.is_dictionary(array.type):
        return landed(array, "value").to_pylist(), None, False
    levels: dict[str, int] = {}
    values: list[int | None] = []
    for c in chunks:
        own = c.dictionary.to_pylist()
        at = [levels.setdefault(x, len(levels) + 1) for x in own]
        values += [None if k is None else at[k] for k in c.indices.to_pylist()]
    return values, list(levels), bool(array.type.ordered)


def levels(table: pa.Table) -> dict[str, tuple[list[str], bool]]:
    """The levels of each dictionary column, those of all batches in the order first seen, and whether they are ordered: what landing as text
    leaves out."""
    return {n: vector(c)[1:] for n, c in zip(table.column_names, table.columns, strict=True) if pa.types.is_dictionary(c.type)}


def land_frame(df: DataFrame) -> DataFrame:
    """The frame's columns in the types they land in, as one projection: narrow whole numbers widen, the least int and bigint are missing."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith(("timestamp", "interval", "decimal")) or kind not in COLUMNS:
            if not kind.startswith("timestamp"):
                raise NotPortable(f"column '{name}' of type {kind} has no home here", path=name, reason=kind, remedy="convert it first")
            out.append(F.col(f"`{name}`"))
            continue
        c = F.col(f"`{name}`").cast(COLUMNS[kind])
        least = {"int": -(2**31), "bigint": -(2**63)}.get(kind)
        out.append((c if least is None else F.when(c != F.lit(least), c)).alias(name))
    return df.select(*out)


def seconds(amount: Column, unit: str) -> Column:
    """A duration of so many units, in seconds."""
    if unit not in UNITS:
        raise NotPortable(f"durations in '{unit}' have no home here", reason=unit)
    return amount.cast("double") * F.lit(UNITS[unit])


def write(df: DataFrame) -> pa.Table:
    """The frame as Arrow, strings as large_string."""
    t = df.toArrow()
    return t.cast(pa.schema([pa.field(f.name, pa.large_string() if pa.types.is_string(f.type) else f.type) for f in t.schema]))


def write_vector(values: list, kind: pa.DataType | None = None) -> pa.Array:
    """A list as one array: strings as large_string, not-a-number kept, None null."""
    a = pa.array(values, kind, from_pandas=False)
    return a.cast(pa.large_string()) if pa.types.is_string(a.type) else a


#: Levels of all columns up to which codes are looked up in one broadcast map.
LOOKED_UP = 100_000


def column_levels(df: DataFrame, ix: str, columns: list[str]) -> DataFrame:
    """column, level, code: the levels of these text columns in the order first seen, each column's codes from 1. All columns are read in one
    pass, with sums before the one shuffle; ranges of (column, first place) add the sizes of those before them, one number a range."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level"), F.col(ix).alias("first")) for c in columns])).alias("e")
    seen = df.select(each).where("e.level is not null").groupBy("e.column", "e.level").agg(F.min("e.first").alias("first"))
    dealt = cut(seen.repartitionByRange("column", "first", "level").withColumn("shard", F.spark_partition_id()))
    sizes = sorted(map(tuple, dealt.groupBy("column", "shard").agg(F.count("*")).collect()))
    start: dict[tuple[str, int], int] = {}
    for (column, shard, n), before in zip(sizes, [None, *sizes], strict=False):
        start[column, shard] = start[column, before[1]] + before[2] if before and before[0] == column else 0
    starts = F.create_map(*[F.lit(x) for (c, k), v in start.items() for x in (f"{k}:{c}", v)]) if start else F.create_map(F.lit(""), F.lit(0))
    own = F.row_number().over(Window.partitionBy("shard", "column").orderBy("first", "level"))
    return dealt.select("column", "level", (own + starts[F.concat(F.col("shard").cast("string"), F.lit(":"), F.col("column"))]).cast("long").alias("code"))


def encode_columns(df: DataFrame, ix: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the frame with each of these text columns as codes, missing ones missing; the levels as column_levels gives them). Up to LOOKED_UP
    levels in all are looked up in one broadcast row of maps, more of them by a join a column."""
    levels = cut(column_levels(df, ix, columns))
    if levels.count() <= LOOKED_UP:
        maps = levels.groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("level", "code"))).alias("codes"))
        by = F.map_from_entries(F.collect_list(F.struct("column", "codes"))).alias("_levels")
        row = maps.agg(by).withColumn("_one", F.lit(1))
        held = df.withColumn("_one", F.lit(1)).join(F.broadcast(row), "_one").drop("_one")  # one row beside each
        coded = held.withColumns({c: F.col("_levels")[c][F.col(f"`{c}`").cast("string")] for c in columns}).drop("_levels")
        return coded, levels
    out = df
    for c in columns:
        own = levels.where(F.col("column") == c).select(F.col("level").alias("_level"), F.col("code").alias("_code"))
        out = out.withColumn("_text", F.col(f"`{c}`").cast("string")).join(own, F.col("_text") == F.col("_level"), "left").withColumn(c, F.col("_code")).drop("_text", "_level", "_code")
    return out, levels


def level_conflicts(batches: DataFrame) -> DataFrame:
    """batch, level, before: where an ordered column's batches (batch, pos, level) disagree with the order first seen over all of them: in that
    batch level stands right behind before, which the order puts after it. A batch holds each of its levels once."""
    merged = column_levels(batches.withColumn("_at", F.struct("batch", "pos")), "_at", ["level"]).select("level", "code")
    w = Window.partitionBy("batch").orderBy("pos")
    behind = batches.join(merged, "level").select("batch", "level", "code", F.lag("code").over(w).alias("_code"), F.lag("level").over(w).alias("before"))
    return behind.where("_code > code").select("batch", "level", "before")


def factor_levels(df: DataFrame, ix: str, x: str) -> DataFrame:
    """level, code: levels in the order first seen. Levels are dealt by range of that order, and each range adds the sizes of those before
    it, one number a range."""
    seen = df.groupBy(F.col(x).alias("level")).agg(F.min(ix).alias("first")).where("level is not null")
    dealt = cut(seen.repartitionByRange("first").withColumn("shard", F.spark_partition_id()))
    start, at = {}, 0
    for shard, n in dealt.groupBy("shard").agg(F.count("*")).orderBy("shard").collect():
        start[shard], at = at, at + n
    starts = F.create_map(*[F.lit(v) for kv in start.items() for v in kv]) if start else F.create_map(F.lit(0), F.lit(0))
    own = F.row_number().over(Window.partitionBy("shard").orderBy("first"))
    return dealt.select("level", (own + starts[F.col("shard")]).cast("long").alias("code"))
