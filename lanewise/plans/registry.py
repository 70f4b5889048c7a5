"""One query for each core operator over the driver's tables, and its SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.functions import codec, columnar, rng
from lanewise.functions import quantiles as ranks
from lanewise.operators import element, geometry, lost, matrices, nested, slices, tasks, tasksets
from lanewise.session import shared_path, written
from lanewise.sources import arrow_files, arrow_io
from lanewise.streaming import channel, ordered

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _elements(spark: SparkSession, d: str, name: str, key: str, x: str, label: str | None = None) -> DataFrame:
    return element.elements(_t(spark, d, name), F.col(key), F.col(x), F.col(label) if label else None)


@query("select o_orderkey + 1 ix, o_orderstatus as name, o_totalprice * 2 as value from orders")
def map_list_values(spark, d):
    return element.map_columns(_elements(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus"), lambda x: x * 2)


@query("select c_custkey + 1 ix, abs(c_acctbal) as value from customer")
def map_template_scalar(spark, d):
    return element.map_columns(_elements(spark, d, "customer", "c_custkey", "c_acctbal"), F.abs, "double")


@query("select o_orderkey + 1 ix, cast(o_totalprice > 1000 as double) as value from orders")
def map_template_widen(spark, d):
    return element.map_columns(_elements(spark, d, "orders", "o_orderkey", "o_totalprice"), lambda x: x > 1000, "double")


@query("select p_partkey + 1 ix, 'lo' as row_name, p_size::bigint as value from part union all select p_partkey + 1, 'hi', p_size * 2 from part")
def map_template_matrix(spark, d):
    m = element.matrix(element.map_columns(_elements(spark, d, "part", "p_partkey", "p_size"), lambda x: F.array(x, x * 2), "int", 2), ["lo", "hi"])
    return m.select("ix", "row_name", F.col("value").cast("long").alias("value"))


@query("select p_partkey + 1 ix, 'lo' as row_name, p_size::double as value from part union all select p_partkey + 1, 'hi', p_size * 2 from part")
def map_python_matrix(spark, d):
    m = element.map_python(_elements(spark, d, "part", "p_partkey", "p_size"), lambda x: {"lo": x, "hi": 2 * x}, "double", size=2)
    return element.matrix(m, ["lo", "hi"]).select("ix", "row_name", "value")


@query("""with e as (select o_orderkey + 1 as col, o_orderstatus as col_name, unnest([1, 2, 3])::bigint as row, unnest(['price', 'half', 'key']) as row_name, unnest([o_totalprice, o_totalprice / 2, o_orderkey]) as value from orders)
 select row, row_name, (col - 1) // 1024 as block, min(col) as first, count(*) as n, list(value order by col)[1] as head, list(value order by col)[-1] as tail, string_agg(col_name, '' order by col) as names from e group by all""")
def matrix_tiles(spark, d):
    """A map with three values an element as a matrix of three rows, turned over in tiles of 1,024 columns, with the names of both sides."""
    t = _elements(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    m = matrices.of_map(element.map_columns(t, lambda x: F.array(x, x / 2, (F.col("ix") - 1).cast("double")), "double", 3), 3, ["price", "half", "key"])
    block = F.floor((F.col("col") - 1) / matrices.BLOCK)
    names = m.col_names.groupBy(block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "name"))), lambda x: x["name"]), "").alias("names"))
    tiles = m.tiles().join(m.row_names.withColumnRenamed("name", "row_name"), "row").join(names, "block")
    return tiles.select("row", "row_name", "block", "first", F.size("values").cast("long").alias("n"), F.element_at("values", 1).alias("head"), F.element_at("values", -1).alias("tail"), "names")


@query("select p_partkey * 2 + unnest([1, 2]) as pos, unnest([p_size, p_size * 2])::double as value from part")
def matrix_column_major(spark, d):
    """The entries of a matrix of two rows in the order of a flat vector, column after column, from a map in Python."""
    made = element.map_python(_elements(spark, d, "part", "p_partkey", "p_size"), lambda x: [x, 2 * x], "double", size=2)
    return matrices.of_map(made, 2).column_major()


@query("select p_partkey + 1 ix, p_size::double as re, -p_size::double as im from part")
def map_python_complex(spark, d):
    m = element.map_python(_elements(spark, d, "part", "p_partkey", "p_size"), lambda x: complex(x, -x), "complex")
    return m.select("ix", "value.re", "value.im")


@query("""select p_partkey + 1 ix, case when p_size % 10 <> 3 then p_size end::integer as value,
 case when p_size % 10 = 3 then 'TemplateMismatch: ' || (3000000000 + p_size) || ' is out of the range of type ''int''' end as error from part""")
def map_python_range(spark, d):
    """A value beyond its template's range is its element's error."""
    return element.map_python(_elements(spark, d, "part", "p_partkey", "p_size"), lambda x: 3_000_000_000 + x if x % 10 == 3 else x, "int")


@query("select p_partkey + 1 ix, '490104' || lpad(lower(to_hex(octet_length(encode(p_brand)))), 2, '0') || '000000' || lower(hex(encode(p_brand))) as stream from part")
def map_python_any(spark, d):
    """Values of any kind, as byte streams."""
    m = element.map_python(_elements(spark, d, "part", "p_partkey", "p_brand"), lambda x: x, "any")
    return m.select("ix", F.lower(F.hex("value")).alias("stream"))


@query("select c_custkey + 1 ix, upper(c_name) as value from customer")
def map_template_char(spark, d):
    return element.map_columns(_elements(spark, d, "customer", "c_custkey", "c_name"), F.upper, "string")


@query("select event_id + 1 ix, user_id * 3 as value from events")
def map_template_int64(spark, d):
    return element.map_columns(_elements(spark, d, "events", "event_id", "user_id"), lambda x: x * 3, "bigint")


@query("select o_orderkey + 1 ix, o_totalprice as value from orders where false")
def map_empty(spark, d):
    return element.map_columns(_elements(spark, d, "orders", "o_orderkey", "o_totalprice").where("false"), lambda x: x, "double")


@query("select 1::bigint ix, 'p_size' as name, max(p_size)::double as value from part union all select 2, 'p_retailprice', max(p_retailprice) from part")
def map_over_columns(spark, d):
    return element.over_columns(_t(spark, d, "part"), ["p_size", "p_retailprice"], lambda c: F.max(c).cast("double"))


@query("select o_orderkey + 1 ix, o_orderkey * 2 + 1 as value, cast(null as varchar) as error from orders")
def map_python(spark, d):
    return element.map_python(_elements(spark, d, "orders", "o_orderkey", "o_orderkey"), lambda x: 2 * x + 1, "bigint")


@query("with n as (select count(*) n from orders), k as (select unnest(range(1, 8)) k, n from n) select k, (k-1)*(n//7) + least(k-1, n%7) + 1 as lo, k*(n//7) + least(k, n%7) as hi from k")
def chunk_ranges(spark, d):
    return geometry.balanced_frame(spark, _t(spark, d, "orders").count(), 7)


@query("select ntile(7) over (order by o_orderkey) as chunk, o_orderkey + 1 ix from orders")
def chunk_membership(spark, d):
    t = _t(spark, d, "orders")
    ix = F.col("o_orderkey") + 1
    return t.select(geometry.chunk_of(ix, t.count(), 7).alias("chunk"), ix.alias("ix"))


@query("select o_orderkey // 58 as morsel, min(o_orderkey) + 1 as lo, max(o_orderkey) + 1 as hi from orders group by 1")
def morsel_spans(spark, d):
    return geometry.morsel_frame(spark, _t(spark, d, "orders").count(), 58)


@query("select w.workers::bigint as workers, greatest(1, least(n, 32 * w.workers))::bigint as chunks, greatest(1, least(n, 32 * w.workers, 2 * w.workers))::bigint as in_flight from (select count(*) n from nation), (values (1), (2), (4)) w(workers)")
def stream_window(spark, d):
    n = _t(spark, d, "nation").count()
    return spark.createDataFrame([(w, *geometry.stream_window(n, w)) for w in (1, 2, 4)], "workers long, chunks long, in_flight long")


@query("select l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_extendedprice / l_quantity as unit_price from lineitem")
def enrich_frame(spark, d):
    """A task that is given a frame and returns it with one more column."""
    with tasks.local_pool(spark, 1) as pool:
        frame = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
        return tasks.collect(pool.submit(lambda df: df.withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity")), df=frame))


@query("""with c as (select event_id + 1 ix, cast(round(value * 100) as bigint) v from events),
 w as (select ix, (sum(v) over w)::bigint as s1, (sum(v * v) over w)::bigint as s2, count(*) over w as n from c window w as (order by ix rows between current row and 999 following))
 select *, s1::double / n / 100 as mean, sqrt((s2::double - s1::double * s1::double / n) / nullif(n - 1, 0)) / 100 as sd from w""")
def sliding_window(spark, d):
    """Count, sum, sum of squares (in cents), mean and standard deviation of the 1,000 values from each start; windows at the end hold what is
    left. A block of 1,000 elements and the one behind it hold all windows that start in the block: no task holds the whole table. Sums run
    on along the two blocks once, and a window's sum is the difference of two of them."""
    v = _t(spark, d, "events").select((F.col("event_id") + 1).alias("ix"), F.round(F.col("value") * 100).cast("long").alias("v"))
    block = F.floor((F.col("ix") - 1) / 1000)
    rows = v.select("ix", "v", F.explode(F.array(block, block - 1)).alias("block"))
    along = Window.partitionBy("block").orderBy("ix")
    so_far, whole = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    squares = F.col("v") * F.col("v")
    run = rows.select("ix", "block", "v", F.sum("v").over(so_far).alias("r1"), F.sum(squares).over(so_far).alias("r2"), F.count("*").over(so_far).alias("r0"))
    until = lambda r: F.coalesce(F.lead(r, 999).over(along), F.last(r).over(whole)) - F.col(r)
    out = run.select("ix", "block", (until("r1") + F.col("v")).alias("s1"), (until("r2") + squares).alias("s2"), (until("r0") + 1).alias("n")).where(block == F.col("block"))
    s1, s2, n = F.col("s1").cast("double"), F.col("s2").cast("double"), F.col("n")
    return out.select("ix", "s1", "s2", "n", (s1 / n / 100).alias("mean"), (F.sqrt((s2 - s1 * s1 / n) / F.nullif(n - 1, F.lit(0))) / 100).alias("sd"))


@query("select l_returnflag, sum(cast(round(l_quantity * 100) as bigint))::bigint as cents, count(*) as n from lineitem group by 1")
def group_mean(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.round(F.col("l_quantity") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))


@query("select l_suppkey, round(sum(sqrt(l_extendedprice)), 4) as total from lineitem group by 1")
def nested_map_sum(spark, d):
    """A map inside each part and a sum: one plan with partial sums before the one shuffle."""
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.sqrt("l_extendedprice")), 4).alias("total"))


@query("select sum(s)::bigint as total, count(*) as parts from (select o_orderkey % 10 p, sum(o_orderkey + 1) s from orders group by 1)")
def nested_tasks(spark, d):
    """A task over ten parts, each a task over its own elements, as one scan: the parts' sums, then the sum of these."""
    parts = _t(spark, d, "orders").select((F.col("o_orderkey") % 10).alias("part"), "o_orderkey")
    return nested.fold_segments(parts, ["part"], F.col("o_orderkey") + 1, [F.sum, F.sum], "total")


@query("""with p as (select p_partkey + 1 ix, p_size::bigint n from part)
 select ix, n * (n + 1) * (n + 2) // 6 as value, (select max(abs(i * j - 7)) from range(1, n + 1) a(i), range(1, i + 1) b(j)) as furthest from p""")
def nested_depth(spark, d):
    """Maps nested three deep: each part's size n is split in 1 to n, each of these in 1 to itself, and the sums of the innermost ones are added
    up; and with unlike folds, the greatest of the greatest."""
    t = _elements(spark, d, "part", "p_partkey", "p_size").withColumn("x", F.col("x").cast("long"))
    to = lambda x: F.sequence(F.lit(1).cast("long"), x)
    sums = nested.nested_map(t, nested.Nested(to, nested.Nested(to, lambda x: x)))
    pairs = nested.Nested(to, nested.Nested(lambda i: F.transform(to(i), lambda j: i * j), lambda x: F.abs(x - 7), lambda x: F.max(x)), "max")
    return sums.join(nested.nested_map(t, pairs).withColumnRenamed("value", "furthest"), "ix")


@query("""with e as (select o_orderkey % 200 + 1 as pos, o_orderkey + 1 as ix, o_orderkey as x from orders),
 t as (select pos, count(*) as n, sum(x * pos)::bigint as total, min(ix) filter (pos % 7 = 0 and x % 1000 >= 990) as ix from e group by 1)
 select pos, n, case when ix is null then total end as value, ix, case when ix is not null then 'ValueError: ' || (ix - 1) end as error from t""")
def task_set(spark, d):
    """Two hundred tasks over the orders in one job: task k adds up k times each of its numbers, and every seventh fails at some."""
    o = _t(spark, d, "orders")

    def task(k):
        def f(x):
            if k % 7 == 0 and x % 1000 >= 990:
                raise ValueError(x)
            return k * x

        return f

    elements = tasksets.routed(o, F.col("o_orderkey") % 200 + 1, F.col("o_orderkey") + 1, F.col("o_orderkey"))
    return tasksets.TaskSet(elements, [task(k) for k in range(1, 201)], "bigint").folds(F.sum)


@query("""with e as (select o_orderkey % 200 + 1 as pos, o_orderkey + 1 as ix, o_orderkey as x from orders),
 bad as (select distinct pos from e where pos % 7 = 0 and x % 1000 >= 990) select pos, ix, x + pos as value from e anti join bad using (pos)""")
def task_set_values(spark, d):
    """What the tasks of a set without a failure give, in one job."""

    def task(k):
        def f(x):
            if k % 7 == 0 and x % 1000 >= 990:
                raise ValueError(x)
            return x + k

        return f

    elements = tasksets.routed(_t(spark, d, "orders"), F.col("o_orderkey") % 200 + 1, F.col("o_orderkey") + 1, F.col("o_orderkey"))
    return tasksets.TaskSet(elements, [task(k) for k in range(1, 201)], "bigint").values()


@query("select quantile_cont(p_retailprice, 0.25) as q1, quantile_cont(p_retailprice, 0.5) as q2, quantile_cont(p_retailprice, 0.75) as q3 from part")
def quantiles(spark, d):
    q = F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return _t(spark, d, "part").agg(q.alias("q")).select(*[F.col("q")[k].alias(f"q{k + 1}") for k in range(3)])


@query("select unnest([0.25, 0.5, 0.75, 0.999])::double as p, unnest(quantile_cont(l_extendedprice, [0.25, 0.5, 0.75, 0.999]))::double as value from lineitem")
def quantiles_narrowed(spark, d):
    """Quantiles of a large column by histograms of ever narrower ranges: what a pass keeps does not grow with the rows."""
    probs = [0.25, 0.5, 0.75, 0.999]
    found = ranks.quantiles(_t(spark, d, "lineitem"), F.col("l_extendedprice"), probs)
    return spark.createDataFrame(list(zip(probs, found, strict=True)), "p double, value double")


@query("select p_partkey + 1 ix, round(ln(p_retailprice), 9) as value from part")
def spec_log(spark, d):
    m = element.map_python(_elements(spark, d, "part", "p_partkey", "p_retailprice"), element.call("math.log"), "double")
    return m.select("ix", F.round("value", 9).alias("value"))


@query("select p_partkey + 1 ix, p_size::bigint * 2 + 1 as value from part")
def source_task(spark, d):
    return element.map_python(_elements(spark, d, "part", "p_partkey", "p_size"), element.call(source="y = x * 2\ny + 1"), "bigint").select("ix", "value")


@query("select vec_id + 1 ix, round(list_sum([x::double for x in embedding]) + 100, 6) as value from embeddings")
def list_fold(spark, d):
    f = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) + 100, 6)
    return element.map_columns(_elements(spark, d, "embeddings", "vec_id", "embedding"), f, "double")


#: The generator's constants and steps in SQL, in whole numbers of 128 bits: words of a seed's base state, and powers of the jump's matrices.
_CONSTANTS = ", ".join(f"{x % n}::hugeint" for m, n in ((rng.A1, rng.M1), (rng.A2, rng.M2)) for row in m for x in row)
_SQUARES = ", ".join(f"({' + '.join(f'{m}{3 * i + j + 1} * {m}{3 * j + c + 1}' for j in range(3))}) % {n}" for m, n in (("a", rng.M1), ("b", rng.M2)) for i in range(3) for c in range(3))
_MOVED = ", ".join(f"case when (ix >> bit) & 1 = 1 then ({' + '.join(f'{m}{3 * i + j + 1} * s{h + j + 1}' for j in range(3))}) % {n} else s{h + i + 1} end" for m, n, h in (("a", rng.M1, 0), ("b", rng.M2, 3)) for i in range(3))
_ENTRIES = ", ".join(f"{m}{k}" for m in "ab" for k in range(1, 10))
_RNG = f"""with recursive lcg(k, s) as (select 0, 42::hugeint union all select k + 1, (69069 * s + 1) % 4294967296 from lcg where k < 80),
 word as (select row_number() over (order by k) w, s from (select k, s from lcg where k > 50 and s < {rng.M2} order by k limit 6)),
 base as (select {", ".join(f"max(s) filter (w = {k}) s{k}" for k in range(1, 7))} from word),
 pw(k, {_ENTRIES}) as (select 0, {_CONSTANTS} union all select k + 1, {_SQUARES} from pw where k < 160)"""
_AT = _RNG + """, moved(bit, ix, s1, s2, s3, s4, s5, s6) as (select 0, {ix}, base.* from {rows}, base union all select bit + 1, ix, """ + _MOVED + """ from moved join pw on pw.k = 127 + bit where bit < {bits})"""
_WORDS = ", ".join(f"(case when s{k} >= 2147483648 then s{k} - 4294967296 else s{k} end)::bigint as s{k}" for k in range(1, 7))
_SEEKS = (0, 1, 7, 1000, 123456789, 4294967295)


@query(_RNG + " select 42::bigint as seed, w::bigint as word, (case when s >= 2147483648 then s - 4294967296 else s end)::bigint as value from word")
def rng_base(spark, d):
    return spark.createDataFrame([(42, k, w) for k, w in enumerate(rng.base(42), 1)], "seed long, word long, value long")


@query(_AT.format(ix="x.k", rows=f"(select unnest({list(_SEEKS)})::bigint k) x", bits=32) + f" select ix as k, {_WORDS} from moved where bit = 32")
def rng_seek(spark, d):
    return spark.createDataFrame([(k, *rng.seek(rng.base(42), k)) for k in _SEEKS], "k long, " + ", ".join(f"s{k} long" for k in range(1, 7)))


@query(_AT.format(ix="o_orderkey + 1", rows="orders", bits=24) + f""" select ix, {_WORDS},
 (((-810728 * s1 + 1403580 * s2) % {rng.M1} + {rng.M1}) % {rng.M1} - ((-1370589 * s4 + 527612 * s6) % {rng.M2} + {rng.M2}) % {rng.M2} + {rng.M1}) % {rng.M1} * {rng.SCALE!r}::double as u from moved where bit = 24""")
def rng_streams(spark, d):
    """The state of each element's stream and its first number. The SQL follows elements up to 2^24, the map itself to 2^53."""
    found = rng.streams(_elements(spark, d, "orders", "o_orderkey", "o_orderkey"), 42)
    return found.select("ix", *[F.col("state")[k].alias(f"s{k + 1}") for k in range(6)], "u")


@query(_AT.format(ix="o_orderkey + 1", rows="orders", bits=24) + f""" select ix, {_WORDS},
 (((-810728 * s1 + 1403580 * s2) % {rng.M1} + {rng.M1}) % {rng.M1} - ((-1370589 * s4 + 527612 * s6) % {rng.M2} + {rng.M2}) % {rng.M2} + {rng.M1}) % {rng.M1} * {rng.SCALE!r}::double as u from moved where bit = 24""")
def rng_native(spark, d):
    """The same streams by column expressions alone."""
    found = rng.native_streams(_elements(spark, d, "orders", "o_orderkey", "o_orderkey"), 42)
    return found.select("ix", *[F.col("state")[k].alias(f"s{k + 1}") for k in range(6)], "u")


#: The numbers of each element's stream in SQL, twenty of them; the first is a uniform draw, and whole numbers below 1,000 take ten bits of one
#: number each until one is below.
_DRAWN = _AT.format(ix="p_partkey + 1", rows="part", bits=24) + f""", number(n, ix, s1, s2, s3, s4, s5, s6) as (select 0, ix, s1, s2, s3, s4, s5, s6 from moved where bit = 24 union all
 select n + 1, ix, s2, s3, ((-810728 * s1 + 1403580 * s2) % {rng.M1} + {rng.M1}) % {rng.M1}, s5, s6, ((-1370589 * s4 + 527612 * s6) % {rng.M2} + {rng.M2}) % {rng.M2} from number where n < 20),
 drawn as (select ix, n, case when (s3 - s6) % {rng.M1} = 0 then {rng.M1} else ((s3 - s6) % {rng.M1} + {rng.M1}) % {rng.M1} end * {rng.SCALE!r}::double as u from number where n > 0),
 tried as (select ix, n, floor(u * 65536)::bigint % 1024 as k from drawn where n > 1)
 select ix, max(u) as value, (arg_min(k, tried.n) filter (k < 1000))::bigint as whole from (select ix, u from drawn where n = 1) f join tried using (ix) group by ix"""


@query(_DRAWN.replace("select 0, 42::hugeint", "select 0, 7::hugeint"))
def map_seeded(spark, d):
    """Draws of a seeded map by the element's own stream: a uniform number, then a whole number below 1,000 by rejection."""
    t = _elements(spark, d, "part", "p_partkey", "p_size")
    drawn = element.map_python(t.repartition(7, "x"), lambda x, rng: [rng.uniform(), float(rng.below(1000))], "double", seed=7, size=2)
    return drawn.select("ix", F.col("value")[0].alias("value"), F.col("value")[1].cast("long").alias("whole"))


@query("select p_partkey + 1 ix, p_size::bigint + 1 + r as value, r::bigint as run from part, (values (0), (1), (2)) t(r)")
def prepared_runs(spark, d):
    """A prepared map, run over three tables."""
    t = _elements(spark, d, "part", "p_partkey", "p_size")
    staged = element.Prepared(t, lambda x: x + 1, "int")
    runs = [staged.run(t.withColumn("x", (F.col("x") + r).cast("int")), collect="view").select("ix", F.col("value").cast("long").alias("value"), F.lit(r).cast("long").alias("run")) for r in range(3)]
    return runs[0].union(runs[1]).union(runs[2])


@query("select count(*) as n, true as same from orders")
def rng_offset_split(spark, d):
    """Two halves with offsets give the streams of the whole."""
    t = _elements(spark, d, "orders", "o_orderkey", "o_orderkey")
    whole = rng.streams(t, 42)
    late = rng.streams(t.where("ix > 100").select((F.col("ix") - 100).alias("ix"), "x"), (42, 100)).select((F.col("ix") + 100).alias("ix"), F.col("state").alias("s2"))
    early = rng.streams(t.where("ix <= 100"), (42, 0)).select("ix", F.col("state").alias("s2"))
    return whole.join(early.union(late), "ix").agg(F.count("*").alias("n"), F.bool_and(F.col("state") == F.col("s2")).alias("same"))


#: A task log from the events: groups of tasks by user, an end for each task; of every third group some failed.
_LOG = "select user_id as grp, event_id, row_number() over (partition by user_id order by event_id) as pos, cast(round(value * 100) as bigint) as ended, (event_type = 'error' or event_id % 37 = 0) and user_id % 3 = 0 as failed from events"

#: The same log with the failures of all groups.
_FAILURES = "select user_id as grp, event_id, row_number() over (partition by user_id order by event_id) as pos, cast(round(value * 100) as bigint) as ended, event_type = 'error' or event_id % 37 = 0 as failed from events"


def _log(spark, d, some="user_id % 3 = 0"):
    """The log of the events, with the failures of the groups that some holds for."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return _t(spark, d, "events").select(F.col("user_id").alias("grp"), "event_id", F.row_number().over(w).alias("pos"), F.round(F.col("value") * 100).cast("long").alias("ended"), (((F.col("event_type") == "error") | (F.col("event_id") % 37 == 0)) & F.expr(some)).alias("failed"))


@query(f"select grp, arg_min(pos, ended * 1000000 + pos)::bigint as position, min(ended) as ended from ({_LOG}) group by 1")
def collect_any(spark, d):
    return tasks.first_ended(_log(spark, d))


@query(f"select grp, pos::bigint as pos, event_id, ended from ({_LOG}) where grp not in (select grp from ({_LOG}) where failed)")
def collect_all(spark, d):
    """What the groups without a failure give, by position."""
    return tasks.in_order(_log(spark, d)).select("grp", F.col("pos").cast("long").alias("pos"), "event_id", "ended")


@query(f"select grp, min(pos) filter (failed)::bigint as index from ({_FAILURES}) group by 1")
def collect_all_error_index(spark, d):
    return tasks.first_failed(_log(spark, d, "true"))


@query("select min(o_orderkey) + 1 as ix, 'ValueError: ' || min(o_orderkey) as error from orders where o_orderkey % 1000 = 999")
def first_error_index(spark, d):
    def f(x):
        if x % 1000 == 999:
            raise ValueError(x)
        return x

    return element.first_error(element.map_python(_elements(spark, d, "orders", "o_orderkey", "o_orderkey"), f, "bigint"))


_SPANS = "select user_id as run, event_id % 97 as start, 1 + event_id % 3 as cnt from events where event_type = 'click'"


@query(f"""with done as ({_SPANS}), runs as (select distinct run from done),
m as (select run, unnest(range(0, 100)) g from runs), c as (select distinct run, unnest(range(start, start + cnt)) g from done),
l as (select m.run, m.g from m anti join c on m.run = c.run and m.g = c.g), i as (select run, g, g - row_number() over (partition by run order by g) k from l)
select run, min(g) * 4 + 1 as lo, max(g) * 4 + 4 as hi from i group by run, k""")
def lost_ranges(spark, d):
    spans = _t(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("run"), (F.col("event_id") % 97).alias("start"), (1 + F.col("event_id") % 3).alias("count"))
    runs = spans.select("run").distinct().select("run", F.lit(100).alias("cursor"), F.lit(4).alias("size"), F.lit(400).alias("n"))
    return lost.lost_ranges(spans, runs)


@query("""select u.run, c.k * 100 + 1 as lo, least((c.k + 1) * 100, 1050) as hi from (select distinct user_id as run from events) u, (select unnest(range(0, 11)) k) c
 where not exists (select 1 from events e where e.user_id = u.run and e.event_id % 11 = c.k and e.event_type <> 'error')""")
def lost_ranges_chunks(spark, d):
    """Chunks of 100 of 1,050 elements, of which each run's events finish some."""
    e = _t(spark, d, "events")
    k = F.col("k")
    chunks = e.select(F.col("user_id").alias("run")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10)))).select("run", k.cast("long").alias("k"), (k * 100 + 1).cast("long").alias("lo"), F.least((k + 1) * 100, F.lit(1050)).cast("long").alias("hi"))
    return lost.lost_chunks(chunks, e.where("event_type <> 'error'").select(F.col("user_id").alias("run"), (F.col("event_id") % 11).alias("k")))


@query("select s.state, count(e.event_id) as n from (values (0, 'free'), (1, 'pending'), (2, 'running'), (3, 'ok'), (4, 'err'), (5, 'cancel'), (6, 'died'), (7, 'lost')) s(code, state) join events e on e.event_id % 8 = s.code group by 1")
def task_state_counts(spark, d):
    return tasks.state_counts(_t(spark, d, "events").select((F.col("event_id") % 8).alias("code")))


def _submitted(spark, d, name: str) -> DataFrame:
    """Each event as a task that was submitted; all but the views have begun."""
    begun = F.when(F.col("event_type") != "view", F.array(F.lit("submit"), F.lit("start"))).otherwise(F.array(F.lit("submit")))
    return _t(spark, d, "events").select(F.col("user_id").alias(name), F.explode(begun).alias("event"))


@query("select user_id as worker, count(*) as injected, count(*) filter (event_type <> 'view') as claimed, count(*) - count(*) filter (event_type <> 'view') as queued from events group by 1")
def pool_stats(spark, d):
    return tasks.stats(_submitted(spark, d, "worker"))


@query("select user_id as submitter, count(*) filter (event_type = 'view') as queued from events group by 1")
def queued(spark, d):
    return tasks.stats(_submitted(spark, d, "submitter"), "submitter").select("submitter", "queued")


@query("select event_id // 256 as batch, min(event_id) as first, max(event_id) as last, count(*) as n from events group by 1")
def stream_batches(spark, d):
    return slices.batch_frame(_t(spark, d, "events"), "event_id", 256)


@query("select event_id as seq, user_id as value from events where event_id >= 100 order by seq limit 64")
def recv_batch_n(spark, d):
    return channel.next_batch(_t(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("value")), 100, 64)


@query("""with m as (select user_id as channel, event_id, row_number() over (partition by user_id order by event_id) - 1 as seq from events)
 select channel, seq + 1 as at, 'message' as kind, seq, event_id from m union all select channel, count(*) + 1, 'closed', count(*), null from m group by 1""")
def ordered_delivery(spark, d):
    """The events as messages of a channel a user, dealt out of order over the batches of a stream, come out by their numbers, and each
    channel's close behind its last one."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    sent = _t(spark, d, "events").select(F.col("user_id").alias("channel"), (F.row_number().over(w) - 1).cast("long").alias("seq"), "event_id", F.lit(False).alias("last"))
    ends = sent.groupBy("channel").agg(F.count("*").alias("seq")).select("channel", "seq", F.lit(None).cast("long").alias("event_id"), F.lit(True).alias("last"))
    arrived = written(sent.union(ends).repartition(6, F.xxhash64("channel", "seq")))
    at = shared_path(spark)
    stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 1).parquet(arrived._lanewise_at)
    out = ordered.in_order(stream, closes="last")
    out.writeStream.format("parquet").option("path", f"{at}/given").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/given").select("channel", "at", "kind", "seq", "event_id")


@query("select p_partkey, p_size::double as wide, p_name as s, p_size::integer as narrow, case when p_size % 5 <> 0 then p_size end::integer as least from part")
def arrow_landing(spark, d):
    """Columns of a table in the types they land in; the least int is a missing value."""
    least = F.when(F.col("p_size") % 5 == 0, F.lit(-(2**31))).otherwise(F.col("p_size").cast("int")).alias("least")
    return arrow_io.land_frame(_t(spark, d, "part").select("p_partkey", F.col("p_size").cast("float").alias("wide"), F.col("p_name").alias("s"), F.col("p_size").cast("smallint").alias("narrow"), least))


@query("""select l_orderkey, l_linenumber::integer as l_linenumber, l_extendedprice::double as l_extendedprice, case when l_quantity % 5 <> 0 then l_quantity::integer end as quantity, l_shipdate, l_returnflag,
 case when l_quantity % 3 = 1 then l_tax end as tax, case when l_quantity % 3 < 2 then l_quantity % 3 = 0 end as nan from lineitem""")
def arrow_files_round_trip(spark, d):
    """A table written as Arrow files by its tasks and read by others, each column where it lands: the least int is missing, not-a-number stays."""
    t = _t(spark, d, "lineitem")
    q = F.col("l_quantity")
    sent = t.select(
        "l_orderkey", F.col("l_linenumber").cast("smallint").alias("l_linenumber"), "l_extendedprice", F.when(q % 5 == 0, F.lit(-(2**31))).otherwise(q.cast("int")).alias("quantity"), "l_shipdate", "l_returnflag",
        F.when(q % 3 == 0, F.lit(float("nan"))).when(q % 3 == 1, F.col("l_tax")).alias("tax"),
    )
    at = shared_path(spark)
    arrow_files.write_arrow(sent, at)
    nan = F.when(F.col("tax").isNotNull(), F.isnan("tax"))
    return arrow_files.read_arrow(spark, at).withColumns({"nan": nan, "tax": F.when(~F.isnan("tax"), F.col("tax"))})


@query("select l_returnflag, sum(l_linenumber)::bigint as lines, count(*) as n from lineitem group by 1")
def arrow_files_columns(spark, d):
    """Two columns of a table of Arrow files, which are read alone."""
    at = shared_path(spark)
    arrow_files.write_arrow(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"), at)
    return arrow_files.read_arrow(spark, at, ["l_linenumber", "l_returnflag"]).groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("lines"), F.count("*").alias("n"))


@query("select event_id, case when event_id % 7 <> 0 then event_id end as seq, value, isnan(x) as nan, x is null as missing from (select event_id, value, case event_id % 3 when 0 then 'nan'::double when 1 then value end as x from events)")
def na_sentinel(spark, d):
    """The least bigint lands as a missing value; not-a-number stays itself and a missing double stays missing."""
    k = F.col("event_id")
    x = F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 3 == 1, F.col("value")).alias("x")
    t = arrow_io.land_frame(_t(spark, d, "events").select("event_id", F.when(k % 7 == 0, F.lit(-(2**63))).otherwise(k).alias("seq"), "value", x))
    return t.select("event_id", "seq", "value", F.when(F.col("x").isNotNull(), F.isnan("x")).alias("nan"), F.col("x").isNull().alias("missing"))


@query("select event_id, user_id * 1.0::double as s, user_id * 0.001::double as ms, user_id * 0.000001::double as us, user_id * 0.000000001::double as ns from events")
def duration_units(spark, d):
    return _t(spark, d, "events").select("event_id", *[arrow_io.seconds(F.col("user_id"), u).alias(u) for u in ("s", "ms", "us", "ns")])


@query("select level, row_number() over (order by f) as code from (select p_brand as level, min(p_partkey) f from part group by 1)")
def factor_levels(spark, d):
    return arrow_io.factor_levels(_t(spark, d, "part"), "p_partkey", "p_brand")


@query("""with b as (select p_brand l, row_number() over (order by min(p_partkey)) c from part group by 1), n as (select p_name l, row_number() over (order by min(p_partkey)) c from part group by 1),
 t as (select p_type l, row_number() over (order by min(p_partkey)) c from part group by 1)
 select p_partkey, b.c as p_brand, n.c as p_name, t.c as p_type from part join b on b.l = p_brand join n on n.l = p_name join t on t.l = p_type""")
def dictionary_codes(spark, d):
    """Three text columns as codes of their levels, which are counted in the order first seen in one pass."""
    t = _t(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return arrow_io.encode_columns(t, "p_partkey", ["p_brand", "p_name", "p_type"])[0]


@query("""select c_custkey + 1 ix, '490104' || lpad(lower(to_hex(octet_length(encode(c_name)))), 2, '0') || '000000' || lower(hex(encode(c_name))) as stream from customer""")
def codec_text(spark, d):
    rows = _elements(spark, d, "customer", "c_custkey", "c_name")
    return codec.pack(rows).select("ix", F.lower(F.hex("stream")).alias("stream"))


@query("select c_custkey, c_name, c_nationkey, c_acctbal, case when c_custkey % 3 > 0 then c_mktsegment end as c_mktsegment from customer")
def codec_columns(spark, d):
    """A table's columns as one stream each a batch, and back."""
    t = _t(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")))
    return columnar.unpack_columns(columnar.pack_columns(t), "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("select o_orderkey + 1 ix, o_totalprice as x from orders")
def codec_round_trip(spark, d):
    return codec.unpack(codec.pack(_elements(spark, d, "orders", "o_orderkey", "o_totalprice")), "double", pa.float64())


@query("""select event_id // 4 as task, case min(event_id % 3) filter (where event_id % 4 = 3) when 0 then 'ok' when 1 then 'err' else 'cancel' end as state
 from events where event_id < 4 * ((select max(event_id) + 1 from events) // 4) group by 1""")
def task_dump(spark, d):
    """Four events a task: submit, start twice (a task that was moved), and what its last event's number says."""
    t = _t(spark, d, "events")
    n = ((t.agg(F.max("event_id")).first()[0] or 0) + 1) // 4 * 4
    k, how = F.col("event_id") % 4, F.element_at(F.array(*map(F.lit, ("done", "error", "drop"))), (F.col("event_id") % 3 + 1).cast("int"))
    return tasks.dump(t.where(F.col("event_id") < n).select(F.floor(F.col("event_id") / 4).alias("task"), F.col("event_id").alias("seq"), F.when(k == 0, "submit").when(k < 3, "start").otherwise(how).alias("event")))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
