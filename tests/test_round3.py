"""What the third round's findings were about."""

import duckdb
from pyspark.sql import functions as F

from lanewise.operators import nested
from lanewise.plans import registry

D = "/root/testdata/sf0.01"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_first_failures_of_all_groups(spark):
    sql = "select grp, min(pos) filter (event_type = 'error' or event_id % 37 = 0) from (select user_id as grp, *, row_number() over (partition by user_id order by event_id) as pos from '{}/events.parquet') group by 1"
    want = duckdb.sql(sql.format(D)).fetchall()
    assert rows(registry.collect_all_error_index(spark, D)) == sorted(want, key=str)
    assert any(i for g, i in want if g % 3)


def test_parts_of_nested_maps_are_dealt_by_elements(spark, monkeypatch):
    monkeypatch.setattr(nested, "DEALT", 2)
    t = spark.range(1, 41).selectExpr("id as ix", "id % 5 as x")
    to = lambda x: F.sequence(F.lit(1).cast("long"), x + 1)
    unlike = nested.nested_map(t, nested.Nested(to, nested.Nested(to, lambda x: x, lambda x: F.max(x)), "sum"))
    assert unlike._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and unlike.rdd.getNumPartitions() == 20
    assert rows(unlike) == sorted([(k, sum(range(2, k % 5 + 3))) for k in range(1, 41)], key=str)
