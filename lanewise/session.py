"""What a session needs before Python code of this library runs on its executors, and shared folders for what outlives a stage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lanewise.operators.errors import EngineError, Stopped

_shipped: set[str] = set()
_cleaned: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the Python workers, once for each application, so that maps run whatever folder they were started from."""
    sc = spark.sparkContext
    if sc._jsc is None:
        raise Stopped("the session has stopped")
    if sc.applicationId in _shipped:
        return
    root, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="lanewise-")
    out = os.path.join(folder, "lanewise.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the archive from the driver while it runs
    _shipped.add(sc.applicationId)


def checkpoint_folder(spark: SparkSession) -> None:
    """See that checkpoints go to a folder that all executors share, and that they go when the application ends.

    That is spark.checkpoint.dir. Where it is unset a local master gets a folder of its own; on a cluster that is an error, since
    executors cannot read one another's temporary folders."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if named := sc.getConf().get("spark.checkpoint.dir"):
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="lanewise-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            sc.setCheckpointDir(folder)
        else:
            raise EngineError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = sc._jsc.sc().getCheckpointDir().get()
    if at not in _cleaned:
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        system = path.getFileSystem(sc._jsc.hadoopConfiguration())

        def clean() -> None:
            with contextlib.suppress(Exception):  # the JVM may have gone first
                system.delete(path, True)

        atexit.register(clean)
        _cleaned.add(at)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder, with the lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession) -> str:
    """A new path below the checkpoint folder, which the driver and all executors share."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/lanewise_{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared checkpoint folder. Unlike a checkpoint's, its size is known to the planner: what is joined
    round after round goes here, since estimates of joins of joins grow without bound."""
    at = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._lanewise_at = at
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that cut or written returned and that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    with contextlib.suppress(Exception):  # what stays goes when the application ends
        at = getattr(df, "_lanewise_at", None) or df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The same rows written to the checkpoint folder in n buckets by the columns' hash: joins on these columns don't move them again."""
    checkpoint_folder(df.sparkSession)
    spark, name = df.sparkSession, f"lanewise_{uuid.uuid4().hex}"
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
    df.write.format("parquet").bucketBy(n, *columns).option("compression", "zstd").option("path", at).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved, so the name can go: the files stay until the application ends
    spark.sql(f"drop table {name}")
    return out


def with_batches(df: DataFrame, rows: int) -> DataFrame:
    """The same plan in a session of its own whose Arrow batches hold at most so many rows. The caller's session stays as it is."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if 0 < int(spark.conf.get(key)) <= rows:
        return df
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(key, str(rows))
    plan = df._jdf.queryExecution().logical()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, plan), own)
