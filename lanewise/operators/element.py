"""Ordered maps over element tables (ix, name, x): one plan each, no shuffle. ix counts from 1."""

from __future__ import annotations

import ast
import importlib
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.session import ship

from .errors import TIMEOUT, EngineError, TemplateMismatch

#: A template accepts its own kind and those before it.
WIDENS = {"boolean": ("boolean",), "int": ("boolean", "int"), "double": ("boolean", "int", "double"), "complex": ("boolean", "int", "double", "complex"), "bigint": ("bigint",), "string": ("string",)}
_PYTHON = {"boolean": (bool,), "int": (bool, int), "double": (bool, int, float), "complex": (bool, int, float, complex), "bigint": (int,), "string": (str,)}
_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "complex": pa.struct([("re", pa.float64()), ("im", pa.float64())]), "bigint": pa.int64(), "string": pa.string(), "any": pa.binary()}
_SQL = {"complex": "struct<re:double,im:double>", "any": "binary"}
_RANGE = {"int": 31, "bigint": 63}


def elements(df: DataFrame, key: Column, x: Column, name: Column | None = None) -> DataFrame:
    """An element table from a dense key that counts from 0: no sort, no window."""
    return df.select((key.cast("long") + 1).alias("ix"), *([name.alias("name")] if name is not None else []), x.alias("x"))


def from_values(spark: SparkSession, values, kind: str | None = None) -> DataFrame:
    """An element table from a list, or from a dict whose keys are the names; kind is the column type of x, found from the values if not given."""
    named = isinstance(values, dict)
    rows = [(k, *((n,) if named else ()), v) for k, (n, v) in enumerate(values.items() if named else ((None, v) for v in values), 1)]
    if kind is None:
        return spark.createDataFrame(rows, ["ix", *["name"] * named, "x"])
    return spark.createDataFrame(rows, "ix long, " + "name string, " * named + f"x {kind}")


def map_columns(table: DataFrame, f: Callable[[Column], Column], template: str | None = None, size: int = 1) -> DataFrame:
    """The map of a column function, inside code generation. The template's kind is checked before the job, widening is a cast, and a
    result of several values is an array whose length is checked while it runs."""
    value = f(F.col("x"))
    out = table.select(*[c for c in ("ix", "name") if c in table.columns], value.alias("value"))
    if template is None:
        return out
    if template not in WIDENS:
        raise TemplateMismatch(f"there is no template '{template}'; it is one of {', '.join(sorted(WIDENS))}")
    kind = dict(out.dtypes)["value"]
    own = kind.removeprefix("array<").removesuffix(">") if size > 1 else kind
    if own not in WIDENS[template]:
        raise TemplateMismatch(f"values of type '{own}' don't fit a template of type '{template}'")
    if size == 1:
        return out.withColumn("value", F.col("value").cast(template))
    gate = F.when(F.size("value") == size, F.col("value").cast(f"array<{template}>")).otherwise(F.raise_error(F.concat(F.lit("template length mismatch at element "), F.col("ix").cast("string"))))
    return out.withColumn("value", gate)


def fitted(v, template: str):
    """The value in the template's kind, widened where it may be; any other kind, or a number out of its range, is a mismatch."""
    if v is None:
        return None
    if template == "any":
        from lanewise.functions import codec

        return codec.write(v)
    if not isinstance(v, _PYTHON[template]) or (template == "bigint" and isinstance(v, bool)):
        raise TemplateMismatch(f"values of type '{type(v).__name__}' don't fit a template of type '{template}'")
    if (bits := _RANGE.get(template)) and not -(1 << bits) <= v < 1 << bits:
        raise TemplateMismatch(f"{v} is out of the range of type '{template}'")
    if template == "complex":
        v = complex(v)
        return {"re": v.real, "im": v.imag}
    return float(v) if template == "double" else int(v) if template == "int" else v


_EXACT = {"boolean": bool, "int": int, "double": float, "bigint": int, "string": str}


def plain(values: list, template: str) -> bool:
    """Whether all values are of the template's own kind already, and within its range."""
    if (own := _EXACT.get(template)) is None or not set(map(type, values)) <= {own, type(None)}:
        return False
    if not (bits := _RANGE.get(template)):
        return True
    there = [v for v in values if v is not None]
    return not there or -(1 << bits) <= min(there) and max(there) < 1 << bits


def fitted_many(v, template: str, size: int) -> list:
    """The values of an element with several, in the template's kind; a dict gives its values in order."""
    values = list(v.values()) if isinstance(v, dict) else list(v) if isinstance(v, (list, tuple)) else [v]
    if len(values) != size:
        raise TemplateMismatch(f"{len(values)} values don't fit a template of length {size}")
    return [fitted(x, template) for x in values]


def map_python(table: DataFrame, f: Callable, template: str, constants: tuple = (), size: int = 1, seed=None, budget: int | None = None) -> DataFrame:
    """The map of a Python function by Arrow batches: (ix, name, value, error). An element that raises, or whose value doesn't fit the
    template, gives its error instead of a value; see first_error.

    template: a kind of WIDENS, or any for values as byte streams; with a size above 1 each element gives so many. With a seed, f is
    given its element's own stream of numbers as rng, the same whatever the partitions. With a budget there is a column failure too:
    what crosses of the error, as a byte stream of at most so many bytes."""
    from lanewise.functions import rng

    if template not in _ARROW:
        raise TemplateMismatch(f"there is no template '{template}'; it is one of {', '.join(sorted(_ARROW))}")
    ship(table.sparkSession)
    named = "name" in table.columns
    narrow = table.select("ix", *(["name"] if named else []), "x")
    first, offset = (None, 0) if seed is None else (rng.base(rng.check_seed(seed)[0]), rng.check_seed(seed)[1])
    one, many = _ARROW[template], _SQL.get(template, template)
    kind = one if size == 1 else pa.list_(one)
    names = ["ix", *["name"] * named, "value", "error", *["failure"] * (budget is not None)]

    def run(batches):
        from .transport import flatten

        for b in batches:
            xs = b.column(b.num_columns - 1).to_pylist()
            values, errors, failures = [], [None] * len(xs), [None] * len(xs)

            def failed(k: int, e: Exception, errors=errors, failures=failures) -> None:
                errors[k] = f"{type(e).__name__}: {e}"
                failures[k] = flatten(e, budget) if budget is not None else None

            states = rng.signed_words(rng.many(first, b.column(0).to_numpy() + offset)).T.tolist() if first and xs else None
            for k, x in enumerate(xs):
                try:
                    values.append(f(x, *constants) if states is None else f(x, *constants, rng=rng.Stream(states[k])))
                except Exception as e:  # noqa: BLE001  the element's own error is data here
                    values.append(None)
                    failed(k, e)
            if size > 1 or not plain(values, template):
                for k, v in enumerate(values):
                    if errors[k] is None:
                        try:
                            values[k] = fitted(v, template) if size == 1 else fitted_many(v, template, size)
                        except Exception as e:  # noqa: BLE001  so is a value that doesn't fit
                            values[k] = None
                            failed(k, e)
            more = [pa.array(failures, pa.binary())] if budget is not None else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(values, kind), pa.array(errors, pa.string()), *more], names=names)

    return narrow.mapInArrow(run, "ix long, " + "name string, " * named + f"value {many if size == 1 else f'array<{many}>'}, error string" + ", failure binary" * (budget is not None))


def matrix(mapped: DataFrame, row_names: list[str]) -> DataFrame:
    """(ix, row_name, value) of a map with several values an element: one row for each of them, named in order."""
    names = F.array(*map(F.lit, row_names))
    each = mapped.select(*[c for c in ("ix", "name") if c in mapped.columns], F.posexplode("value").alias("_k", "value"))
    return each.withColumn("row_name", F.element_at(names, F.col("_k") + 1)).drop("_k")


def first_error(mapped: DataFrame) -> DataFrame:
    """The least element that failed and its error, in one pass with partial aggregation."""
    return mapped.where("error is not null").agg(F.min("ix").alias("ix"), F.min_by("error", "ix").alias("error"))


def collect(mapped: DataFrame) -> list:
    """Values in input order; raises the error of the least element that failed, with its index and what crossed of it."""
    rows = mapped.orderBy("ix").collect()
    if "error" in mapped.columns:
        for r in rows:
            if r["error"] is not None:
                if "failure" in mapped.columns:
                    from .transport import restored

                    raise restored(bytes(r["failure"]), index=r["ix"])
                raise EngineError(r["error"], index=r["ix"])
    return [complex(r["value"]["re"], r["value"]["im"]) if r["value"] is not None and dict(mapped.dtypes)["value"] == _SQL["complex"] else r["value"] for r in rows]


def over_columns(df: DataFrame, columns: list[str], f: Callable[[Column], Column]) -> DataFrame:
    """One result for each column of a frame: all in one aggregation, then turned to rows."""
    wide = df.agg(*[f(F.col(c)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(k).cast("long").alias("ix"), F.lit(c).alias("name"), F.col(c).alias("value")) for k, c in enumerate(columns, 1)])
    return wide.select(F.inline(pairs))


class Call:
    """A function that travels as its name or its source, and is looked up or compiled once where it runs."""

    def __init__(self, name: str | None, source: str | None):
        self.name, self.source = name, source
        self.ready = None

    def __getstate__(self) -> dict:
        return {"name": self.name, "source": self.source, "ready": None}

    def __call__(self, *args, **named):
        if self.ready is None:
            self.ready = self.found() if self.name is not None else self.compiled()
        return self.ready(*args, **named)

    def found(self) -> Callable:
        module, _, attr = self.name.rpartition(".")
        return getattr(importlib.import_module(module), attr)

    def compiled(self) -> Callable:
        tree = ast.parse(self.source)
        last = ast.Expression(tree.body.pop().value) if tree.body and isinstance(tree.body[-1], ast.Expr) else None
        body, value = compile(tree, "<task>", "exec"), compile(last, "<task>", "eval") if last else None

        def run(x=None, **named):
            space = {"x": x, **named}
            exec(body, space)  # noqa: S102  running given source is this function's purpose
            return eval(value, space) if value else None  # noqa: S307

        return run


def call(name: str | None = None, source: str | None = None) -> Call:
    """A function by its qualified name, or by source whose last expression is the value, with x bound; None if it ends in a statement."""
    if (name is None) == (source is None):
        raise EngineError("exactly one of name and source is needed")
    if name is not None and not name.rpartition(".")[0]:
        raise EngineError("a qualified name is needed")
    return Call(name, source)


def collect_within(mapped: DataFrame, timeout: float | None):
    """collect(), or TIMEOUT if it takes longer: then the job is interrupted."""
    if timeout is None:
        return collect(mapped)
    spark, tag, out = mapped.sparkSession, f"lanewise-{uuid.uuid4().hex}", []

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            out.append((collect(mapped), None))
        except BaseException as e:  # noqa: BLE001  raised where it is waited for
            out.append((None, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(timeout)
    if t.is_alive():
        spark.sparkContext.cancelJobsWithTag(tag)
        return TIMEOUT
    value, error = out[0]
    if error:
        raise error
    return value


class Prepared:
    """A map staged once and run many times. f takes a Column, or with python=True a value.

    A run may bring a new table, a seed, and a time limit. What was staged serves again after a run that ended cleanly and was collected;
    after an error, a timeout, a view, a table of another schema or another seed the next run stages anew. stagings counts that."""

    def __init__(self, table: DataFrame, f: Callable, template: str | None = None, size: int = 1, constants: tuple = (), python: bool = False):
        if python and template is None:
            raise EngineError("a map of a Python function needs a template")
        self.table, self.f, self.template, self.size, self.constants, self.python = table, f, template, size, constants, python
        self.staged, self.seed, self.stagings = None, None, 0
        self.stage(None)

    def stage(self, seed) -> DataFrame:
        self.seed, self.stagings = seed, self.stagings + 1
        if self.python:
            self.staged = map_python(self.table, self.f, self.template, self.constants, self.size, seed)
        else:
            if seed is not None:
                raise EngineError("a map of a column function takes no seed")
            self.staged = map_columns(self.table, self.f, self.template, self.size)
        return self.staged

    def replace(self, table: DataFrame) -> None:
        """Another table for the runs from now on."""
        self.table, self.staged = table, None

    def run(self, table: DataFrame | None = None, seed=None, timeout: float | None = None, collect: str = "copy"):
        """The values in order (copy), or the frame of the map (view), or TIMEOUT."""
        if collect not in ("copy", "view"):
            raise EngineError("collect is copy or view")
        if collect == "view" and self.template is None:
            raise EngineError("a view needs a template")
        if table is not None and table is not self.table:
            self.replace(table)
        mapped = self.staged if self.staged is not None and seed == self.seed else self.stage(seed)
        self.staged = None
        if collect == "view":
            return mapped
        values = collect_within(mapped, timeout)
        if values is not TIMEOUT:
            self.staged = mapped
        return values

    def __repr__(self) -> str:
        return f"<prepared map of {'a Python' if self.python else 'a column'} function, template {self.template or 'none'}, {'staged' if self.staged is not None else 'to be staged'}>"
