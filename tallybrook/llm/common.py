"""What several operators of the subpackage share."""

from __future__ import annotations

import contextlib
import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators between words: space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. Only a session that runs in one
    process (``local``) gets one of its own where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python gets, in rows and bytes, unless the session has set its own bounds."""
    for name, value in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 2 << 20)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder, once, and reads them again."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, also where inner lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_tool: dict = {}  # what a Python worker keeps from task to task: one at a time


def tool(key: tuple, make):
    """``make()``, made once in each Python worker. Only the last one asked for is kept."""
    if key not in _tool:
        forget()
        _tool[key] = make()
    return _tool[key]


def forget() -> None:
    """Gives back the memory of what is kept: workers go on to other operators' tasks."""
    import gc

    if _tool:
        _tool.clear()
        gc.collect()
        release()


def release() -> None:
    """Gives the system back what is freed, by Arrow too: allocators keep it, and a worker that waits holds it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


class Recent:
    """Values of short strings that recent batches asked for: two generations of ``size`` at most."""

    LENGTH = 64

    def __init__(self, size: int = 1 << 16):
        self.size, self.now, self.past = size, {}, {}

    def of(self, keys: set, make) -> dict:
        """A dict with the values of ``keys``; ``make`` gives those of a list of new ones."""
        now, past = self.now, self.past
        missing = keys.difference(now)
        kept = missing.intersection(past)
        new = list(missing.difference(kept))
        made = dict(zip(new, make(new), strict=True)) if new else {}
        made.update(zip(kept, map(past.__getitem__, kept), strict=True))
        short = {k: v for k, v in made.items() if len(k) <= self.LENGTH}
        if len(now) + len(short) > self.size:
            found = {k: now[k] for k in keys.intersection(now)} | made
            self.past, self.now = now, dict(itertools.islice(short.items(), self.size))
            return found
        now.update(short)
        return now if len(short) == len(made) else now | made


def map_texts(docs: DataFrame, text: str, fields: list[tuple[str, str]], make) -> DataFrame:
    """``docs`` without its text and with new columns, made from whole texts in Arrow batches of bounded size.

    ``make()`` is called once in each task and returns a function from a list of texts (null: empty) to as many
    rows, one value for each of ``fields`` (name, SQL type). Columns of the input that clash with new ones are dropped.
    """
    small_batches(docs.sparkSession)
    names = [n for n, _ in fields]
    kept = [c for c in docs.columns if c != text and c not in names]
    slim = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*kept).schema] + [f"`{n}` {k}" for n, k in fields])

    def run(batches):
        import gc

        import pyarrow as pa

        work = make()
        kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            if batch.num_rows:
                gc.disable()  # a batch makes many short-lived objects and no cycles
                try:
                    rows = work([x or "" for x in batch.column(batch.num_columns - 1).to_pylist()])
                finally:
                    gc.enable()
                made = [pa.array(col, kinds[k]) for col, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*kept, *names])

    return slim.mapInArrow(run, schema)


def hot_join(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the row of ``table`` of their key. ``table`` has each key once, and in ``n`` how many rows have it.

    Keys of more than a five-thousandth of all rows, so 5000 keys at most, are broadcast: none of them lands in one task.
    """
    often = max(1000, (table.agg(F.sum(n)).first()[0] or 0) // 5000)
    hot = table.filter(F.col(n) > often)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col(n) <= often).hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def constant(one: DataFrame, column: str) -> Column:
    """The value in the only row of ``one``, as a constant of the plan, which goes from the JVM to the tasks."""
    spark, kind, name = one.sparkSession, one.schema[column].dataType.simpleString(), f"_{column}_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind}")
    spark.sql(f"SET VARIABLE {name} = (SELECT `{column}` FROM {{one}})", one=one)
    return F.expr(name)
