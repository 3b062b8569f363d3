"""Ordered key-value tables on Parquet: families, prefix scans, puts and deletes, exports.

A table is a folder of change rows (cf, key, value, seq, deleted), partitioned by cf and sorted by key in each file: a prefix or a point becomes a range on ``key``, which Parquet's statistics skip files by.
The newest change of a key holds. ``compact`` rewrites the rows that hold.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as form
from ..sources.sinks import write_pieces

SCHEMA = "cf string, key binary, value binary, seq long, deleted boolean"
DEFAULT = "default"
LIMIT = 100


def after_prefix(prefix: bytes) -> bytes | None:
    """The first key behind all that start so; None if there is none."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def has_prefix(key: Column, prefix: bytes) -> Column:
    """A half-open range, which reaches the scan, where a call of startswith would not."""
    if not prefix:
        return F.lit(True)
    end = after_prefix(prefix)
    found = key >= F.lit(prefix)
    return found & (key < F.lit(end)) if end else found


def latest(changes: DataFrame) -> DataFrame:
    """cf, key, value: the newest change of each key, without the deleted. Of equal seq the greater value holds."""
    newest = changes.groupBy("cf", "key").agg(F.max(F.struct("seq", "deleted", "value")).alias("c"))
    return newest.filter(~F.col("c.deleted")).select("cf", "key", F.col("c.value").alias("value"))


def scan(rows: DataFrame, prefix: bytes = b"", limit: int | None = LIMIT) -> DataFrame:
    """Rows (key, value) in the order of keys. The limit runs as a distributed top-k."""
    found = rows.filter(has_prefix(F.col("key"), prefix)).orderBy("key")
    return found if limit is None else found.limit(limit)


def scan_flagged(rows: DataFrame, prefix: bytes = b"", limit: int = LIMIT) -> tuple[list, bool]:
    """Rows up to the limit, and whether there are more: one row more is looked at."""
    found = scan(rows, prefix, limit + 1).collect()
    return found[:limit], len(found) > limit


def put(changes: DataFrame, cf: str, key: bytes, value: bytes, seq: int) -> DataFrame:
    return changes.unionByName(changes.sparkSession.createDataFrame([(cf, bytearray(key), bytearray(value), seq, False)], SCHEMA))


def delete(changes: DataFrame, cf: str, key: bytes, seq: int) -> DataFrame:
    return changes.unionByName(changes.sparkSession.createDataFrame([(cf, bytearray(key), None, seq, True)], SCHEMA))


def changes_of(rows: DataFrame) -> DataFrame:
    """Rows (cf, key, value) as the first changes of a table."""
    return rows.select("cf", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("deleted"))


def export_rows(rows: DataFrame) -> DataFrame:
    """key, value in the form that can be read back, in the order of keys."""
    return rows.orderBy("key").select(form.export(F.col("key")).alias("key"), form.export(F.col("value")).alias("value"))


def stats(rows: DataFrame) -> DataFrame:
    """cf, keys, key_bytes, value_bytes, least_key, most_key (display form)."""
    one = rows.groupBy("cf").agg(F.count("*").alias("keys"), F.sum(F.length("key")).alias("key_bytes"), F.sum(F.length("value")).alias("value_bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    return one.select("cf", "keys", "key_bytes", "value_bytes", form.display(F.col("lo")).alias("least_key"), form.display(F.col("hi")).alias("most_key"))


def families(rows: DataFrame, selected: str = DEFAULT) -> DataFrame:
    return rows.select("cf").distinct().select("cf", (F.col("cf") == selected).alias("selected"))


def _json_array(rows: DataFrame):
    yield b"["
    for i, r in enumerate(rows.toLocalIterator()):
        yield (",\n" * (i > 0) + json.dumps(r.asDict(), ensure_ascii=False)).encode()
    yield b"]\n"


class Store:
    """A table in a folder. ``writable`` allows puts, deletes and compaction."""

    def __init__(self, spark: SparkSession, path: str, cf: str = DEFAULT, writable: bool = False):
        self.spark, self.path, self.cf, self.writable = spark, path, cf, writable

    def changes(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def rows(self) -> DataFrame:
        return latest(self.changes().filter(F.col("cf") == self.cf)).select("key", "value")

    def _write(self, rows: DataFrame, mode: str = "append", path: str | None = None) -> None:
        if not self.writable:
            raise ValueError("the table is open for reading only")
        rows.repartitionByRange("cf", "key").sortWithinPartitions("cf", "key").write.mode(mode).partitionBy("cf").parquet(path or self.path)

    def load(self, rows: DataFrame) -> None:
        """Adds rows (key, value) at once."""
        self._write(changes_of(rows.withColumn("cf", F.lit(self.cf))).withColumn("seq", F.lit(time.time_ns())))

    def put(self, key: str, *value: str) -> None:
        """Words of the value are joined by one space."""
        row = (self.cf, bytearray(form.parse_literal(key)), bytearray(form.parse_literal(" ".join(value))), time.time_ns(), False)
        self._write(self.spark.createDataFrame([row], SCHEMA))

    def delete(self, key: str) -> None:
        self._write(self.spark.createDataFrame([(self.cf, bytearray(form.parse_literal(key)), None, time.time_ns(), True)], SCHEMA))

    def get(self, key: str) -> bytes | None:
        found = latest(self.changes().filter((F.col("cf") == self.cf) & (F.col("key") == F.lit(form.parse_literal(key))))).first()
        return bytes(found["value"]) if found else None

    def scan(self, prefix: str = "", limit: int | None = LIMIT) -> DataFrame:
        some = self.changes().filter((F.col("cf") == self.cf) & has_prefix(F.col("key"), form.parse_literal(prefix)))
        return scan(latest(some).select("key", "value"), b"", limit)

    def keys(self, prefix: str = "", limit: int | None = LIMIT) -> DataFrame:
        return self.scan(prefix, limit).select("key")

    def count(self, prefix: str = "") -> int:
        return self.scan(prefix, None).count()

    def stats(self) -> DataFrame:
        return stats(latest(self.changes()))

    def families(self) -> DataFrame:
        return families(self.changes(), self.cf)

    def compact(self, into: str) -> Store:
        """The rows that hold, as a new table in ``into``."""
        self._write(changes_of(latest(self.changes())), "errorifexists", into)
        return Store(self.spark, into, self.cf, self.writable)

    def export(self, path: str | None = None, kind: str = "csv", force: bool = False) -> tuple[DataFrame, int]:
        """(rows, count). With a path also written: csv with a header, jsonl, or json (one array, written by the driver)."""
        rows = export_rows(self.rows())
        n = rows.count()
        if path is None:
            return rows, n
        mode = "overwrite" if force else "errorifexists"
        if kind == "csv":
            rows.write.mode(mode).option("header", True).option("escape", '"').csv(path)
        elif kind == "jsonl":
            rows.write.mode(mode).json(path)
        elif kind == "json":
            from pyspark.errors import AnalysisException

            if not force:
                try:
                    self.spark.read.format("binaryFile").load(path)
                except AnalysisException:
                    pass
                else:
                    raise ValueError(f"{path} exists")
            write_pieces(_json_array(rows), path)
        else:
            raise ValueError("format must be csv, json or jsonl")
        return rows, n
