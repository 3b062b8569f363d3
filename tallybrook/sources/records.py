"""Record scans: a DataFrame with one BINARY column ``value``.

Records end at a line feed, or at NUL. A carriage return stays. A last record without its end counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that trimming removes (fixed value: the Unicode white space characters).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def clean(df: DataFrame, column: str = "value", trim: bool = False, ignore_empty: bool = False) -> DataFrame:
    """Trims first, then drops empty items."""
    if trim:
        df = df.withColumn(column, _trimmed(F.col(column)).cast(df.schema[column].dataType))
    return df.filter(F.length(column) > 0) if ignore_empty else df


def _trimmed(value: Column) -> Column:
    return F.btrim(value.cast("string"), F.lit(WHITE))


def read(spark: SparkSession, paths: str | list[str], nul: bool = False, trim: bool = False, ignore_empty: bool = False) -> DataFrame:
    """All records of the files: a union of them all, none across files."""
    lines = spark.read.option("lineSep", "\0" if nul else "\n").text(paths)
    return clean(lines.select(F.col("value").cast("binary").alias("value")), "value", trim, ignore_empty)


def read_stream(spark: SparkSession, path: str, nul: bool = False, trim: bool = False, ignore_empty: bool = False) -> DataFrame:
    """The same as files arrive in a folder: what standard input is to a single program."""
    lines = spark.readStream.option("lineSep", "\0" if nul else "\n").text(path)
    return clean(lines.select(F.col("value").cast("binary").alias("value")), "value", trim, ignore_empty)


def read_raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value and terminated: whether the record had its line feed (only a file's last may not)."""
    files = spark.read.format("binaryFile").load(paths).select("content")

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                records = content.split(b"\n")
                last = records.pop()
                ends = [True] * len(records) + [False] * bool(last)
                records += [last] * bool(last)
                for lo in range(0, len(records), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(records[lo : lo + 10_000], pa.binary()), pa.array(ends[lo : lo + 10_000], pa.bool_())], ["value", "terminated"])

    return files.mapInArrow(split, "value binary, terminated boolean")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
