"""Plans of log offsets for a consumer group, from frames that describe the log.

``bounds`` (partition, low, high): the first offset of each partition, and the one after its last. ``committed``
(partition, at). ``log`` (partition, offset, ts). A plan is a DataFrame and has no effects; ``starting_offsets``
gives it the form in which Spark's Kafka source takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import OffsetSpec


def bounds_of(log: DataFrame) -> DataFrame:
    """partition, low, high of a log's rows."""
    return log.groupBy("partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"))


def pair_bounds(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """partition, low, high from (partition, offset) frames. A partition in one of them only raises."""
    both = starts.select("partition", F.col("offset").alias("low")).join(ends.select("partition", F.col("offset").alias("high")), "partition", "full")
    need = lambda c, what: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"the {what} offset is missing of partition "), F.col("partition").cast("string"))).cast("long"))
    return both.select("partition", need("low", "start").alias("low"), need("high", "end").alias("high"))


def first_at(log: DataFrame, millis: int) -> DataFrame:
    """partition, offset: the first at or after an instant, in whole milliseconds; -1 if there is none."""
    late = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) >= millis
    return log.groupBy("partition").agg(F.coalesce(F.min(F.when(late, F.col("offset"))), F.lit(-1)).alias("offset"))


def check_partitions(bounds: DataFrame, partitions: list[int] | None) -> None:
    """Ids run from 0; one beyond the last raises."""
    n = bounds.count()
    for p in partitions or []:
        if not 0 <= p < n:
            raise ValueError(f"partition {p} out of range: the topic has {n}")


def plan(bounds: DataFrame, spec: OffsetSpec, committed: DataFrame | None = None, log: DataFrame | None = None, partitions: list[int] | None = None, fetched: bool = True) -> DataFrame:
    """partition, current_offset, new_offset, low_watermark, high_watermark.

    The current offset is ``-`` if none is committed and ``?`` if they couldn't be fetched.
    """
    check_partitions(bounds, partitions)
    rows = bounds.filter(F.col("partition").isin(partitions)) if partitions else bounds
    if spec.mode == "numeric":
        rows = rows.withColumn("new", F.lit(spec.value).cast("long"))
    elif spec.mode in ("earliest", "latest"):
        rows = rows.withColumn("new", F.col("low" if spec.mode == "earliest" else "high"))
    elif log is None:
        raise ValueError("a timestamp needs the log")
    else:
        # an offset below zero means that nothing came so late
        at = first_at(log, spec.value).withColumnRenamed("offset", "at_")
        rows = rows.join(at, "partition", "left").withColumn("new", F.when(F.coalesce("at_", F.lit(-1)) < 0, F.col("high")).otherwise(F.col("at_")))
    current = F.lit("-" if fetched else "?")
    if committed is not None and fetched:
        rows = rows.join(committed.select("partition", F.col("at").alias("_at")), "partition", "left")
        current = F.coalesce(F.when(F.col("_at") >= 0, F.col("_at").cast("string")), current)
    return rows.select(F.col("partition").cast("int").alias("partition"), current.alias("current_offset"), F.col("new").cast("long").alias("new_offset"), F.col("low").cast("long").alias("low_watermark"), F.col("high").cast("long").alias("high_watermark"))


def with_warnings(planned: DataFrame) -> DataFrame:
    """Adds warning: ``below low watermark``, ``above high watermark`` or null."""
    low = F.col("new_offset") < F.col("low_watermark")
    return planned.withColumn("warning", F.when(low, "below low watermark").when(F.col("new_offset") > F.col("high_watermark"), "above high watermark"))


def plan_text(planned: DataFrame, group: str, topic: str, spec: OffsetSpec, dry_run: bool = False) -> str:
    """The plan as a table with a header (fixed layout). A row for each partition of a topic, a few thousand at most."""
    rows = [(str(r["partition"]), r["current_offset"], str(r["new_offset"]), str(r["low_watermark"]), str(r["high_watermark"])) for r in planned.orderBy("partition").collect()]
    named = [("Group ", group), ("Topic ", topic), ("Offset", spec.describe())] + [("Mode  ", "DRY RUN (no changes will be committed)")] * dry_run
    titles = ("Partition", "Current Offset", "New Offset", "Low Watermark", "High Watermark")
    table = [titles, tuple("-" * (len(t) + (t == "Partition")) for t in titles), *rows]
    lines = ["", *(f"  {k}: {v}" for k, v in named), "", *("  " + "  ".join(cell.ljust(12 if i == 0 else 16) for i, cell in enumerate(row)) for row in table), ""]
    return "".join(line + "\n" for line in lines)


def warning_lines(planned: DataFrame) -> list[str]:
    """A line for each new offset outside its partition's bounds (fixed layout)."""
    out = []
    for r in with_warnings(planned).filter("warning is not null").orderBy("partition").collect():
        below = r["new_offset"] < r["low_watermark"]
        bound = f"< low watermark {r['low_watermark']} (will consume from earliest available)" if below else f"> high watermark {r['high_watermark']} (consumer will wait for new messages)"
        out.append(f"  warning: partition {r['partition']}: offset {r['new_offset']} {bound}")
    return out


def starting_offsets(planned: DataFrame, topic: str) -> str:
    """JSON for ``startingOffsets``. One entry for each partition of a topic, a few thousand at most."""
    entries = ",".join(f'"{r["partition"]}":{r["new_offset"]}' for r in planned.orderBy("partition").collect())
    name = topic.replace("\\", "\\\\").replace('"', '\\"')
    return f'{{"{name}":{{{entries}}}}}'
