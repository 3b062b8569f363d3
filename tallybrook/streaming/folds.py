"""Structured Streaming forms of the operators.

Filters (stable samples, membership) hold no state and run in append mode as they are. Folds are aggregations: in
complete mode they give at any time what the batch form gives for the rows so far, and windows with a watermark
give each window once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_of
from ..operators import bloom, hll, sampling


def sample_stable(stream: DataFrame, item: str, rate: float, seed: int = 0) -> DataFrame:
    return sampling.stable(stream, item, rate, seed)


def members(stream: DataFrame, item: str, state: bytes, invert: bool = False) -> DataFrame:
    """For filters that fit a broadcast: a larger one meets items in a join that needs them all at once (``bloom.test``
    in ``foreachBatch``)."""
    if len(state) > bloom.BROADCAST:
        raise ValueError("the filter is too large for a stream's tasks: use bloom.test in foreachBatch")
    return bloom.test(stream, item, state, invert)


def registers(stream: DataFrame, item: str, p: int = hll.DEFAULT_P) -> DataFrame:
    """idx, rank so far (complete or update mode): ``hll.estimate_registers`` of them is the count."""
    return hll.registers(stream, item, p)


def windowed_distinct(stream: DataFrame, time: str, item: str, width: str, delay: str, p: int = 12) -> DataFrame:
    """window_start, approx_unique of tumbling windows, by the engine's own sketch."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    return timed.groupBy(F.window("_t", width).alias("w")).agg(F.hll_sketch_estimate(F.hll_sketch_agg(item, F.lit(p))).alias("approx_unique")).select(F.col("w.start").alias("window_start"), "approx_unique")


def value_counts(stream: DataFrame, item: str) -> DataFrame:
    """item, count_estimate so far, the most frequent first (complete mode)."""
    counts = stream.filter(F.col(item).isNotNull()).groupBy(F.col(item).cast("string").alias("item")).agg(F.count("*").alias("count_estimate"))
    return counts.orderBy(F.desc("count_estimate"), "item")


class Reservoir:
    """For ``foreachBatch``: the ``n`` rows of least hash of (seed, key) so far, in a Parquet folder.

    Rows that have a key of their own are a uniform sample, and a batch that comes again changes nothing. What earlier
    batches left is found in the folder, so a query that is started again goes on from there.
    """

    def __init__(self, path: str, n: int, key: str, seed: int = 1):
        self.path, self.n, self.key, self.seed = path, n, key, seed

    def _last(self, below: int | None = None) -> int | None:
        """The last batch whose rows are complete."""
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = files.get_file_info(fs.FileSelector(name, allow_not_found=True))
        done = [int(x.base_name) for x in found if x.base_name.isdigit() and (below is None or int(x.base_name) < below)]
        return max((i for i in done if files.get_file_info(f"{name}/{i}/_SUCCESS").type == fs.FileType.File), default=None)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, last = batch.sparkSession, self._last(batch_id)
        rows = batch.withColumn("_h", hash_of(F.col(self.key).cast("string"), self.seed))
        if last is not None:
            rows = rows.unionByName(spark.read.parquet(f"{self.path}/{last}"))
        rows.dropDuplicates(["_h"]).orderBy("_h").limit(self.n).write.mode("overwrite").parquet(f"{self.path}/{batch_id}")

    def rows(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{self._last()}").drop("_h")
