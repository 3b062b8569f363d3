from pyspark.sql import functions as F

from tallybrook.operators import bloom, hll, sampling
from tallybrook.streaming import folds


def _stream(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") % 700).cast("string").alias("item"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("n"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    df, stream = _stream(spark, tmp_path)
    _run(folds.sample_stable(stream, "item", 0.25, 3), "sampled", "append")
    assert spark.table("sampled").count() == sampling.stable(df, "item", 0.25, 3).count()
    state = bloom.build(df.filter("n < 50"), "item", 100, 0.01)
    _run(folds.members(stream, "item", state), "found", "append")
    assert spark.table("found").count() == bloom.test(df, "item", state).count()
    _run(folds.registers(stream, "item", 10), "regs", "complete")
    assert hll.estimate_registers(spark.table("regs"), 10).first() == hll.count(df, "item", 10).first()
    _run(folds.value_counts(stream, "item"), "counts", "complete")
    assert spark.table("counts").count() == 700
    _run(folds.windowed_distinct(stream, "ts", "item", "1 day", "1 hour"), "days", "complete")
    assert spark.table("days").count() == 2


def test_reservoir(spark, tmp_path):
    df, stream = _stream(spark, tmp_path)
    keep = folds.Reservoir(str(tmp_path / "r"), 20, "n")
    q = stream.writeStream.foreachBatch(keep).start()
    q.processAllAvailable()
    q.stop()
    rows = keep.rows(spark).collect()
    assert len(rows) == 20 and len({r.n for r in rows}) == 20
    # a new object goes on from the folder: the sample is that of all rows, and a batch that comes again changes nothing
    again = folds.Reservoir(str(tmp_path / "r"), 20, "n")
    more = df.selectExpr("item", "ts", "n + 2000 AS n")
    for _ in range(2):
        again(more, 100)
    whole = folds.Reservoir(str(tmp_path / "w"), 20, "n")
    whole(df.unionByName(more), 0)
    assert {r.n for r in again.rows(spark).collect()} == {r.n for r in whole.rows(spark).collect()}
