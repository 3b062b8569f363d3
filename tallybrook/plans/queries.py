"""Queries of the engine's own operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as form
from ..functions.hashing import hash_of, hex_of
from ..functions.parsing import OffsetSpec, offset_spec
from ..operators import bloom, heavy, hll, kv, offsets, profile, sampling
from ..sources import records
from ..sources.paths import scratch
from ..sources.sinks import json_array, json_object, key_value_lines, omit_zero, read_states, tsv_lines, write_json_array, write_records, write_state, write_verbatim

SEGMENT, OTHER = "BUILDING", "MACHINERY"
FILTER = bloom.sizing(1000, 0.01)
UNION = bloom.sizing(2000, 0.01)
SIZINGS = ((1_000_000, 0.001), (10, 0.01), (20, 0.01), (100, 0.01), (10_000, 0.01), (500_000, 0.01))
INSTANT = "timestamp:2024-01-10T06:30:00Z"
LATE = "timestamp:2100-01-01"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def item(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("item"))


# heavy hitters


def heavy_exact_user(spark, d):
    return heavy.exact(table(spark, d, "events"), "user_id")


def heavy_exact_part(spark, d):
    return heavy.exact(table(spark, d, "lineitem"), "l_partkey", 20)


def heavy_bounded_exact_regime(spark, d):
    return heavy.bounded(table(spark, d, "events"), "event_type", 5)


def heavy_bounded_order(spark, d):
    return heavy.bounded(table(spark, d, "events"), "user_id", 10, 50, ["ts", "event_id"])


def heavy_merged(spark, d):
    return heavy.merged(table(spark, d, "events"), "event_type", 5)


def heavy_bounded_native(spark, d):
    return heavy.native(table(spark, d, "events"), "event_type", 5, 1000)


def heavy_tsv(spark, d):
    return tsv_lines(heavy.exact(table(spark, d, "orders"), "o_orderpriority", 3))


# hashing and sketches


def hash64_vectors(spark, d):
    return table(spark, d, "part").select("p_partkey", hex_of(hash_of(F.col("p_name"))).alias("h"), hex_of(hash_of(F.col("p_name"), 42)).alias("h_seed"))


def hll_count_user(spark, d):
    return hll.count(item(table(spark, d, "events"), "user_id"), "item")


def hll_count_part(spark, d):
    return hll.count(item(table(spark, d, "lineitem"), "l_partkey"), "item")


def hll_registers(spark, d):
    return hll.registers(item(table(spark, d, "orders"), "o_custkey"), "item", 10)


def hll_by_group(spark, d):
    events = table(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("item"))
    return hll.count(events, "item", 14, ("event_type",))


def hll_merge_days(spark, d):
    days = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("item"))
    return hll.inspect(hll.merge(hll.build(days, "item", 12, ("day",)))).select("precision", "approx_unique", "relative_error")


def hll_merge_registers(spark, d):
    days = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("item"))
    return hll.estimate_registers(hll.merge_registers(hll.registers(days, "item", 12, ("day",))), 12)


def hll_inspect(spark, d):
    return hll.inspect(hll.build(item(table(spark, d, "orders"), "o_custkey"), "item", 10))


def hll_precision_sweep(spark, d):
    parts = item(table(spark, d, "lineitem"), "l_partkey")
    each = [hll.count(parts, "item", p).select(F.lit(p).alias("p"), "approx_unique", "relative_error") for p in (4, 10, 14)]
    return records.union_all(*each)


def hll_native_user(spark, d):
    return hll.count_native(table(spark, d, "events"), "user_id", 12)


# membership


def _segment(spark, d, *names):
    return table(spark, d, "customer").filter(F.col("c_mktsegment").isin(*names)).select(F.col("c_custkey").cast("string").alias("item"))


def _state(spark, d, size, *names):
    return bloom.build(_segment(spark, d, *names), "item", size.expected, size.rate)


def bloom_sizing(spark, d):
    rows = [(n, p, s.bits, s.hashes) for n, p in SIZINGS for s in [bloom.sizing(n, p)]]
    return spark.createDataFrame(rows, "expected long, rate double, bits long, hashes int")


def bloom_bits(spark, d):
    return bloom.bits(_segment(spark, d, SEGMENT), "item", FILTER)


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("item"))


def bloom_test_semi(spark, d):
    return bloom.test(_orders(spark, d), "item", _state(spark, d, FILTER, SEGMENT))


def bloom_test_anti(spark, d):
    return bloom.test(_orders(spark, d), "item", _state(spark, d, FILTER, SEGMENT), invert=True)


def bloom_test_joined(spark, d):
    f = bloom.unpack(_state(spark, d, FILTER, SEGMENT))
    slabs = spark.createDataFrame([(0, bytearray(f.bits.tobytes()))], "slab long, bytes binary")
    return bloom.test_bits(_orders(spark, d), "item", slabs, f.size)


def bloom_union(spark, d):
    state = bloom.union([_state(spark, d, UNION, SEGMENT), _state(spark, d, UNION, OTHER)])
    return bloom.test(_orders(spark, d), "item", state).select("o_orderkey")


def bloom_inspect(spark, d):
    return bloom.inspect(spark, bloom.union([_state(spark, d, UNION, SEGMENT), _state(spark, d, UNION, OTHER)]))


def bloom_fpr(spark, d):
    absent = spark.range(10_000).select(F.concat(F.lit("x"), F.col("id")).alias("item"))
    return bloom.test(absent, "item", _state(spark, d, FILTER, SEGMENT)).agg(F.count("*").alias("false_positives"))


def semi_exact(spark, d):
    return _orders(spark, d).join(_segment(spark, d, SEGMENT), "item", "left_semi").select("o_orderkey", "item")


def anti_exact(spark, d):
    return _orders(spark, d).join(_segment(spark, d, SEGMENT), "item", "left_anti").select("o_orderkey", "item")


# profiles


def card_typed_events(spark, d):
    return profile.frame(table(spark, d, "events"), ["user_id", "event_type", "props"])


def card_typed_json(spark, d):
    p = omit_zero(profile.frame(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"]), "nulls", "missing", "empty")
    return p.select(json_object("field", "approx_unique", "nulls", "missing", "empty", "total").alias("json"))


def card_delimited(spark, d):
    n = table(spark, d, "nation")
    line = F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).otherwise(F.concat_ws("|", "n_name", "n_regionkey", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise("x")))
    return profile.delimited_lines(n.select(line.alias("value")), "|", [1, 2, 3])


def card_csv(spark, d):
    path = scratch(spark, "csv")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.concat(F.col("n_name"), F.lit(', "q"'))).alias("name"))
    n.coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return profile.csv(spark, [path], ["id", "name"])


def card_json_props(spark, d):
    return profile.json_lines(table(spark, d, "events"), [".k", ".z"], value="props")


def card_json_values(spark, d):
    o = table(spark, d, "orders")
    which = F.col("o_orderkey") % 5
    value = F.when(which == 0, "null").when(which == 1, '""').when(which == 2, F.concat(F.lit('{"b":'), F.col("o_custkey"), F.lit("}"))).when(which == 3, F.concat(F.col("o_custkey"), F.lit(".0")))
    line = F.when(which == 4, "[1]").otherwise(F.concat(F.lit('{"a":'), value, F.lit("}")))
    return profile.json_lines(o.select(line.alias("value")), [".a", ".a.b"], 12)


# samples


def sample_stable(spark, d):
    return sampling.stable(item(table(spark, d, "orders"), "o_orderkey"), "item", 0.2, 42)


def sample_rate_all(spark, d):
    return sampling.stable(item(table(spark, d, "orders"), "o_orderkey"), "item", 1.0, 42)


def sample_rate_none(spark, d):
    return sampling.stable(item(table(spark, d, "orders"), "o_orderkey"), "item", 0.0, 42)


def sample_bernoulli(spark, d):
    return sampling.by_chance(table(spark, d, "orders"), 0.1, 7).select("o_orderkey")


def sample_reservoir(spark, d):
    return sampling.fixed(table(spark, d, "orders"), 500, 7).select("o_orderkey")


def sample_reservoir_size(spark, d):
    return sampling.fixed(table(spark, d, "orders"), 500, 7).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_n"))


# records


def text_trim_nonempty(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return records.clean(lines, "value", trim=True, ignore_empty=True).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))


def union_all_inputs(spark, d):
    """Two files of records, read as one input."""
    paths = []
    for name, key in (("customer", "c_nationkey"), ("supplier", "s_nationkey")):
        paths.append(scratch(spark, name))
        write_records(table(spark, d, name).select(F.col(key).cast("string").alias("value")), paths[-1])
    return records.read(spark, paths).groupBy(F.decode("value", "UTF-8").alias("nation")).agg(F.count("*").alias("n"))


def _lines(spark, d):
    return table(spark, d, "documents").filter("text is not null").select(F.explode(F.split("text", "\n")).alias("value"))


def _sizes(rows):
    return rows.agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("bytes"))


def scan_lines(spark, d):
    path = scratch(spark, "lines")
    write_records(_lines(spark, d), path)
    return _sizes(records.read(spark, path))


def scan_lines_cleaned(spark, d):
    path = scratch(spark, "lines")
    write_records(_lines(spark, d), path)
    return _sizes(records.read(spark, path, trim=True, ignore_empty=True))


def scan_nul(spark, d):
    path = scratch(spark, "nul")
    table(spark, d, "documents").filter("text is not null").select("text").write.option("lineSep", "\0").text(path)
    return _sizes(records.read(spark, path, nul=True))


def scan_verbatim(spark, d):
    """Records without a line feed behind the last, written and read again."""
    path = scratch(spark, "raw")
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0]
    write_verbatim(o.orderBy("o_orderkey").select(F.col("o_orderpriority").cast("binary").alias("value"), (F.col("o_orderkey") != last).alias("terminated")), path)
    return records.read_raw(spark, path).agg(F.count("*").alias("n"), F.count_if("terminated").alias("ended"), F.sum(F.length("value")).alias("bytes"))


def write_json_array_file(spark, d):
    path = scratch(spark, "json")
    write_json_array(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", path)
    return spark.read.schema("p_partkey long, p_name string").json(path, multiLine=True)


def heavy_json(spark, d):
    return json_array(heavy.exact(table(spark, d, "lineitem"), "l_partkey", 20), "rank")


def heavy_key_values(spark, d):
    rows = heavy.exact(table(spark, d, "orders"), "o_orderpriority", 5).collect()
    return spark.createDataFrame([(key_value_lines(r.asDict()),) for r in rows], "value string")


def hll_state_files(spark, d):
    """Sketches of two halves, written to files, read and merged."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("item"), (F.col("o_orderkey") % 2).alias("half"))
    paths = []
    for r in hll.build(o, "item", 12, ("half",)).collect():
        paths.append(scratch(spark, "state"))
        write_state(bytes(r["state"]), paths[-1])
    return hll.estimates(hll.merge(read_states(spark, paths).select("state")))


def bloom_state_files(spark, d):
    path = scratch(spark, "state")
    write_state(_state(spark, d, FILTER, SEGMENT), path)
    return bloom.test(_orders(spark, d), "item", bytes(read_states(spark, path).first()["state"]))


def bloom_test_stored(spark, d):
    f = bloom.unpack(_state(spark, d, FILTER, SEGMENT))
    return bloom.test_bits(_orders(spark, d), "item", bloom.stored_slabs(spark, f.bits), f.size, invert=True)


# key-value tables


def _kv(spark, d):
    p = table(spark, d, "part").select(F.lit("default").alias("cf"), F.encode(F.concat(F.lit("part/"), F.lpad("p_partkey", 8, "0")), "UTF-8").alias("key"), F.encode("p_name", "UTF-8").alias("value"))
    c = table(spark, d, "customer").select(F.lit("people").alias("cf"), F.encode(F.concat("c_mktsegment", F.lit("/"), "c_custkey"), "UTF-8").alias("key"), F.encode("c_name", "UTF-8").alias("value"))
    return p.unionByName(c)


def _text(rows):
    return rows.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


def _stores(spark, d):
    """The same rows in a stored table, as its two families."""
    path = scratch(spark, "kv")
    found = [kv.Store(spark, path, cf, writable=True) for cf in ("default", "people")]
    for store in found:
        store.load(_kv(spark, d).filter(F.col("cf") == store.cf).select("key", "value"))
    return found


def kv_get(spark, d):
    value = _stores(spark, d)[0].get("part/00000042")
    return spark.createDataFrame([("part/00000042", value.decode())] if value is not None else [], "key string, value string")


def kv_scan_prefix(spark, d):
    return _text(_stores(spark, d)[1].scan("BUILDING/1", None))


def kv_scan_limit(spark, d):
    return _text(_stores(spark, d)[0].scan("part/0000001", 15))


def kv_keys(spark, d):
    return _stores(spark, d)[1].keys().select(F.decode("key", "UTF-8").alias("key"))


def kv_count_prefix(spark, d):
    return spark.createDataFrame([(_stores(spark, d)[1].count("MACHINERY/"),)], "n long")


def kv_put_delete(spark, d):
    store = _stores(spark, d)[0]
    store.put("part/00000001", "changed")
    store.put("new", "row")
    store.delete("part/00000002")
    store.delete("new2")
    store.put("part/00000003", "first")
    store.put("part/00000003", "second")
    return _text(store.scan("", None))


def kv_export_csv(spark, d):
    path = scratch(spark, "csv")
    _stores(spark, d)[1].export(path, "csv")
    return spark.read.option("header", True).option("escape", '"').schema("key string, value string").csv(path)


def kv_export_json(spark, d):
    path = scratch(spark, "json")
    _stores(spark, d)[1].export(path, "json")
    return spark.read.schema("key string, value string").json(path, multiLine=True)


def kv_export(spark, d):
    n = table(spark, d, "nation")
    value = F.when(F.col("n_nationkey") % 3 == 0, F.unhex(F.lit("00FF"))).when(F.col("n_nationkey") % 3 == 1, F.encode(F.concat(F.lit("0x"), "n_name"), "UTF-8")).otherwise(F.encode(F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.col("n_name")), "UTF-8"))
    return kv.export_rows(n.select(F.encode("n_name", "UTF-8").alias("key"), value.alias("value")))


def kv_format(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.encode(F.when(F.col("n_nationkey") % 4 == 0, "").when(F.col("n_nationkey") % 4 == 1, F.concat(F.col("n_name"), F.lit("é"))).otherwise(F.col("n_name")), "UTF-8").alias("v"))
    return n.select("n_nationkey", form.display(F.col("v")).alias("shown"), (form.parse(form.export(F.col("v"))) == F.col("v")).alias("same"))


def kv_families(spark, d):
    return _stores(spark, d)[0].families()


def kv_stats(spark, d):
    return _stores(spark, d)[0].stats()


# log offsets


def _log(spark, d):
    from pyspark.sql import Window

    events = table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("partition"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    place = F.row_number().over(Window.partitionBy("partition").orderBy("ts", "event_id")) - 1
    return events.withColumn("offset", place.cast("long")).select("partition", "offset", "ts")


def _committed(spark):
    return spark.createDataFrame([(0, 7), (1, -1), (3, 1_000_000)], "partition int, at long")


def _plan(spark, d, spec, **more):
    log = _log(spark, d)
    return offsets.plan(offsets.bounds_of(log), spec if isinstance(spec, OffsetSpec) else offset_spec(spec), log=log, **more)


def offsets_numeric(spark, d):
    return _plan(spark, d, "120")


def offsets_earliest(spark, d):
    return _plan(spark, d, "Beginning")


def offsets_latest(spark, d):
    return _plan(spark, d, "END")


def offsets_timestamp(spark, d):
    return _plan(spark, d, INSTANT)


def offsets_timestamp_late(spark, d):
    return _plan(spark, d, LATE)


def offsets_current(spark, d):
    return _plan(spark, d, "earliest", committed=_committed(spark))


def _bounded_plan(spark, d):
    bounds = offsets.bounds_of(_log(spark, d)).withColumns({"low": F.col("low") + 10 * F.col("partition"), "high": F.col("partition") * 7 + 6})
    return offsets.plan(bounds, offset_spec("15"))


def offsets_warnings(spark, d):
    return offsets.with_warnings(_bounded_plan(spark, d))


def offsets_subset(spark, d):
    return _plan(spark, d, "latest", partitions=[1, 3])


def offsets_plan_text(spark, d):
    spec = offset_spec("latest")
    return spark.createDataFrame([(offsets.plan_text(_plan(spark, d, spec, committed=_committed(spark)), "group-a", "topic-a", spec, dry_run=True),)], "text string")


def offsets_warning_lines(spark, d):
    lines = offsets.warning_lines(_bounded_plan(spark, d))
    return spark.createDataFrame([(x,) for x in lines], "value string")


def greeting(spark, d):
    return spark.range(1).select(F.lit("Hello, world!").alias("message"))


QUERIES = (
    heavy_exact_user, heavy_exact_part, heavy_bounded_exact_regime, heavy_bounded_order, heavy_merged, heavy_bounded_native, heavy_tsv, heavy_json, heavy_key_values,
    hash64_vectors, hll_count_user, hll_count_part, hll_registers, hll_by_group, hll_merge_days, hll_merge_registers, hll_inspect, hll_precision_sweep, hll_native_user, hll_state_files,
    bloom_sizing, bloom_bits, bloom_test_semi, bloom_test_anti, bloom_test_joined, bloom_union, bloom_inspect, bloom_fpr, bloom_state_files, bloom_test_stored, semi_exact, anti_exact,
    card_typed_events, card_typed_json, card_delimited, card_csv, card_json_props, card_json_values,
    sample_stable, sample_rate_all, sample_rate_none, sample_bernoulli, sample_reservoir, sample_reservoir_size,
    text_trim_nonempty, union_all_inputs, scan_lines, scan_lines_cleaned, scan_nul, scan_verbatim, write_json_array_file,
    kv_get, kv_scan_prefix, kv_scan_limit, kv_keys, kv_count_prefix, kv_put_delete, kv_export, kv_export_csv, kv_export_json, kv_format, kv_families, kv_stats,
    offsets_numeric, offsets_earliest, offsets_latest, offsets_timestamp, offsets_timestamp_late, offsets_current, offsets_warnings, offsets_subset, offsets_plan_text, offsets_warning_lines,
    greeting,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
