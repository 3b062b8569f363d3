import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybrook.functions.parsing import offset_spec
from tallybrook.operators import bloom, heavy, hll, kv, offsets, profile, sampling
from tallybrook.sources import records, sinks


def items(spark, values):
    return spark.createDataFrame([(v,) for v in values], "item string")


# sketches


@pytest.mark.parametrize("p,n,expected", [(14, 1000, 1003), (14, 1500, 1501)])
def test_hll_estimates(spark, p, n, expected):
    row = hll.count(items(spark, [str(i) for i in range(1, n + 1)] * 2), "item", p).first()
    assert row.approx_unique == expected and row.relative_error == 1.04 / 2 ** (p / 2)


@pytest.mark.parametrize("p,n", [(4, 10_000), (14, 100), (14, 10_000), (20, 20_000)])
def test_hll_tolerance(spark, p, n):
    got = hll.count(spark.range(n).select(F.col("id").cast("string").alias("item")), "item", p).first().approx_unique
    assert abs(got - n) <= max(3, 5 * hll.relative_error(p) * n)


def test_hll_merge_and_states(spark):
    df = items(spark, [f"a-{i}" for i in range(1000)] + [f"b-{i}" for i in range(1000)]).withColumn("half", F.substring("item", 1, 1))
    states = hll.build(df, "item", 10, ("half",))
    merged = hll.merge(states)
    whole = hll.build(df, "item", 10).first().state
    assert bytes(merged.first().state) == bytes(whole)
    seen = hll.inspect(merged).first()
    assert 1500 <= seen.approx_unique <= 2600 and seen.precision == 10 and seen.registers == 1024
    assert hll.count(df, "item", 10).first().approx_unique == seen.approx_unique
    by = hll.merge(hll.build(df, "item", 10, ("half",)), ("half",))
    assert by.count() == 2
    with pytest.raises(ValueError, match="different precision"):
        hll.merge(states.select("state").unionByName(hll.build(df, "item", 9)))


def test_hll_empty_and_null(spark):
    df = items(spark, [None])
    assert hll.inspect(hll.build(df, "item", 8)).first().approx_unique == 0
    assert hll.build(df.limit(0), "item", 8).count() == 1


def test_hll_rejects_unsound_states():
    good = hll.pack(4, bytes(16))
    assert hll.unpack(good + b"more")[0] == 4
    assert len(hll.pack(4, b"")) == 31
    bad = [b"XXX1" + good[4:], good[:4] + b"\x02" + good[5:], good[:5] + b"\x05" + good[6:], good[:-1], good[:-1] + bytes([62]), good[:10] + b"?" + good[11:], good[:20]]
    for state in bad:
        with pytest.raises(ValueError):
            hll.unpack(state)
    for p in (3, 21):
        with pytest.raises(ValueError, match="precision must be between"):
            hll.check_precision(p)


# filters


def test_bloom_sizing():
    got = {(n, p): (s.bits, s.hashes) for n, p in ((1_000_000, 0.001), (10, 0.01), (100, 0.01), (10_000, 0.01)) for s in [bloom.sizing(n, p)]}
    assert got == {(1_000_000, 0.001): (14377588, 10), (10, 0.01): (96, 7), (100, 0.01): (959, 7), (10_000, 0.01): (95851, 7)}
    for n, p in ((0, 0.1), (10, 0), (10, 1), (10, float("nan")), (10, float("inf")), (10**12, 0.01), (1, 1e-300)):
        with pytest.raises(ValueError):
            bloom.sizing(n, p)


def test_bloom_members(spark):
    present = spark.range(10_000).select(F.concat(F.lit("in-"), "id").alias("item"))
    absent = spark.range(10_000).select(F.concat(F.lit("out-"), "id").alias("item"))
    state = bloom.build(present, "item", 10_000, 0.01)
    assert bloom.test(present, "item", state).count() == 10_000
    false = bloom.test(absent, "item", state).count()
    assert false <= 200 and bloom.test(absent, "item", state, invert=True).count() == 10_000 - false
    assert bloom.unpack(state).inserted == 10_000


def test_bloom_joined_equals_broadcast(spark):
    df = items(spark, ["alice", "bob", "carol", None])
    state = bloom.build(df, "item", 10, 0.01)
    f = bloom.unpack(state)
    slabs = spark.createDataFrame([(0, bytearray(f.bits.tobytes()))], "slab long, bytes binary")
    asked = items(spark, ["alice", "dave", "bob", None, "alice"])
    for invert in (False, True):
        a = sorted(map(str, bloom.test(asked, "item", state, invert).collect()))
        b = sorted(map(str, bloom.test_bits(asked, "item", slabs, f.size, invert).collect()))
        assert a == b


def test_bloom_slabs(spark, monkeypatch):
    """A filter of many slabs, with fewer held by a task than there are, and rows in many tasks."""
    monkeypatch.setattr(bloom, "SLAB", 64)
    monkeypatch.setattr(bloom, "HELD", 2)
    df = items(spark, [f"i{i % 700}" for i in range(1000)] + [None]).repartition(5)
    f = bloom.unpack(bloom.build(df, "item", 1000, 0.01))
    expected = np.zeros(f.size.bits, bool)
    expected[[r.bit for r in bloom.bits(df, "item", f.size).collect()]] = True
    assert f.inserted == 1000 and np.array_equal(np.unpackbits(f.bits, bitorder="little")[: f.size.bits].astype(bool), expected)
    assert bloom.unpack(bloom.build(df.limit(0), "item", 10, 0.01)).inserted == 0


def test_bloom_union_and_states(spark):
    one, two = (bloom.build(items(spark, [x, x]), "item", 100, 0.01) for x in ("alpha", "beta"))
    both = bloom.union([one, two])
    assert bloom.test(items(spark, ["alpha", "beta"]), "item", both).count() == 2
    assert bloom.inspect(spark, both).first().inserted_items == 4
    with pytest.raises(ValueError, match="incompatible"):
        bloom.union([one, bloom.build(items(spark, ["x"]), "item", 200, 0.01)])
    with pytest.raises(ValueError):
        bloom.union([one])
    tiny = bloom._pack_header(bloom.Sizing(5, 0.5, 8, 1), 0) + b"\x00"
    assert bloom.unpack(tiny + b"rest").size.bits == 8
    for bad in (b"NOPE" + one[4:], one[:4] + b"\x09" + one[5:], one[:-1], one[:30], one[:37] + b"\x00\x00\x00\xff" + one[41:]):
        with pytest.raises(ValueError):
            bloom.unpack(bad)


# frequent values


def test_heavy_exact(spark):
    rows = heavy.exact(items(spark, list("bbbaac") + [None]), "item", 2).collect()
    assert [tuple(r) for r in rows] == [(1, "b", 3), (2, "a", 2)]


def test_space_saving():
    assert heavy.space_saving(list("xxxxxxxxab"), 2) == {"x": 8, "b": 2}
    assert heavy.space_saving(list("abxxxxxxxx"), 2)["x"] == 9
    stream = [str(i) for i in range(10_000)] + ["heavy"] * 1000
    counts = heavy.space_saving(stream, 100)
    assert max(counts, key=counts.get) == "heavy" and sum(counts.values()) == len(stream)


def test_heavy_bounded_and_merged(spark):
    df = items(spark, list("xxxxxxxxab"))
    assert [tuple(r) for r in heavy.bounded(df.coalesce(1), "item", 1, 2).collect()] == [(1, "x", 8)]
    assert [tuple(r) for r in heavy.merged(df, "item", 3).collect()] == [(1, "x", 8), (2, "a", 1), (3, "b", 1)]
    assert heavy.bounded(df.limit(0), "item").count() == 0
    for k, c in ((0, None), (10, 5)):
        with pytest.raises(ValueError):
            heavy.check(k, c)


# samples


def test_samples(spark):
    df = spark.range(1, 101).select(F.col("id").cast("string").alias("item"))
    assert sampling.stable(df, "item", 0.0).count() == 0 and sampling.stable(df, "item", 1.0).count() == 100
    a = {r.item for r in sampling.stable(df, "item", 0.3, 5).collect()}
    assert a == {r.item for r in sampling.stable(df.repartition(3), "item", 0.3, 5).collect()} and 10 < len(a) < 60
    assert sampling.fixed(df, 10, 3).count() == 10 and sampling.fixed(df, 200, 3).count() == 100 and sampling.fixed(df, 0, 3).count() == 0
    assert sampling.by_chance(df, 0.0).count() == 0 and sampling.by_chance(df, 1.0).count() == 100
    for kw in ({}, {"rate": 0.1, "n": 3}, {"rate": 1.5}, {"n": 3, "stable": True}, {"n": -1}):
        with pytest.raises(ValueError):
            sampling.check(**kw)


# profiles


def profiles(df):
    return {r.field: (r.approx_unique, r.nulls, r.missing, r.empty, r.total) for r in df.collect()}


def test_profile_csv(spark, tmp_path):
    one, two = tmp_path / "a.csv", tmp_path / "b.csv"
    one.write_text('user_id,country\n1,NL\n2,\n2,"B ""x"""\n')
    two.write_text("country,user_id\nNL,3\n")
    assert profiles(profile.csv(spark, [str(one), str(two)], ["user_id", "country"])) == {"user_id": (3, 0, 0, 0, 4), "country": (2, 0, 0, 1, 4)}
    with pytest.raises(ValueError, match="no column"):
        profile.csv(spark, [str(one)], ["nope"])
    short = tmp_path / "c.csv"
    short.write_text("a,b\n1\n")
    with pytest.raises(Exception):  # noqa: B017
        profile.csv(spark, [str(short)], ["a", "b"]).collect()


def test_profile_delimited(spark, tmp_path):
    f = tmp_path / "t.tsv"
    f.write_text("a\tb\tc\r\na\t\tc\nx\ty\tz\nlone\n")
    assert profiles(profile.delimited(spark, str(f), "\t", [1, 2, 3])) == {"1": (3, 0, 0, 0, 4), "2": (2, 0, 1, 1, 4), "3": (2, 0, 1, 0, 4)}
    for bad in ([0], [-1]):
        with pytest.raises(ValueError):
            profile.delimited_lines(spark.createDataFrame([("a",)], "value string"), ",", bad)


def test_profile_json(spark):
    lines = ['{"id":9007199254740992}', '{"id":9007199254740993}', '{"id":1}', '{"id":1.0}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert profiles(profile.json_lines(df, [".id"])) == {".id": (4, 0, 0, 0, 4)}
    more = ['{"u":null,"m":{"c":"NL"}}', '{"u":7,"m":{}}', '{"u":"7","m":{"c":null}}', '{"u":"","m":3}', "[1]"]
    df = spark.createDataFrame([(x,) for x in more], "value string")
    assert profiles(profile.json_lines(df, ["u", ".m.c"])) == {"u": (1, 1, 1, 1, 5), ".m.c": (1, 1, 3, 0, 5)}
    for bad in ('{"a":', "", '{"a":1} x', '{"a":NaN}'):
        with pytest.raises(Exception, match="invalid JSON"):
            profile.json_lines(spark.createDataFrame([(bad,)], "value string"), ["a"]).collect()
    with pytest.raises(ValueError):
        profile.path_parts(".")


def test_json_encoding():
    v = json.loads('{"b":[1.0,"<\\u2028"],"a":{"z":1e0,"y":null}}', parse_int=profile._Number, parse_float=profile._Number)
    assert profile.encode_json(v) == '{"a":{"y":null,"z":1e0},"b":[1.0,"\\u003c\\u2028"]}'
    assert profile.json_cells('{"a":1,"a":2}', [["a"]]) == [("present", b"2")]


def test_profile_frame_nulls_and_long(spark):
    df = spark.createDataFrame([("x" * (1 << 20), None), ("", 1), (None, 1)], "a string, b int")
    assert profiles(profile.frame(df, ["a", "b"])) == {"a": (1, 1, 0, 1, 3), "b": (1, 1, 0, 0, 3)}
    assert profiles(profile.frame(df.limit(0), ["a"])) == {"a": (0, 0, 0, 0, 0)}


# records and sinks


def test_records(spark, tmp_path):
    f = tmp_path / "r.txt"
    f.write_bytes(b"  a \n\nb\r\nlast\xff")
    got = [bytes(r.value) for r in records.read(spark, str(f)).collect()]
    assert got == [b"  a ", b"", b"b\r", b"last\xff"]
    assert [bytes(r.value) for r in records.read(spark, str(f), trim=True, ignore_empty=True).limit(2).collect()] == [b"a", b"b"]
    z = tmp_path / "z.txt"
    z.write_bytes(b"aa\0bb\0aa")
    assert [bytes(r.value) for r in records.read(spark, str(z), nul=True).collect()] == [b"aa", b"bb", b"aa"]
    assert [(bytes(r.value), r.terminated) for r in records.read_raw(spark, str(f)).collect()] == [(b"  a ", True), (b"", True), (b"b\r", True), (b"last\xff", False)]
    assert records.union_all(records.read(spark, str(f)), records.read(spark, str(z))).count() == 5


def test_json_array_loses_no_rows(spark, tmp_path):
    df = spark.range(10_001).repartition(3)
    with pytest.raises(Exception, match="more than 10000 rows"):
        sinks.json_array(df, "id").collect()
    sinks.write_json_array(df, "id", str(tmp_path / "all.json"))
    assert [r["id"] for r in json.loads((tmp_path / "all.json").read_text())] == list(range(10_001))
    sinks.write_json_array(df.limit(0), "id", str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b"), (2, "c\td")], "rank int, item string")
    assert sinks.json_array(df, "rank").first().json == '[{"rank":1,"item":"a\\u003cb"},{"rank":2,"item":"c\\td"}]'
    assert sinks.json_array(df.limit(0), "rank").first().json == "[]"
    assert [r.value for r in sinks.tsv_lines(df).collect()] == ["1\ta<b", "2\tc\td"]
    assert sinks.text_table([{"a": 1, "bb": "x"}], ["a", "bb"]) == "a  bb\n1  x\n"
    assert sinks.key_value_lines({"a": 1}) == "a=1\n"
    sinks.write_records(df.select(F.col("item").alias("value")), str(tmp_path / "o"))
    with pytest.raises(Exception, match="exist"):
        sinks.write_records(df.select(F.col("item").alias("value")), str(tmp_path / "o"))
    sinks.write_state(b"HLL1...", str(tmp_path / "s"))
    assert bytes(sinks.read_states(spark, str(tmp_path / "s")).first().state) == b"HLL1..."


def test_verbatim_records(spark, tmp_path):
    for raw in (b"  a \n\nb\r\nlast", b"x\n", b"", b"\n"):
        (tmp_path / "in").write_bytes(raw)
        sinks.write_verbatim(records.read_raw(spark, str(tmp_path / "in")), str(tmp_path / "out"))
        assert (tmp_path / "out").read_bytes() == raw


# key-value tables


def test_kv_store(spark, tmp_path):
    store = kv.Store(spark, str(tmp_path / "kv"), writable=True)
    store.load(spark.createDataFrame([(bytearray(b"alpha"), bytearray(b"one")), (bytearray(b"beta"), bytearray(b"two"))], "key binary, value binary"))
    assert store.get("alpha") == b"one" and store.get("gamma") is None
    store.put("0x01", "0x00")
    store.put("a b", "c", "d")
    store.put("alpha", "uno")
    store.delete("beta")
    assert [(bytes(r.key), bytes(r.value)) for r in store.scan().collect()] == [(b"\x01", b"\x00"), (b"a b", b"c d"), (b"alpha", b"uno")]
    assert store.count("a") == 2 and [bytes(r.key) for r in store.keys("al").collect()] == [b"alpha"]
    rows, n = store.export()
    assert n == 3 and [tuple(r) for r in rows.collect()] == [("0x01", "0x00"), ("a b", "c d"), ("alpha", "uno")]
    store.export(str(tmp_path / "x.json"), "json")
    assert json.loads((tmp_path / "x.json").read_text())[0] == {"key": "0x01", "value": "0x00"}
    with pytest.raises(ValueError):
        store.export(str(tmp_path / "x.json"), "json")
    store.export(str(tmp_path / "x.json"), "json", force=True)
    small = store.compact(str(tmp_path / "kv2"))
    assert small.changes().count() == 3 and small.get("alpha") == b"uno"
    people = kv.Store(spark, str(tmp_path / "kv"), cf="people", writable=True)
    people.put("z", "1")
    assert {(r.cf, r.selected) for r in people.families().collect()} == {("default", False), ("people", True)}
    assert {r.cf: r["keys"] for r in people.stats().collect()} == {"default": 3, "people": 1}
    with pytest.raises(ValueError, match="reading only"):
        kv.Store(spark, str(tmp_path / "kv")).put("a", "b")


def test_kv_prefix_is_pushed_down(spark, tmp_path):
    assert kv.after_prefix(b"a\xff") == b"b" and kv.after_prefix(b"\xff") is None
    df = spark.createDataFrame([(bytearray(k),) for k in (b"a", b"a\xff\x01", b"b", b"\xff\xff")], "key binary")
    got = lambda p: [bytes(r.key) for r in df.filter(kv.has_prefix(F.col("key"), p)).collect()]
    assert got(b"a") == [b"a", b"a\xff\x01"] and got(b"\xff") == [b"\xff\xff"] and len(got(b"")) == 4
    df.write.parquet(str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).filter(kv.has_prefix(F.col("key"), b"a"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    rows, more = kv.scan_flagged(df, b"", 3)
    assert len(rows) == 3 and more and kv.scan_flagged(df, b"", 4)[1] is False


# log offsets


def test_offsets(spark):
    bounds = spark.createDataFrame([(0, 5, 20), (1, 10, 30)], "partition int, low long, high long")
    log = spark.sql("select * from values (0, 12L, timestamp'2024-01-02 00:00:00.0005'), (1, 11L, timestamp'2024-01-01') t(partition, offset, ts)")
    got = lambda spec, **kw: [tuple(r) for r in offsets.plan(bounds, offset_spec(spec), **kw).orderBy("partition").collect()]
    assert got("7") == [(0, "-", 7, 5, 20), (1, "-", 7, 10, 30)]
    assert [r[2] for r in got("earliest")] == [5, 10] and [r[2] for r in got("latest", partitions=[1])] == [30]
    assert [r[2] for r in got("timestamp:2024-01-02", log=log)] == [12, 30]
    committed = spark.createDataFrame([(0, 9), (1, -1)], "partition int, at long")
    assert [r[1] for r in got("7", committed=committed)] == ["9", "-"] and [r[1] for r in got("7", fetched=False)] == ["?", "?"]
    warned = offsets.with_warnings(offsets.plan(bounds, offset_spec("25"))).orderBy("partition").collect()
    assert [r.warning for r in warned] == ["above high watermark", None]
    assert offsets.starting_offsets(offsets.plan(bounds, offset_spec("7")), "t") == '{"t":{"0":7,"1":7}}'
    with pytest.raises(ValueError, match="out of range"):
        offsets.plan(bounds, offset_spec("7"), partitions=[2])
    ends = spark.createDataFrame([(0, 20)], "partition int, offset long")
    starts = spark.createDataFrame([(0, 5), (1, 10)], "partition int, offset long")
    with pytest.raises(Exception, match="end offset is missing of partition 1"):
        offsets.pair_bounds(starts, ends).collect()


def test_estimate_matches_frame():
    regs = np.zeros(16, np.uint8)
    assert hll.estimate(regs) == 0
