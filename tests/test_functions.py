import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybrook.functions import bytes as form
from tallybrook.functions import parsing
from tallybrook.functions.hashing import SECOND_SEED, hash64, hash_of, hash_ragged, hex_of, unsigned_less

GOLDEN = {
    b"": ("efd01f60ba992926", "6bcb9d63eb8eab8b"),
    b"a": ("82a2a958a9bece5b", "4e7e6b73b43d4b33"),
    b"alice": ("3507d047a67c08f4", "593a50315553af36"),
    b"\xff\x00": ("6697e69689e5177a", "37b43963654528c5"),
    b"hello world": ("7c6d8c019b6ee5d5", "bd111edde57d5c17"),
}


def test_hash_golden_vectors(spark):
    for data, (plain, seeded) in GOLDEN.items():
        assert f"{hash64(data):016x}" == plain and f"{hash64(data, SECOND_SEED):016x}" == seeded
    df = spark.createDataFrame([(bytearray(k),) for k in GOLDEN] + [(None,)], "v binary")
    rows = df.select("v", hex_of(hash_of(F.col("v"))).alias("h"), hex_of(hash_of(F.col("v"), SECOND_SEED)).alias("s")).collect()
    assert {bytes(r.v): (r.h, r.s) for r in rows if r.v is not None} == GOLDEN
    assert [r.h for r in rows if r.v is None] == [None]


@given(st.lists(st.binary(max_size=40), max_size=30), st.integers(0, 2**64 - 1))
def test_vectorised_hash_equals_plain(items, seed):
    sizes = np.array([len(x) for x in items], np.int64)
    got = hash_ragged(np.frombuffer(b"".join(items), np.uint8), np.cumsum(sizes) - sizes, sizes, seed)
    assert got.tolist() == [hash64(x, seed) for x in items]


def test_long_items_hash_alike():
    items = [b"x" * 511, b"y" * 600, b"", b"z" * 512]
    sizes = np.array([len(x) for x in items], np.int64)
    assert hash_ragged(np.frombuffer(b"".join(items), np.uint8), np.cumsum(sizes) - sizes, sizes).tolist() == [hash64(x) for x in items]


def test_unsigned_less(spark):
    values = [0, 1, 2**63 - 1, -(2**63), -1]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    for bound in (0, 1, 2**63, 2**64 - 1):
        got = [r[0] for r in df.select(unsigned_less(F.col("h"), bound)).collect()]
        assert got == [(v % 2**64) < bound for v in values]


def test_byte_forms(spark):
    cases = {b"": ("(empty)", "0x"), b"abc": ("abc", "abc"), b"\x00": ("0x00", "0x00"), b"0xAB": ("0xAB", "0x30784142"), b"a\tb": ("a\tb", "a\tb"), b"\x7f": ("0x7f", "0x7f")}
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "v binary")
    rows = df.select("v", form.display(F.col("v")).alias("d"), form.export(F.col("v")).alias("e"), form.parse(form.export(F.col("v"))).alias("p")).collect()
    assert {bytes(r.v): (r.d, r.e) for r in rows} == cases and all(bytes(r.v) == bytes(r.p) for r in rows)
    with pytest.raises(Exception, match="invalid hex"):
        spark.createDataFrame([("0xA",)], "t string").select(form.parse(F.col("t"))).collect()
    assert form.parse_literal("0X0aFF") == b"\n\xff" and form.parse_literal("é") == "é".encode()
    for bad in ("0xA", "0x0g", "0x 01"):
        with pytest.raises(ValueError):
            form.parse_literal(bad)


def test_command_words():
    assert parsing.split_command('put "a b" c\\ d ""') == ["put", "a b", "c d", ""]
    assert parsing.split_command("  ") == [] and parsing.split_command("it's") == ["it's"]
    for bad in ('a "b', "a\\"):
        with pytest.raises(ValueError):
            parsing.split_command(bad)


def test_offset_specs():
    spec = parsing.offset_spec
    assert spec("12") == parsing.OffsetSpec("numeric", 12) and spec("BEGINNING").mode == "earliest" and spec("End").mode == "latest"
    assert spec("timestamp:1970-01-02").value == 86_400_000 and spec("timestamp:1970-01-01T00:00:01.2349Z").value == 1234
    assert spec("timestamp:1970-01-01 00:00:02").value == 2000 and spec("timestamp:1970-01-01T01:00:00+01:00").value == 0
    for bad in ("-1", "x", "TIMESTAMP:1970-01-01", "timestamp:yesterday", "timestamp:1970-13-01", ""):
        with pytest.raises(ValueError):
            spec(bad)
    assert spec("timestamp:1970-01-02").describe() == "timestamp:1970-01-02T00:00:00Z"
    assert [spec(x).describe() for x in ("7", "beginning", "END")] == ["7 (numeric)", "earliest (beginning of partition)", "latest (end of partition / high watermark)"]


def test_lists_and_options():
    assert parsing.partition_list(" 3,1,,3") == [1, 3] and parsing.partition_list(" , ") is None
    for bad in ("a", "-1", "1.5"):
        with pytest.raises(ValueError):
            parsing.partition_list(bad)
    assert parsing.prefix_limit(["5"]) == ("", 5) and parsing.prefix_limit(["ab", "7"]) == ("ab", 7) and parsing.prefix_limit([]) == ("", 100)
    with pytest.raises(ValueError):
        parsing.prefix_limit(["a", "0"])
    opts = parsing.kafka_options("# x\nbootstrap.servers = h:1\nsecurity.protocol=SASL_SSL\nsasl.username=u\nsasl.password=p\n")
    assert opts["kafka.bootstrap.servers"] == "h:1" and 'username="u"' in opts["kafka.sasl.jaas.config"]
    for bad in ("", "bootstrap.servers", "bootstrap.servers=h\nsecurity.protocol=x", "bootstrap.servers=h\nsecurity.protocol=SASL_SSL"):
        with pytest.raises(ValueError):
            parsing.kafka_options(bad)
