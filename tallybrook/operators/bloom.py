"""Membership filters: approximate semi-joins and anti-joins.

Each task sets its items' bits in slabs of the filter, which are combined. A filter's size is fixed by its sizing
(512 MiB at most), not by what is tested: filters of up to ``BROADCAST`` bytes are sent to the tasks, larger ones are
written to the shared folder and joined by position.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HASH_NAME, SECOND_SEED, bit_positions, hash_of, positions
from ..sources.paths import scratch

# The state's layout and limits.
MAGIC, VERSION = b"BLM1", 1
MOST_BYTES, MOST_HASHES = 512 << 20, 64
BROADCAST = 32 << 20
#: Bytes of a filter's row of bits while it is built.
SLAB = 1 << 16
#: Slabs that a task holds at once.
HELD = 256


@dataclass(frozen=True)
class Sizing:
    expected: int
    rate: float
    bits: int
    hashes: int

    @property
    def bytes(self) -> int:
        return -(-self.bits // 8)


def sizing(expected: int, rate: float) -> Sizing:
    if expected <= 0:
        raise ValueError(f"a filter for {expected} items: at least one is needed")
    if not (math.isfinite(rate) and 0 < rate < 1):
        raise ValueError(f"a rate of false positives lies between 0 and 1, not at {rate}")
    need = math.ceil(-expected * math.log(rate) / math.log(2) ** 2)
    if need > MOST_BYTES * 8:
        raise ValueError("the filter would need more than the 512 MiB limit")
    hashes = max(1, math.floor(need / expected * math.log(2) + 0.5))
    if hashes > MOST_HASHES:
        raise ValueError(f"that rate takes {hashes} hashes an item, more than {MOST_HASHES}")
    return Sizing(expected, rate, need, hashes)


def bits(df: DataFrame, item: str, size: Sizing, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., bit: the set positions. Null items are not inserted."""
    some = df.filter(F.col(item).isNotNull())
    return some.select(*by, F.explode(positions(F.col(item), size.bits, size.hashes)).alias("bit")).distinct()


def _pack_header(size: Sizing, inserted: int) -> bytes:
    name = HASH_NAME.encode()
    return MAGIC + struct.pack(">BQQdQIB", VERSION, size.expected, inserted, size.rate, size.bits, size.hashes, len(name)) + name + struct.pack(">Q", size.bytes)


def slabs(df: DataFrame, item: str, size: Sizing) -> DataFrame:
    """slab, bytes: the filter's set parts, one scan of ``df``; of slab -1 the bytes are the number of items."""
    bits_of = 8 * SLAB

    def fill(batches):
        import pyarrow as pa

        held, inserted = {}, 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slab", "bytes"])

        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
            inserted += len(h1)
            at = np.unique(bit_positions(h1, h2, size.bits, size.hashes))
            slab = at // bits_of
            for part in np.split(at, np.flatnonzero(np.diff(slab)) + 1) if len(at) else []:
                no, place = int(part[0]) // bits_of, part % bits_of
                if no not in held and len(held) >= HELD:
                    yield out()
                    held = {}
                np.bitwise_or.at(held.setdefault(no, np.zeros(SLAB, np.uint8)), place >> 3, (1 << (place & 7)).astype(np.uint8))
        held[-1] = np.array([inserted], "<u8")
        yield out()

    def join(table):
        import pyarrow as pa

        no, rows = table.column("slab")[0].as_py(), table.column("bytes").to_pylist()
        one = np.sum([np.frombuffer(r, "<u8") for r in rows], axis=0, dtype="<u8") if no == -1 else np.bitwise_or.reduce([np.frombuffer(r, np.uint8) for r in rows])
        return pa.table({"slab": pa.array([no], pa.int64()), "bytes": pa.array([one.tobytes()], pa.binary())})

    hashed = df.filter(F.col(item).isNotNull()).select(hash_of(F.col(item)).alias("h1"), hash_of(F.col(item), SECOND_SEED).alias("h2"))
    # in two steps, so that no task holds a slab of every other one
    some = hashed.mapInArrow(fill, "slab long, bytes binary").withColumn("lane", F.spark_partition_id() % 32)
    first = some.groupBy("lane", "slab").applyInArrow(join, "slab long, bytes binary")
    return first.groupBy("slab").applyInArrow(join, "slab long, bytes binary")


def build(df: DataFrame, item: str, expected: int, rate: float) -> bytes:
    """The filter's state file. The driver holds the state and a slab."""
    size = sizing(expected, rate)
    out, inserted = np.zeros(size.bytes, np.uint8), 0
    for r in slabs(df, item, size).toLocalIterator():
        if r["slab"] < 0:
            inserted = int.from_bytes(r["bytes"], "little")
        else:
            part = np.frombuffer(r["bytes"], np.uint8)[: size.bytes - r["slab"] * SLAB]
            out[r["slab"] * SLAB : r["slab"] * SLAB + len(part)] = part
    return _pack_header(size, inserted) + out.tobytes()


@dataclass
class Filter:
    size: Sizing
    inserted: int
    bits: np.ndarray


def unpack(state: bytes) -> Filter:
    """ValueError if the state is not a sound one. Bytes behind it are ignored; other sizings within bounds are fine."""
    if state[:4] != MAGIC:
        raise ValueError("not a filter: bad magic")
    try:
        version, expected, inserted, rate, n, hashes, named = struct.unpack(">BQQdQIB", state[4:42])
        name = state[42 : 42 + named]
        (size,) = struct.unpack(">Q", state[42 + named : 50 + named])
    except struct.error:
        raise ValueError("filter is cut short") from None
    if version != VERSION:
        raise ValueError("unsupported filter version")
    if name != HASH_NAME.encode():
        raise ValueError("unsupported hash")
    if expected == 0 or not 0 < rate < 1:
        raise ValueError("bad expected items or rate")
    if not 1 <= n <= MOST_BYTES * 8 or not 1 <= hashes <= MOST_HASHES or size != -(-n // 8):
        raise ValueError("bad filter size")
    data = np.frombuffer(state[50 + named : 50 + named + size], np.uint8)
    if len(data) != size:
        raise ValueError("filter is cut short")
    return Filter(Sizing(expected, rate, n, hashes), inserted, data)


def test(df: DataFrame, item: str, state: bytes, invert: bool = False) -> DataFrame:
    """Rows whose item may be in the filter, or with ``invert`` those that surely are not. Null items are in none."""
    f = unpack(state)
    if len(f.bits) > BROADCAST:
        return test_bits(df, item, stored_slabs(df.sparkSession, f.bits), f.size, invert)
    held = df.sparkSession.sparkContext.broadcast(f.bits)
    n, k = f.size.bits, f.size.hashes

    @F.arrow_udf("boolean")
    def probe(h1, h2):
        import pyarrow as pa

        a, b = (x.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for x in (h1, h2))
        b = np.where(b == 0, np.uint64(1), b)
        live = np.arange(len(a))
        for i in range(k):  # items leave at their first bit that is not set
            at = ((a[live] + np.uint64(i) * b[live]) % np.uint64(n)).astype(np.int64)
            live = live[(held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(a), bool)
        out[live] = True
        return pa.array(out & h1.is_valid().to_numpy(zero_copy_only=False))

    found = probe(hash_of(F.col(item)), hash_of(F.col(item), SECOND_SEED))
    return df.filter(~found if invert else found)


def stored_slabs(spark, bits: np.ndarray) -> DataFrame:
    """slab, bytes: a filter's bits, written to the shared folder slab by slab and read by the executors."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    path = scratch(spark, "bits")
    files, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    files.create_dir(name, recursive=True)
    kind = pa.schema([("slab", pa.int64()), ("bytes", pa.binary())])
    with pq.ParquetWriter(f"{name}/slabs.parquet", kind, filesystem=files) as out:
        n = -(-len(bits) // SLAB)
        for first in range(0, n, 64):
            some = range(first, min(n, first + 64))
            out.write_table(pa.table({"slab": pa.array(some, pa.int64()), "bytes": pa.array([bits[i * SLAB : (i + 1) * SLAB].tobytes() for i in some], pa.binary())}, kind))
    return spark.read.parquet(path)


def test_bits(df: DataFrame, item: str, slabs: DataFrame, size: Sizing, invert: bool = False) -> DataFrame:
    """The same for a filter too large to send to every task: the different items' positions meet ``slabs`` (slab,
    bytes) in a join, and rows meet the items that are in none."""
    value = F.col(item).cast("binary")
    asked = df.filter(F.col(item).isNotNull()).select(value.alias("_item")).distinct()
    at = asked.select("_item", F.explode(positions(F.col("_item"), size.bits, size.hashes)).alias("bit")).withColumn("slab", F.floor(F.col("bit") / (8 * SLAB)))
    byte = f"cast(conv(hex(substring(bytes, cast(floor(bit / 8) % {SLAB} as int) + 1, 1)), 16, 10) as int)"
    missed = at.join(slabs, "slab", "left").filter(F.col("bytes").isNull() | (F.expr(f"shiftright({byte}, cast(bit % 8 as int)) & 1") == 0))
    gone = missed.select("_item").distinct()
    there = df.filter(F.col(item).isNotNull())
    kept = there.join(gone, there[item].cast("binary") == gone["_item"], "left_semi" if invert else "left_anti")
    return kept.unionByName(df.filter(F.col(item).isNull())) if invert else kept


def union(states: list[bytes]) -> bytes:
    """All that any filter holds. Sizes, hashes and rates must be equal; expected items need not be."""
    if len(states) < 2:
        raise ValueError("union needs at least two filters")
    found = [unpack(s) for s in states]
    first = found[0]
    for f in found[1:]:
        if (f.size.bits, f.size.hashes, f.size.rate) != (first.size.bits, first.size.hashes, first.size.rate):
            raise ValueError("filters are incompatible")
    joined = np.bitwise_or.reduce([f.bits for f in found])
    return _pack_header(first.size, sum(f.inserted for f in found)) + joined.tobytes()


def inspect(spark, state: bytes) -> DataFrame:
    """One row of metadata (fixed names and type)."""
    f = unpack(state)
    row = ("bloom-filter", VERSION, f.size.expected, f.inserted, f.size.rate, f.size.bits, f.size.hashes, HASH_NAME)
    return spark.createDataFrame([row], "type string, version int, expected_items long, inserted_items long, false_positive_rate double, bit_count long, hash_count int, hash string")
