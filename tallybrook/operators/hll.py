"""Approximate distinct counts with mergeable registers.

While aggregating, a sketch is rows (idx, rank), so that building, merging and counting are plain group-bys with
map-side combining: at most 2^p rows leave a task for each group. State files hold the registers densely.
"""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HASH_NAME, hash_of

# The state's layout and limits.
MAGIC, VERSION = b"HLL1", 1
LEAST_P, MOST_P = 4, 20
DEFAULT_P = 14
ALPHAS = {16: 0.673, 32: 0.697, 64: 0.709}


def check_precision(p: int) -> None:
    if not LEAST_P <= p <= MOST_P:
        raise ValueError(f"precision must be between {LEAST_P} and {MOST_P}, got {p}")


def relative_error(p: int) -> float:
    return 1.04 / math.sqrt(1 << p)


def index_of(h: Column, p: int) -> Column:
    return F.shiftrightunsigned(h, 64 - p).cast("int")


def rank_of(h: Column, p: int) -> Column:
    """Leading zeros behind the index, plus one."""
    rest = F.shiftleft(h, p)
    return F.when(rest == 0, F.lit(65 - p)).otherwise(F.lit(65) - F.length(F.bin(rest)))


def registers(df: DataFrame, item: str, p: int = DEFAULT_P, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., idx, rank: the registers that are not zero. Null items count for nothing."""
    check_precision(p)
    hashed = df.filter(F.col(item).isNotNull()).select(*by, hash_of(F.col(item)).alias("h"))
    return hashed.select(*by, index_of(F.col("h"), p).alias("idx"), rank_of(F.col("h"), p).alias("rank")).groupBy(*by, "idx").agg(F.max("rank").alias("rank"))


def merge_registers(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, "idx").agg(F.max("rank").alias("rank"))


def estimate_registers(regs: DataFrame, p: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., approx_unique, relative_error. Ranks are counted first and added up in order, so the sum is always the same."""
    check_precision(p)
    m = 1 << p
    counts = regs.groupBy(*by, "rank").agg(F.count("*").alias("n"))
    one = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("c"))
    zeros = F.lit(m) - F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    total = F.aggregate("c", zeros.cast("double"), lambda a, x: a + x["n"] * F.pow(F.lit(2.0), -x["rank"]))
    alpha = ALPHAS.get(m, 0.7213 / (1 + 1.079 / m))
    raw = F.lit(alpha * m * m) / total
    linear = F.lit(float(m)) * F.ln(F.lit(float(m)) / F.nullif(zeros, F.lit(0)))
    best = F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw)
    return one.select(*by, F.floor(best + 0.5).cast("long").alias("approx_unique"), F.lit(relative_error(p)).alias("relative_error"))


def count(df: DataFrame, item: str, p: int = DEFAULT_P, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., approx_unique, relative_error."""
    return estimate_registers(registers(df, item, p, by), p, by)


def count_native(df: DataFrame, item: str, p: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """The engine's own sketch: faster, with other hashes and so other estimates."""
    return df.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_sketch_agg(item, F.lit(p))).alias("approx_unique"))


def pack(p: int, dense: bytes) -> bytes:
    name = HASH_NAME.encode()
    return MAGIC + struct.pack(">BBB", VERSION, p, len(name)) + name + struct.pack(">I", 1 << p) + dense


def unpack(state: bytes) -> tuple[int, np.ndarray]:
    """Precision and registers; ValueError if the state is not a sound one. Bytes behind it are ignored."""
    if state[:4] != MAGIC:
        raise ValueError("not a sketch: bad magic")
    if len(state) < 7 or state[4] != VERSION:
        raise ValueError("unsupported sketch version")
    p, size = state[5], state[6]
    if state[7 : 7 + size] != HASH_NAME.encode():
        raise ValueError("unsupported hash")
    at = 7 + size
    if len(state) < at + 4:
        raise ValueError("sketch is cut short")
    (n,) = struct.unpack(">I", state[at : at + 4])
    if n != 1 << p:
        raise ValueError("register count does not match the precision")
    check_precision(p)
    regs = np.frombuffer(state[at + 4 : at + 4 + n], np.uint8)
    if len(regs) != n:
        raise ValueError("sketch is cut short")
    if regs.max(initial=0) > 65 - p:
        raise ValueError("impossible register")
    return p, regs


def build(df: DataFrame, item: str, p: int = DEFAULT_P, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., state: a row for each group; one row, also for no items, without ``by``."""
    regs = registers(df, item, p, by)
    if not by:
        empty = df.sparkSession.range(1).select(F.lit(-1).alias("idx"), F.lit(0).alias("rank"))
        regs = regs.unionByName(empty)
    return _to_state(regs, p, by)


def _to_state(regs: DataFrame, p: int, by: tuple[str, ...]) -> DataFrame:
    packed = regs.groupBy(*by).agg(F.collect_list("idx").alias("i"), F.collect_list("rank").alias("r"))

    @F.arrow_udf("binary")
    def dense(i, r):
        import pyarrow as pa

        out = []
        for idx, rank in zip(i.to_pylist(), r.to_pylist(), strict=True):
            a = np.zeros(1 << p, np.uint8)
            at, v = np.array(idx, np.int64), np.array(rank, np.uint8)
            a[at[at >= 0]] = v[at >= 0]
            out.append(pack(p, a.tobytes()))
        return pa.array(out, pa.binary())

    return packed.select(*by, dense("i", "r").alias("state"))


def decode(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., p, idx, rank of all states; unsound ones raise."""

    @F.arrow_udf("array<struct<p:int,idx:int,rank:int>>")
    def run(state):
        import pyarrow as pa

        found = [unpack(s) for s in state.to_pylist()]
        live = [np.union1d(np.flatnonzero(r), [0]) for _, r in found]  # register 0 stands for the state also when it is zero
        sizes = [len(x) for x in live]
        flat = [np.repeat([p for p, _ in found], sizes), np.concatenate([*live, []]), np.concatenate([*(r[x] for (_, r), x in zip(found, live, strict=True)), []])]
        rows = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in flat], ["p", "idx", "rank"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), rows)

    return states.select(*by, F.inline(run("state")))


def merge(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One state for each group. Sketches of unequal precision raise."""
    ps = [r["p"] for r in states.select(F.expr("cast(conv(hex(substring(state, 6, 1)), 16, 10) as int)").alias("p")).distinct().limit(2).collect()]
    if len(ps) > 1:
        raise ValueError("sketches have different precision")
    if not ps:
        return states.select(*by, "state")
    return _to_state(merge_registers(decode(states, by).select(*by, "idx", "rank"), by), ps[0], by)


def inspect(states: DataFrame) -> DataFrame:
    """type, version, precision, registers, hash, approx_unique, relative_error of each state (fixed names and type)."""

    @F.arrow_udf("struct<type:string,version:int,precision:int,registers:int,hash:string,approx_unique:long,relative_error:double>")
    def run(state):
        import pyarrow as pa

        rows = []
        for s in state.to_pylist():
            p, regs = unpack(s)
            rows.append({"type": "hyperloglog", "version": VERSION, "precision": p, "registers": 1 << p, "hash": HASH_NAME, "approx_unique": estimate(regs), "relative_error": relative_error(p)})
        kinds = {"type": pa.string(), "version": pa.int32(), "precision": pa.int32(), "registers": pa.int32(), "hash": pa.string(), "approx_unique": pa.int64(), "relative_error": pa.float64()}
        return pa.array(rows, pa.struct(list(kinds.items())))

    return states.select(run("state").alias("s")).select("s.*")


def estimates(states: DataFrame) -> DataFrame:
    """approx_unique, relative_error of each state."""
    return inspect(states).select("approx_unique", "relative_error")


def estimate(regs: np.ndarray) -> int:
    m = len(regs)
    counts = np.bincount(regs)
    zeros = int(counts[0]) if len(counts) else 0
    total = sum(int(n) * 2.0**-r for r, n in enumerate(counts))
    raw = ALPHAS.get(m, 0.7213 / (1 + 1.079 / m)) * m * m / total
    if raw <= 2.5 * m and zeros:
        raw = m * math.log(m / zeros)
    return math.floor(raw + 0.5)
