"""The stable 64-bit hash that sketches, filters and samples share, as Arrow UDFs over numpy.

Hashes are kept as BIGINT in two's complement; ``unsigned_less`` and ``unsigned_mod`` read them as unsigned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
HASH_NAME = "fnv1a64-avalanche-v1"
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
AVALANCHE = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
SECOND_SEED = 0x9E3779B97F4A7C15

MASK = (1 << 64) - 1
#: Items beyond this many bytes are hashed on their own.
LONG = 512


def hash64(data: bytes, seed: int = 0) -> int:
    """The hash of one item, in plain Python: what the vectorised form must give."""
    h = FNV_OFFSET ^ (seed & MASK)
    for b in data:
        h = (h ^ b) * FNV_PRIME & MASK
    for factor in AVALANCHE:
        h = (h ^ h >> 33) * factor & MASK
    return h ^ h >> 33


def hash_ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the items that lie in ``flat`` (uint8) from ``starts`` on: one step for each byte position."""
    prime = np.uint64(FNV_PRIME)
    h = np.full(len(sizes), FNV_OFFSET ^ (seed & MASK), np.uint64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] <= LONG]
    ranked = sizes[order]
    live, at = h[order], starts[order]
    for k in range(int(ranked[0]) if len(ranked) else 0):
        n = int(np.searchsorted(-ranked, -k, "left"))  # items longer than k come first
        live[:n] = (live[:n] ^ flat[at[:n] + k]) * prime
    h[order] = live
    for i in np.flatnonzero(sizes > LONG).tolist():
        x = FNV_OFFSET ^ (seed & MASK)
        for b in flat[starts[i] : starts[i] + sizes[i]].tobytes():
            x = (x ^ b) * FNV_PRIME & MASK
        h[i] = x
    for factor in AVALANCHE:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow as pa

    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def hash_of(item: Column, seed: int = 0) -> Column:
    """BIGINT hash of a BINARY or STRING column; null for null."""

    @F.arrow_udf("long")
    def run(column):
        import pyarrow as pa

        h = hash_ragged(*_flat(column), seed).view(np.int64)
        return pa.array(h, mask=column.is_null().to_numpy(zero_copy_only=False))

    return run(item.cast("binary"))


def positions(item: Column, bits: int, hashes: int) -> Column:
    """ARRAY<BIGINT> of an item's bit positions: (h1 + i * h2 mod 2^64) mod bits."""

    @F.arrow_udf("array<long>")
    def run(column):
        import pyarrow as pa

        flat = _flat(column)
        found = bit_positions(hash_ragged(*flat), hash_ragged(*flat, SECOND_SEED), bits, hashes)
        rows = np.arange(len(column) + 1, dtype=np.int32) * hashes
        out = pa.ListArray.from_arrays(pa.array(rows), pa.array(found.ravel()))
        return out if not column.null_count else pa.array([v if ok else None for v, ok in zip(out.to_pylist(), column.is_valid().to_pylist(), strict=True)], out.type)

    return run(item.cast("binary"))


def bit_positions(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    h2 = np.where(h2 == 0, np.uint64(1), h2)
    steps = h1[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * h2[:, None]
    return (steps % np.uint64(bits)).astype(np.int64)


def hex_of(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def unsigned_less(h: Column, bound: int) -> Column:
    """h < bound, both unsigned: flipping the sign bit keeps the order."""
    flip = F.lit(-(1 << 63)).cast("long")
    flipped = (bound ^ (1 << 63)) & MASK
    return h.bitwiseXOR(flip) < F.lit(flipped - (1 << 64) if flipped >> 63 else flipped).cast("long")
