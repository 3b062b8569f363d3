"""Exact top-k by inner product over vectors sorted by length.

All vectors are rotated into the basis of the singular vectors of the whole table, so that a few leading
coordinates carry most of every product. Candidates are dealt by descending length into blocks. A block's
candidates are taken longest first, some at a time: the product over the leading coordinates plus the lengths
of both rests (Cauchy-Schwarz) bounds each score, and only pairs whose bound reaches the query's k-th best
score so far are multiplied out, in whole numbers. The block of the longest vectors comes first and gives
every query a threshold; later blocks whose longest vector can't reach that of any query of a block of queries
are not sent to it.

Queries go in blocks of ``QUERIES`` rows, candidates in blocks of ``ROWS`` (fewer if they are wide: ``BYTES``). A
block of queries meets blocks of candidates through a join on the block's number; no list of vectors passes
through the driver, only the dimension-square matrix of sums and counts of blocks by the logarithm of their
length. Broadcast is one block of candidates: ``BYTES`` at most.

Cases: every row is a vector of its own, also where ids repeat, and a candidate of all rows but itself. A vector
that is null or has null or non-finite components, or a null id, takes no part; an empty one is zero. Shorter
vectors are as if filled up with zeros. Equal scores go to the smaller id. With fewer than k candidates all are
returned. A component that isn't below 2^62 in whole numbers, or a score that doesn't fit a long, is an error.
Further columns are not read. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

K, ROWS, QUERIES, STEP = 10, 4096, 256, 512
BYTES = 8 << 20
#: The part of all squared lengths that the leading coordinates carry.
ENERGY = 0.7
FLOOR = -(1 << 63)
#: Steps of a doubling of length by which blocks are counted.
FINE = 8


def whole(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """vec_id, v (floor(scale * component), array<long>), row (its number): a row for each usable vector."""
    scaled = F.transform(vector, lambda c: c.cast("double") * F.lit(scale))
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    number = lambda c: F.when(F.abs(c) < F.lit(2.0**62), F.floor(c)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    return vectors.filter(F.col(vec_id).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(scaled, number).alias("v"), F.monotonically_increasing_id().alias("row"))


def _matrix(column, width: int) -> np.ndarray:
    offsets = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(offsets), width), np.int64)
    out[np.arange(width) < offsets[:, None]] = flat
    return out


def rotation(vectors: DataFrame) -> tuple[np.ndarray, int]:
    """The singular vectors of all rows (as columns, the largest first), and how many lead."""
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0

    def gram(batches):
        import pyarrow as pa

        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(0), width).astype(float)  # rounding only turns the basis a little
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "row": pa.array(total.tolist(), pa.list_(pa.float64()))})

    rows = vectors.select("v").mapInArrow(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    g = np.zeros((width, width))
    for r in rows.collect():  # the dimension squared
        g[r["i"], r["j"]] = r["x"]
    values, basis = np.linalg.eigh(g)
    values, basis = values[::-1], basis[:, ::-1]
    share = np.cumsum(np.maximum(values, 0)) / max(values.sum(), 1e-300)
    return np.ascontiguousarray(basis), int(min(np.searchsorted(share, ENERGY) + 1, max(1, width))) if width else 0


def blocks(vectors: DataFrame, width: int, rows: int) -> DataFrame:
    """Packs the rows of each partition, in their order, into blocks: ids, rows, m (matrix), longest (length)."""

    def packed(ids, nos, m):
        import pyarrow as pa

        small = not m.size or np.abs(m).max() < 1 << 31
        longest = math.sqrt(float((m.astype(float) ** 2).sum(1).max(initial=0)))
        cells = [ids.astype("<i8").tobytes(), nos.astype("<i8").tobytes(), m.astype("<i4" if small else "<i8").tobytes()]
        return pa.RecordBatch.from_arrays([*(pa.array([c], pa.binary()) for c in cells), pa.array([longest])], ["ids", "rows", "m", "longest"])

    def pack(batches):
        held, n = [], 0
        for b in batches:
            part = (b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), width))
            first = 0
            while first < len(part[0]):
                upto = min(len(part[0]), first + rows - n)
                held.append([x[first:upto] for x in part])
                n, first = n + upto - first, upto
                if n == rows:
                    yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if held:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return vectors.select("vec_id", "row", "v").mapInArrow(pack, "ids binary, rows binary, m binary, longest double")


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q, self.s, self.i = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, FLOOR, np.int64)

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.concatenate((self.q, q)), np.concatenate((self.s, s)), np.concatenate((self.i, i))
        by = np.lexsort((i, -s, q))
        q, s, i = q[by], s[by], i[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.q, self.s, self.i = q[top], s[top], i[top]
        kth = place == self.k - 1
        self.least[q[kth]] = s[kth]


def products(q: np.ndarray, c: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products of rows; exact."""
    if safe:
        return np.einsum("ij,ij->i", q, c)
    found = [sum(x * y for x, y in zip(a, b, strict=True)) for a, b in zip(q.tolist(), c.tolist(), strict=True)]
    if any(not -(1 << 63) < x < 1 << 63 for x in found):
        raise OverflowError("a score doesn't fit a long")
    return np.array(found, np.int64)


def scan(q_rows, q, c_rows, c_ids, c, basis, lead: int, least, k: int) -> tuple[Best, int, float]:
    """The best of one block of candidates for one of queries; how many pairs were multiplied out; and the least
    length of a candidate that could still be among any query's best."""
    best = Best(len(q_rows), k)
    best.least = np.maximum(best.least, least)
    known = best.least.copy()
    c_len = np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.argsort(-c_len, kind="stable")
    c_rows, c_ids, c, c_len = c_rows[order], c_ids[order], c[order], c_len[order]
    qf = q.astype(float)
    qr, cr = qf @ basis, c.astype(float) @ basis
    q_len = np.sqrt((qf**2).sum(1))
    q_rest, c_rest = (np.sqrt((x[:, lead:] ** 2).sum(1)) for x in (qr, cr))
    safe, done = float(q_len.max(initial=0)) * float(c_len.max(initial=0)) < 2.0**62, 0
    for first in range(0, len(c), STEP):
        part = slice(first, first + STEP)
        slack = 1e-9 * q_len * c_len[first] + 1e-6
        live = np.flatnonzero(q_len * c_len[first] + slack >= best.least)  # the others are through with all that follow
        if not len(live):
            break
        bound = qr[live, :lead] @ cr[part, :lead].T + np.outer(q_rest[live], c_rest[part]) + slack[live, None]
        a, b = np.nonzero((bound >= best.least[live, None]) & (c_rows[part] != q_rows[live, None]))
        a, b = live[a], b + first
        done += len(a)
        for lo in range(0, len(a), 1 << 16):
            some = slice(lo, lo + (1 << 16))
            best.add(a[some], products(q[a[some]], c[b[some]], safe), c_ids[b[some]])
            best.least = np.maximum(best.least, known)
    # a query of length zero, or without k candidates yet, may need any
    open_ = (q_len == 0) | (best.least == FLOOR)
    reach = np.where(open_, 0.0, best.least.astype(float) * (1 - 1e-8) / np.where(q_len == 0, 1, q_len) - 1e-3)
    return best, done, float(max(0.0, reach.min(initial=np.inf)))


def _scanned(pairs: DataFrame, width: int, basis: np.ndarray, lead: int, k: int) -> DataFrame:
    """One row for each pair of blocks: qb, least, reach, and the best found as arrays."""

    def run(batches):
        import pyarrow as pa

        ints = lambda b: np.frombuffer(b, "<i8")
        for batch in batches:
            for row in range(batch.num_rows):
                qb, q_ids, q_rows, q, least, c_ids, c_rows, c = (batch.column(i)[row].as_py() for i in range(8))
                q_ids, q_rows, c_ids, c_rows = map(ints, (q_ids, q_rows, c_ids, c_rows))
                m = [np.frombuffer(x, "<i4" if len(x) == 4 * n * width else "<i8").reshape(n, width).astype(np.int64) for x, n in ((q, len(q_ids)), (c, len(c_ids)))]
                known = ints(least) if least else np.full(len(q_ids), FLOOR, np.int64)
                best, _, reach = scan(q_rows, m[0], c_rows, c_ids, m[1], basis, lead, known, k)
                lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (q_ids[best.q], q_rows[best.q], best.i, best.s)]
                yield pa.RecordBatch.from_arrays([pa.array([qb]), pa.array([best.least.astype("<i8").tobytes()], pa.binary()), pa.array([reach]), *lists], ["qb", "least", "reach", "q", "r", "i", "s"])

    return pairs.select("qb", "q_ids", "q_rows", "q_m", "least", "ids", "rows", "m").mapInArrow(run, "qb long, least binary, reach double, q array<long>, r array<long>, i array<long>, s array<long>")


def _size_class(length: Column) -> Column:
    return F.floor(F.log2(length + 1) * FINE).cast("int")


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row that ``is_query`` (over vec_id) picks."""
    small_batches(vectors.sparkSession)
    v = cut(whole(vectors, vec_id, vector, scale))
    basis, lead = rotation(v)
    width = len(basis)
    rows = max(16, min(ROWS, BYTES // (8 * max(1, width))))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n = v.count()
    dealt = v.withColumn("_sq", length).repartitionByRange(max(1, -(-n // rows)), F.desc("_sq"), "row").sortWithinPartitions(F.desc("_sq"), "row")
    by_length = Window.orderBy(F.desc("longest"), "cb")
    # a row for each block; only its number and length are ranked
    made = cut(blocks(dealt, width, rows).withColumn("cb", F.monotonically_increasing_id()))
    place = made.select("cb", "longest").withColumn("place", F.row_number().over(by_length) - 1).drop("longest")
    candidates = made.join(place, "cb").drop("cb")
    asked = v.filter(is_query)
    asked = blocks(asked.repartition(max(1, -(-asked.count() // QUERIES)), "row"), width, QUERIES)
    asked = cut(asked.select(F.monotonically_increasing_id().alias("qb"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("m").alias("q_m")))
    first = F.broadcast(candidates.filter("place = 0").select(F.lit(0).alias("one"), "ids", "rows", "m"))
    begun = cut(_scanned(asked.withColumns({"one": F.lit(0), "least": F.lit(None).cast("binary")}).join(first, "one"), width, basis, lead, k))
    # how many blocks have a length of each class or more: lengths are below 2^126, so these are some thousand classes
    counts = {r["c"]: r["count"] for r in made.groupBy(_size_class(F.col("longest")).alias("c")).count().collect()}
    top = max(counts, default=0)
    as_long = [sum(x for c, x in counts.items() if c >= at) for at in range(top + 1)]
    reached = F.coalesce(F.get(F.array(*map(F.lit, as_long)), _size_class(F.col("reach"))), F.lit(0))
    later = asked.join(begun.select("qb", "least", (reached - 1).cast("int").alias("last")).filter("last > 0").hint("merge"), "qb").withColumn("place", F.explode(F.sequence(F.lit(1), F.col("last"))))
    rest = _scanned(later.join(candidates.hint("shuffle_hash"), "place"), width, basis, lead, k)
    found = begun.unionByName(rest).select(F.explode(F.arrays_zip("q", "r", "i", "s")).alias("x")).select(F.col("x.q").alias("query_id"), F.col("x.r").alias("row"), F.col("x.i").alias("vec_id"), F.col("x.s").alias("score"))
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
