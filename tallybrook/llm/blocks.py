"""A store of documents in blocks, and the hashing of their words.

Operators that go over whole texts several times don't shuffle them: the documents are written once, as they
are scanned, to files of the shared folder of some ``BYTES`` each (all columns; ``ROWS`` rows at most). What the
passes exchange names a document by its block's number and its place in it. A block's number is made of its
partition and its place in that partition's output, so no task numbers them all. A task that is run again writes
under another name; only files that the stored index names are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, fresh_path, release, small_batches

BYTES, ROWS = 4 << 20, 1 << 18
#: Bytes of a block's texts whose words are hashed at once: the arrays of a whole block take some 20 times its bytes.
PART = 1 << 20
#: Bits of a document's place in its block, and of a block's place in its partition's output.
PLACE, TURN = 24, 16
#: Words of more bytes are hashed one by one.
LONG = 1 << 10
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The lowest 0 to 8 bytes of a number.
LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def files(uri: str):
    """File system and path of a file in the shared folder; Hadoop's name of an S3 store is Arrow's s3."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def binary(column) -> list[bytes]:
    """The values of a string column as bytes; null: empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def pack(a: np.ndarray) -> bytes:
    import pyarrow as pa

    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(b: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True), kind)


class _Block:
    """A block that is being written: batches go to its file as they come, of texts only the bytes stay."""

    def __init__(self, out: str, no: int, schema):
        import uuid

        import pyarrow.parquet as pq

        self.no, self.uri = no, f"{out}/{uuid.uuid4().hex}"
        fs, path = files(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = pq.ParquetWriter(path, schema, filesystem=fs, compression="zstd")
        self.raw, self.ids, self.bytes = [], [], 0

    def add(self, batch, place: int, key: int) -> None:
        self.file.write_batch(batch)
        self.raw += binary(batch.column(place))
        self.ids += batch.column(key).to_pylist()
        self.bytes += batch.nbytes


def store(docs: DataFrame, text: str = "text", gather=None) -> tuple[DataFrame, DataFrame]:
    """Writes the blocks. Returns their index, a row for each document: no, block (uri), idx, id (``__id``), of its
    text digest (16 bytes) and n_words, and ``keys``; and sums (packed arrays of int64, a row for each task).

    ``gather()`` is made once in each task: its ``keys(texts)``, an array of int64 of a block's texts, goes to the
    block's first row, and its ``sums()`` is read at the task's end.
    """
    small_batches(docs.sparkSession)
    out = fresh_path(docs.sparkSession, "blocks")
    place, key = docs.columns.index(text), docs.columns.index("__id")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        forget()
        part, turn, block, maker = TaskContext.get().partitionId(), 0, None, gather() if gather else None
        names = ["no", "block", "idx", "id", "digest", "n_words", "keys", "sums"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

        def rows(block):
            block.file.close()
            n = len(block.raw)
            keys = [None] * n
            if maker:
                keys[0] = maker.keys(block.raw)  # None: there are none
            columns = [[block.no] * n, [block.uri] * n, range(n), block.ids, [hashlib.blake2b(x, digest_size=16).digest() for x in block.raw], [len(x.split()) for x in block.raw], keys, [None] * n]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            first = 0
            while first < batch.num_rows:
                if block is None:
                    if turn >= 1 << TURN:
                        raise RuntimeError("a partition holds more blocks than can be numbered: use more partitions")
                    block, turn = _Block(out, (part << TURN) + turn, batch.schema), turn + 1
                left = max(1, BYTES - block.bytes)
                some = batch.slice(first, min(batch.num_rows - first, ROWS - len(block.raw), max(1, left * batch.num_rows // max(1, batch.nbytes))))
                block.add(some, place, key)
                first += some.num_rows
                if block.bytes >= BYTES or len(block.raw) >= ROWS:
                    yield rows(block)
                    block = None
                    release()
        if block is not None:
            yield rows(block)
            block = None
            release()
        if maker:
            yield pa.RecordBatch.from_arrays([pa.array([None] * 1, k) for k in kinds[:-1]] + [pa.array([pack(maker.sums())], pa.binary())], names)

    made = cut(docs.mapInArrow(run, "no long, block string, idx int, id long, digest binary, n_words long, keys array<long>, sums binary"))
    return made.filter("block is not null").drop("sums"), made.filter("sums is not null").select("sums")


def total(sums: DataFrame) -> np.ndarray | None:
    """The sum of packed arrays, added up in three steps; None without any."""

    def add(batches):
        import pyarrow as pa

        n = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                a = unpack(x, "<i8")
                n = a.copy() if n is None else n + a
        if n is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(n)], pa.binary())], ["sums"])

    for parts in (32, 1):
        sums = sums.mapInArrow(add, "sums binary").repartition(parts)
    found = sums.mapInArrow(add, "sums binary").first()
    return unpack(found["sums"], "<i8") if found else None


def by_block(frame: DataFrame, blocks: int) -> DataFrame:
    """Rows of blocks dealt evenly: a task for each block while there are few, for 16 when there are many."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(max(1, min(blocks, max(4 * cores, blocks // 16))))


def place(no, idx):
    """The number of a document, of its block's number and its place (columns, or whole numbers in ``idx``)."""
    return F.shiftleft(no, PLACE).bitwiseOR(idx.cast("long"))


def load(uri: str, columns: list[str] | None = None):
    import pyarrow.parquet as pq

    fs, path = files(uri)
    return pq.read_table(path, filesystem=fs, columns=columns)


def texts(uri: str, text: str, idx: list[int] | None = None) -> list[bytes]:
    column = load(uri, [text]).column(0)
    return binary(column if idx is None else column.take(idx))


def parts(texts: list[bytes]):
    """Runs of texts, in order, of some ``PART`` bytes each; a longer text has one of its own."""
    first, size = 0, 0
    for k, x in enumerate(texts):
        if size and size + len(x) > PART:
            yield texts[first:k]
            first, size = k, 0
        size += len(x)
    if first < len(texts):
        yield texts[first:]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    x = (a ^ (a >> U(29))) * U(0x9E3779B97F4A7C15) + b
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(31))


def split(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    gap = SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of words: eight bytes of all words at once are mixed in, then the next eight of those longer.

    The mixing isn't linear, so words that differ in a pattern don't agree under every seed, as sums of powers would.
    """
    n = ends - starts
    out = (n.astype(U) + U(seed)) * U(0x9FB21C651E98DF25)
    if not len(n):
        return out
    # eight bytes from each place on
    lanes = np.ndarray(len(raw) + 1, np.uint64, raw + bytes(8), strides=(1,))
    long = np.flatnonzero(n > LONG)
    live = np.flatnonzero(n <= LONG) if len(long) else slice(None)
    at, left = starts[live], n[live]
    while True:
        x = (out[live] ^ (lanes[at] & LOWEST[np.minimum(left, 8)])) * U(0x9FB21C651E98DF25)
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        out[live] = x ^ (x >> U(29))
        go = np.flatnonzero(left > 8)
        if not len(go):
            break
        live = go if isinstance(live, slice) else live[go]
        at, left = at[go] + 8, left[go] - 8
    for i in long.tolist():
        out[i] = U(int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little"))
    return out


class Words:
    """The words of texts, one after the other: hash (``h``), ``starts`` and ``ends`` in ``raw``, ``doc``; of each
    text its first word (``first``) and number of words (``n``)."""

    def __init__(self, texts: list[bytes], seed: int):
        self.raw = b"\n".join(texts)
        self.starts, self.ends = split(self.raw)
        self.h = hashes(self.raw, self.starts, self.ends, seed)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.first = np.searchsorted(self.starts, self.begin)
        self.n = np.diff(np.append(self.first, len(self.h)))
        self.doc = np.repeat(np.arange(len(texts)), self.n)

    def inside(self, n: int) -> np.ndarray:
        """The places from which n words go on in one text."""
        return np.flatnonzero(self.doc[: max(0, len(self.h) - n + 1)] == self.doc[n - 1 :])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, for each place that has them."""
    if len(h) < n:
        return h[:0]
    out, done, power, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, done = power, size
            else:
                m = len(h) - done - size + 1
                out, done = mix(out[:m], power[done : done + m]), done + size
        size *= 2
        if size > n:
            return out[: len(h) - n + 1]
        power = mix(power[: -(size // 2)], power[size // 2 :])
