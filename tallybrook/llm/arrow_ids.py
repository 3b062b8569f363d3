"""Token ids in Arrow stream files of equal-length sequences, readable at random without copying.

Documents are dealt by ranges of their id, so that the shards' order is the documents' order. Each task encodes
its documents, strings the ids together and cuts them into sequences of ``LENGTH`` ids. A shard, of some ``TOKENS``
ids at most, is three Arrow stream files in the shared folder:

- ``.ids``: columns ``ids`` (fixed-size list of the narrowest unsigned type that holds the vocabulary) and ``mask``
  (the number of the sequence's mask), ``ROWS`` sequences a batch;
- ``.masks``: column ``mask`` (fixed-size list of bytes, 0 on padding): that of full sequences, and that of the last;
- ``.docs``: columns ``doc_id``, ``start`` (in the shard) and ``n_tokens``.

Batches all have ``ROWS`` rows but the last and so one size in bytes: row i is at a known place. Of a mapped file it is
a view; from a remote one its batch alone is read. A task that is run again writes files of other names, and only
those that the manifest names are read.

Words (cut at ASCII white space, where no token goes across) are encoded by the library, and the ids of recent ones
are kept: two generations of ``KEPT`` words of ``LONG`` bytes at most.

Cases: a null or empty text is the end id alone. Rows of equal id follow by a hash of their text, and equal rows by
their place in the input; a null id is first. Very long texts run over many sequences. Further columns are not
written. No rows: no shards.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import files
from .bpe_count import byte_symbols
from .common import cut, fresh_path, small_batches, tool

LENGTH, ROWS = 1024, 256
#: Ids of a shard, beyond which a document starts another; and bytes of text for each task.
TOKENS, SHARE = 1 << 24, 32 << 20
KEPT, LONG = 1 << 18, 64
END = 1
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


class Words(dict):
    """The ids of words, as bytes, made when first asked for. Two generations of ``KEPT`` words at most."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.past: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        # with such a file, a word of plain letters is one pre-token in lower case, and the model alone will do
        self.plain = spec["model"].get("end_of_word_suffix") == "</w>" and kinds == ["NFC", "Replace", "Lowercase"]
        self.symbols = {b: c for b, c in enumerate(byte_symbols())}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.past.get(word)
        if ids is None:
            text = word.decode()
            m = self.plain and SIMPLE.fullmatch(text)
            if not m:
                ids = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                ids = self._core(m[1].lower()) + self._core(m[2]) if m[2] else self._core(m[1].lower())
        if len(word) <= LONG:
            self[word] = ids
        return ids

    def _core(self, text: str) -> bytes:
        key = text.encode()
        found = self.get(key) or self.past.get(key)
        if found is None:
            found = array(self.code, [t.id for t in self.tokenizer.model.tokenize(key.decode("latin-1").translate(self.symbols))]).tobytes()
            if len(key) <= LONG:
                self[key] = found
        return found

    def encode(self, text: bytes) -> bytes:
        if len(self) > KEPT:
            self.past = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def words(path: str) -> Words:
    return tool(("words", path), lambda: Words(path))


class _Writer:
    """Writes one shard. Holds a batch of sequences at most besides the index of its documents."""

    def __init__(self, uri: str, code: str, length: int, rows: int):
        import numpy as np
        import pyarrow as pa

        self.np, self.pa = np, pa
        self.uri, self.length, self.rows = uri, length, rows
        self.dtype = np.dtype("<u2" if code == "H" else "<u4")
        kind = pa.uint16() if code == "H" else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.uint8())], {"rows": str(rows), "length": str(length)})
        self.files, path = files(uri)
        self.path = path
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(f"{path}.ids")
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.index = self.files.open_output_stream(f"{path}.docs")
        self.entry = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.docs = pa.ipc.new_stream(self.index, self.entry)
        self.buffer, self.held, self.total, self.n_docs = [], 0, 0, 0

    def add(self, doc_ids: list, blobs: list[bytes]) -> None:
        n = [len(b) // self.dtype.itemsize for b in blobs]
        starts = []
        for k in n:
            starts.append(self.total)
            self.total += k
        self.docs.write_batch(self.pa.RecordBatch.from_arrays([self.pa.array(x, self.pa.int64()) for x in (doc_ids, starts, n)], schema=self.entry))
        self.n_docs += len(doc_ids)
        self.buffer += blobs
        self.held += sum(n)
        if self.held >= self.length * self.rows:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        np, pa = self.np, self.pa
        flat, size = np.frombuffer(b"".join(self.buffer), self.dtype), self.length * self.rows
        whole = len(flat) // size * size
        for first in range(0, whole, size):
            self._batch(flat[first : first + size], size)
        rest = flat[whole:]
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
            rest = rest[:0]
        self.buffer, self.held = [rest.tobytes()], len(rest)

    def _batch(self, flat, real: int) -> None:
        np, pa = self.np, self.pa
        full = np.arange(self.length, len(flat) + 1, self.length) <= real
        made = [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), pa.array((~full).astype(np.uint8))]
        self.stream.write_batch(pa.RecordBatch.from_arrays(made, schema=self.schema))

    def close(self) -> tuple[int, int]:
        self._flush(last=True)
        masks = self.np.ones((2, self.length), self.np.uint8)
        masks[1, self.total % self.length :] = 0
        with self.files.open_output_stream(f"{self.path}.masks") as out:
            batch = self.pa.RecordBatch.from_arrays([self.pa.FixedSizeListArray.from_arrays(self.pa.array(masks.ravel()), self.length)], ["mask"])
            with self.pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
        for x in (self.stream, self.docs, self.out, self.index):
            x.close()
        return self.n_docs, self.total


def write(docs: DataFrame, path: str, out: str, text: str = "text", end: int = END, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Writes the shards below the shared folder ``out``. Returns the manifest: shard, uri, docs, tokens, first_token."""
    small_batches(docs.sparkSession)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_h"), F.col(text).cast("string").alias("text"))
    size = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE))
    # equal rows in bulk are parted by their place
    order = ("doc_id", "_h", "_row")
    dealt = dealt.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from .blocks import binary

        part, turn, writer, known = TaskContext.get().partitionId(), 0, None, words(path)
        stop = array(known.code, [end]).tobytes()

        def done():
            n, total = writer.close()
            return pa.RecordBatch.from_pylist([{"shard": (part << 24) + turn, "uri": writer.uri, "docs": n, "tokens": total}])

        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or _Writer(f"{out}/shard-{part:06d}-{turn:06d}-{uuid.uuid4().hex}", known.code, length, rows)
            writer.add(batch.column(0).to_pylist(), [known.encode(x) + stop for x in binary(batch.column(1))])
            if writer.total >= TOKENS:
                yield done()
                writer, turn = None, turn + 1
        if writer:
            yield done()

    manifest = cut(dealt.mapInArrow(run, "shard long, uri string, docs long, tokens long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


class Shard:
    """Random access to a shard's sequences: ``shard[i]`` is (ids, mask), views of a batch's memory."""

    def __init__(self, uri: str):
        import pyarrow as pa

        self.ipc, self.uri = pa.ipc, uri
        self.source = self._open(".ids")
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.rows, self.length = (int(self.schema.metadata[k]) for k in (b"rows", b"length"))
        self.first, self.at, self.held = self.source.tell(), -1, None
        end = self.source.size() - 8  # the stream's end mark
        if end > self.first:
            pa.ipc.read_message(self.source)
        self.size = max(1, self.source.tell() - self.first)
        self.n_batches = -(-(end - self.first) // self.size)
        with self._open(".masks") as f:
            self.masks = pa.ipc.open_stream(f).read_next_batch().column(0).values.to_numpy(zero_copy_only=True).view(bool)

    def _open(self, kind: str):
        import pyarrow as pa

        store, path = files(self.uri)
        return pa.memory_map(path + kind) if type(store).__name__ == "LocalFileSystem" else store.open_input_file(path + kind)

    def batch(self, i: int):
        """The i-th batch; the one before is let go."""
        if i != self.at:
            self.source.seek(self.first + i * self.size)
            self.at, self.held = i, self.ipc.read_record_batch(self.ipc.read_message(self.source), self.schema)
        return self.held

    def __len__(self) -> int:
        return (self.n_batches - 1) * self.rows + self.batch(self.n_batches - 1).num_rows if self.n_batches else 0

    def _values(self, batch: int):
        return self.batch(batch).column(0).values.to_numpy(zero_copy_only=True)

    def __getitem__(self, i: int):
        batch, row = divmod(i, self.rows)
        mask = self.batch(batch).column(1)[row].as_py() * self.length
        return self._values(batch)[row * self.length : (row + 1) * self.length], self.masks[mask : mask + self.length]

    def spans(self, start: int, n: int):
        """Views that hold tokens start to start + n."""
        size = self.rows * self.length
        while n > 0:
            batch, first = divmod(start, size)
            view = self._values(batch)[first : first + n]
            yield view
            start, n = start + len(view), n - len(view)

    def docs(self):
        """Batches of doc_id, start, n_tokens."""
        with self._open(".docs") as f:
            yield from self.ipc.open_stream(f)

    def close(self) -> None:
        self.held = None
        self.source.close()


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32, from the shards' files."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                for part in shard.docs():
                    ids, starts, sizes = (part.column(i).to_pylist() for i in range(3))
                    sums = []
                    for start, n in zip(starts, sizes, strict=True):
                        crc = 0
                        for view in shard.spans(start, n):
                            crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([first + s for s in starts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()

    shards = max(1, manifest.count())  # a task for each; their sizes say nothing of the files'
    return manifest.select("uri", "first_token").repartition(shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Writes ``docs`` to a new folder below the shared one and reads the files back."""
    return read(write(docs, path, fresh_path(docs.sparkSession, "ids"), text))
