"""Substring dedup with prefix-partitioned suffix trees.

Removed is every word that a window of ``WINDOW`` words covers whose words also start earlier: in a document of
smaller id, or earlier in the same. Windows are judged on the input. Of equal texts only the first is a string of
the trees; all words of the others start later (if there is a window at all).

1. While documents are stored in blocks (blocks.py), suffixes are counted by the hash of their first 5, 10 and 15
   words, in ``BUCKETS`` buckets a length. A suffix' prefix is the shortest of these whose bucket holds ``GROUP``
   suffixes at most, else the whole window: prefixes grow until what shares them fits memory.
2. A sieve leaves out suffixes that no other one follows to the depth of a window: in each window the five words of
   least hash are its anchor, equal windows have equal anchors, and an anchor that occurs once rules its windows out.
3. Each other suffix goes to the group of its prefix, once for each block and window, as a path label (a hash of the
   whole window under another seed) with its document. Groups hold some ``GROUP`` suffixes.
4. A group's subtree is made by sorting its suffixes by prefix and label; suffixes that agree in both hang under one
   internal node as deep as a window, a repeat. The node's first leaf stays, and its block is told so.
5. Each block takes out the words of all windows of which it doesn't hold the first leaf.

Blocks exchange plain rows of five numbers; a prefix that everything shares is lengthened, and what even shares its
window comes once from each block. Prefix and label are 64 bits each, of two seeds: 128 bits stand for a window's
words, and 128 bits of BLAKE2 for a text; neither is compared word by word afterwards.

Cases: a null text has no words and stays null. Texts shorter than a window stay whole, and a text of which nothing
is removed stays as it is, white space included. Rows of equal id and different text follow by the BLAKE2 digest of
their text. A null id is before all others. Repeated rows are copies. Columns that clash with new ones are dropped.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U
from .common import cut, release

WINDOW, ANCHOR = 20, 5
#: Prefix lengths before the whole window.
PREFIXES = (5, 10, 15)
BUCKETS = 1 << 18
#: Suffixes of a group, and of a prefix' bucket that isn't lengthened.
GROUP = 1 << 17
ONE, TWO = 1, 2


def slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """best (minimum or maximum) of each n values in a row."""
    out, size = x, 1
    while size * 2 <= n:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1]) if n > size else out


class Suffixes(B.Words):
    """Words of a block's texts, and the suffixes of a window at least with the anchors of their windows."""

    def __init__(self, texts: list[bytes]):
        super().__init__(texts, ONE)
        self.where = self.inside(WINDOW)
        g, w = B.grams(self.h, ANCHOR), WINDOW - ANCHOR + 1
        self.key, self.low, self.high = np.zeros(0, U), self.where[:0], self.where[:0]
        if not len(self.where):
            return
        want = slide(g, w, np.minimum)[self.where]
        anchor = np.full(len(self.where), -1, np.int64)
        for d in range(w):  # the last place of the least hash
            hit = g[self.where + d] == want
            anchor[hit] = self.where[hit] + d
        # windows of one anchor are neighbours
        new = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
        self.key = g[anchor[new]]
        self.low, self.high = self.where[new], np.append(self.where[new[1:] - 1], self.where[-1])

    def under(self, keys: np.ndarray) -> np.ndarray:
        """The places of suffixes whose window has one of the anchors."""
        rows = np.flatnonzero(np.isin(self.key, keys))
        n = self.high[rows] - self.low[rows] + 1
        return np.repeat(self.low[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def labels(self, at: np.ndarray) -> np.ndarray:
        return B.grams(B.hashes(self.raw, self.starts, self.ends, TWO), WINDOW)[at]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(46)).astype(np.int64)


class Statistics:
    """For the block store: a block's anchors (those that it holds more often, twice), and suffixes by prefix."""

    def __init__(self):
        self.counts = np.zeros((len(PREFIXES), BUCKETS), np.int64)

    def keys(self, texts: list[bytes]) -> np.ndarray:
        found = [np.zeros(0, U)]
        for some in B.parts(texts):
            s = Suffixes(some)
            for i, n in enumerate(PREFIXES):
                self.counts[i] += np.bincount(_bucket(B.grams(s.h, n)[s.where]), minlength=BUCKETS)
            found.append(s.key)
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        return np.concatenate((keys, keys[n > 1])).view(np.int64)

    def sums(self) -> np.ndarray:
        return self.counts.ravel()


def prefixes(s: Suffixes, at: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """The hash of each suffix' prefix, lengthened until its bucket isn't ``crowded`` (a row of bits a length)."""
    out = B.mix(B.grams(s.h, WINDOW)[at], np.full(len(at), WINDOW, U))
    for n, row in zip(reversed(PREFIXES), crowded[::-1], strict=True):
        h = B.grams(s.h, n)[at]
        fits = ~row[_bucket(h)]
        out[fits] = B.mix(h[fits], np.full(fits.sum(), n, U))
    return out


def deep_nodes(prefix: np.ndarray, label: np.ndarray, order: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The subtree's leaves sorted by prefix, label and ``order``; and where in that sorting the nodes begin, as
    deep as a window, under which they hang."""
    by = np.lexsort((*order[::-1], label, prefix))
    new = np.ones(len(by), bool)
    new[1:] = (prefix[by][1:] != prefix[by][:-1]) | (label[by][1:] != label[by][:-1])
    return by, np.flatnonzero(new)


def _suffixes(uri: str, text: str, idx: list[int], keys: list[int]) -> tuple[Suffixes, np.ndarray]:
    s = Suffixes(B.texts(uri, text, idx))
    return s, s.under(np.array(keys, np.int64).view(U))


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeats cut out of their texts, and n_words and n_removed."""
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    docs = docs.select(*(F.col(c).cast("string").alias(c) if c == text else F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in kept))
    index, sums = B.store(docs.withColumn("__id", F.coalesce("doc_id", F.lit(-(1 << 63)))), text, Statistics)
    spark, counts = docs.sparkSession, B.total(sums)
    crowded = (counts if counts is not None else np.zeros(len(PREFIXES) * BUCKETS, np.int64)).reshape(-1, BUCKETS) > GROUP
    crowded = spark.sparkContext.broadcast(crowded)  # a byte for each bucket and length
    number = index.filter("idx = 0").select("no", "block")
    n_blocks = max(1, number.count())

    # the sieve: anchors that occur more than once, for the blocks that hold them
    told = index.filter("keys is not null").select("no", F.explode("keys").alias("key"))
    met = told.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1").groupBy("no").agg(F.collect_set("key").alias("keys"))
    first = index.filter(F.col("n_words") >= WINDOW).groupBy("digest").agg(F.min(F.struct("id", "no", "idx")).alias("f"))
    ties = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    firsts = first.select("f.no", F.struct("f.idx", "f.id", ties.alias("tie")).alias("f")).groupBy("no").agg(F.array_sort(F.collect_list("f")).alias("firsts"))
    found = number.join(firsts.hint("merge"), "no", "left").join(met.hint("merge"), "no", "left")
    todo = cut(found.select("no", "block", F.col("firsts.idx").alias("idx"), F.col("firsts.id").alias("ids"), F.col("firsts.tie").alias("ties"), F.coalesce("keys", F.array().cast("array<long>")).alias("keys")))

    def send(batches):
        import pyarrow as pa

        for batch in batches:
            for no, uri, idx, ids, ties, keys in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                s, at = _suffixes(uri, text, idx, keys)
                prefix, label, doc = prefixes(s, at, crowded.value), s.labels(at), s.doc[at]
                id_, tie = np.array(ids, np.int64)[doc], np.array(ties, np.int64)[doc]
                by, node = deep_nodes(prefix, label, (id_, tie, at))
                one = np.sort(by[node])  # once for each window, in the order of documents
                for lo in range(0, len(one), 20_000):
                    r = one[lo : lo + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (prefix[r].view(np.int64), label[r].view(np.int64), id_[r], tie[r], np.full(len(r), no))], ["prefix", "label", "id", "tie", "no"])
                del s, at, prefix, label, doc, id_, tie, by, node, one
                release()

    some = todo.filter("idx is not null and size(keys) > 0")
    sent = B.by_block(some, n_blocks).mapInArrow(send, "prefix long, label long, id long, tie long, no long")
    most = some.agg(F.sum(F.size("keys"))).first()[0] or 0
    groups = max(8, most * (WINDOW - ANCHOR + 2) // 2 // GROUP)

    def subtree(table):
        import pyarrow as pa

        prefix, label, id_, tie, no = (table.column(i).to_numpy() for i in range(5))
        by, node = deep_nodes(prefix, label, (id_, tie, no))
        leaf = by[node]
        return pa.table({"no": no[leaf], "label": label[leaf]})

    grouped = sent.groupBy(F.pmod(F.xxhash64("prefix"), F.lit(groups)))
    owned = grouped.applyInArrow(subtree, "no long, label long").groupBy("no").agg(F.collect_list("label").alias("owned"))
    last = todo.join(owned.hint("merge"), "no", "left")

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_words long", "n_removed long"])
    place = kept.index(text)

    def take_out(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, idx, ids, ties, keys, owned in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                table = B.load(uri)
                raw = B.binary(table.column(place))
                gone = later(raw, idx or [], ids or [], ties or [], keys, owned or [])
                left = [without(x, gone[i] if i in gone else None) for i, x in enumerate(raw)]
                texts = [y[0] if there else None for there, y in zip(table.column(place).is_valid().to_pylist(), left, strict=True)]
                columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == place else table.column(i) for i in range(len(kept))]
                yield from pa.table([*columns, pa.array([x[1] for x in left], pa.int64()), pa.array([x[2] for x in left], pa.int64())], [*kept, "n_words", "n_removed"]).combine_chunks().to_batches(max_chunksize=500)
                del table, raw, gone, left, texts, columns
                release()  # the worker waits, or goes on to another operator

    return B.by_block(last.select("block", "idx", "ids", "ties", "keys", "owned"), n_blocks).mapInArrow(take_out, schema)


def later(raw: list[bytes], idx: list[int], ids: list[int], ties: list[int], keys: list[int], owned: list[int]) -> dict[int, np.ndarray | bool]:
    """Of each text that loses words, the places of its windows that also start earlier; True: all of a copy."""
    first = set(idx)
    gone = {i: True for i, x in enumerate(raw) if i not in first}
    if idx and keys:
        s = Suffixes([raw[i] for i in idx])
        at = s.under(np.array(keys, np.int64).view(U))
        label, doc = s.labels(at), s.doc[at]
        by, node = deep_nodes(np.zeros(len(at), U), label, (np.array(ids, np.int64)[doc], np.array(ties, np.int64)[doc], at))
        stays = by[node][np.isin(label[by[node]], np.array(owned, np.int64).view(U))]
        lost = np.ones(len(at), bool)
        lost[stays] = False
        at = np.sort(at[lost])
        for part in np.split(at, np.flatnonzero(np.diff(s.doc[at])) + 1) if len(at) else []:
            d = int(s.doc[part[0]])
            gone[idx[d]] = part - s.first[d]
    return gone


def without(raw: bytes, gone: np.ndarray | bool | None) -> tuple[bytes, int, int]:
    """A text without the words of the windows at ``gone`` (True: it copies an earlier text, if it has a window),
    its words and how many were removed. What stays keeps the white space before it."""
    if gone is None or gone is True:
        n = len(raw.split())
        return (b"", n, n) if gone is True and n >= WINDOW else (raw, n, 0)
    starts, ends = B.split(raw)
    n = len(starts)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + WINDOW, -1)
    stays = np.cumsum(edge)[:n] == 0
    # runs of words that stay: each from the end of what stays before it, or with its own first word
    turn = np.flatnonzero(np.diff(np.concatenate(([False], stays, [False])).view(np.int8)))
    parts = []
    for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        begin = 0 if a == 0 else int(starts[a]) if not parts else int(ends[a - 1])
        parts.append(raw[begin : len(raw) if b == n else int(ends[b - 1])])
    return b"".join(parts), n, n - int(stays.sum())
