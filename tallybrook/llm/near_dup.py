"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: its windows of ``SHINGLE`` words, each weighing its count times an inverse document
frequency, 1 + ln((documents + 1) / (df + 1)). A window is in no more documents than its rarest word, and that word's
frequency stands for the window's: copies of a passage then don't make the passage light, and two near copies weigh
alike however many there are. Word frequencies are counted over all documents, in ``BUCKETS`` hash buckets, a fixed
size at any scale, while the documents are stored in blocks (blocks.py).

From each set ``SAMPLES`` consistent weighted samples are drawn; two sets agree in a sample with the probability
of their weighted Jaccard similarity. Samples form ``BANDS`` bands of ``ROWS``. Documents are candidates of each
other where a band agrees (at similarity 0.8 all but some 0.02 % of pairs do). Candidates are joined into families
by label propagation over links to the least member of each meeting, so no pairs are listed. Equal texts are one
document throughout.

A family's texts come from the block store in cells of some ``2 * CELL`` texts and ``2 * CELL_WORDS`` words. Small
families share a cell. A large one is cut into chunks; all meet the first. What is then one class needs no more
comparing; only where a family falls into several are the texts outside the largest compared with all others. A cell
multiplies out the exact weighted Jaccard similarities of its texts at once and gives back the links that span its
classes; those of all cells, joined by label propagation, are the classes. No link within a family is lost.

Cases: a text of less than ``SHINGLE`` words is one window. Null or empty texts have no windows: each is a class
of its own. Rows of equal id and different text are different documents. A null id is before all others. Equal
texts are one class. Columns that clash with new ones are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import U
from .common import cut, hot_join, release, tool

SHINGLE, LEAST = 5, 0.8
ROWS, BANDS = 4, 16
SAMPLES = ROWS * BANDS
BUCKETS = 1 << 18
#: Random values of each sample, which windows pick by their hash.
DRAWS = 1 << 14
CELL, CELL_WORDS = 256, 1 << 17
#: Windows that are multiplied out at once.
WIDE = 4096
NO_ID = -(1 << 63)
SEED = 3


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(46)).astype(np.int64)


class Frequencies:
    """For the block store: in how many documents the words of each bucket are."""

    def __init__(self):
        self.df = np.zeros(BUCKETS, np.int64)

    def keys(self, texts: list[bytes]) -> None:
        for some in B.parts(texts):
            w = B.Words(some, SEED)
            self.df += np.bincount(np.unique(w.doc * BUCKETS + _bucket(w.h)) % BUCKETS, minlength=BUCKETS)

    def sums(self) -> np.ndarray:
        return self.df


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies as weights: 1 in all of n documents."""
    return (1 + np.log((n + 1) / (df + 1))).astype(np.float32)


def vectors(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, window hash, weight, and the weight of one count: sorted by document and hash."""
    w = B.Words(texts, SEED)
    rare = idf[_bucket(w.h)]
    inside = w.inside(SHINGLE)
    who, key, top = [w.doc[inside]], [B.grams(w.h, SHINGLE)[inside]], [rare[inside]]
    for d in range(1, SHINGLE):
        top[0] = np.maximum(top[0], rare[inside + d])
    for n in range(1, SHINGLE):  # shorter texts: all their words
        some = np.flatnonzero(w.n == n)
        k, t = w.h[w.first[some]], rare[w.first[some]]
        for d in range(1, n):
            k, t = B.mix(k, w.h[w.first[some] + d]), np.maximum(t, rare[w.first[some] + d])
        who.append(some), key.append(k), top.append(t)
    who, key, top = np.concatenate(who), np.concatenate(key), np.concatenate(top)
    by = np.lexsort((key, who))
    who, key, top = who[by], key[by], top[by]
    new = np.ones(len(key), bool)
    new[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return who[at], key[at], (np.diff(np.append(at, len(key))) * top[at]).astype(np.float32), top[at]


def draws() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each sample: r and ln c (c, r of Gamma(2, 1)) and beta (uniform)."""

    def make():
        rng = np.random.default_rng(17)
        return [(rng.gamma(2, 1, DRAWS).astype(np.float32), np.log(rng.gamma(2, 1, DRAWS)).astype(np.float32), rng.random(DRAWS, np.float32)) for _ in range(SAMPLES)]

    return tool(("draws", DRAWS, SAMPLES), make)


def bands(who: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The band keys of n documents (rows; 0 for one without windows)."""
    out = np.zeros((n, BANDS), U)
    if not len(who):
        return out
    edge = np.flatnonzero(np.diff(who, prepend=-1) != 0)
    for lo in range(0, len(edge), 512):  # some documents at once: the arrays stay in the processor's cache
        starts = edge[lo : lo + 512]
        end = edge[lo + 512] if lo + 512 < len(edge) else len(who)
        k, w = key[starts[0] : end], np.log(weight[starts[0] : end])
        begin = starts - starts[0]
        sizes = np.diff(np.append(begin, len(k)))
        owner = np.repeat(np.arange(len(starts)), sizes)
        made = np.zeros((len(starts), BANDS), U)
        for j, (r_, c_, b_) in enumerate(draws()):
            pick = ((k * U(2 * j + 1) ^ (k >> U(23))) * U(0x9E3779B97F4A7C15) >> U(50)).astype(np.int64)
            r, b = r_[pick], b_[pick]
            t = np.floor(w / r + b)
            a = c_[pick] - r * (t - b) - r
            best = np.flatnonzero(a == np.minimum.reduceat(a, begin)[owner])
            first = best[np.flatnonzero(np.diff(owner[best], prepend=-1) != 0)]  # of equal ones the least hash
            sample = B.mix(k[first], t[first].astype(np.int64).astype(U) + U(j))
            band = j // ROWS
            made[:, band] = B.mix(made[:, band], sample)
        out[who[starts]] = made
    return out


def band_keys(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """The band keys of texts, some at a time."""
    return np.concatenate([np.zeros((0, BANDS), U), *(bands(*vectors(some, idf)[:3], len(some)) for some in B.parts(texts))])


def similarities(who: np.ndarray, key: np.ndarray, weight: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard similarities of the pairs of n sets (what stands on the diagonal means nothing).

    A window counted t times is t windows, so that least weights add up as products.
    """
    times = np.maximum(np.rint(weight / idf).astype(np.int64), 1)
    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    who, root = np.repeat(who, times), np.sqrt(np.repeat(weight / times, times).astype(np.float64))
    key = np.repeat(key, times) + turn.astype(U) * U(0x9E3779B97F4A7C15)
    total = np.bincount(who, root * root, n)
    by = np.argsort(key, kind="stable")
    feature = np.cumsum(np.diff(key[by], prepend=key[by[:1]]) != 0)
    shared = np.bincount(feature)[feature] > 1
    by, feature = by[shared], feature[shared]
    feature = np.cumsum(np.diff(feature, prepend=feature[:1]) != 0)
    low = np.zeros((n, n))
    for first in range(0, int(feature[-1]) + 1 if len(feature) else 0, WIDE):
        lo, hi = np.searchsorted(feature, (first, first + WIDE))
        x = np.zeros((n, min(WIDE, int(feature[-1]) + 1 - first)))
        x[who[by[lo:hi]], feature[lo:hi] - first] = root[by[lo:hi]]
        low += x @ x.T
    return low / np.maximum(total[:, None] + total[None, :] - low, 1e-300)


def spanning(similar: np.ndarray) -> list[tuple[int, int]]:
    """Links (later, earlier) that join what the pairs of the boolean matrix join."""
    root = list(range(len(similar)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((int(j), int(i)))
    return links


def _idf(spark, sums: DataFrame, n: int):
    """Broadcast: the idf of each bucket, ``BUCKETS`` numbers."""
    df = B.total(sums)
    return spark.sparkContext.broadcast(weights(np.zeros(BUCKETS, np.int64) if df is None else df, n))


def _pairwise(chunks, chunk):
    """Structs (i, j) of those cells of all two chunks in which a document of ``chunk`` stands."""
    return F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: F.struct(F.least(k, chunk).alias("i"), F.greatest(k, chunk).alias("j")))


def _chunks(n: str, words: str):
    return F.greatest(F.lit(1), F.ceil(F.col(n) / CELL), F.ceil(F.col(words) / CELL_WORDS)).cast("int")


def _dealt(chunks):
    return F.pmod(F.xxhash64("gid"), chunks).cast("int")


def _first_cells(families: DataFrame) -> DataFrame:
    """gid, family, i, j: small families share cells (family -1); of a large one, all chunks meet the first."""
    half = F.lit(0.5)
    small = (F.col("n") <= CELL * half) & (F.col("words") <= CELL_WORDS * half)
    n, words = families.filter(small).agg(F.count("*"), F.sum("n_words")).first()
    bins = max(1, -(-n // (CELL // 2)), -(-(words or 0) // (CELL_WORDS // 2)))
    shared = families.filter(small).select("gid", F.lit(-1).cast("long").alias("family"), F.pmod(F.xxhash64("family"), F.lit(bins)).cast("int").alias("i"), F.lit(-1).alias("j"))
    large = families.filter(~small).withColumn("chunks", _chunks("n", "words")).withColumn("chunk", _dealt(F.col("chunks")))
    meets = F.when((F.col("chunk") == 0) & (F.col("chunks") > 1), F.sequence(F.lit(1), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    return shared.unionByName(large.select("gid", "family", F.lit(0).alias("i"), F.explode(meets).alias("j")))


def _second_cells(families: DataFrame, found: DataFrame) -> DataFrame:
    """gid, family, i, j: of families with more than one part left, those outside the largest meet all others.

    ``found``: node, label of what the first cells linked. Cells (i, j): chunks outside the largest part; (i, -1 - j):
    one of them and one of the largest.
    """
    large = families.filter((F.col("n") > CELL // 2) | (F.col("words") > CELL_WORDS // 2)).select("gid", "family", "n_words")
    parts = large.join(found.select(F.col("node").alias("gid"), "label").hint("merge"), "gid", "left").withColumn("part", F.coalesce("label", "gid"))
    sizes = parts.groupBy("family", "part").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    by = sizes.groupBy("family").agg(F.max(F.struct("n", "words", "part")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("words").alias("words")).filter("parts > 1")
    by = by.withColumns({"out_n": F.col("n") - F.col("most.n"), "out_words": F.col("words") - F.col("most.words"), "in_n": F.col("most.n"), "in_words": F.col("most.words")})
    by = cut(by.select("family", "n", F.col("most.part").alias("largest"), _chunks("out_n", "out_words").alias("outer"), _chunks("in_n", "in_words").alias("inner")))
    at = hot_join(parts.select("gid", "family", "part"), by, "family", "n").withColumn("inside", F.col("part") == F.col("largest"))
    at = at.withColumn("chunk", F.when(F.col("inside"), _dealt(F.col("inner"))).otherwise(_dealt(F.col("outer"))))
    own = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda k: F.struct(k.alias("i"), (-1 - F.col("chunk")).alias("j")))
    others = F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda k: F.struct(F.col("chunk").alias("i"), (-1 - k).alias("j")))
    cells = F.explode(F.when(F.col("inside"), own).otherwise(F.concat(others, _pairwise(F.col("outer"), F.col("chunk"))))).alias("c")
    return at.select("gid", "family", cells).select("gid", "family", "c.i", "c.j")


def _links(cells: DataFrame, number: DataFrame, n_blocks: int, text: str, idf) -> DataFrame:
    """u, v: pairs of one cell that are similar, as many as it takes to join their classes."""
    asked = cells.withColumns({"no": F.shiftright("gid", B.PLACE), "idx": F.col("gid").bitwiseAND((1 << B.PLACE) - 1).cast("int")})
    wanted = asked.groupBy("no").agg(F.collect_list(F.struct("idx", "family", "i", "j")).alias("asked")).join(number.hint("merge"), "no")

    def fetch(batches):
        import pyarrow as pa

        for batch in batches:
            for no, uri, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                idx = sorted({r["idx"] for r in rows})
                found = dict(zip(idx, B.texts(uri, text, idx), strict=True))
                some, size = [], 0
                for k, r in enumerate(rows):
                    some.append(r)
                    size += len(found[r["idx"]])
                    if size > 1 << 20 or len(some) == 500 or k == len(rows) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array([r["family"] for r in some], pa.int64()), pa.array([r["i"] for r in some], pa.int32()), pa.array([r["j"] for r in some], pa.int32()), pa.array([(no << B.PLACE) + r["idx"] for r in some], pa.int64()), pa.array([found[r["idx"]] for r in some], pa.binary())], ["family", "i", "j", "gid", "raw"])
                        some, size = [], 0
                del found, some, rows
                release()  # the worker waits, or goes on to another operator

    def compare(table):
        import pyarrow as pa

        gids = table.column("gid").to_pylist()
        similar = similarities(*vectors(table.column("raw").to_pylist(), idf.value), len(gids)) >= LEAST
        links = spanning(similar)
        del similar
        release()
        return pa.table({"u": pa.array([gids[a] for a, _ in links], pa.int64()), "v": pa.array([gids[b] for _, b in links], pa.int64())})

    texts = B.by_block(wanted.select("no", "block", "asked"), n_blocks).mapInArrow(fetch, "family long, i int, j int, gid long, raw binary")
    return texts.groupBy("family", "i", "j").applyInArrow(compare, "u long, v long")


def _then(step: DataFrame, more: DataFrame) -> DataFrame:
    """node, label: ``step``'s labels, followed on where ``more`` (node, label) has them as nodes."""
    onward = more.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return step.join(onward.hint("merge"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for the nodes of ``links`` (u, v), by label propagation.

    In each round a node takes its least neighbour's label, followed down to a node without lesser neighbours. Links
    then go between those labels, each once, so that later rounds see only what the earlier ones haven't joined.
    """
    lesser = lambda df, a, b: df.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    first = edges = cut(lesser(links, "u", "v"))
    rounds = []
    while not edges.isEmpty():
        step = cut(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")))
        while not step.join(step.select(F.col("node").alias("label")).hint("merge"), "label", "left_semi").isEmpty():
            step = cut(_then(step, step))
        rounds.append(step)
        from_u = edges.join(step.select(F.col("node").alias("u"), F.col("label").alias("a")).hint("merge"), "u")
        from_both = from_u.join(step.select(F.col("node").alias("v"), F.col("label").alias("b")).hint("merge"), "v", "left")
        edges = cut(lesser(from_both.select("a", F.coalesce("b", "v").alias("b")), "a", "b"))
    nodes = first.select(F.col("u").alias("node")).unionByName(first.select(F.col("v").alias("node"))).distinct()
    labels = nodes.withColumn("label", F.col("node"))
    if not rounds:
        return labels
    whole = rounds.pop()
    while rounds:  # what a later round moves had no lesser neighbour before, so no node is moved in two
        whole = cut(_then(rounds.pop(), whole).unionByName(whole))
    return cut(_then(labels, whole))


def classes(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index of the stored rows with gid; and of each different text digest, n (rows that have it), the class'
    first row (``first``: id, gid) and its members (rows). Texts without words are not among them."""
    spark = docs.sparkSession
    stored = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text: F.col(text).cast("string")})
    index, sums = B.store(stored, text, Frequencies)
    index = index.withColumn("gid", B.place(F.col("no"), F.col("idx")))
    number = index.filter("idx = 0").select("no", "block")
    n_blocks, idf = max(1, number.count()), _idf(spark, sums, index.count())
    # equal texts are one document, named by the first
    heads = cut(index.filter("n_words > 0").groupBy("digest").agg(F.min(F.struct("id", "gid")).alias("first"), F.count("*").alias("n"), F.first("n_words").alias("n_words")).withColumn("gid", F.col("first.gid")))
    todo = heads.select(F.shiftright("gid", B.PLACE).alias("no"), F.col("gid").bitwiseAND((1 << B.PLACE) - 1).cast("int").alias("idx")).groupBy("no").agg(F.sort_array(F.collect_list("idx")).alias("idx")).join(number.hint("merge"), "no")

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, no, idx in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = B.texts(uri, text, idx)
                made = band_keys(raw, idf.value).view(np.int64)
                for lo in range(0, len(idx), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array([(no << B.PLACE) + i for i in idx[lo : lo + 2000]], pa.int64()), pa.array(made[lo : lo + 2000].tolist(), pa.list_(pa.int64()))], ["gid", "keys"])
                del raw, made
                release()

    drawn = B.by_block(todo.select("block", "no", "idx"), n_blocks).mapInArrow(draw, "gid long, keys array<long>")
    met = cut(drawn.select("gid", F.posexplode("keys").alias("band", "k")).select("gid", F.xxhash64("band", "k").alias("key")))
    least = met.groupBy("key").agg(F.min("gid").alias("v"), F.count("*").alias("n")).filter("n > 1")
    found = components(hot_join(met, least, "key", "n").select(F.col("gid").alias("u"), "v").filter("u <> v").distinct())
    members = found.select(F.col("node").alias("gid"), F.col("label").alias("family")).join(heads.select("gid", "n_words").hint("merge"), "gid")
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    families = cut(hot_join(members, sizes, "family", "n"))
    links = cut(_links(_first_cells(families), number, n_blocks, text, idf))
    labels = components(links)
    more = cut(_second_cells(families, labels))
    if not more.isEmpty():
        labels = components(links.unionByName(cut(_links(more, number, n_blocks, text, idf))))
    known = cut(heads.join(labels.select(F.col("node").alias("gid"), "label").hint("merge"), "gid", "left").withColumn("label", F.coalesce("label", "gid")))
    of_class = known.groupBy("label").agg(F.min("first").alias("of"), F.sum("n").alias("members"), F.count("*").alias("texts"))
    return index, hot_join(known.select("digest", "n", "label"), of_class, "label", "texts").select("digest", "n", F.col("of").alias("first"), "members")


def label(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of its class), members (rows of the class), kept (its first row)."""
    index, known = classes(docs.select("doc_id", text), text)
    name = lambda c: F.when(c != NO_ID, c)
    rows = index.filter("n_words > 0").select("id", "gid", "digest")
    full = hot_join(rows, cut(known), "digest", "n").select(name(F.col("id")).alias("doc_id"), name(F.col("first.id")).alias("class_id"), "members", (F.col("gid") == F.col("first.gid")).alias("kept"))
    bare = index.filter("n_words = 0").select(name(F.col("id")).alias("doc_id"), name(F.col("id")).alias("class_id"), F.lit(1).cast("long").alias("members"), F.lit(True).alias("kept"))
    return full.unionByName(bare)


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` but one document of each class only, its first."""
    index, known = classes(docs, text)
    stay = known.select(F.col("first.gid").alias("gid")).distinct().unionByName(index.filter("n_words = 0").select("gid"))
    at = stay.select(F.shiftright("gid", B.PLACE).alias("no"), F.col("gid").bitwiseAND((1 << B.PLACE) - 1).cast("int").alias("idx")).groupBy("no").agg(F.sort_array(F.collect_list("idx")).alias("idx"))
    number = index.filter("idx = 0").select("no", "block")
    names = docs.columns

    def take(batches):
        for batch in batches:
            for uri, idx in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from B.load(uri, names).take(idx).combine_chunks().to_batches(max_chunksize=500)
                release()

    return B.by_block(at.join(number.hint("merge"), "no").select("block", "idx"), max(1, number.count())).mapInArrow(take, docs.schema)
