"""Quality rules: n-gram likelihood ratios between trusted texts and the whole corpus.

Words and pairs of words are hashed into buckets. Two multinomials over the buckets are counted, one over the
trusted documents and one over all. A document's score is the mean over its n-grams of
log(p_trusted / p_corpus); it is kept if the score is no less than a threshold. Nothing is drawn at random, so
every document has one verdict. The ratios are rounded to whole 2^-20ths and added as integers, so that the
order of adding doesn't matter.

There is a bucket for every ``PER_BUCKET`` n-grams of the trusted texts: what can be told apart follows from how
often they show it. So the table grows with the labelled documents, and stops at ``MOST_BUCKETS``: its
ratios, 1 MB at most, are an array that every task holds, and scoring shuffles nothing.

The trusted texts are those of all documents labelled good (``trusted``: of so many at most, the first in the order
of a hash of their id). Their list of ids is broadcast up to ``SENT`` ids; a longer one is joined by shuffling the texts.
The threshold is the quantile ``loss`` of the scores that the trusted texts, all of them, get from a model of the other
trusted ones, as a good document that isn't trusted would: about that part of the good documents is lost. It is found
by counting scores in bins, so that no task holds them all. With fewer than ``FEW`` of them that pass the base rules it
is ``LEAST``.

Before that, base rules reject documents that are too short or repeat themselves.

Cases: a null text has no words and fails the base rules. Without trusted texts all ratios are 0 and the base
rules alone decide. Repeated rows are each counted and judged. Further columns are kept unless they clash with
a column made here, which replaces them. A label given twice counts once; an id with contradicting labels is
not trusted. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, constant, cut, let, words

#: The least and the largest number of buckets, and the trusted texts' n-grams for each bucket between.
BUCKETS, MOST_BUCKETS, PER_BUCKET = 10_000, 1 << 18, 16
#: Trusted ids that are broadcast (some 64 bytes each in an executor).
SENT = 1 << 21
#: Added to each bucket's count.
PRIOR = 0.5
#: The part of the good documents that the threshold may lose.
LOSS = 0.005
#: With fewer trusted texts than ``FEW``, the least mean ratio of a kept document.
FEW, LEAST = 30, -0.06
UNIT = 1 << 20
SYMBOLS = "[#*$%&|<>]"


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _pairs(h: Column) -> Column:
    """A hash of each element with the next. Of pairs of words again: of three words."""
    n = F.size(h) - 1
    return F.when(n > 0, F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<long>"))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(text: Column) -> Column:
    return let(_word_hashes(text), lambda h: F.concat(h, _pairs(h)))


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= SENT else ids


def _trusted(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """Adds good: whether the row's doc_id is in ``trusted_ids``."""
    ids = _sent(trusted_ids.select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(ids, F.col("doc_id") == F.col("_id"), "left").withColumn("good", F.col("_id").isNotNull()).drop("_id")


def counts(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, corpus, trusted: n-grams of all documents, and of those whose doc_id is in ``trusted_ids``."""
    each = _trusted(docs.select("doc_id", F.col(text).alias("_text")), trusted_ids).select("good", F.explode(_grams(F.col("_text"))).alias("h"))
    return each.groupBy(_bucket(F.col("h"), buckets).alias("bucket")).agg(F.count("*").alias("corpus"), F.count_if("good").alias("trusted"))


def trusted_sample(labels: DataFrame, most: int | None = None) -> DataFrame:
    """Ids labelled good and never bad: all, or at most ``most``, the first in the order of their hash."""
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("least"), F.max(F.coalesce("toxic", F.lit(0)) if "toxic" in labels.columns else F.lit(0)).alias("toxic"))
    found = good.filter((F.col("least") == 1) & (F.col("toxic") == 0)).select("doc_id")
    return found if most is None else found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _log_ratio(t: Column, trusted: Column, c: Column, corpus: int, buckets: int) -> Column:
    log = lambda n, total: F.log((n + F.lit(PRIOR)) / (total + F.lit(PRIOR * buckets)))
    return F.rint(F.lit(UNIT) * (log(t, trusted) - log(c, F.lit(corpus)))).cast("int")


def model(counted: DataFrame, buckets: int) -> DataFrame:
    """One row: corpus, trusted, ratio (arrays with a place for each bucket; ratios in 2^-20ths)."""
    corpus, trusted = counted.agg(F.sum("corpus"), F.sum("trusted")).first()
    every = counted.sparkSession.range(buckets).select(F.col("id").cast("int").alias("id")).join(counted.hint("merge"), F.col("id") == F.col("bucket"), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ratio = _log_ratio(number("trusted"), F.lit(trusted), number("corpus"), corpus, buckets) if trusted else F.lit(0)
    one = every.select(F.struct(F.col("id").alias("bucket"), number("corpus").alias("corpus"), number("trusted").alias("trusted"), ratio.alias("ratio")).alias("b")).agg(F.sort_array(F.collect_list("b")).alias("b"))
    return cut(one.select("b.corpus", "b.trusted", "b.ratio"))


def _repeat_words(three: Column) -> Column:
    """Words inside three-word windows (given as their hashes) that the text holds twice or more.

    Windows are sorted by the upper bits of their hash with their position below; those that equal a neighbour in
    all 64 bits repeat. Near linear in the text, however long.
    """

    def sorted_windows(bits: Column) -> Column:
        return F.sort_array(F.transform(three, lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits).bitwiseOR(i.cast("long"))))

    def starts(s: Column, bits: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
        whole = lambda x: F.get(three, place(x))
        upper = lambda x: F.call_function("shiftright", x, bits)

        def same(a: Column, j: Column) -> Column:
            b = F.get(s, j)
            return F.coalesce((upper(a) == upper(b)) & (whole(a) == whole(b)), F.lit(False))

        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), place))

    def covered(p: Column) -> Column:
        n = F.size(p)
        gaps = F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), lambda a, b: F.least(F.lit(3), b - a).cast("long"))
        return F.when(n > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))

    bits = F.length(F.bin(F.size(three).cast("long")))
    marked = let(bits, lambda k: let(sorted_windows(k), lambda s: let(starts(s, k), covered)))
    return F.when(F.size(F.array_distinct(three)) == F.size(three), F.lit(0).cast("long")).otherwise(marked)


def measure(docs: DataFrame, text: str = "text", worth=None) -> DataFrame:
    """Adds the base figures, base_failed and n_grams; with ``worth`` (of a hash) also _sum, over all n-grams."""
    found = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(found, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    zero = F.lit(0).cast("long")
    sum_of = lambda x: F.aggregate(x, zero, lambda a, h: a + worth(h)) if worth else zero
    of_pairs = lambda h: lambda p: F.struct(F.size(h).cast("long").alias("n"), let(_pairs(p), _repeat_words).alias("repeats"), (sum_of(h) + sum_of(p)).alias("sum"))
    df = docs.withColumns(
        {
            "_h": let(_word_hashes(F.col(text)), lambda h: let(_pairs(h), of_pairs(h))),
            "_dup": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "_chars": F.length(F.regexp_replace(found, SPACES, "")).cast("long"),
            "_symbols": F.regexp_count(found, F.lit(SYMBOLS)).cast("long"),
        }
    )
    n, repeats = F.col("_h.n"), F.col("_h.repeats")
    made = {"n_words": n, "word_chars": F.col("_chars"), "n_symbols": F.col("_symbols"), "n_dup_lines": F.col("_dup"), "n_repeat_words": repeats, "base_failed": (n < 50) | (100 * repeats > 50 * n)}
    made |= {"n_grams": n + F.greatest(n - 1, zero)} | ({"_sum": F.col("_h.sum")} if worth else {})
    return df.withColumns(made).drop("_h", "_dup", "_chars", "_symbols")


def held_out(trusted: DataFrame, table: DataFrame, totals: tuple[int, int], text: str, buckets: int) -> DataFrame:
    """score: those of trusted texts, each under a model of the other trusted ones; null where the base rules failed.

    A text's buckets are sorted, so that those of one number follow each other.
    """
    corpus, all_trusted = totals
    c, t = constant(table, "corpus"), constant(table, "trusted")

    def total(b: Column) -> Column:
        """Of sorted buckets: each run's length times its ratio without the run, added up."""
        begin = F.filter(_upto(F.size(b)), lambda i: (i == 0) | (F.get(b, i) != F.get(b, i - 1)))
        others = F.lit(all_trusted) - F.col("n_grams")

        def worth(i: Column, k: Column) -> Column:
            at, own = F.get(b, i), k - i
            return own * _log_ratio(F.get(t, at) - own, others, F.get(c, at), corpus, buckets)

        runs = let(begin, lambda x: F.zip_with(x, F.concat(F.slice(x, F.lit(2), F.size(x)), F.array(F.size(b))), worth))
        return F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x)

    in_order = F.sort_array(F.transform(_grams(F.col(text)), lambda h: _bucket(h, buckets)))
    # no filter: below it the base figures would be made again
    return trusted.select(F.when(~F.col("base_failed"), let(in_order, total) / F.col("n_grams") / UNIT).alias("score"))


def quantile(scores: DataFrame, part: float) -> tuple[int, float | None]:
    """How many scores there are, and the one of rank ``part``, or the least of those within 2^-20 of it.

    They are counted in wide bins, then those of one wide bin in narrow ones.
    """
    narrow = F.floor(F.col("score") * UNIT)
    wide = F.shiftright(narrow, 10)
    left = scores.filter("score is not null")

    def binned(rows: DataFrame, bin: Column) -> list[tuple]:
        return sorted(map(tuple, rows.groupBy(bin.alias("bin")).agg(F.count("*"), F.min("score")).collect()))

    def at(bins: list[tuple], rank: int) -> tuple:
        for bin, n, least in bins:
            if rank < n:
                return bin, rank, least
            rank -= n
        raise IndexError(rank)

    bins = binned(left, wide)
    n = sum(b[1] for b in bins)
    if not n:
        return 0, None
    bin, rank, _ = at(bins, int(part * (n - 1)))
    return n, at(binned(left.filter(wide == bin), narrow), rank)[2]


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", least: float | None = None, trusted: int | None = None, loss: float = LOSS) -> DataFrame:
    """``docs`` with the columns of ``measure``, score (the mean ratio; null without n-grams) and kept.

    kept: base rules passed and the score is no less than ``least`` (None: as the trusted texts have it).
    """
    plain = docs.drop("score", "kept")
    ids = cut(trusted_sample(labels, trusted))
    good = cut(plain.select("doc_id", F.col(text).alias("_text")).join(_sent(ids), "doc_id", "left_semi").select("_text"))
    shown = good.agg(F.sum(F.greatest(2 * F.size(words(F.col("_text"))) - 1, F.lit(0)))).first()[0] or 0
    buckets = max(BUCKETS, min(MOST_BUCKETS, shown // PER_BUCKET))
    counted = cut(counts(plain, ids, text, buckets))
    table = model(counted, buckets)
    if least is None:
        totals = tuple(x or 0 for x in counted.agg(F.sum("corpus"), F.sum("trusted")).first())
        n, found = quantile(cut(held_out(measure(good, "_text"), table, totals, "_text", buckets)), loss)
        least = found if n >= FEW else LEAST
    ratio = constant(table, "ratio")
    df = measure(plain, text, lambda h: F.get(ratio, _bucket(h, buckets)))
    n = F.col("n_grams")
    made = {"score": F.when(n > 0, F.col("_sum") / n / UNIT), "kept": ~F.col("base_failed") & (F.col("_sum") >= n * F.lit(least) * UNIT)}
    return df.withColumns(made).drop("_sum")
