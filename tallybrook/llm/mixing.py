"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and served in that order, up to ``REPEATS`` times
over. A serving's virtual finish time is the words its source has then served, divided by the source's target,
so all sources run at the pace of their targets. Servings are ordered by finish time over all sources and cut
where the total budget is used up. A serving that would bring its source past its target by more than half the
document is not in the queue: what one source can't use, for want of small documents, doesn't swell the others.

Sources by code point, null last, weigh 5, 2, 1, 5, ... of the total; a target stops at ``REPEATS`` times the
source's size and the excess goes to the others by weight until none is above (water filling).

No source, however large, is ordered in one task: running sums are taken over about sqrt(n) blocks of hash
values first, then inside each block. Likewise the cut: first over blocks of finish time, then inside the one
block where the budget ends. Only figures of single rows pass through the driver.

Cases: a null source is a source, the last. A null text has size 0 and is never served, as are documents of a
source without words. Repeated rows are each served. A null id is hashed as ``null``. Further columns are kept
unless they clash with a column made here, which replaces them. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix-1"


def _sized(docs: DataFrame, text: str) -> DataFrame:
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    # '=' before a name keeps it apart from null, and '~' sorts behind it
    return docs.withColumns({"size": F.size(words(F.col(text))).cast("long"), "_order": order, "_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))})


def targets(sized: DataFrame) -> DataFrame:
    """_source, source_size, target: a row for each source."""
    sums = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_name, all_rows = Window.orderBy("_source"), Window.partitionBy(F.lit(1))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS)).cast("double")
    t = sums.withColumns({"w": weight, "total": F.sum("source_size").over(all_rows), "most": REPEATS * F.col("source_size")})
    # in the order of most / w, a source stays below its cap once the rest can take all that is left at equal pace
    fill = Window.orderBy(F.col("most") / F.col("w"), "_source")
    t = t.withColumns({"full": F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "rest": F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    t = t.withColumn("pace", (F.col("total") - F.col("full")) / F.col("rest"))
    pace = F.max(F.when(F.col("pace") * F.col("w") <= F.col("most"), F.col("pace"))).over(all_rows)  # the first that fits is the largest
    return t.withColumn("pace", pace).select("_source", "source_size", F.least(F.col("most").cast("double"), F.col("pace") * F.col("w")).alias("target"))


@dataclass
class Plan:
    blocks: int
    #: _source, _block, offset, source_size, target
    offsets: DataFrame
    #: Finish time, source and order of the last serving that is taken; None: all are.
    last: tuple | None


def _block(order: Column, blocks: int) -> Column:
    return F.floor(F.conv(F.substring(order, 1, 12), 16, 10).cast("double") / float(16**12) * blocks).cast("int")


def _served(sized: DataFrame, plan: Plan) -> DataFrame:
    """Adds the sums up to each document in its source, and the source's figures."""
    df = sized.withColumn("_block", _block(F.col("_order"), plan.blocks)).join(plan.offsets.hint("merge"), ["_source", "_block"])
    inside = Window.partitionBy("_source", "_block").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_sum", F.col("offset") + F.sum("size").over(inside))


def _finish(turn: int) -> Column:
    """The virtual finish time of a serving; null if its source is nearer to its target without it."""
    upto = F.col("source_size") * turn + F.col("_sum")
    return F.when(2 * upto - F.col("size") <= 2 * F.col("target"), upto / F.col("target"))


def plan(docs: DataFrame, text: str = "text") -> Plan:
    slim = cut(_sized(docs.select("doc_id", "source", F.col(text).alias("_text")), "_text").drop("_text", "source"))
    n = slim.count()
    blocks = max(16, 8 * math.isqrt(n))
    sums = slim.groupBy("_source", _block(F.col("_order"), blocks).alias("_block")).agg(F.sum("size").alias("s"))
    before = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.withColumn("offset", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s").join(targets(slim), "_source"))
    made = Plan(blocks, offsets, None)
    served = _served(slim, made).filter("size > 0 and target > 0")
    items = served.select("size", "_source", "_order", "doc_id", F.explode(F.array(*(_finish(i) for i in range(REPEATS)))).alias("finish")).filter("finish is not null")
    items = items.withColumn("slot", F.floor(F.col("finish") * blocks))
    budget = slim.agg(F.sum("size")).first()[0] or 0
    slots = items.groupBy("slot").agg(F.sum("size").alias("s"))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = slots.withColumn("upto", F.sum("s").over(upto)).filter(F.col("upto") > budget).orderBy("slot").first()
    if over is None:
        return made
    row = Window.orderBy("finish", "_source", "_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = items.filter(F.col("slot") == over["slot"]).withColumn("upto", F.lit(over["upto"] - over["s"]) + F.sum("size").over(row)).filter(F.col("upto") <= budget)
    last = inside.orderBy(F.col("upto").desc(), F.col("finish").desc(), F.col("_source").desc(), F.col("_order").desc()).first()
    made.last = (last["finish"], last["_source"], last["_order"]) if last else (over["slot"] / blocks, "", "")
    return made


def mix(docs: DataFrame, text: str = "text", made: Plan | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, times (how often the mix takes the document) and taken (words)."""
    made = made or plan(docs, text)
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "times", "taken", "offset")]
    df = _served(_sized(docs.select(*kept), text), made)

    def within(turn: int) -> Column:
        if made.last is None:
            return F.when(_finish(turn).isNotNull(), 1).otherwise(0)
        finish, source, order = made.last
        place = F.struct(_finish(turn).alias("f"), F.col("_source").alias("s"), F.col("_order").alias("o"))
        return F.when(_finish(turn).isNotNull() & (place <= F.struct(F.lit(finish).alias("f"), F.lit(source).alias("s"), F.lit(order).alias("o"))), 1).otherwise(0)

    times = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((within(i) for i in range(REPEATS)), F.lit(0))).otherwise(0)
    df = df.withColumn("times", times.cast("int"))
    return df.select(*kept, "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))
