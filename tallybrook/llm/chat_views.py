"""Chat formatting: every participant's view of a dialogue.

For each conversation and each speaker in it, the dialogue is rendered with that speaker as the assistant,
the other speakers as named users, and a mask over what the assistant says, its end mark included. The role
``system`` is no speaker and stays what it is in every view. Marks inside texts and names get a space, so that no
text can end its turn or begin another; line ends inside names become spaces.

A view is given in parts of ``TURNS`` turn numbers, which join to the whole text, so that one endless
conversation is spread over many tasks. A part of more than ``CROWD`` utterances, which share turn numbers, is cut
into pieces of ``TURNS`` utterances: those rows alone are sorted by ranges and numbered, so neither a part nor a
conversation is ever one task. Spans of the mask count code points from the start of their part or piece.

Cases: rows alike in conversation, turn, role and text are one utterance. Several in one turn follow by role,
then text. A null turn comes first, as part -1; a null text is empty; a null role is a user without a name, comes
before other roles and gets no view. A null conversation is a conversation. One without speakers has no view.
Further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TURNS, CROWD = 64, 256
BEGIN, END = "<|im_start|>", "<|im_end|>"
#: What both marks begin with, and what stands for it in texts.
MARK, PLAIN = "<|im_", "<| im_"
#: Parts, or pieces of a part, that meet their speakers in one group.
STRETCH = 64


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    found = [a[c].eqNullSafe(b[f"_{c}"]) for c in columns]
    return found[0] if len(found) == 1 else found[0] & _same(a, b, *columns[1:])


def _marked(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"_{c}" if c in columns else c) for c in df.columns))


def _pieces(rows: DataFrame) -> DataFrame:
    """The utterances of crowded parts with ``piece``."""
    order = ("conv_id", "part", "turn", "role", "text")
    dealt = rows.dropDuplicates().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("range", F.shiftright("_at", 33)))
    # where a part begins in each range, and how much of it came before
    sizes = dealt.groupBy("conv_id", "part", "range").agg(F.min("_at").alias("least"), F.count("*").alias("n"))
    of_part = Window.partitionBy("conv_id", "part")
    before = F.coalesce(F.sum("n").over(of_part.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = _marked(sizes.withColumns({"before": before, "all": F.sum("n").over(of_part)}).drop("n"), "conv_id", "part", "range")
    placed = dealt.join(starts.hint("merge"), _same(dealt, starts, "conv_id", "part", "range"))
    piece = F.when(F.col("all") > CROWD, F.floor((F.col("before") + F.col("_at") - F.col("least")) / TURNS)).otherwise(0).cast("long")
    return placed.select("conv_id", "part", "turn", "role", "text", piece.alias("piece"))


def _parts(rows: DataFrame) -> DataFrame:
    """conv_id, part, piece, turns (in order)."""
    counts = rows.groupBy("conv_id", "part").count()
    crowded = cut(counts.filter(F.col("count") > CROWD))
    turn = F.struct("turn", "role", "text")
    key = ("conv_id", "part")
    some = lambda df: df.groupBy("conv_id", "part", "piece").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    if crowded.isEmpty():
        return some(rows.withColumn("piece", F.lit(0).cast("long")))
    # parts of more than a five-thousandth of all rows, 5000 at most, are found by broadcast, so none is one task
    often = max(CROWD, (counts.agg(F.sum("count")).first()[0] or 0) // 5000)
    named = _marked(crowded, *key)
    hot, warm = F.broadcast(named.filter(F.col("count") > often)), named.filter(F.col("count") <= often).hint("merge")
    rest = rows.join(hot, _same(rows, hot, *key), "left_anti")
    full = rows.join(hot, _same(rows, hot, *key), "left_semi").unionByName(rest.join(warm, _same(rest, warm, *key), "left_semi"))
    cold = rest.join(warm, _same(rest, warm, *key), "left_anti")
    return some(cold.withColumn("piece", F.lit(0).cast("long")).unionByName(_pieces(full)))


def views(conversations: DataFrame) -> DataFrame:
    """conv_id, participant, part, piece, n_turns, text, mask (``start:end`` spans joined by commas)."""
    turn = F.col("turn").cast("long")
    rows = conversations.select("conv_id", turn.alias("turn"), F.coalesce(F.floor(turn / TURNS), F.lit(-1)).cast("long").alias("part"), "role", F.coalesce("text", F.lit("")).alias("text"))
    parts = cut(_parts(rows).withColumns({"stretch": F.floor(F.col("part") / STRETCH), "lap": F.floor(F.col("piece") / STRETCH)}))
    # one short row for each conversation and speaker, and for each stretch of it
    speakers = rows.filter(F.col("role").isNotNull() & (F.col("role") != "system")).groupBy("conv_id", F.col("role").alias("participant")).agg(F.lit(1).alias("_one")).drop("_one")
    stretches = _marked(parts.select("conv_id", "stretch", "lap").distinct(), "conv_id", "stretch", "lap")
    wanted = speakers.join(stretches.hint("merge"), _same(speakers, stretches, "conv_id")).drop("conv_id")
    seen = parts.join(wanted.hint("merge"), _same(parts, wanted, "conv_id", "stretch", "lap")).drop("_conv_id", "_stretch", "_lap")

    def label(role: Column) -> Column:
        name = F.replace(F.translate(role, "\n\r", "  "), F.lit(MARK), F.lit(PLAIN))
        return F.when(role.isNull(), "user").when(role == F.col("participant"), "assistant").when(role == "system", "system").otherwise(F.concat(F.lit("user name="), name))

    head = F.transform("turns", lambda t: F.concat(F.lit(BEGIN), label(t["role"]), F.lit("\n")))
    body = F.transform("turns", lambda t: F.concat(F.replace(t["text"], F.lit(MARK), F.lit(PLAIN)), F.lit(END)))
    seen = seen.withColumns({"_head": head, "_body": body})
    seen = seen.withColumn("_size", F.zip_with("_head", "_body", lambda h, b: F.struct(F.length(h).cast("long").alias("h"), F.length(b).cast("long").alias("b"))))
    # a part is short, so adding up the sizes before each turn anew is cheap
    before = lambda i: F.aggregate(F.slice("_size", F.lit(1), i), F.lit(0).cast("long"), lambda a, s: a + s["h"] + s["b"] + 1)
    spans = F.transform("turns", lambda t, i: F.when(t["role"] == F.col("participant"), F.concat_ws(":", before(i) + F.get("_size", i)["h"], before(i) + F.get("_size", i)["h"] + F.get("_size", i)["b"])))
    return seen.select(
        "conv_id",
        "participant",
        "part",
        "piece",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.zip_with("_head", "_body", lambda h, b: F.concat(h, b, F.lit("\n"))), "").alias("text"),
        F.array_join(spans, ",").alias("mask"),
    )
