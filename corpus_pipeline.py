"""The corpus pipeline: five stages, each on all rows that the one before kept.

Quality rules reject documents; of near-duplicates one stays; repeated passages are cut out of texts (documents
of which nothing is left go); sources are mixed to their weights (a document may be taken up to three times, or
not at all); what remains is encoded and decoded. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import mixing, near_dup, quality, spm, substring
from tallybrook.llm.common import cut, table
from tallybrook.llm.queries import tokenizer


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with all columns that a stage doesn't use in one, where no column that it makes replaces them."""
    rest = [F.col(c) for c in docs.columns if c not in used]
    return docs.select(*used, *([F.struct(*rest).alias("_rest")] if rest else []))


def _whole(made: DataFrame, docs: DataFrame, *used: str, **more: Column) -> DataFrame:
    """The columns of ``docs`` again; ``more`` replaces some of them."""
    found = {c: F.col(c) if c in used else F.col(f"_rest.{c}") for c in docs.columns}
    return made.select(*(more.get(c, found[c]).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(_apart(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return _whole(judged.filter("kept"), docs, "doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = substring.dedup(_apart(docs, "doc_id", "text")).filter("n_words > n_removed")
    size = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return _whole(left, docs, "doc_id", "text", **size)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    used = ("doc_id", "source", "text")
    mixed = mixing.mix(_apart(docs, *used)).filter("times > 0")
    return _whole(mixed.withColumn("_turn", F.explode(F.sequence(F.lit(1), "times"))), docs, *used)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spm.encode_decode(docs.select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Sampling by floating-point hashes, suffix trees and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
