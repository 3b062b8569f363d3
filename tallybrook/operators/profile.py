"""Profiles of fields: approximate distinct values, nulls, missing and empty ones, and the total.

Every input becomes an array of (state, encoded) for its fields, which one exploded group-by per register and per
state turns into profiles: a row is read once whatever the number of fields.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_of
from . import hll

MISSING, NULL, EMPTY, PRESENT = "missing", "null", "empty", "present"
STATE = "array<struct<state:string,encoded:binary>>"


def summarise(cells: DataFrame, fields: list[str], p: int = hll.DEFAULT_P) -> DataFrame:
    """field, approx_unique, nulls, missing, empty, total, from ``cells`` (ARRAY of (state, encoded), one for each field)."""
    hll.check_precision(p)
    if not fields:
        raise ValueError("fields are needed")
    each = cells.select(F.posexplode("cells").alias("no", "c")).select("no", "c.state", "c.encoded")
    hashed = each.withColumn("h", hash_of(F.when(F.col("state") == PRESENT, F.col("encoded"))))
    # registers and counters of all fields in one aggregation: absent values share one register row for each state
    slot = F.when(F.col("h").isNotNull(), hll.index_of(F.col("h"), p))
    part = hashed.select("no", "state", slot.alias("idx"), F.when(F.col("h").isNotNull(), hll.rank_of(F.col("h"), p)).alias("rank"))
    regs = part.groupBy("no", "state", "idx").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    ranks = regs.groupBy("no", "state", "rank").agg(F.count("*").alias("registers"), F.sum("n").alias("n"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0))
    one = ranks.groupBy("no").agg(
        of(NULL).alias("nulls"),
        of(MISSING).alias("missing"),
        of(EMPTY).alias("empty"),
        F.sum("n").alias("total"),
        F.array_sort(F.collect_list(F.when(F.col("state") == PRESENT, F.struct("rank", F.col("registers").alias("n"))))).alias("c"),
    )
    m = 1 << p
    zeros = F.lit(m) - F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    total = F.aggregate("c", zeros.cast("double"), lambda a, x: a + x["n"] * F.pow(F.lit(2.0), -x["rank"]))
    raw = F.lit(hll.ALPHAS.get(m, 0.7213 / (1 + 1.079 / m)) * m * m) / total
    best = F.when((raw <= 2.5 * m) & (zeros > 0), F.lit(float(m)) * F.ln(F.lit(float(m)) / F.nullif(zeros, F.lit(0)))).otherwise(raw)
    names = cells.sparkSession.createDataFrame(list(enumerate(fields)), "no int, field string")
    found = names.join(one.withColumn("unique", F.floor(best + 0.5).cast("long")), "no", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return found.orderBy("no").select("field", zero("unique").alias("approx_unique"), zero("nulls").alias("nulls"), zero("missing").alias("missing"), zero("empty").alias("empty"), zero("total").alias("total"))


def _cell(state: Column, encoded: Column) -> Column:
    return F.struct(state.alias("state"), encoded.cast("binary").alias("encoded"))


def _text_cell(value: Column, absent: str = MISSING) -> Column:
    return _cell(F.when(value.isNull(), absent).when(F.length(value) == 0, EMPTY).otherwise(PRESENT), value.cast("string"))


def frame(df: DataFrame, fields: list[str], p: int = hll.DEFAULT_P) -> DataFrame:
    """Of typed columns, each as its text. A null is a null."""
    return summarise(df.select(F.array(*(_text_cell(F.col(f).cast("string"), NULL) for f in fields)).cast(STATE).alias("cells")), fields, p)


def delimited_lines(lines: DataFrame, delimiter: str, ordinals: list[int], p: int = hll.DEFAULT_P, value: str = "value") -> DataFrame:
    """Of 1-based fields of delimited lines; a line too short has the field missing. One carriage return is taken off."""
    if any(n < 1 for n in ordinals):
        raise ValueError("fields are numbered from 1")
    if not delimiter:
        raise ValueError("a delimiter is needed")
    parts = F.split(F.regexp_replace(F.col(value).cast("string"), "\r\\z", ""), re.sub(r"([^A-Za-z0-9\s])", r"\\\1", delimiter), -1)
    split = lines.select(parts.alias("parts"))
    return summarise(split.select(F.array(*(_text_cell(F.get("parts", F.lit(n - 1))) for n in ordinals)).cast(STATE).alias("cells")), [str(n) for n in ordinals], p)


def delimited(spark: SparkSession, paths, delimiter: str, ordinals: list[int], p: int = hll.DEFAULT_P) -> DataFrame:
    return delimited_lines(spark.read.option("lineSep", "\n").text(paths), delimiter, ordinals, p)


def csv(spark: SparkSession, paths: list[str], columns: list[str], p: int = hll.DEFAULT_P) -> DataFrame:
    """Of columns that each file's own header names. Short and long rows raise; blanks are empty, not null."""
    if not columns:
        raise ValueError("columns are needed")
    cells = None
    for path in [paths] if isinstance(paths, str) else paths:
        head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
        for c in columns:
            if c not in head.columns:
                raise ValueError(f"{path}: no column {c!r}")
        some = head.select(F.array(*(_text_cell(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in columns)).cast(STATE).alias("cells"))
        cells = some if cells is None else cells.unionByName(some)
    return summarise(cells, columns, p)


def path_parts(path: str) -> list[str]:
    parts = path.removeprefix(".").split(".")
    if parts == [""]:
        raise ValueError("a path needs a name")
    return parts


class _Number(str):
    """A JSON number as it is spelt."""


def encode_json(value) -> str:
    """Compact JSON with sorted keys, numbers as spelt, and < > & and the two line separators escaped."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{encode_json(k)}:{encode_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(encode_json, value)) + "]"
    text = json.dumps(value, ensure_ascii=False)
    if isinstance(value, str):
        for c in "<>&\u2028\u2029":
            text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def json_cells(line: str, paths: list[list[str]]) -> list[tuple[str, bytes | None]]:
    def refuse(text):
        raise ValueError(f"invalid number {text}")

    root = json.loads(line, parse_int=_Number, parse_float=_Number, parse_constant=refuse)
    out = []
    for parts in paths:
        value, found = root, True
        for name in parts:
            if not isinstance(value, dict) or name not in value:
                found = False
                break
            value = value[name]
        if not found:
            out.append((MISSING, None))
        elif value is None:
            out.append((NULL, None))
        elif isinstance(value, str) and not isinstance(value, _Number):
            out.append((PRESENT, value.encode("utf-8", "replace")) if value else (EMPTY, None))
        else:
            out.append((PRESENT, encode_json(value).encode("utf-8", "replace")))
    return out


def json_lines(lines: DataFrame, paths: list[str], p: int = hll.DEFAULT_P, value: str = "value") -> DataFrame:
    """Of dotted paths into one JSON value a line. Numbers count as spelt; a line that isn't one value raises."""
    if not paths:
        raise ValueError("paths are needed")
    split = [path_parts(x) for x in paths]

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("state", pa.string()), ("encoded", pa.binary())]))
        for batch in batches:
            rows = []
            for line in batch.column(0).to_pylist():
                try:
                    rows.append([{"state": s, "encoded": e} for s, e in json_cells(line, split)])
                except ValueError as e:
                    raise ValueError(f"invalid JSON line {line[:80]!r}: {e}") from None
            yield pa.RecordBatch.from_arrays([pa.array(rows, kind)], ["cells"])

    cells = lines.filter(F.col(value).isNotNull()).select(F.col(value).cast("string")).mapInArrow(run, f"cells {STATE}")
    return summarise(cells, paths, p)


def json_files(spark: SparkSession, files, paths: list[str], p: int = hll.DEFAULT_P) -> DataFrame:
    return json_lines(spark.read.option("lineSep", "\n").text(files), paths, p)
