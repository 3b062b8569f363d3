"""Sinks: records, JSON, tab-separated values, aligned tables and files of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, column: str = "value", overwrite: bool = False) -> None:
    """One record a line, always with a line feed."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", "\n").text(path)


def json_object(*columns: str) -> Column:
    """A JSON object of the columns, with < > & escaped."""
    text = F.to_json(F.struct(*columns))
    for c in "<>&":
        text = F.replace(text, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return text


def omit_zero(df: DataFrame, *columns: str) -> DataFrame:
    """Zeros as null, which JSON leaves out."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in columns})


def json_array(rows: DataFrame, order: str, most: int = 10_000) -> DataFrame:
    """One row, json: the rows as an array in the order of a column. More than ``most`` rows fail: ``write_json_array`` writes those."""
    some = rows.limit(most + 1).select(F.struct(order, json_object(*rows.columns).alias("j")).alias("s"))
    text = F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["j"]), ","), F.lit("]"))
    failed = F.raise_error(F.lit(f"more than {most} rows for a JSON array: use write_json_array")).cast("string")
    return some.agg(F.array_sort(F.collect_list("s")).alias("s")).select(F.when(F.size("s") > most, failed).otherwise(text).alias("json"))


def write_json_array(rows: DataFrame, order: str, path: str) -> None:
    """All rows as one array to a file, in the order of a column. The driver holds one partition at a time."""
    lines = rows.select(F.col(order).alias("o"), json_object(*rows.columns).alias("j")).orderBy("o", "j").select("j")

    def pieces():
        yield b"["
        for i, r in enumerate(lines.toLocalIterator()):
            yield (",\n" * (i > 0) + r["j"]).encode()
        yield b"]\n"

    write_pieces(pieces(), path)


def tsv_lines(df: DataFrame) -> DataFrame:
    """value: the rows as tab-separated lines, without quoting. The header is ``"\\t".join(df.columns)``."""
    return df.select(F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), "\t").alias("value"))


def text_table(rows: list[dict], header: list[str]) -> str:
    """Aligned columns, two spaces apart, of rows that are on the driver already."""
    cells = [header, *([str(r[h]) for h in header] for r in rows)]
    widths = [max(len(line[i]) for line in cells) for i in range(len(header))]
    return "".join("  ".join(c.ljust(w) for c, w in zip(line[:-1], widths, strict=False)) + ("  " if len(header) > 1 else "") + line[-1] + "\n" for line in cells)


def key_value_lines(row: dict) -> str:
    return "".join(f"{k}={v}\n" for k, v in row.items())


def write_pieces(pieces, path: str) -> None:
    """Bytes, piece by piece, to a file of any file system that the driver reaches."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with files.open_output_stream(name) as out:
        for piece in pieces:
            out.write(piece)


def write_state(state: bytes, path: str) -> None:
    """A sketch or filter to a file."""
    write_pieces([state], path)


def write_verbatim(rows: DataFrame, path: str) -> None:
    """Records (value, terminated) in their order, as ``records.read_raw`` gives them: a last one may have no line
    feed. The driver holds one partition at a time."""
    write_pieces((bytes(r["value"]) + b"\n" * r["terminated"] for r in rows.select("value", "terminated").toLocalIterator()), path)


def read_states(spark, paths: str | list[str]) -> DataFrame:
    """path, state: files of state, read by the executors."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("content").alias("state"))
