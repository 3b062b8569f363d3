"""Display, export and input forms of keys and values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_printable(data: Column) -> Column:
    """Only 0x20 to 0x7E, line feed, carriage return and tab; the empty value is printable."""
    return F.rlike(F.hex(data), F.lit("^(?:[2-6][0-9A-F]|7[0-9A-E]|0[9AD])*$"))


def hex_form(data: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(data)))


def display(data: Column) -> Column:
    return F.when(F.length(data) == 0, "(empty)").when(is_printable(data), F.decode(data, "UTF-8")).otherwise(hex_form(data))


def export(data: Column) -> Column:
    """Round-trippable: text unless empty, binary or like a hex form."""
    text = F.decode(data, "UTF-8")
    plain = (F.length(data) > 0) & is_printable(data) & ~F.lower(text).startswith("0x")
    return F.when(plain, text).otherwise(hex_form(data))


def parse(text: Column) -> Column:
    """Hex behind 0x or 0X, else UTF-8. Bad hex raises."""
    digits = F.substr(text, F.lit(3))
    good = F.rlike(digits, F.lit("^(?:[0-9A-Fa-f]{2})*$"))
    decoded = F.when(good, F.unhex(digits)).otherwise(F.raise_error(F.concat(F.lit("invalid hex input "), text)).cast("binary"))
    return F.when(F.lower(F.substr(text, F.lit(1), F.lit(2))) == "0x", decoded).otherwise(F.encode(text, "UTF-8"))


def parse_literal(text: str) -> bytes:
    """The same for an argument of the driver."""
    if text[:2] in ("0x", "0X"):
        if not re.fullmatch("(?:[0-9A-Fa-f]{2})*", text[2:]):
            raise ValueError(f"invalid hex input {text!r}")
        return bytes.fromhex(text[2:])
    return text.encode()
