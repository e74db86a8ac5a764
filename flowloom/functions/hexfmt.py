"""Text forms of the exported flow columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex4(value: Column) -> Column:
    """16-bit number as four lowercase hex digits."""
    return F.lpad(F.lower(F.hex(value.cast("long"))), 4, "0")


def hex_list(values: Column) -> Column:
    """``c02b;c02f`` or ``-`` when there is nothing to list."""
    return join_or_dash(F.transform(values, hex4))


def join_or_dash(values: Column) -> Column:
    text = F.when(F.size(values) > 0, F.array_join(values, ";")).otherwise(F.lit("-"))
    return F.when(values.isNotNull(), text)


def bytes_as_text(values: Column) -> Column:
    """Byte strings one character per byte."""
    return F.transform(values, lambda v: F.decode(v, "ISO-8859-1"))


def fixed3(value: Column) -> Column:
    """Three decimals of the binary value, ties to even (0.0625 is 0.062, 2.0005 is 2.001).

    ``bround`` sees the shortest decimal form and takes 2.0005 for a tie, while the number
    stored is a little more. Where that form is a tie, the exact rest of ``value * 10000``
    tells the side; it follows from the two halves of the mantissa without rounding.
    """
    scaled = value * 10000.0
    carry = value * 134217729.0
    high = carry - (carry - value)
    rest = (high * 10000.0 - scaled) + (value - high) * 10000.0
    tie = (scaled == F.floor(scaled)) & (F.abs(scaled) % 10 == 5)
    down = F.floor(scaled / 10.0) / 1000.0
    up = F.ceil(scaled / 10.0) / 1000.0
    return F.when(tie & (rest > 0), up).when(tie & (rest < 0), down).otherwise(F.bround(value, 3))


def fixed3_text(value: Column) -> Column:
    return F.format_string("%.3f", fixed3(value))


def grease(value: Column) -> Column:
    """Reserved code points 0x0A0A, 0x1A1A .. 0xFAFA."""
    return (F.shiftright(value, 8) == value.bitwiseAND(255)) & (value.bitwiseAND(15) == 10)


def without_grease(values: Column) -> Column:
    return F.filter(values, lambda v: ~grease(v))


def on_one_line(value: Column) -> Column:
    """Backslashes and line breaks as ``\\\\``, ``\\n`` and ``\\r``, so that a text file has one row a line."""
    for char, spelled in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(char), F.lit(spelled))
    return value


def from_one_line(value: Column) -> Column:
    """The text that ``on_one_line`` wrote."""
    # Backslash pairs are set apart first, as their second half may stand before an n or r.
    for spelled, char in (("\\\\", "\x00"), ("\\n", "\n"), ("\\r", "\r"), ("\x00", "\\")):
        value = F.replace(value, F.lit(spelled), F.lit(char))
    return value
