"""Cleaning of the text and number columns of raw flow files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -------------------------------------------------------------------------
EMPTY_WORDS = ["nan", "none", "null"]
NO_VALUE = "none"
LABEL_WORDS = {
    "0": 0,
    "1": 1,
    "benign": 0,
    "normal": 0,
    "legitimate": 0,
    "anomalous": 1,
    "anomaly": 1,
    "malicious": 1,
    "attack": 1,
    "true": 1,
    "false": 0,
}
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY_PATTERN = r"(?i)^[+-]?inf(inity)?$"


def stripped(text: Column) -> Column:
    """Whitespace of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_text(text: Column) -> Column:
    """Stripped text; missing values and spelled-out missing values become empty."""
    value = stripped(F.coalesce(text, F.lit("")))
    return F.when(F.lower(value).isin(EMPTY_WORDS), F.lit("")).otherwise(value)


def _or_no_value(value: Column, present: Column) -> Column:
    return F.when(value.isin("", "-"), F.lit(NO_VALUE)).otherwise(present)


def legacy_version(text: Column) -> Column:
    """``303`` and ``0303`` are the same token; hex letters become lowercase."""
    value = clean_text(text)
    padded = F.when(F.length(value) < 4, F.lpad(value, 4, "0")).otherwise(value)
    return _or_no_value(value, F.when(value.rlike(r"^\d+$"), padded).otherwise(F.lower(value)))


def alpn_names(text: Column) -> Column:
    value = clean_text(text)
    return _or_no_value(value, F.lower(value))


def to_number(text: Column) -> Column:
    """Double, or NULL for anything that is not a plain number; infinities are numbers."""
    value = stripped(text)
    sign = F.when(value.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(value.rlike(NUMBER_PATTERN), value.try_cast("double")).when(
        value.rlike(INFINITY_PATTERN), sign * F.lit(float("inf"))
    )


def label_of(text: Column) -> Column:
    """0 or 1 for a known spelling, else NULL."""
    words = F.create_map(*[F.lit(x) for pair in LABEL_WORDS.items() for x in pair])
    return F.try_element_at(words, F.lower(stripped(text)))


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(float("inf"))
