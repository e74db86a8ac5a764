"""A bitmap of keys that goes to all tasks, so that rows without a key stay out of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of a bitmap row, fixed by Spark, and of all of them at most (32 MB).
BUCKET_BITS = 1 << 15
MOST_BITS = 1 << 28


def marked(rows: DataFrame, keys: DataFrame, count: int, *, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: true for all whose hash ``key`` is one of ``keys`` (some ``count`` of them), and for few others.

    Both tables hold the hash as a long that is not null.
    """
    bits = min(MOST_BITS, max(BUCKET_BITS, 1 << (16 * max(count, 1) - 1).bit_length()))
    at = F.col(key).bitwiseAND(F.lit(bits - 1)) + 1
    held = keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.expr("_place div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("cast(shiftleft(1, cast(_place % 8 as int)) as int)")) != 0
    met = rows.withColumns({"_bucket": F.bitmap_bucket_number(at), "_place": F.bitmap_bit_position(at)}).join(F.broadcast(held), "_bucket", "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(is_set, F.lit(False)).alias(flag))
