"""Bitmaps of bounded size: they keep rows out of a shuffle that an exact join would drop anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 1 << 26  # bits of a bitmap: 8 MB, whatever it is made from


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each led by underscores until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _place(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PLACES))


def bitmap_of(ids: DataFrame, column: str) -> DataFrame:
    """(bucket, bits): the places that a column's values hash to; PLACES bits at most."""
    rows = ids.select(_place(F.col(column)).alias("p"))
    return rows.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def likely(rows: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """rows without those whose value is surely not among the bitmap's. An exact join must follow.

    What passes by chance grows with the share of places taken; when all are taken, all rows pass.
    """
    bucket, bits, at = unused(rows.columns, "bucket", "bits", "at")
    known = F.broadcast(bitmap.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
    place = _place(F.col(column))
    met = rows.withColumns({bucket: F.bitmap_bucket_number(place), at: F.bitmap_bit_position(place)}).join(known, bucket)
    byte = f"cast(conv(hex(substring(`{bits}`, cast(`{at}` div 8 as int) + 1, 1)), 16, 10) as int)"
    return met.where(f"shiftright({byte}, cast(`{at}` % 8 as int)) % 2 = 1").select(rows.columns)
