"""Bitmaps of hashed values: filters of a bounded size in front of joins that would move much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored

MOST = 1 << 24  # bits: 2 MB
FEW = 1 << 15  # rows of a few bytes that every task can hold: 256 KB a column


def few(rows: int) -> bool:
    """Whether a table of longs is better sent to every task than shuffled; either way the rows are the same."""
    return rows <= FEW


def _bit(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits))


def _bits(values: int) -> int:
    return max(1 << 12, min(MOST, 1 << (16 * max(values, 1) - 1).bit_length()))


def bitmap(values: DataFrame, column: str, bits: int | None = None) -> tuple[Column, int]:
    """A scalar array of longs with a bit set for every value, and its number of bits.

    Without ``bits`` it has 16 a row, ``MOST`` at most.  Past that more passes, never less: what is
    filtered still meets the exact join.
    """
    if bits is None:
        bits = _bits(values.count())
    at = _bit(F.col(column), bits)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))
    pages = values.groupBy(F.shiftright(at, 6).alias("page")).agg(F.bit_or(one).alias("bits"))
    every = values.sparkSession.range(bits // 64).withColumnRenamed("id", "page")
    rows = every.join(pages, "page", "left").agg(
        F.sort_array(F.collect_list(F.struct("page", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("rows")
    )
    return stored(rows.select(F.col("rows.bits").alias("bits"))).scalar(), bits


def listed(value: Column, array: Column, bits: int) -> Column:
    """Whether the value's bit is set."""
    page = F.get(array, F.shiftright(_bit(value, bits), 6).cast("int"))
    return F.getbit(page, _bit(value, bits).bitwiseAND(63).cast("int")) == 1


def likely(rows: DataFrame, column: str, values: DataFrame, of: str) -> DataFrame:
    """The rows whose ``column`` is among ``values``, and few others: what a join would find.

    Few values are sent themselves, which takes no shuffle; else their bitmap.
    """
    values = values.select(F.col(of).alias("_listed"))
    n = values.count()
    if few(n):
        return rows.join(F.broadcast(values), F.col(column) == F.col("_listed"), "left_semi")
    return rows.filter(listed(F.col(column), *bitmap(values, "_listed", _bits(n))))
