"""Seeded random order and exact ranks without a one-task sort.

The random order of a row is ``md5(seed || ':' || id)``.  Its first hex digits spread rows over
65,536 equal buckets, so a global rank is a small running sum over bucket counts plus a rank
inside each bucket.  Exact-size samples need even less: only the one bucket that holds the last
sampled row is ranked, which gives a cut key; the sample is then a plain filter.
Ids must be unique within the table (or within each group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions.blocks import join_null_safe

BUCKET_DIGITS = 4


def random_key(seed: int | str, row_id: str | Column) -> Column:
    col = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")))


def _bucket(key: Column) -> Column:
    return F.substring(key, 1, BUCKET_DIGITS)


def _bucket_offsets(df: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Rows before each bucket; at most 65,536 rows per group reach the window."""
    counts = df.groupBy(*by, _bucket(F.col(key)).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def ranked(df: DataFrame, key: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based exact rank of every row by ``key`` (a hex string), within ``by`` if given."""
    offsets = _bucket_offsets(df.select(*by, key), key, by).drop("_n")
    inside = Window.partitionBy(*by, "_bucket").orderBy(key)
    return (
        join_null_safe(df.withColumn("_bucket", _bucket(F.col(key))), offsets, [*by, "_bucket"])
        .withColumn(out, F.col("_before") + F.row_number().over(inside))
        .drop("_bucket", "_before")
    )


def cut_keys(df: DataFrame, key: str, wanted: Column, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: the key of the ``wanted``-th smallest row, as ``cut``.

    ``wanted`` may use the column ``total`` (rows in the group).  Groups with ``wanted < 1`` get
    the empty string, groups with ``wanted >= total`` a string above every hex key, so
    ``key <= cut`` selects exactly the wanted rows.
    """
    slim = df.select(*by, key) if by else df.select(F.lit(0).alias("_all"), key)
    by = list(by) or ["_all"]
    plan = (
        _bucket_offsets(slim, key, by)
        .withColumn("total", F.sum("_n").over(Window.partitionBy(*by)))
        .withColumn("_want", wanted.cast("bigint"))
    )
    # One deciding bucket per group: the one with the wanted row, or the first if there is no cut.
    edge = F.when(F.col("_want") < 1, "").when(F.col("_want") >= F.col("total"), "~")
    holds = (F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_n") >= F.col("_want"))
    deciding = (
        plan.withColumn("_edge", edge)
        .filter(F.when(F.col("_edge").isNull(), holds).otherwise(F.col("_before") == 0))
        .select(
            *by,
            "_bucket",
            "_edge",
            F.when(F.col("_edge").isNull(), F.col("_want") - F.col("_before")).otherwise(1).alias("_nth"),
        )
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(key)
    return (
        join_null_safe(slim.withColumn("_bucket", _bucket(F.col(key))), deciding, [*by, "_bucket"])
        .withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_rn") == F.col("_nth"))
        .select(*by, F.coalesce("_edge", key).alias("cut"))
    )


def with_cut(df: DataFrame, key: str, wanted: Column, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``picked``: true for the ``wanted`` rows with the smallest keys (of each group)."""
    cuts = cut_keys(df, key, wanted, by)
    if by:
        return join_null_safe(df, cuts, by).withColumn("picked", F.col(key) <= F.col("cut")).drop("cut")
    return df.withColumn("picked", F.col(key) <= F.coalesce(cuts.select("cut").scalar(), F.lit("")))
