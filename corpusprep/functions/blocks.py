"""Running values over an integer order column: a prefix scan over blocks, blocks of blocks, ...

A window partitioned by run or path puts a whole run into one task, and one run may hold a third
of all rows.  Here each group is cut into blocks of the order column, at most 65,536 values wide;
blocks are reduced first, and their totals are carried forward in the same way, block table by
block table, until a level has at most 65,536 rows by the width of its numbers.  So no window holds
more than that many rows of a group, however sparse the order is (``x << 32``, hashes, times).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored

BLOCK = 65536


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, null equal to null; the keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def _number(value: Column, width: int) -> Column:
    """Which block of ``width`` a whole number lies in, rounded down."""
    return ((value - F.pmod(value, F.lit(width))) / width).cast("bigint")


def _total(kind: str, value: Column, order: str) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col(order)))
    return {"sum": F.sum, "count": F.count, "max": F.max, "xor": F.bit_xor}[kind](value)


def _before(kind: str, value: Column, window) -> Column:
    """A running value over totals; counts have become sums."""
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "count": F.sum, "max": F.max, "xor": F.bit_xor}[kind](value).over(window)


def _joined(kind: str, here: Column, carry: Column) -> Column:
    """A running value inside a block together with what comes before the block."""
    if kind == "last":
        return F.coalesce(here, carry)
    if kind == "max":
        return F.greatest(here, carry)
    if kind == "xor":
        return F.coalesce(here, F.lit(0)).bitwiseXOR(F.coalesce(carry, F.lit(0)))
    return F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))


def _carries(totals: DataFrame, by: list[str], key: str, kinds: Mapping[str, str], levels: int) -> DataFrame:
    """``by, key, _c_<name>``: what all blocks before ``key`` come to, from ``_t_<name>`` of each."""
    up = f"{key}_up"
    window = Window.partitionBy(*by, *([up] if levels else [] if by else [F.lit(0)]))
    earlier = window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = {n: _before(k, F.col(f"_t_{n}"), earlier) for n, k in kinds.items()}
    if not levels:
        return totals.select(*by, key, *[c.alias(f"_c_{n}") for n, c in inside.items()])
    totals = totals.withColumn(up, _number(F.col(key), BLOCK))
    again = {n: "sum" if k == "count" else k for n, k in kinds.items()}
    wider = totals.groupBy(*by, up).agg(*[_total(k, F.col(f"_t_{n}"), key).alias(f"_t_{n}") for n, k in again.items()])
    here = totals.select(*by, key, up, *[c.alias(f"_i_{n}") for n, c in inside.items()])
    both = join_null_safe(here, _carries(wider, by, up, again, levels - 1), [*by, up])
    return both.select(*by, key, *[_joined(k, F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(f"_c_{n}") for n, k in kinds.items()])


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    values: Mapping[str, tuple[str, Column]],
    exclusive: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Adds running values per group in ``order``.

    ``values`` maps an output name to ``(kind, column)`` with kind ``sum``, ``count``, ``max``,
    ``last`` (last non-null) or ``xor``.  ``exclusive`` leaves the current row out.  ``order`` must
    be an integer that is unique within the group.  The table of block totals is stored (a job
    runs); up to ``BLOCK`` totals are carried by one window, more through two wider tables, whose
    numbers take 32 and 16 bits.
    """
    by, kinds = list(by), {n: k for n, (k, _) in values.items()}
    src = df.withColumn("_block", _number(F.col(order), block))
    for name, (_, col) in values.items():
        src = src.withColumn(f"_v_{name}", col)
    totals = stored(
        src.groupBy(*by, "_block").agg(*[_total(k, F.col(f"_v_{n}"), order).alias(f"_t_{n}") for n, k in kinds.items()])
    )
    carry = _carries(totals, by, "_block", kinds, 2 if totals.count() > BLOCK else 0)
    inside = (
        Window.partitionBy(*by, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )

    def combined(name: str, kind: str) -> Column:
        v = F.col(f"_v_{name}")
        here = F.count(v).over(inside) if kind == "count" else _before(kind, v, inside)
        return _joined(kind, here, F.col(f"_c_{name}"))

    names = [c for c in df.columns if c not in values]
    return join_null_safe(src, carry, [*by, "_block"]).select(
        *names, *[combined(n, k).alias(n) for n, k in kinds.items()]
    )
