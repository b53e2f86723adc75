"""Sets of rows or of values as bits, so that a wide table is filtered where it lies instead of being shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored

ROW = "_row"
LOOKED_UP = 1 << 28  # most rows whose marks are one value (32 MB); those of more rows are joined
_TASK = 33  # bits of a row's place within its task, see monotonically_increasing_id
_LONGEST = 27  # bits of a filter's length, 16 MB


def numbered(df: DataFrame) -> DataFrame:
    """The frame, stored, with a number for every row; one that has numbers is returned as it is."""
    return df if ROW in df.columns else stored(df.withColumn(ROW, F.monotonically_increasing_id()))


def _task(row: Column) -> Column:
    return F.shiftright(row, _TASK).cast("int")


def _word(row: Column) -> Column:
    return F.shiftright(row.bitwiseAND((1 << _TASK) - 1), 6).cast("int")


def _bit(number: Column) -> Column:
    return number.bitwiseAND(63).cast("int")


def _one(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(number))


def _in_order(place: str, value: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(place, value))), lambda x: x[value])


def with_marks(df: DataFrame, rows: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: whether the row's number is among ``rows`` (one bigint column ``ROW``).

    One bit for each row is looked up, 64 in a word, the words in one list for each task that wrote rows.  Runs jobs.
    """
    places = df.groupBy(_task(F.col(ROW)).alias("task")).agg(
        F.max(_word(F.col(ROW))).alias("last"), F.count(F.lit(1)).alias("n")
    )
    tasks, n = places.agg(F.coalesce(F.max("task") + 1, F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n > LOOKED_UP:
        found = stored(rows.select(ROW, F.lit(True).alias(out)).distinct())
        return df.join(found, ROW, "left").withColumn(out, F.coalesce(out, F.lit(False)))
    none = F.lit(0).cast("bigint").alias("bits")
    empty = places.select("task", F.explode(F.sequence(F.lit(0), "last")).alias("word"), none)
    words = (
        rows.select(_task(F.col(ROW)).alias("task"), _word(F.col(ROW)).alias("word"), _one(F.col(ROW)).alias("bits"))
        .unionByName(empty)
        .groupBy("task", "word")
        .agg(F.bit_or("bits").alias("bits"))
    )
    lists = words.groupBy("task").agg(_in_order("word", "bits").alias("words"))
    idle = df.sparkSession.range(tasks).select(F.col("id").cast("int").alias("task"), F.lit(None).cast("array<bigint>").alias("words"))
    by_task = lists.unionByName(idle).groupBy("task").agg(F.max("words").alias("words"))
    marks = stored(by_task.agg(_in_order("task", "words").alias("marks"))).select("marks").scalar()
    held = F.get(F.get(marks, _task(F.col(ROW))), _word(F.col(ROW)))
    return df.withColumn(out, F.coalesce(F.getbit(held, _bit(F.col(ROW))) == 1, F.lit(False)))


def value_filter(values: DataFrame, columns: list[str], n: int) -> Callable[..., Column]:
    """A test that all of ``n`` values pass, and about an eighth of the others at most (more if ``n`` is beyond 2^24)."""
    bits = min(max((8 * n).bit_length(), 12), _LONGEST)

    def place(*cols: Column) -> Column:
        return F.xxhash64(*cols).bitwiseAND((1 << bits) - 1)

    at = place(*[F.col(c) for c in columns])
    empty = values.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = (
        values.select(F.shiftright(at, 6).alias("word"), _one(at).alias("bits"))
        .unionByName(empty)
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
    )
    held = stored(words.agg(_in_order("word", "bits").alias("words"))).select("words").scalar()
    return lambda *cols: F.getbit(F.get(held, F.shiftright(place(*cols), 6).cast("int")), _bit(place(*cols))) == 1
