"""Knowledge-base lists: type to instances and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.blocks import running


def invert_kb(kb: DataFrame, reverse: bool = False, page: int = 10000) -> DataFrame:
    """``(key, pos, value)`` to ``(name, page, entries)``: type to instances, or instance to types.

    Order (by the unique integer ``pos``) and repeats are kept.  A list longer than ``page``
    entries continues on the next page, so the list of a type that holds a third of the table
    is built by many tasks; a usual list is page 0 alone.
    """
    name, entry = ("value", "key") if reverse else ("key", "value")
    entries = kb.select(F.col(name).alias("name"), F.col(entry).alias("entry"), "pos")
    numbered = running(entries, ["name"], "pos", {"_rank": ("count", F.lit(1))}, exclusive=True)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))), lambda e: e["entry"])
    return numbered.groupBy("name", F.floor(F.col("_rank") / page).cast("bigint").alias("page")).agg(
        listed.alias("entries")
    )
