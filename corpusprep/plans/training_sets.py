"""The four annotation jobs: from annotated items to train and test sets.

Repair is the expensive step and several branches need its result (counts, split, tags), so each
job stores the repaired items once in the shared folder; the branches then read only the columns
they use.  ``keep`` names the columns of the items that the result has beside id, title, spans, tags
and flags (all of them by default): what nobody reads need not be stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored
from corpusprep.functions.marks import ROW, numbered
from corpusprep.operators import annotate as an
from corpusprep.operators.sampling import random_split

TEST_RATIO = 0.2


def _repaired(items: DataFrame, types: Sequence[str] | None, keep: Sequence[str] | None) -> DataFrame:
    tagged = an.repair_and_deoverlap(items, types)
    if keep is None:
        return tagged
    named = {"item_id", "title", "tagged", *keep}
    return tagged.select(*[c for c in tagged.columns if c in named])


def build_single_value_set(
    items: DataFrame, types: Sequence[str] | None = None, test_ratio: float = TEST_RATIO, seed: int | str = 0
) -> DataFrame:
    """Strict repair, tags on the lower-cased title, exact random split; all rows are kept.

    An item without spans has no tags, so it is left out of the BIO text.
    """
    tagged = an.repair_and_deoverlap(items, types, mode="strict")
    lowered = an.bio_tags(tagged.withColumn("_low", F.lower("title")), title="_low").drop("_low")
    lowered = lowered.withColumn("tags", F.when(F.size("tagged") > 0, F.col("tags")))
    # No row is dropped, so the split needs the ids alone and nothing has to be stored.
    return random_split(lowered, "item_id", test_ratio, seed)


def build_multi_value_set(
    items: DataFrame,
    types: Sequence[str] | None = None,
    test_ratio: float = TEST_RATIO,
    seed: int | str = 0,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Repair, tags, rows without spans dropped, exact random split."""
    tagged = stored(_repaired(items, types, keep)).filter(F.size("tagged") > 0)
    return random_split(an.bio_tags(tagged), "item_id", test_ratio, seed)


def _flag_rare(
    rows: DataFrame, counted: DataFrame, ratio: float, threshold: int, seed: int | str
) -> DataFrame:
    counts = stored(an.count_type_value(counted))
    return an.flag_new_value(
        rows,
        an.select_rare_values(counts, ratio, threshold),
        an.small_type_values(counts, threshold),
        seed=seed,
    )


def build_new_value_set(
    items: DataFrame,
    types: Sequence[str] | None = None,
    test_ratio: float = TEST_RATIO,
    threshold: int = 50,
    seed: int | str = 0,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Repair, tags; rows with a rare value (or a lucky draw of a small type) are test rows."""
    tagged = numbered(_repaired(items, types, keep))
    kept = tagged.filter(F.size("tagged") > 0)
    return an.bio_tags(_flag_rare(kept, tagged, test_ratio, threshold, seed)).drop(ROW)


def build_training_set(
    items: DataFrame,
    split_way: str = "random",
    types: Sequence[str] | None = None,
    test_ratio: float = TEST_RATIO,
    threshold: int = 40,
    seed: int | str = 0,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Repair, empty and repeated items dropped, tags, then a ``random`` or ``new-value`` split.

    Value counts are taken before repeats are dropped.
    """
    if split_way not in ("random", "new-value"):
        raise ValueError(f"unknown split {split_way!r}; random or new-value")
    tagged = numbered(_repaired(items, types, keep))
    kept = an.drop_empty_and_duplicate(tagged)
    if split_way == "random":
        return an.bio_tags(random_split(kept, "item_id", test_ratio, seed)).drop(ROW)
    return an.bio_tags(_flag_rare(kept, tagged, test_ratio, threshold, seed)).drop(ROW)
