"""Exact-size reproducible samples, splits and batches.

All random order is ``md5(seed || ':' || id)``, see ``functions.ranks``.  Sizes are computed in
doubles, as ``int(n * ratio)`` is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.blocks import running
from corpusprep.functions.ranks import random_key, ranked, with_cut

CLICK_KEY = ["user_id", "click_article_id", "click_timestamp"]


def _share(total: Column, ratio: float) -> Column:
    return F.floor(total.cast("double") * F.lit(float(ratio))).cast("bigint")


def head(df: DataFrame, order: str, n: int = 1000) -> DataFrame:
    """The first ``n`` rows by ``order``: a top-n, never a global sort."""
    return df.orderBy(order).limit(n)


def ratio_sample(df: DataFrame, id_col: str, ratio: float, seed: int | str = 0) -> DataFrame:
    """``int(n * ratio)`` random rows.  Two passes over the id column give the cut key."""
    keyed = df.withColumn("_key", random_key(seed, id_col))
    picked = with_cut(keyed, "_key", _share(F.col("total"), ratio))
    return picked.filter("picked").drop("_key", "picked")


def random_split(df: DataFrame, id_col: str, test_ratio: float = 0.2, seed: int | str = 0) -> DataFrame:
    """Adds ``is_test``: exactly ``ceil(n * test_ratio)`` random rows are test rows."""
    keyed = df.withColumn("_key", random_key(seed, id_col))
    wanted = F.ceil(F.col("total").cast("double") * F.lit(float(test_ratio))).cast("bigint")
    return with_cut(keyed, "_key", wanted).withColumnRenamed("picked", "is_test").drop("_key")


def stratified_sample(
    df: DataFrame, id_col: str, ratio: float, labels: str = "labels", seed: int | str = 0
) -> DataFrame:
    """Rows ``(label, row_id, part)`` with ``part`` ``sampled`` or ``rest``.

    A row joins each of its distinct labels, label -1 if it has none, so it can appear more than
    once.  Per label ``int(n * ratio + 1)`` rows are sampled.  A label that holds most of the
    rows is still spread over all hash buckets.
    """
    present = F.array_distinct(F.coalesce(F.col(labels), F.array().cast("array<int>")))
    strata = F.when(F.size(present) > 0, present).otherwise(F.array(F.lit(-1)))
    rows = df.select(F.explode(strata).alias("label"), F.col(id_col).alias("row_id")).withColumn(
        "_key", random_key(seed, "row_id")
    )
    wanted = F.floor(F.col("total").cast("double") * F.lit(float(ratio)) + 1).cast("bigint")
    picked = with_cut(rows, "_key", wanted, by=["label"])
    return picked.select(
        "label", "row_id", F.when(F.col("picked"), "sampled").otherwise("rest").alias("part")
    )


def stratum_report(strata: DataFrame) -> DataFrame:
    """Per label: all rows, sampled rows, the rest."""
    return strata.groupBy("label").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("part") == "sampled").alias("sampled"),
        F.count_if(F.col("part") == "rest").alias("rest"),
    )


def part_sizes(df: DataFrame, n_part: int) -> DataFrame:
    """``(part, size)``: near-equal part sizes with the remainder in the last part."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    size = F.floor(F.col("n") / n_part)
    return n.select(F.col("n"), F.explode(F.sequence(F.lit(0), F.lit(n_part - 1))).alias("part")).select(
        "part",
        F.when(F.col("n") < n_part, F.raise_error(F.lit("fewer rows than parts")).cast("bigint"))
        .otherwise(size + F.when(F.col("part") == n_part - 1, F.col("n") % n_part).otherwise(0))
        .cast("bigint")
        .alias("size"),
    )


def with_ordinal(df: DataFrame, order: str, out: str = "ordinal") -> DataFrame:
    """0-based position of every row by a unique integer ``order`` column."""
    return running(df, [], order, {out: ("count", F.lit(1))}, exclusive=True)


def assign_part(df: DataFrame, order: str, n_part: int) -> DataFrame:
    """Adds ``part``: contiguous near-equal parts in ``order``, the remainder in the last one."""
    total = df.agg(F.count(F.lit(1)))
    placed = with_ordinal(df, order, "_pos").withColumn("_n", total.scalar())
    part = F.least(F.floor(F.col("_pos") / F.floor(F.col("_n") / n_part)), F.lit(n_part - 1))
    checked = F.when(
        F.col("_n") < n_part, F.raise_error(F.lit("fewer rows than parts")).cast("bigint")
    ).otherwise(part.cast("bigint"))
    return placed.withColumn("part", checked).drop("_pos", "_n")


def fixed_batches(
    df: DataFrame, id_col: str, n: int, fill: bool = False, seed: int | str = 0
) -> DataFrame:
    """Adds ``batch`` and ``filler``: shuffled rows cut into batches of ``n``.

    With ``fill`` the last batch is completed by random rows of the earlier batches, marked as
    fillers (all earlier rows if there are fewer than needed).
    """
    keyed = df.withColumn("_key", random_key(seed, id_col))
    batched = ranked(keyed, "_key", out="_rank").withColumn(
        "batch", F.floor((F.col("_rank") - 1) / n).cast("bigint")
    )
    rows = batched.drop("_key", "_rank").withColumn("filler", F.lit(False))
    if not fill:
        return rows
    size = df.agg(F.count(F.lit(1)).alias("n"))
    full = F.floor(size.scalar() / n)
    earlier = batched.filter(F.col("batch") < full).drop("_key", "_rank", "batch")
    keyed_again = earlier.withColumn("_key", random_key(f"{seed}:fill", id_col))
    missing = F.pmod(F.lit(n) - F.pmod(size.scalar(), F.lit(n)), F.lit(n))
    fillers = with_cut(keyed_again, "_key", missing).filter("picked").drop("_key", "picked")
    return rows.unionByName(
        fillers.withColumn("batch", full.cast("bigint")).withColumn("filler", F.lit(True))
    )


def dedup_clicks(clicks: DataFrame) -> DataFrame:
    """One row per (user, article, time)."""
    return clicks.dropDuplicates(CLICK_KEY)


def click_log(train: DataFrame, test: DataFrame | None = None, offline: bool = True) -> DataFrame:
    """The training clicks, joined by the test clicks when not ``offline``, without repeats."""
    return dedup_clicks(train if offline or test is None else train.unionByName(test))


def sample_users(clicks: DataFrame, n: int = 10000, seed: int | str = 0) -> DataFrame:
    """The clicks of ``n`` random users, without repeats; too few users is an error."""
    users = clicks.select("user_id").distinct().withColumn("_key", random_key(seed, "user_id"))
    wanted = F.when(
        F.col("total") < n, F.raise_error(F.lit("fewer users than the sample size")).cast("bigint")
    ).otherwise(F.lit(n))
    chosen = with_cut(users, "_key", wanted).filter("picked").select("user_id")
    return dedup_clicks(clicks.join(chosen, "user_id", "left_semi"))
