"""Exact-match evaluation of tags and relation triples, and training metric series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.blocks import running


def _first_word(text: Column) -> Column:
    return F.substring_index(text, " ", 1)


def triple_key(pattern: str) -> list[Column]:
    """The columns two triples must share to count as equal."""
    c = F.col
    keys = {
        "only_head_index": [c("subj_tok_span.s"), c("predicate"), c("obj_tok_span.s")],
        "whole_span": [
            c("subj_tok_span.s"),
            c("subj_tok_span.e"),
            c("predicate"),
            c("obj_tok_span.s"),
            c("obj_tok_span.e"),
        ],
        "whole_text": [c("subject"), c("predicate"), c("object")],
        "only_head_text": [_first_word(c("subject")), c("predicate"), _first_word(c("object"))],
    }
    if pattern not in keys:
        raise ValueError(f"unknown pattern {pattern!r}; one of {sorted(keys)}")
    return keys[pattern]


def match_triples(gold: DataFrame, pred: DataFrame, pattern: str = "only_head_text") -> DataFrame:
    """One row ``(correct_num, pred_num, gold_num)``: per-sample sets of keys, summed.

    Both sides go through one grouping by (sample, key), so repeats collapse on the map side and
    a sample that holds most triples is spread by its keys.
    """
    names = [f"_k{i}" for i, _ in enumerate(triple_key(pattern))]

    def side(df: DataFrame, is_gold: bool) -> DataFrame:
        key = [k.alias(n) for k, n in zip(triple_key(pattern), names)]
        return df.select("sample_id", *key, F.lit(is_gold).alias("g"), F.lit(not is_gold).alias("p"))

    return (
        side(gold, True)
        .unionByName(side(pred, False))
        .groupBy("sample_id", *names)
        .agg(F.bool_or("g").alias("g"), F.bool_or("p").alias("p"))
        .agg(
            F.count_if(F.col("g") & F.col("p")).alias("correct_num"),
            F.count_if("p").alias("pred_num"),
            F.count_if("g").alias("gold_num"),
        )
    )


def prf(counts: DataFrame, mode: str = "eps") -> DataFrame:
    """Adds ``precision``, ``recall``, ``f1``; ``eps`` pads the denominators, ``percent`` guards zeros."""
    correct, pred, gold = (F.col(n).cast("double") for n in ("correct_num", "pred_num", "gold_num"))
    if mode == "eps":
        eps = F.lit(1e-10)
        with_pr = counts.withColumns(
            {"precision": correct / (pred + eps), "recall": correct / (gold + eps)}
        )
        p, r = F.col("precision"), F.col("recall")
        return with_pr.withColumn("f1", 2 * p * r / (p + r + eps))
    if mode == "percent":
        with_pr = counts.withColumns(
            {
                "precision": F.when(pred != 0, correct / pred * 100).otherwise(0.0),
                "recall": F.when(gold != 0, correct / gold * 100).otherwise(0.0),
            }
        )
        p, r = F.col("precision"), F.col("recall")
        return with_pr.withColumn("f1", F.when((p != 0) | (r != 0), 2 * p * r / (p + r)).otherwise(0.0))
    raise ValueError(f"unknown mode {mode!r}; eps or percent")


def sample_accuracy(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row ``sample_acc``: the share of samples whose tags all agree; inputs ``(sample_id, pos, tag)``."""
    none = F.lit(None).cast(gold.schema["tag"].dataType)
    both = gold.select("sample_id", "pos", F.col("tag").alias("g"), none.alias("p")).unionByName(
        pred.select("sample_id", "pos", none.alias("g"), F.col("tag").alias("p"))
    )
    per_tag = both.groupBy("sample_id", "pos").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    same = F.coalesce(F.col("g") == F.col("p"), F.lit(False))
    per_sample = per_tag.groupBy("sample_id").agg(F.bool_and(same).alias("ok"))
    return per_sample.agg(F.avg(F.col("ok").cast("double")).alias("sample_acc"))


def epoch_means(batches: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return batches.groupBy("run", "epoch").agg(*[F.avg(m).alias(m) for m in metrics])


def running_means(batches: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Adds ``avg_<metric>``: the mean over the batches of the epoch up to and including this one."""
    values = {f"_s_{m}": ("sum", F.col(m)) for m in metrics}
    values["_n"] = ("count", F.lit(1))
    sums = running(batches, ["run", "epoch"], "batch", values)
    means = {f"avg_{m}": F.col(f"_s_{m}") / F.col("_n") for m in metrics}
    return sums.withColumns(means).drop(*values)


def best_so_far(metrics: DataFrame, metric: str, order: str = "epoch", by: Sequence[str] = ("run",)) -> DataFrame:
    """Adds ``best_before`` and ``improved`` (strictly better; the first row always improves)."""
    seen = running(metrics, by, order, {"best_before": ("max", F.col(metric))}, exclusive=True)
    better = F.col("best_before").isNull() | (F.col(metric) > F.col("best_before"))
    return seen.withColumn("improved", better)
