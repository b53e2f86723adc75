"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored
from corpusprep.llm import decontaminate, line_dedup, near_dup, packing, resample
from corpusprep.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

OWN = ("doc_id", "text", "n_chars")  # columns the stages read or write
APART = 1 << 62  # ids from here on stand for rows that have no id of their own


def _under_plain_names(stage: Stage) -> Stage:
    """The stage over a table whose other columns have names that clash with none of an operator's."""

    @wraps(stage)
    def renamed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        kept = stage(spark, docs.toDF(*[c if c in OWN else f"_own{i}" for i, c in enumerate(docs.columns)]), sf_dir)
        return kept.toDF(*docs.columns)

    return renamed


def _without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents that are not among ``_id, _fp`` (id and text hash)."""
    marked = docs.withColumn("_text_hash", near_dup.text_hash(F.col("text")))
    same = marked[doc_id].eqNullSafe(gone["_id"]) & (marked["_text_hash"] == gone["_fp"])
    return marked.join(gone, same, "left_anti").drop("_text_hash")


@_under_plain_names
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labels keeps.

    Null and empty texts have weight 0 and rows without an id no noise; repeated rows and ties share
    one key, so all of them stay or go.  Without labels of both kinds every row stays.  Long texts are
    weighed whole.  An empty table stays empty, other columns stay whatever their names.
    """
    return resample.sampled(docs, table(spark, sf_dir, "labels"))


@_under_plain_names
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more share, but for the last holder's.

    Every row stays, with null or empty text as it was (one empty line, which is too short to be
    shared); ``n_chars``, if there is such a column, is that of the text that is left.  Rows of one
    id are one holder; a null id is a holder smaller than any other.  Repeated rows lose the same
    lines.  Long texts are split whole.  Other columns stay whatever their names.
    """
    found = line_dedup.keep_bitmaps(docs)
    text = F.when(F.col("keep_runs").isNull(), F.col("text")).otherwise(line_dedup.kept_text(F.col("text"), F.col("keep_runs")))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds ``_key``, an id for which there is one text only.

    An id's own text is that of the smallest hash; other texts of that id, and texts without an id,
    get one by their hash, beyond all true ids, so that a true id is kept before them.
    """
    text_hash = near_dup.text_hash(F.col("text"))
    owners = docs.groupBy(F.col("doc_id").alias("_shared")).agg(F.min(text_hash).alias("_first"), F.max(text_hash).alias("_last"))
    shared = stored(owners.filter("_first <> _last").select("_shared", "_first"))
    of_text = F.lit(APART) + F.pmod(F.xxhash64(F.lit("row"), "doc_id", "text"), F.lit(APART))
    other = F.col("doc_id").isNull() | F.col("_shared").isNotNull() & (text_hash != F.col("_first"))
    return (
        docs.join(shared, F.col("doc_id") == F.col("_shared"), "left")
        .withColumn("_key", F.when(other, of_text).otherwise(F.col("doc_id").cast("bigint")))
        .drop("_shared", "_first")
    )


@_under_plain_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows without an id and different texts under one id take part like any others and go before a
    row with an id of its own does; of repeated rows (one id, or none, and one text) one stays, and
    which of their other columns' values stay is open.  Null and empty texts are no duplicates of
    those of other ids.  Long texts are compared whole.  Ids are integers below 2^62.
    """
    keyed = _keyed(docs).withColumn("_hash", near_dup.text_hash(F.col("text")))
    found = near_dup.near_duplicates(keyed, doc_id="_key", width=5, percent=80)
    gone = found.filter(F.col("_id") != F.col("component_id")).select("_id", "_fp").distinct()
    left = _without(keyed, gone, "_key")
    again = stored(keyed.groupBy("_key", "_hash").count().filter("count > 1").select("_key", "_hash"))
    once = left.join(again, ["_key", "_hash"], "left_anti").select(*docs.columns)
    # Only rows that are repeated are put side by side, after one of each task's.
    many = left.join(again, ["_key", "_hash"], "left_semi").groupBy("_key", "_hash")
    row = many.agg(F.first(F.struct(*docs.columns)).alias("row"))
    return once.unionAll(row.select("row.*"))


@_under_plain_names
def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item.

    Null and empty texts have no words and stay; rows of one id, or of none, are judged each by its
    own text, repeated rows alike.  Long texts are searched whole.  Other columns stay whatever their
    names.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("n_hit > 0").select("_id", "_fp").distinct())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences along the curve.

    Null and empty texts are their closing token only; every repeated row is packed.  An empty table
    gives no piece.  Only columns of pieces are returned.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json")).select(
        F.col("_id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", clean_of_benchmarks),
    ("packing", packed),
]

# Stages 1, 3 and 5 (a trained model, sketches with components, a space-filling curve) have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
