"""A dataset kept as numbered chunks: cumulative sizes and row lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.blocks import running


def cumulative_sizes(chunks: DataFrame) -> DataFrame:
    """Adds ``cumulative`` to ``(chunk_id, n_rows)``: rows up to and including the chunk."""
    return running(chunks, [], "chunk_id", {"cumulative": ("sum", F.col("n_rows"))})


def locate_rows(indices: DataFrame, chunks: DataFrame) -> DataFrame:
    """``idx`` to ``(idx, chunk_id, row_in_chunk, status)``; negatives count from the end.

    The lookup is a merge: the distinct positions asked for and the first positions of the chunks go
    into one ordered stream, and the last chunk start is carried along it, block by block.  Work is
    linear however chunk sizes differ.  Out-of-range indices get status ``out_of_range``.
    """
    rows = chunks.agg(F.coalesce(F.sum("n_rows"), F.lit(0)))
    pos = F.when(F.col("idx") < 0, rows.scalar() + F.col("idx")).otherwise(F.col("idx"))
    wanted = indices.withColumn("_pos", pos.cast("bigint"))
    chunk = F.struct((F.col("cumulative") - F.col("n_rows")).alias("lo"), F.col("cumulative").alias("hi"), "chunk_id")
    starts = cumulative_sizes(chunks).filter(F.col("n_rows") > 0).select(chunk.alias("_chunk"))
    asked = wanted.select("_pos", F.lit(None).cast(starts.schema["_chunk"].dataType).alias("_chunk"))
    stream = starts.select(F.col("_chunk.lo").alias("_pos"), "_chunk").unionByName(asked.filter("_pos is not null"))
    merged = running(stream.groupBy("_pos").agg(F.max("_chunk").alias("_chunk")), [], "_pos", {"_at": ("last", F.col("_chunk"))})
    inside = F.col("_pos") < F.col("_at.hi")
    return wanted.join(merged.select("_pos", "_at"), "_pos", "left").select(
        "idx",
        F.when(inside, F.col("_at.chunk_id")).alias("chunk_id"),
        F.when(inside, F.col("_pos") - F.col("_at.lo")).alias("row_in_chunk"),
        F.when(inside, "ok").otherwise("out_of_range").alias("status"),
    )
