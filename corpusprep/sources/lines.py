"""Large text files in parallel: lines with their numbers, and CSV records with quoted line breaks.

A file is read in the splits that Spark makes of it.  What a split cannot know by itself (how many
lines lie before it, whether it begins inside quotes) comes from a scan over small tables of totals.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions.blocks import running
from corpusprep.functions.durable import stored


def numbered_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """``(path, line_no, line)``: every line of the files with its 0-based number in its file.

    A line ends at CR LF, CR or LF, or only at ``line_sep``; a final line end opens no further line,
    and a byte order mark at the start of a file is no part of it.  Two passes: lines are counted by
    split, the counts are summed up per file, and each line adds its place in the split.  A split is
    read by one task in order, so the ids that Spark gives rows there are successive.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("line"),
    )
    splits = stored(raw.groupBy("path", "_at").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")))
    starts = running(splits, ["path"], "_at", {"_before": ("sum", F.col("_n"))}, exclusive=True).drop("_n")
    number = F.col("_before") + F.col("_row") - F.col("_first")
    return raw.join(starts, ["path", "_at"]).select("path", number.alias("line_no"), "line")


def line_totals(spark: SparkSession, path: str) -> DataFrame:
    """``(path, n_lines, n_chars)`` of the files; CR LF and CR count as one character, like LF.

    Every LF ends a record, which is counted by itself: its characters, the CRs in it that end lines,
    and, for the last record of a file, which ends are missing.
    """
    records = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
            F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
            F.col("value").alias("v"),
        )
    )
    returns = F.length("v") - F.length(F.replace("v", F.lit("\r"), F.lit("")))
    crlf = F.endswith("v", F.lit("\r")).cast("bigint")
    totals = records.groupBy("path").agg(
        F.sum(F.length("v") - crlf + 1).alias("chars"),
        F.sum(returns - crlf + 1).alias("lines"),
        F.sum(F.octet_length("v") + 1).alias("bytes"),
        F.max("size").alias("size"),
        F.max_by(F.endswith("v", F.lit("\r")), "at").alias("last_cr"),
    )
    # Without a final LF one line end was counted too many; a CR there ends the line all the same.
    # A byte order mark is left out by the reader: sizes differ by its three bytes.
    open_end = F.col("bytes") - F.col("size")
    unended = (open_end == 1) | (open_end == -2)
    cr = unended & F.col("last_cr")
    lines = F.col("lines")
    chars = F.col("chars") - F.when(unended & ~F.col("last_cr"), 1).otherwise(0)
    return totals.select("path", F.when(cr, lines).otherwise(lines).alias("n_lines"), chars.alias("n_chars"))


# ---------------------------------------------------------------- CSV
OUTSIDE, INSIDE, CLOSED = 0, 1, 2  # between quotes, in a quoted cell, behind a quote that may close it


def _end_state(pieces: Column, begin: int) -> Column:
    """1 if the line whose text between quotes is ``pieces`` ends inside quotes, having begun
    outside (at the start of a cell) or inside."""

    def step(acc: Column, piece: Column) -> Column:
        # ``acc``: the state before the piece; what the quote behind the piece makes of it.
        opens = F.when(F.endswith(piece, F.lit(",")), INSIDE).otherwise(OUTSIDE)
        return (
            F.when(acc == INSIDE, CLOSED)
            .when((acc == CLOSED) & (piece == ""), INSIDE)
            .when((acc == 3) & (piece == ""), INSIDE)
            .otherwise(opens)
            .cast("int")
        )

    first = 3 if begin == OUTSIDE else INSIDE  # 3: outside at the start of the line
    quotes = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # no quote behind the last piece
    return (F.aggregate(quotes, F.lit(first).cast("int"), step) == INSIDE).cast("int")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(path, record, text)``: the records of CSV files, whose quoted cells may hold line breaks.

    Every line is a map from "begins inside quotes" to "ends inside quotes".  Such maps leave the
    state, turn it or set it, so their composition over all lines before is the last set state
    turned as often as lines turn it since: two running values.  Records begin where the state is
    outside.  Records of one line stay where they are, only longer ones are gathered.  CR LF in a
    cell becomes LF; empty lines between records are left out.
    """
    lines = numbered_lines(spark, path, "\n").withColumn("line", F.regexp_replace("line", "\r\\z", ""))
    pieces = F.split("line", '"', -1)
    plain = ~F.contains("line", F.lit('"'))
    maps = stored(
        lines.select(
            "path",
            "line_no",
            F.when(plain, 0).otherwise(_end_state(pieces, OUTSIDE)).alias("f0"),
            F.when(plain, 1).otherwise(_end_state(pieces, INSIDE)).alias("f1"),
        )
    )
    turns, sets = (F.col("f0") > F.col("f1")).cast("int"), F.col("f0") == F.col("f1")
    turned = running(maps, ["path"], "line_no", {"x": ("xor", turns)}, exclusive=True)
    known = running(turned, ["path"], "line_no", {"w": ("last", F.when(sets, F.col("f0").bitwiseXOR(F.col("x"))))}, exclusive=True)
    state = F.coalesce("w", F.lit(0)).bitwiseXOR(F.col("x"))
    states = known.select("path", "line_no", (state == 0).alias("begins"), F.when(state == 0, F.col("f0")).otherwise(F.col("f1")).alias("after"))
    counted = running(states, ["path"], "line_no", {"record": ("sum", F.col("begins").cast("bigint"))})
    placed = lines.join(counted, ["path", "line_no"]).withColumn("record", F.col("record") - 1)
    whole = F.col("begins") & (F.col("after") == 0)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"])
    gathered = placed.filter(~whole).groupBy("path", "record").agg(F.array_join(in_order, "\n").alias("text"))
    every = placed.filter(whole).select("path", "record", F.col("line").alias("text")).unionByName(gathered)
    return every.filter(F.col("text") != "")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header line as string columns, ``""`` being a quote inside a quoted cell.

    What ``spark.read.csv(header=True, multiLine=True, escape='"')`` gives, but for files that are
    too large for a task; files may order their columns differently, and columns that a file does
    not have are null.  Header lines are the only rows that reach the driver, each distinct one once.
    """
    records = stored(csv_records(spark, path))
    heads = records.join(records.groupBy("path").agg(F.min("record").alias("record")), ["path", "record"], "left_semi")
    kinds = [r["text"] for r in heads.select("text").distinct().collect()]
    body = records.join(heads.select("path", "record"), ["path", "record"], "left_anti")
    frames = []
    for kind in sorted(kinds):
        names = next(csv.reader(io.StringIO(kind, newline="")))
        own = body if len(kinds) == 1 else body.join(heads.filter(F.col("text") == kind).select("path"), "path", "left_semi")
        schema = ", ".join(f"_c{i} string" for i in range(len(names)))
        cells = F.from_csv("text", F.lit(schema), {"escape": '"', "multiLine": "true"})
        frames.append(own.select(cells.alias("r")).select(*[F.col(f"r._c{i}").alias(n) for i, n in enumerate(names)]))
    if not frames:
        raise ValueError(f"no header line in {path}")
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
