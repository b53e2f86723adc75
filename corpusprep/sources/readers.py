"""Readers: annotation CSV, JSON lines, knowledge-base JSON, numbered documents, logs, listings."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.operators.annotate import ANNOTATION
from corpusprep.operators.logs import split_lines
from corpusprep.sources.lines import line_totals, numbered_lines, read_csv

# The annotation file's columns and what they are called here.
ANNOTATION_COLUMNS = {
    "Category ID": "category_id",
    "item_id": "item_id",
    "shop_id": "shop_id",
    "model_id": "model_id",
    "title": "title",
    "description": "description",
    "extraction_right_value_list_all": "anns",
}
_IDS = ("category_id", "item_id", "shop_id", "model_id")


@F.pandas_udf(T.StringType())
def _literal_to_json(cells: pd.Series) -> pd.Series:
    """A Python literal of tuples as JSON arrays."""
    return cells.map(lambda c: None if c is None else json.dumps(ast.literal_eval(c)))


def _annotations(cell: Column) -> Column:
    """JSON array of 7-element arrays to annotation structs."""
    rows = F.from_json(cell, "array<array<string>>")
    at = lambda r, i: F.get(r, F.lit(i))
    return F.transform(
        rows,
        lambda r: F.struct(
            at(r, 0).alias("attribute_value"),
            at(r, 1).alias("attribute_type"),
            at(r, 2).alias("source"),
            at(r, 3).try_cast("double").alias("score"),
            at(r, 4).cast("int").alias("start_idx"),
            at(r, 5).cast("int").alias("end_idx"),
            at(r, 6).cast("int").alias("line_idx"),
        ).cast(ANNOTATION),
    )


def read_annotations(
    spark: SparkSession, path: str, cells: str = "json", multi_line: bool = True
) -> DataFrame:
    """The seven used columns of the annotation CSV; ``cells`` is ``json`` or ``literal``.

    The file may have any further columns, in any order.  With ``multi_line`` quoted cells may
    hold line breaks; large files are split in either case.
    """
    raw = read_csv(spark, path) if multi_line else spark.read.csv(path, header=True, escape='"', enforceSchema=False)
    picked = raw.select(*[F.col(f"`{src}`").alias(dst) for src, dst in ANNOTATION_COLUMNS.items()])
    cell = F.col("anns") if cells == "json" else _literal_to_json("anns")
    return picked.withColumns({c: F.col(c).cast("bigint") for c in _IDS}).withColumn("anns", _annotations(cell))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object per line, with a given schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of lists per file to ``(key, pos, value)``; ``pos`` keeps the file order."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("_k", "e"))
        .select("_k", F.col("e.key").alias("key"), F.posexplode("e.value").alias("_v", "value"))
        .select("key", (F.col("_k").cast("bigint") * (1 << 32) + F.col("_v")).alias("pos"), "value")
    )


def _documents(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, text)`` of whole files; CR LF and CR alone are read as LF."""
    return spark.read.text(pattern, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text")
    )


def read_documents(
    spark: SparkSession, directory: str, prefix: str, start: int, end: int, mode: str = "line"
) -> DataFrame:
    """Numbered files ``prefix000.txt`` of a closed range, up to the first missing number.

    ``line`` gives ``(num, line_no, line)``, ``document_list`` ``(num, lines)``, ``document_str``
    ``(num, text)``.  The gap is found on the numbers alone.  Lines are read by splits of the files,
    lists and whole texts are one row for a file.
    """
    number = F.regexp_extract(F.col("path"), rf"{prefix}(\d+)\.txt$", 1).cast("int")
    listing = (
        spark.read.format("binaryFile")
        .load(f"{directory}/{prefix}*.txt")
        .select("path")
        .filter(F.col("path").rlike(rf"{prefix}\d{{3,}}\.txt$"))
        .select(number.alias("num"))
        .filter(F.col("num").between(start, end))
        .distinct()
    )
    successors = listing.select((F.col("num") + 1).alias("num"))
    candidates = successors.unionByName(spark.range(1).select(F.lit(start).alias("num")))
    first_gap = candidates.join(listing, "num", "left_anti").agg(F.min("num"))


    def wanted(files: DataFrame) -> DataFrame:
        named = files.filter(F.col("path").rlike(rf"{prefix}\d{{3,}}\.txt$")).withColumn("num", number).drop("path")
        return named.filter(F.col("num").between(start, end) & (F.col("num") < first_gap.scalar()))

    files = f"{directory}/{prefix}*.txt"
    if mode == "line":
        return wanted(numbered_lines(spark, files)).select("num", "line_no", "line")
    docs = wanted(_documents(spark, files)).select("num", "text")
    if mode == "document_list":
        return docs.select("num", split_lines(F.col("text")).alias("lines"))
    return docs


def scan_files(spark: SparkSession, base: str, suffix: str = ".xls") -> DataFrame:
    """Recursive listing ``(path, length)`` of the files with a suffix (case-sensitive)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(base)
        .select("path", "length")
    )


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per file: number of lines and of 8,192-character blocks; files are read by splits."""
    return line_totals(spark, path).select(
        "path", "n_lines", F.ceil(F.col("n_chars") / 8192).cast("bigint").alias("n_blocks")
    )


def read_log_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: whole logs."""
    return _documents(spark, path)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line_no, line)`` with the line number in the file; CR alone also ends a line.

    A log is read by as many tasks as it has splits.
    """
    return numbered_lines(spark, path)
