"""Writers: BIO text, train/test sets, concatenation, published copies."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.operators.annotate import bio_text, count_type, tag_names


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace whatever lies at the path."""
    df.write.mode("overwrite").format(fmt).save(path)


def concat_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of the first, then all of the second, as ``src`` 0 and 1 before the own columns."""
    return first.select(F.lit(0).alias("src"), "*").unionByName(second.select(F.lit(1).alias("src"), "*"))


def append_source(second: DataFrame, path: str, fmt: str = "text") -> None:
    """Append the rows to the source at the path."""
    second.write.mode("append").format(fmt).save(path)


def write_bio(df: DataFrame, path: str) -> None:
    """``word TAG`` lines, a blank line between items; items without words are left out."""
    texts = df.select(bio_text(F.col("tags")).alias("value")).filter(F.col("value") != "")
    texts.write.mode("overwrite").option("lineSep", "\n\n").text(path)


def overlap_line(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row ``value``: dropped overlaps of both sides as ``train#test``."""
    side = lambda d, name: d.select(F.lit(name).alias("side"), "num_overlap")
    both = side(train, "train").unionByName(side(test, "test"))
    total = lambda name: F.coalesce(
        F.sum(F.when(F.col("side") == name, F.col("num_overlap"))), F.lit(0)
    ).cast("string")
    return both.agg(F.concat_ws("#", total("train"), total("test")).alias("value"))


def _type_report(df: DataFrame, amount: str) -> DataFrame:
    """Counts per type and the number of rows under the name ``amount``."""
    rows = df.agg(F.lit(amount).alias("attr_type"), F.count(F.lit(1)).alias("count"))
    return count_type(df).unionByName(rows)


def _files(spark: SparkSession, path: str):
    """The Hadoop path and the file system it lies on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def committed(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write several outputs to; it takes the place of ``path`` when all are written.

    Until then, and after a failure, readers find the earlier outputs whole.  The earlier folder is
    moved aside and the new one renamed into its place, and put back if that fails; a file system
    without renames (an object store) copies, so readers there should wait for the call's end.
    """
    tag = uuid.uuid4().hex
    target, fs = _files(spark, path)
    staged, _ = _files(spark, f"{path.rstrip('/')}.new-{tag}")
    before, _ = _files(spark, f"{path.rstrip('/')}.old-{tag}")
    try:
        yield staged.toString()
    except BaseException:
        fs.delete(staged, True)
        raise
    had = fs.exists(target)
    if had and not fs.rename(target, before):
        fs.delete(staged, True)
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(staged, target):
        if had:
            fs.rename(before, target)
        raise OSError(f"cannot rename the new outputs to {path}")
    fs.delete(before, True)


def write_split(train: DataFrame, test: DataFrame, path: str, tagged: bool = True) -> None:
    """Train and test tables, BIO texts, overlap sums, per-type counts and the tag names, all of them
    or, after a failure, none: the folder at ``path`` is replaced as a whole."""
    with committed(train.sparkSession, path) as folder:
        for name, df in (("train", train), ("test", test)):
            overwrite(df, f"{folder}/{name}")
            overwrite(_type_report(df, f"{name}_amount"), f"{folder}/{name}_attr_count", "json")
            if tagged:
                write_bio(df, f"{folder}/{name}_bio")
        if tagged:
            overwrite(overlap_line(train, test), f"{folder}/num_overlap", "text")
        both = train.select("anns").unionByName(test.select("anns"))
        overwrite(tag_names(both), f"{folder}/tag_names", "json")


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """A ``head`` (a bounded number of rows) in ``order`` as one JSON array in one text row."""
    rows = F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(order), F.to_json(F.struct("*")).alias("_json")))),
        lambda r: r["_json"],
    )
    df.agg(F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]")).alias("value")).write.mode(
        "overwrite"
    ).text(path)


HALVES = 4  # 32-bit parts of a row's hash, summed apart


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``columns, n_rows, h0 ... h3`` that tells tables apart as multisets of rows.

    Every row gets a 128-bit hash of all its columns, taken as text with nulls marked; its parts are
    summed, so order and partitions do not matter, but a changed row, or one copy traded for another,
    changes the sums.  Columns go by name.
    """
    names = sorted(df.columns)
    cells = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), {"ignoreNullFields": "false"})
    digest = F.md5(cells.cast("binary"))
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)") for i in range(HALVES)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"h{i}") for i, p in enumerate(parts)]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)
    return df.agg(F.lit(kinds).alias("columns"), F.count(F.lit(1)).alias("n_rows"), *sums)


def _manifest(uri: str) -> str:
    return f"{uri.rstrip('/')}.manifest"


def publish(df: DataFrame, uri: str) -> None:
    """A gzip copy at any URI Hadoop can write, and beside it, written last, ``<uri>.manifest`` with
    the fingerprint of the rows that were to be copied.  The manifest of an earlier copy goes first, so
    an interrupted copy has none."""
    path, fs = _files(df.sparkSession, _manifest(uri))
    fs.delete(path, True)
    df.write.mode("overwrite").option("compression", "gzip").parquet(uri)
    fingerprint(df).write.mode("overwrite").json(_manifest(uri))


def verify_publish(df: DataFrame, uri: str) -> bool:
    """True if the published copy holds just the rows of the frame, each as often, and its manifest
    says so too."""
    spark = df.sparkSession
    try:
        copy, stated = spark.read.parquet(uri), spark.read.json(_manifest(uri)).first()
    except AnalysisException:  # no copy, or one that was not completed
        return False
    own = fingerprint(df).first().asDict()
    return own == fingerprint(copy).first().asDict() and stated is not None and own == {**own, **stated.asDict()}
