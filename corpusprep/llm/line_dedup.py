"""Lines that many documents share, found over hashes and returned as run-length keep bitmaps.

Line hashes are range-partitioned and sorted by document and position inside each key, so that
one pass over the sorted rows sees the first occurrence of every document and counts documents
per key.  Texts never travel with the hashes.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOT_KEYS = 4096  # a key with a larger share than 1 / HOT_KEYS of the rows is counted apart
TRACKED = 16384


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def _fingerprint(text: Column) -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``(_id, _fp, _pos, _h1, _h2)`` of every line whose key has at least ``min_chars``."""
    rows = docs.select(
        F.col(doc_id).alias("_id"), _fingerprint(F.col(text)).alias("_fp"), F.posexplode(lines_of(F.col(text)))
    )
    return rows.filter(F.length(F.btrim("col", F.lit(BLANKS))) >= min_chars).select(
        "_id",
        "_fp",
        F.col("pos").alias("_pos"),
        F.xxhash64(line_key(F.col("col"))).alias("_h1"),
        F.xxhash64(F.lit(1), line_key(F.col("col"))).alias("_h2"),
    )


def hot_keys(occurrences: DataFrame) -> DataFrame:
    """The keys with a large share of the rows, ``HOT_KEYS`` times a third at most.

    A frequent-items sketch holds every item with more than 1 / (0.75 * TRACKED) of the rows, so
    no larger key is left for one task; one wrongly listed is only counted the other way.
    """
    sketch = occurrences.agg(
        F.expr(f"approx_top_k(_h1, {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    listed = sketch.select("n", F.explode("top").alias("k"))
    return listed.filter(F.col("k.count") * HOT_KEYS > F.col("n")).select(F.col("k.item").alias("_h1"))


def dropped_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int, min_docs: int) -> DataFrame:
    """``(_id, _fp, _pos)`` of every line to drop."""
    occ = stored(line_occurrences(docs, doc_id, text, min_chars))
    hot = F.broadcast(stored(hot_keys(occ)))  # at most HOT_KEYS rows of one bigint
    # Range partitions of whole keys, sorted by document and position inside a key.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = occ.join(hot, "_h1", "left_anti").repartitionByRange(parts, "_h1", "_h2")
    key = Window.partitionBy("_h1", "_h2")
    stream = key.orderBy("_id", "_fp", "_pos")
    here = F.struct("_id")
    first = (~F.lag(here).over(stream).eqNullSafe(here)).cast("int")
    cold = cold.withColumn("_first", first).select(
        "*", F.sum("_first").over(key).alias("_n"), F.max("_id").over(key).alias("_last")
    )
    # A hot key's documents are counted with partial sums; its rows stay where they are.
    of_hot = occ.join(hot, "_h1")
    totals = (
        of_hot.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one"))
        .groupBy("_h1", "_h2").agg(F.count("_one").alias("_n"), F.max("_id").alias("_last"))
    )
    of_hot = of_hot.join(F.broadcast(totals), ["_h1", "_h2"])  # one row for each listed key
    names = ["_id", "_fp", "_pos", "_n", "_last"]
    found = cold.select(*names).unionAll(of_hot.select(*names))
    return found.filter((F.col("_n") >= min_docs) & ~F.col("_id").eqNullSafe(F.col("_last"))).select(*names[:3])


def keep_bitmaps(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """Adds ``n_lines``, ``n_dropped`` and ``keep_runs`` to every row of ``docs``.

    A line's key is the line stripped of blanks with A-Z lowered.  Keys of ``min_chars`` code
    points found in ``min_docs`` documents lose their lines except in the largest id that holds
    them.  ``keep_runs`` is the keep bitmap in run lengths: ``(start, length)`` of every run of kept
    lines, 0-based; null if every line stays.

    A null or empty text is one empty line.  Rows that share an id are one document when documents
    are counted, and each row is answered with its own lines; a null id is a document too, smaller
    than any other.  Other columns stay as they are, whatever their names, except that those three names are replaced.
    """
    drops = (
        dropped_lines(docs, doc_id, text, min_chars, min_docs)
        .groupBy("_id", "_fp")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_drops"))
    )
    body = F.coalesce(F.col(text), F.lit(""))
    n_lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "keep_runs")]
    # Other columns travel under plain names, whatever theirs are.
    plain = {c: f"_c{i}" for i, c in enumerate(others)}
    left = docs.select(
        *[docs[f"`{c}`"].alias(n) for c, n in plain.items()],
        docs[doc_id].alias("_ld_own"),
        _fingerprint(F.col(text)).alias("_ld_text"),
        n_lines.cast("bigint").alias("_ld_n"),
    )
    joined = left.join(
        drops.withColumnsRenamed({"_id": "_ld_id", "_drops": "_ld_drops"}),
        F.col("_ld_own").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_text") == F.col("_fp")),
        "left",
    )
    before = F.concat(F.array(F.lit(-1)), F.col("_ld_drops"))
    after = F.concat(F.col("_ld_drops"), F.array(F.col("_ld_n").cast("int")))
    runs = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return joined.select(
        *[F.col(n).alias(c) for c, n in plain.items()],
        F.col("_ld_n").alias("n_lines"),
        F.coalesce(F.size("_ld_drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.filter(runs, lambda r: r["length"] > 0).alias("keep_runs"),
    )


def kept_text(text: Column, keep_runs: Column) -> Column:
    """The text with only the lines of ``keep_runs``; all of it where that is null."""
    lines = lines_of(text)
    kept = F.flatten(F.transform(keep_runs, lambda r: F.slice(lines, r["start"] + 1, r["length"])))
    return F.when(keep_runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))
