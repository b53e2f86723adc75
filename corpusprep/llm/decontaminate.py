"""Benchmark windows found in documents by a prefix-filtered join.

A window (ten successive words of an item) is a set of words to be contained whole, so one prefix
token is enough: its rarest word, by its count in the documents.  Documents send only the places
of such words, each with the few words around it; a place meets the windows with that prefix,
the length and position bounds are applied, and the words are compared one by one.  Texts are
never shuffled.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.arrays import let, unnest
from corpusprep.functions.durable import stored
from corpusprep.llm.bitmap import bitmap, listed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITS = 1 << 19  # of a word filter: 64 KB, whatever the number of items


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and characters outside ASCII, A-Z lowered; empty for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(lowered, NOT_WORD, -1), lambda w: w != "")


def windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct windows: ``(window, words, size, item_ids)``, ids as strings; an item of fewer words
    is one."""
    name = F.coalesce(F.col(item_id).cast("string"), F.lit("null"))
    tokens = items.select(name.alias("item"), words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - width, F.lit(0)))
    each = tokens.select("item", "ws", F.explode(starts).alias("s")).select(
        "item", F.slice("ws", F.col("s") + 1, width).alias("words")
    )
    found = each.groupBy("words").agg(F.collect_set("item").alias("item_ids"))
    return found.select(
        F.xxhash64("words").alias("window"), "words", F.size("words").alias("size"), "item_ids"
    )


def prefix_windows(docs: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """Adds ``prefix``, the window's rarest word in the documents (ties by the word), and ``offset``,
    its first place in the window; windows with a word that no document has are left out."""
    vocabulary = found.select(F.explode("words").alias("word")).distinct()
    marked = docs.withColumn("_bits", bitmap(vocabulary, "word", BITS)[0])
    known = unnest(marked, [], F.filter(words(F.col(text)), lambda w: listed(w, F.col("_bits"), BITS)), "word")
    counts = known.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    tokens = found.select("window", "size", F.posexplode("words").alias("at", "word"))
    rarest = (
        tokens.join(counts, "word")
        .groupBy("window", "size")
        .agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "word", "at")).alias("least"))
        .filter(F.col("known") == F.col("size"))
        .select("window", F.col("least.word").alias("prefix"), F.col("least.at").alias("offset"))
    )
    return found.join(rarest, "window")


def hits(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, occurrences, found)``.

    ``documents`` has ``_id, _fp, n_words`` of every row (``_fp`` tells rows of one id and different
    texts apart), ``occurrences`` has ``_id, _fp, start, size, window`` of every place of a window,
    ``found`` the windows with their ``item_ids``.
    """
    found = stored(windows(items, item_id, item_text, width))
    tokens = stored(prefix_windows(docs, text, found))
    reach = width - 1

    def places(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            first = F.greatest(i - reach, F.lit(0))
            around = F.slice(ws, first + 1, 2 * reach + 1)
            return F.struct(w.alias("prefix"), i.alias("at"), (i - first).alias("before"), around.alias("around"))

        chosen = F.filter(F.transform(ws, lambda w, i: F.when(listed(w, F.col("_bits"), BITS), i)), lambda i: i.isNotNull())
        return F.struct(
            F.size(ws).cast("bigint").alias("n"),
            F.transform(chosen, lambda i: one(F.get(ws, i), i)).alias("places"),
        )

    slim = stored(
        docs.withColumn("_bits", bitmap(tokens, "prefix", BITS)[0]).select(
            F.col(doc_id).alias("_id"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_fp"),
            let(words(F.col(text)), places).alias("w"),
        ).select("_id", "_fp", F.col("w.n").alias("n_words"), F.col("w.places").alias("places"))
    )
    candidates = slim.select("_id", "_fp", "n_words", F.explode("places").alias("p")).select(
        "_id", "_fp", "n_words", "p.*"
    )
    by_prefix = tokens.select("prefix", "window", "size", "offset", "words")
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))  # position and length
    same = F.slice("around", F.col("before") - F.col("offset") + 1, F.col("size")) == F.col("words")
    occurrences = candidates.join(by_prefix, "prefix").filter(F.when(fits, same).otherwise(False)).select(
        "_id", "_fp", start.alias("start"), "size", "window"
    )
    return slim.drop("places"), occurrences, found.select("window", "item_ids")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
) -> DataFrame:
    """One row per document row: ``_id``, ``_fp``, ``n_words``, ``n_hit``, ``item_ids``, ``hit_runs``.

    A word inside any occurrence of a window is hit; ``hit_runs`` has ``(first, past the last)``
    word of every covered run in order, ``item_ids`` the items with occurring windows as sorted
    strings.  Null and wordless texts have no words and no hits; items without words have no window;
    an item without an id counts under the string ``null``.  Repeated rows are answered each.
    """
    slim, occurrences, found = hits(docs, items, doc_id, text, item_id, item_text, width)
    occurrences = stored(occurrences)
    ends = F.struct(F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e"))
    # All places of one document; at most one entry for each word and window size.
    spans = occurrences.groupBy("_id", "_fp").agg(F.sort_array(F.collect_set(ends)).alias("spans"))
    merged = spans.select("_id", "_fp", F.expr(
        """aggregate(spans, struct(cast(array() as array<struct<s:int,e:int>>) as runs, -1 as s, -1 as e),
            (a, x) -> if(x.s <= a.e, struct(a.runs as runs, a.s as s, greatest(a.e, x.e) as e),
                struct(if(a.s < 0, a.runs, concat(a.runs, array(struct(a.s as s, a.e as e)))) as runs,
                       x.s as s, x.e as e)),
            a -> concat(a.runs, array(struct(a.s as s, a.e as e))))"""
    ).alias("hit_runs"))
    names = (
        occurrences.select("_id", "_fp", "window").distinct().join(found, "window")
        .select("_id", "_fp", F.explode("item_ids").alias("item"))
        .groupBy("_id", "_fp")
        .agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    )
    facts = merged.join(names.withColumnsRenamed({"_id": "_i", "_fp": "_f"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_fp") == F.col("_f")))
    facts = facts.select(F.col("_id").alias("_i"), F.col("_fp").alias("_f"), "hit_runs", "item_ids")
    covered = F.aggregate("hit_runs", F.lit(0).cast("bigint"), lambda n, r: n + r["e"] - r["s"])
    return slim.join(facts, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_fp") == F.col("_f")), "left").select(
        "_id",
        "_fp",
        "n_words",
        F.coalesce(covered, F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        "hit_runs",
    )
