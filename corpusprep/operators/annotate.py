"""Span annotations: repair, de-overlap, count, split on rare values, tag.

A row is one item: ``item_id, title, anns array<struct<attribute_value, attribute_type, source,
score, start_idx, end_idx, line_idx>>``.  Repair, de-overlap and tagging are ordered scans over
the item's own array (``spans``), so they run inside the task and shuffle nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions import arrays as A
from corpusprep.functions import patterns as P
from corpusprep.functions.durable import stored
from corpusprep.functions.marks import ROW, numbered, value_filter, with_marks
from corpusprep.functions.ranks import random_key, with_cut
from corpusprep.operators import spans as span_steps

ANNOTATION = (
    "struct<attribute_value:string,attribute_type:string,source:string,score:double,"
    "start_idx:int,end_idx:int,line_idx:int>"
)
SPAN = "struct<indexed_text:string,attribute_type:string,start_idx:int,end_idx:int>"


# ---------------------------------------------------------------- filters
def _valid(anns: Column, types: Sequence[str] | None, strict: bool) -> Column:
    def keep(a: Column) -> Column:
        valid = a["start_idx"] >= 0
        if not strict:
            valid = valid & (a["end_idx"] >= 0)
        return valid if types is None else valid & a["attribute_type"].isin(list(types))

    return F.filter(anns, keep)


def filter_types(
    df: DataFrame, types: Sequence[str] | None = None, anns: str = "anns", strict: bool = False
) -> DataFrame:
    """Keep annotations of the given types (all if None) with a valid start (and end)."""
    return df.withColumn(anns, _valid(F.col(anns), types, strict))


def tag_name(attr_type: Column) -> Column:
    return F.replace(F.trim(attr_type), F.lit(" "), F.lit("##"))


def tag_names(df: DataFrame) -> DataFrame:
    """``(attr_type, tag)`` for every annotation type in the table."""
    return attribute_types(df).select("attr_type", tag_name(F.col("attr_type")).alias("tag"))


# ---------------------------------------------------------------- repair
_RUNS = f"[{P.PY_WORD}]+|[^{P.PY_WORD}]+"
_SEP = "\x1f"
_SCANNED = 4096  # longest title, in characters, in which a value is searched from its start
_TRIED = 16  # occurrences of a run that are compared at a time


def _run_marked(text: Column) -> Column:
    """``text`` with a separator behind every run of word or of other characters."""
    return F.regexp_replace(text, f"({_RUNS})", f"$1{_SEP}")


def _separators(piece: Column) -> Column:
    return F.length(piece) - F.length(F.replace(piece, F.lit(_SEP), F.lit("")))


def _searchable(text: Column) -> Column:
    """A title ready for ``_whole_word_start``, evaluated once per title.

    A short title is ``marked``: separators stand exactly at its word edges, and a whole-word hit
    of a target is a literal hit of the target's own runs between separators.  A long one, or one
    that holds the separator itself, gets a run ``index``, so that a search does not walk through
    the title.  Both find the same hits.
    """
    lead = F.when(text.rlike(f"^[{P.PY_WORD}]"), _SEP).otherwise("")
    ends_other = text.rlike(f"[^{P.PY_WORD}]\\z")
    marked = A.let(
        F.concat(lead, _run_marked(text)),
        lambda m: F.when(ends_other, F.substring(m, F.lit(1), F.length(m) - 1)).otherwise(m),
    )
    short = (F.length(text) <= _SCANNED) & ~F.contains(text, F.lit(_SEP))
    return F.struct(
        F.when(short, marked).alias("marked"),
        F.when(~short, _run_index(text)).alias("index"),
        A.pages(text).alias("paged"),
    )


def _whole_word_start(text: Column, searchable: Column, target: Column) -> Column:
    """0-based start of the first whole-word hit of ``target`` in the title, -1 if none."""
    marked = searchable["marked"]

    def unmarked(at: Column) -> Column:
        return F.when(at >= 0, at - _separators(F.substring(marked, F.lit(1), at)))

    scanned = A.let(F.instr(marked, F.concat(F.lit(_SEP), _run_marked(target))) - 1, unmarked)
    found = F.when(marked.isNotNull(), scanned).otherwise(
        _indexed_start(text, searchable["paged"], searchable["index"], target)
    )
    return F.when(F.length(target) > 0, F.coalesce(found, F.lit(-1))).otherwise(-1)


def _run_index(text: Column) -> Column:
    """The runs of word and of other characters of a text, sorted.

    ``starts`` holds the start of every run and the length of the text; ``keys`` are the runs in
    sorted order and ``at`` their numbers; ``halves`` are the steps of a binary search in ``keys``.
    """

    def indexed(runs: Column) -> Column:
        lengths = F.concat(F.transform(runs, lambda r: F.length(r)), F.array(F.lit(0)))
        ordered = F.sort_array(F.transform(runs, lambda r, i: F.struct(r.alias("run"), i.alias("i"))))
        bits = F.length(F.bin(F.size(runs)))
        return A.let(
            ordered,
            lambda o: F.struct(
                A.running_starts(lengths).alias("starts"),
                F.transform(o, lambda x: x["run"]).alias("keys"),
                F.transform(o, lambda x: x["i"]).alias("at"),
                F.transform(F.sequence(F.lit(1), bits), lambda k: F.pow(F.lit(2), bits - k).cast("int")).alias("halves"),
                text.rlike(f"^[{P.PY_WORD}]").alias("word_first"),
                text.rlike(f"[{P.PY_WORD}]\\z").alias("word_last"),
            ),
        )

    return A.let(F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0)), indexed)


def _before(index: Column, key: Column, equal: bool) -> Column:
    """Number of keys smaller than (or equal to) ``key``."""

    def step(pos: Column, half: Column) -> Column:
        probe = F.get(index["keys"], pos + half - 1)
        return F.when(probe <= key if equal else probe < key, pos + half).otherwise(pos)

    return F.aggregate(index["halves"], F.lit(0), step)


def _indexed_start(text: Column, paged: Column, index: Column, target: Column) -> Column:
    """0-based start of the first whole-word hit of ``target`` in the indexed text, null if none.

    A hit begins and ends at run boundaries that are word edges, so its runs are the target's.
    The occurrences of the target's longest run are looked up and compared in their order; a
    target of one run needs three of them at most, because only the outer runs can lack an edge.
    """
    n = F.length(target)
    last = F.size(index["keys"])

    def search(runs: Column) -> Column:
        lengths = F.transform(runs, lambda r: F.length(r))
        return A.let(
            A.let(
                F.array_position(lengths, F.array_max(lengths)).cast("int") - 1,
                lambda j: F.struct(j.alias("j"), F.get(runs, j).alias("key"), F.size(runs).alias("m")),
            ),
            lambda t: A.let(_before(index, t["key"], equal=False), lambda low: from_key(t, low)),
        )

    def from_key(t: Column, low: Column) -> Column:
        def start(i: Column) -> Column:
            """Start of the hit whose looked-up run has number ``i``, null if there is none."""
            first, stop = i - t["j"], i - t["j"] + t["m"]
            begin = F.get(index["starts"], first)
            edges = ((first > 0) | index["word_first"]) & ((stop < last) | index["word_last"])
            fits = (first >= 0) & (F.get(index["starts"], stop) - begin == n) & edges
            return F.when(fits & (A.page_slice(text, paged, begin, begin + n) == target), begin)

        def hits(pos: Column, count: Column) -> Column:
            return F.get(
                F.filter(F.transform(F.slice(index["at"], pos + 1, count), start), lambda x: x.isNotNull()), F.lit(0)
            )

        def compared(high: Column) -> Column:
            tries = F.sequence(F.lit(0), F.floor((high - low - 1) / _TRIED).cast("int"))
            found = F.aggregate(
                tries,
                F.lit(None).cast("int"),
                lambda hit, k: F.coalesce(hit, hits(low + k * _TRIED, F.least(F.lit(_TRIED), high - low - k * _TRIED))),
            )
            return F.when(high > low, found)

        one = F.when(F.get(index["keys"], low) == t["key"], hits(low, F.lit(3)))
        return F.when(t["m"] == 1, one).otherwise(A.let(_before(index, t["key"], equal=True), compared))

    return A.let(F.regexp_extract_all(target, F.lit(_RUNS), F.lit(0)), search)


def _mode_is_strict(mode: str) -> bool:
    if mode not in ("default", "strict"):
        raise ValueError(f"unknown mode {mode!r}; default or strict")
    return mode == "strict"


def repair_and_deoverlap(
    df: DataFrame,
    types: Sequence[str] | None = None,
    mode: str = "default",
    title: str = "title",
    anns: str = "anns",
) -> DataFrame:
    """Adds ``tagged array<span>``: repaired title annotations without contained repeats.

    Where value and offsets disagree the first whole-word hit of the value wins, else of the
    sliced text, else the annotation is dropped.  ``default`` then drops an annotation inside the
    latest kept one of the same type; ``strict`` drops every overlap, and a dropped annotation
    still moves the end.
    """
    strict = _mode_is_strict(mode)
    tagged = span_steps.tagged(strict, None if types is None else list(types))(F.col(title), F.col(anns))
    return df.withColumn("tagged", tagged)


def drop_empty_and_duplicate(df: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Drop rows without annotations; of equal (annotation set, title) keep the smallest id.

    Rows are compared by 128 bits of title and annotations, and the survivors are marked by their numbers, so
    that titles and annotations are not shuffled.  Copies collapse in the map-side combine.  Columns other than
    id, title and tagged come from the surviving row.  Without row numbers the frame is stored first.
    """
    held = numbered(df)
    ordered = F.sort_array("tagged")
    tagged = held.filter(F.size("tagged") > 0).select(ROW, id_col, "title", ordered.alias("_t"))
    known = [F.array_contains(F.col("_t")[c], v) for c, v in (("indexed_text", ""), ("attribute_type", ""), ("start_idx", -1), ("end_idx", -1))]
    # Hashes pass over missing values; where there may be one, its place counts too.
    missing = ~F.coalesce(~reduce(Column.__or__, known), F.lit(False))
    content = [F.isnull("title"), F.col("title"), F.col("_t"), F.when(missing, F.to_json("_t"))]
    survivors = (
        tagged.select(ROW, id_col, *[F.xxhash64(F.lit(k), *content).alias(f"_h{k}") for k in (1, 2)])
        .groupBy("_h1", "_h2")
        .agg(F.min(F.struct(F.isnull(id_col), id_col, ROW)).alias("_first"))
        .select(f"_first.{ROW}")
    )
    rest = {c: F.when(F.col(id_col).isNotNull(), F.col(c)) for c in df.columns if c not in (id_col, "title", "tagged", ROW)}
    kept = with_marks(held, survivors, "_kept").filter("_kept")
    return kept.withColumns(rest | {"tagged": ordered}).select(*df.columns)


# ---------------------------------------------------------------- counts
def attribute_types(df: DataFrame, anns: str = "anns") -> DataFrame:
    return A.unnest(df, [], F.transform(anns, lambda a: a["attribute_type"]), "attr_type").distinct()


def spans(df: DataFrame, *keep: str) -> DataFrame:
    """One row per span of ``tagged``: the kept columns, then the span fields."""
    return A.unnest(df, list(keep), F.col("tagged"), "_t").select(*keep, "_t.*")


def count_type_value(df: DataFrame) -> DataFrame:
    return (
        spans(df)
        .groupBy(F.col("attribute_type").alias("attr_type"), F.col("indexed_text").alias("value_content"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def count_type(df: DataFrame) -> DataFrame:
    return spans(df).groupBy(F.col("attribute_type").alias("attr_type")).agg(F.count(F.lit(1)).alias("count"))


def count_source_type(
    df: DataFrame,
    types: Sequence[str] | None = None,
    mode: str = "default",
    title: str = "title",
    anns: str = "anns",
) -> DataFrame:
    """``(source_type, count)`` of annotations that survive repair.

    Description annotations count as they are.  In ``default`` mode contained repeats are not
    counted; in ``strict`` mode dropped overlaps are.
    """
    strict = _mode_is_strict(mode)
    repaired = span_steps.repaired(strict, deoverlap=not strict)
    label = lambda x: F.concat_ws("-", x["src"], x["typ"])
    counted = repaired(F.col(title), _valid(F.col(anns), types, strict))
    return A.unnest(df, [], F.transform(counted, label), "source_type").groupBy("source_type").agg(
        F.count(F.lit(1)).alias("count")
    )


def values_by_type(df: DataFrame, anns: str = "anns") -> DataFrame:
    """Adds ``type_values map<type, array<value>>``: order and repeats kept."""

    def grouped(all_anns: Column) -> Column:
        return F.map_from_entries(
            F.transform(
                F.array_distinct(F.transform(all_anns, lambda a: a["attribute_type"])),
                lambda t: F.struct(
                    t,
                    F.transform(
                        F.filter(all_anns, lambda a: a["attribute_type"] == t), lambda a: a["attribute_value"]
                    ),
                ),
            )
        )

    return df.withColumn("type_values", A.let(F.col(anns), grouped))


# ---------------------------------------------------------------- rare values
def small_types(counts: DataFrame, threshold: int) -> DataFrame:
    """Types whose values occur fewer than ``4 * threshold`` times in all."""
    return (
        counts.groupBy("attr_type")
        .agg(F.sum("count").alias("total"))
        .filter(F.col("total") < 4 * threshold)
        .select("attr_type")
    )


def _rare_depth(counts: DataFrame, ratio: float, threshold: int) -> tuple[DataFrame, Column]:
    """How many of the rarest values per type are selected.

    S(k), the occurrences of the k rarest values of every type, is piecewise linear in k with
    breakpoints only where a type moves on to the next count, so one row per (type, count)
    decides it.  Returns the ranges ``(attr_type, count, start, n)`` below the threshold, small
    types left out, and the depth k.
    """
    whole = Window.partitionBy("attr_type")
    rarer = whole.orderBy("count").rowsBetween(Window.unboundedPreceding, -1)
    hist = (
        counts.groupBy("attr_type", "count")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("total", F.sum(F.col("count") * F.col("n")).over(whole))
        .withColumn("start", F.coalesce(F.sum("n").over(rarer), F.lit(0)))
        .filter(F.col("total") >= 4 * threshold)
    )
    ranges = hist.filter(F.col("count") < threshold).select("attr_type", "count", "start", "n")
    facts = hist.agg(
        F.struct(
            F.sum(F.when(F.col("start") == 0, F.col("count"))).alias("s1"),
            F.floor(F.sum(F.col("count") * F.col("n")).cast("double") * F.lit(float(ratio))).alias("target"),
        ).alias("f")
    )
    steps = (
        ranges.select(
            F.explode(
                F.array(
                    F.struct((F.col("start") + 1).alias("k"), F.col("count").alias("d")),
                    F.struct((F.col("start") + F.col("n") + 1).alias("k"), (-F.col("count")).alias("d")),
                )
            ).alias("x")
        )
        .groupBy(F.col("x.k").alias("k"))
        .agg(F.sum("x.d").alias("d"))
    )
    by_k = Window.partitionBy(F.lit(0)).orderBy("k")
    upto = by_k.rowsBetween(Window.unboundedPreceding, 0)
    before = by_k.rowsBetween(Window.unboundedPreceding, -1)
    segments = (
        steps.withColumn("slope", F.sum("d").over(upto))
        .withColumn("next", F.lead("k").over(by_k))
        .withColumn("gain", F.col("slope") * (F.coalesce("next", F.col("k")) - F.col("k")))
        .withColumn("s_before", F.coalesce(F.sum("gain").over(before), F.lit(0)))
        .withColumn("f", facts.scalar())
    )
    reach = F.col("k") - 1 + F.greatest(
        F.ceil((F.col("f.target") - F.col("s_before")) / F.col("slope")), F.lit(1)
    )
    in_two = F.greatest(F.least(F.coalesce("next", F.col("k")), F.lit(3)) - F.col("k"), F.lit(0))
    solved = segments.agg(
        F.max("k").alias("stall"),  # one past the last rank with a value below the threshold
        F.sum(F.col("slope") * in_two).alias("s2"),
        F.min(
            F.when((F.col("slope") > 0) & (F.col("s_before") + F.col("gain") >= F.col("f.target")), reach)
        ).alias("reach"),
        F.max("f.target").alias("target"),
        F.max("f.s1").alias("s1"),
    )
    depth = solved.select(
        F.when(F.col("s1") >= F.col("target"), 1)
        .when(F.col("s2") == F.col("s1"), 2)
        .otherwise(
            F.least(
                F.when(F.col("reach").isNotNull(), F.greatest("reach", F.lit(2))).otherwise(F.col("stall") + 3),
                F.greatest("stall", F.lit(3)),
            )
        )
        .cast("bigint")
    )
    return ranges, depth.scalar()


def select_rare_values(counts: DataFrame, ratio: float = 0.2, threshold: int = 40) -> DataFrame:
    """``(attr_type, value_content, count)`` of the rare values that mark test rows.

    Small types are left out.  The k rarest values of every type are taken, k being the least
    that covers ``int(total * ratio)`` occurrences (or that adds nothing more), and of those the
    ones occurring fewer than ``threshold`` times.  Store the counts first: they are read several
    times.  Equal counts are ordered by the hash of the
    value, so that the rank of millions of once-seen values is spread over hash buckets.
    """
    ranges, depth = _rare_depth(counts, ratio, threshold)
    # A few rows, stored so that their size is known: the counts need no shuffle to meet them.
    reached = stored(ranges.withColumn("_k", depth - F.col("start")).filter(F.col("_k") >= 1))
    low = counts.filter(F.col("count") < threshold).join(reached, ["attr_type", "count"])
    chosen = ["attr_type", "value_content", "count"]
    whole = low.filter(F.col("n") <= F.col("_k")).select(chosen)
    # Only a count that the depth cuts through needs an order among its values.
    partly = low.filter(F.col("n") > F.col("_k")).withColumn("_key", random_key("value", "value_content"))
    cut = with_cut(partly, "_key", F.col("_k"), by=["attr_type", "count", "_k"]).filter("picked")
    return whole.unionByName(cut.select(chosen))


def small_type_values(counts: DataFrame, threshold: int) -> DataFrame:
    """``(attr_type, value_content)`` of the small types: fewer than ``4 * threshold`` per type."""
    return counts.join(stored(small_types(counts, threshold)), "attr_type", "left_semi").select(
        "attr_type", "value_content"
    )


def flag_new_value(
    df: DataFrame,
    rare: DataFrame,
    small: DataFrame,
    p: float = 0.05,
    seed: int | str = 0,
    id_col: str = "item_id",
) -> DataFrame:
    """Adds ``is_test``: some span has a rare value, or is of a small type and its draw is below ``p``.

    ``small`` lists the values of the small types.  Rare and small values are one table joined by
    (type, value): a type alone would be a join key that holds a third of all spans.  Only spans that pass a
    filter made from these values are shuffled, and rows are marked by their numbers.  Without row numbers the
    frame is stored first.
    """
    limit = F.lit(int(p * 2**32)).cast("bigint")
    draw = random_key(seed, F.concat_ws(":", id_col, "attribute_type", "start_idx", "end_idx"))
    value = ["attribute_type", "indexed_text"]
    marked = stored(
        rare.select("attr_type", "value_content", F.lit(True).alias("_rare"))
        .unionByName(small.select("attr_type", "value_content", F.lit(False).alias("_rare")))
        .withColumnsRenamed({"attr_type": "attribute_type", "value_content": "indexed_text"})
    )
    held = numbered(df)
    passes = value_filter(marked, value, marked.count())
    lucky = F.conv(F.substring(draw, 1, 8), 16, 10).cast("bigint") < limit
    hits = (
        spans(held, id_col)
        .filter(passes(*[F.col(c) for c in value]))
        .select(id_col, *value, lucky.alias("_lucky"))
        .join(marked, value)
        .filter(F.col("_rare") | F.col("_lucky"))
        .select(id_col)
        .distinct()
    )
    rows = held.select(ROW, id_col).join(hits, id_col, "left_semi").select(ROW)
    return with_marks(held, rows, "is_test").select(*df.columns, "is_test")


def new_value_split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` by the ``is_test`` flag."""
    return flagged.filter(~F.col("is_test")), flagged.filter("is_test")


def value_count_report(counts: DataFrame, rare: DataFrame) -> DataFrame:
    """Distinct values per type: all of them and the selected ones."""
    both = counts.select("attr_type", F.lit(0).alias("picked")).unionByName(
        rare.select("attr_type", F.lit(1).alias("picked"))
    )
    return both.groupBy("attr_type").agg(
        F.count_if(F.col("picked") == 0).alias("all_values"), F.sum("picked").alias("selected_values")
    )


# ---------------------------------------------------------------- tags
def bio_tags(
    df: DataFrame, scheme: str = "BIO", order: str = "type", title: str = "title", spans_col: str = "tagged"
) -> DataFrame:
    """Adds ``tags array<struct<word, tag>>`` and ``num_overlap``.

    Spans are visited by (type, start, longest first) or, with ``order='position'``, by (start,
    longest first, type); a span that begins before the end of the last accepted one is dropped
    and counted.  Words outside accepted spans get ``O``.
    """
    if scheme not in ("BIO", "BIOSE"):
        raise ValueError(f"unknown scheme {scheme!r}; BIO or BIOSE")
    if order not in ("type", "position"):
        raise ValueError(f"unknown order {order!r}; type or position")
    tagged = span_steps.bio(scheme, order)(F.col(title), F.col(spans_col))
    return df.withColumn("_bio", tagged).select(
        *[F.col(c) for c in df.columns], F.col("_bio.tags").alias("tags"), F.col("_bio.num_overlap").alias("num_overlap")
    )


def bio_text(tags: Column) -> Column:
    """``word TAG`` lines of one item."""
    return F.array_join(F.transform(tags, lambda t: F.concat_ws(" ", t["word"], t["tag"])), "\n")


# ---------------------------------------------------------------- attribute text
def parse_attribute_pairs(df: DataFrame, id_col: str = "item_id", col: str = "attrs") -> DataFrame:
    """``k:v1|||v2,v3;k2:v`` to rows ``(id, attr, pos, value)``; the last repeat of a key wins."""
    low = lambda c: F.lower(F.regexp_replace(c, P.SPACE_EDGES, ""))
    pairs = F.transform(
        F.filter(
            F.transform(F.split(col, "[;；]"), lambda p: F.split(p, ":", -1)), lambda kv: F.size(kv) == 2
        ),
        lambda kv: F.struct(
            low(F.get(kv, F.lit(0))).alias("attr"),
            F.transform(
                F.split(low(F.get(kv, F.lit(1))), r"\|\|\||,", -1), lambda v: F.regexp_replace(v, P.SPACE_EDGES, "")
            ).alias("vals"),
        ),
    )
    last = A.let(
        pairs,
        lambda ps: F.filter(
            ps,
            lambda p, i: ~F.exists(
                F.slice(ps, i + 2, F.size(ps)), lambda q: q["attr"] == p["attr"]
            ),
        ),
    )
    pairs_out = A.unnest(df, [id_col], last, "p").select(id_col, "p.attr", "p.vals")
    return A.unnest_pos(pairs_out, [id_col, "attr"], F.col("vals"), "pos", "value")


def explode_description(df: DataFrame, id_col: str = "item_id", col: str = "description") -> DataFrame:
    r"""Rows ``(id, line_idx, line)``: a list literal (lower-cased) or lines split at ``\x01``."""
    listed = F.from_json(
        F.when(F.col(col).rlike(r"^\s*\["), F.lower(col)), "array<string>", {"allowSingleQuotes": "true"}
    )
    return A.unnest_pos(df, [id_col], F.coalesce(listed, F.split(col, "\x01", -1)), "line_idx", "line")
