"""Metric series out of training and evaluation logs: ``(path, line_no, line)`` rows.

Lines are filtered by their markers first where the job allows it.  Running state over the lines
of one log uses block-wise running values, so a log that holds most of the lines is still many
tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions import arrays as A
from corpusprep.functions import patterns as P
from corpusprep.functions.blocks import BLOCK, join_null_safe, running


def _has(pattern: str, plain: bool = False) -> Column:
    return F.contains(F.col("line"), F.lit(pattern)) if plain else F.col("line").rlike(pattern)


def _group(pattern: str, i: int) -> Column:
    return F.regexp_extract(F.col("line"), pattern, i)


def split_lines(text: Column) -> Column:
    """Lines of a whole text; the newline is CR LF, CR or LF, a final empty piece is dropped."""
    pieces = F.split(text, "\r\n|\r|\n", -1)
    return F.when(
        F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    ).otherwise(pieces)


def extract_series(logs: DataFrame, pattern: str = P.SERIES) -> DataFrame:
    """Rows ``(path, i, value)``: all matches in the whole text, numbered from 0."""
    matches = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(1))
    return A.unnest_pos(logs, ["path"], matches, "i", "value")


def third_decimal(lines: DataFrame, skip: int = 2) -> DataFrame:
    """``(path, line_no, value)``: the third decimal number of every line after the first two."""
    third = F.get(F.regexp_extract_all(F.col("line"), F.lit(r"\p{Nd}+\.\p{Nd}+"), F.lit(0)), F.lit(2))
    return lines.filter(F.col("line_no") >= skip).select("path", "line_no", third.alias("value"))


def block_pick(lines: DataFrame, size: int = 6, offset: int = 5) -> DataFrame:
    """``(path, pos, value)``: of every block of lines the first number before ``,`` or ``)``.

    The last three picks a, b, c become b, c, a and go first, then the second pick up to the
    fourth last; the first pick is left out.  Blocks are counted by ``line_no``.
    """
    picks = lines.filter(F.pmod(F.col("line_no"), F.lit(size)) == offset).select(
        "path", F.floor(F.col("line_no") / size).alias("k"), _group(r"([\p{Nd}.]+)[,)]", 1).alias("value")
    )
    sized = join_null_safe(picks, picks.groupBy("path").agg(F.count(F.lit(1)).alias("n")), ["path"])
    from_end = F.col("n") - F.col("k")
    pos = (
        F.when(from_end == 3, 2)
        .when(from_end == 2, 0)
        .when(from_end == 1, 1)
        .when(F.col("k") >= 1, F.col("k") + 2)
    )
    return sized.select("path", pos.cast("bigint").alias("pos"), "value").filter(F.col("pos").isNotNull())


def slice_sections(lines: DataFrame) -> DataFrame:
    """``(path, section, line_no, line, epoch)``: lines after a results marker.

    A section ends at the next ``Total epoch`` line, which gives its epoch minus one; a repeated
    marker inside is an ordinary line.  A section without an end has no epoch.  Outside a section
    only the marker counts and inside only the end, so a line that holds both switches.
    """
    is_end, is_mark = _has(P.EPOCH_END), _has(P.RESULTS_MARKER, plain=True)
    event = F.when(is_end & is_mark, "both").when(is_end, "end").when(is_mark, "mark")
    epoch = _group(P.EPOCH_END, 1).try_cast("int") - 1
    # Sections are worked out on the few marker and end lines alone.
    events = lines.select("path", "line_no", event.alias("event"), epoch.alias("epoch")).filter(
        F.col("event").isNotNull()
    )
    # Whether a line is inside: the last marker or end says so, turned by every "both" since.
    both = F.col("event") == "both"
    switched = running(events, ["path"], "line_no", {"_turns": ("sum", both.cast("bigint"))})
    state = F.when(~both, F.struct(F.col("event").alias("event"), F.col("_turns").alias("turns")))
    before = running(switched, ["path"], "line_no", {"_prev": ("last", state)}, exclusive=True)
    turns = F.col("_turns") - both.cast("bigint") - F.coalesce("_prev.turns", F.lit(0))
    inside = F.coalesce(F.col("_prev.event") == "mark", F.lit(False)) != (turns % 2 == 1)
    opens = (F.col("event") != "end") & ~inside
    turning = before.withColumn("_opens", opens).filter(F.col("_opens") | ((F.col("event") != "mark") & inside))
    numbered = running(turning, ["path"], "line_no", {"section": ("sum", F.col("_opens").cast("bigint"))})
    sections = numbered.groupBy("path", "section").agg(
        F.min("line_no").alias("_from"),
        F.max(F.when(~F.col("_opens"), F.col("line_no"))).alias("_to"),
        F.max(F.when(~F.col("_opens"), F.col("epoch"))).alias("epoch"),
    )
    ends = lines.groupBy("path").agg(F.max("line_no").alias("_last"))
    # A section is listed once per block of lines it touches, so lines find theirs by equality.
    listed = (
        join_null_safe(sections, ends, ["path"])
        .withColumn("_to", F.coalesce("_to", F.col("_last") + 1))
        .select(
            "path",
            "section",
            "epoch",
            "_from",
            "_to",
            F.explode(F.sequence(F.floor(F.col("_from") / BLOCK), F.floor(F.col("_to") / BLOCK))).alias("_block"),
        )
    )
    return (
        join_null_safe(lines.withColumn("_block", F.floor(F.col("line_no") / BLOCK)), listed, ["path", "_block"])
        .filter((F.col("line_no") > F.col("_from")) & (F.col("line_no") < F.col("_to")))
        .select("path", "section", "line_no", "line", "epoch")
    )


def run_blocks(
    lines: DataFrame, marker: str, block_marker: str = "test_triples", drop_last: bool = False
) -> DataFrame:
    """``(path, run, idx, value)``: first ``0.ddd`` of the third line of every test block.

    A marker line starts a run, a block marker line starts a block and is its line 1.  ``idx``
    numbers the values of a run from 0.  ``drop_last`` leaves the last run of a log out.
    """
    marked = running(
        lines,
        ["path"],
        "line_no",
        {
            "run": ("sum", _has(marker, plain=True).cast("bigint")),
            "_head": ("last", F.when(_has(block_marker, plain=True), F.col("line_no"))),
        },
    )
    third = marked.filter((F.col("run") >= 1) & (F.col("line_no") - F.col("_head") == 2))
    numbered = running(third, ["path", "run"], "line_no", {"idx": ("count", F.lit(1))}, exclusive=True)
    values = numbered.select("path", "run", "idx", F.regexp_extract("line", r"0\.\p{Nd}+", 0).alias("value"))
    if not drop_last:
        return values
    last = lines.filter(_has(marker, plain=True)).groupBy("path").agg(F.count(F.lit(1)).alias("_runs"))
    return join_null_safe(values, last, ["path"]).filter(F.col("run") < F.col("_runs")).drop("_runs")


def training_accuracy(lines: DataFrame) -> DataFrame:
    """``(path, rn, ent, head, tail)``: the accuracy lines of every log, numbered from 1."""
    found = lines.filter(_has(P.TRAIN_ACCURACY)).select(
        "path",
        "line_no",
        *[_group(P.TRAIN_ACCURACY, i).cast("double").alias(n) for i, n in ((1, "ent"), (2, "head"), (3, "tail"))],
    )
    return running(found, ["path"], "line_no", {"rn": ("count", F.lit(1))}).drop("line_no")


def align_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs' accuracy series by iteration; the second is cut one behind the end of the first.

    Inputs are the lines of one log each.
    """
    left, right = training_accuracy(a).drop("path"), training_accuracy(b).drop("path")
    cut = right.filter(F.col("rn") <= left.agg(F.count(F.lit(1))).scalar() + 1)
    named = lambda d, suffix: d.select(
        "rn", *[F.col(c).alias(f"{c}_{suffix}") for c in ("ent", "head", "tail")]
    )
    return named(left, "a").join(named(cut, "b"), "rn", "full")


def _paired_groups(lines: DataFrame) -> DataFrame:
    """One row per group of lines that ends with a pseudo-label line."""
    kind = (
        F.when(_has(P.STUDENT_ACCURACY), "student")
        .when(_has(P.TEACHER_ACCURACY), "teacher")
    )
    relevant = lines.select("path", "line_no", "line", kind.alias("kind"), _has(P.PSEUDO_LABEL).alias("closes")).filter(
        F.col("kind").isNotNull() | F.col("closes")
    )
    numbered = running(
        relevant, ["path"], "line_no", {"grp": ("sum", F.col("closes").cast("bigint"))}, exclusive=True
    )
    number = lambda pattern, i: F.regexp_extract("line", pattern, i)
    parsed = numbered.select(
        "path",
        "grp",
        "kind",
        "closes",
        *[
            F.when(F.col("kind") == "student", number(P.STUDENT_ACCURACY, i))
            .when(F.col("kind") == "teacher", number(P.TEACHER_ACCURACY, i))
            .cast("double")
            .alias(n)
            for i, n in ((1, "ent"), (2, "head"), (3, "tail"))
        ],
        F.when(F.col("closes"), number(P.PSEUDO_LABEL, 1).cast("double")).alias("score"),
    )
    return (
        parsed.groupBy("path", "grp")
        .agg(
            F.count("kind").alias("n_acc"),
            F.max("kind").alias("kind"),
            F.max("ent").alias("ent"),
            F.max("head").alias("head"),
            F.max("tail").alias("tail"),
            F.max("score").alias("score"),
            F.bool_or("closes").alias("closed"),
        )
        .filter(F.col("closed") & (F.col("n_acc") > 0))
        .drop("closed")
    )


def pair_metrics(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pairs, errors)``: validation accuracies with the score of the next pseudo-label line.

    Pairs are ``(path, kind, grp, all, ent, head, tail, score)``; the first student group of a log
    is skipped.  A group with more than one accuracy line goes to ``errors``.
    """
    groups = _paired_groups(lines)
    errors = groups.filter(F.col("n_acc") > 1).select("path", "grp", "n_acc")
    good = groups.filter(F.col("n_acc") == 1)
    first = good.filter(F.col("kind") == "student").groupBy("path").agg(
        F.min("grp").alias("_first")
    ).withColumnRenamed("path", "_path")
    pairs = (
        good.join(first, good["path"].eqNullSafe(first["_path"]), "left")
        .filter((F.col("kind") == "teacher") | (F.col("grp") > F.col("_first")))
        .select(
            "path",
            "kind",
            "grp",
            (F.col("ent") + F.col("head") + F.col("tail")).alias("all"),
            "ent",
            "head",
            "tail",
            "score",
        )
    )
    return pairs, errors


def pairwise_max(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(epoch, col, value)`` to the maximum of neighbouring columns ``col`` and ``col + 1``.

    Only the first half of the columns is kept, the first epoch is dropped and the others are
    labelled 2, 3, ... in their order, whatever their numbers.  ``by`` names the columns that tell
    several matrices apart.  Every cell is offered to its own column and the one before it, so no
    pivot is needed.
    """
    by = list(by)
    one = [] if by else [F.lit(0).alias("_one")]
    keys = by or ["_one"]
    cells = matrix.select(*by, *one, "epoch", "col", "value")
    widths = cells.groupBy(*keys).agg(F.floor((F.max("col") + 1) / 2).alias("_half"))
    epochs = running(
        cells.select(*keys, "epoch").distinct(), keys, "epoch", {"_label": ("count", F.lit(1))}
    ).filter(F.col("_label") > 1)
    offered = join_null_safe(join_null_safe(cells, epochs, [*keys, "epoch"]), widths, keys)
    return (
        offered.select(
            *by,
            F.col("_label").alias("epoch"),
            F.explode(F.array(F.col("col"), F.col("col") - 1)).alias("col"),
            "value",
            "_half",
        )
        .filter((F.col("col") >= 0) & (F.col("col") < F.col("_half")))
        .groupBy(*by, "epoch", "col")
        .agg(F.max("value").alias("value"))
    )
