"""Array expressions that stay inside one row: no shuffle and no Python worker.

Spark's ``aggregate`` copies its accumulator array at every step, so a plain ordered scan over
n elements costs n^2.  ``scan`` folds fixed-size chunks and glues the chunk results, which keeps
very long texts (hundreds of thousands of tokens in one row) close to linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A column alias gives no such promise: the optimiser may inline it into a lambda, where it
    would run again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, keep: list[str], arr: Column, name: str = "x", **computed: Column) -> DataFrame:
    """One row per (non-null) array element, ``arr`` evaluated once.

    A plain ``explode`` makes the optimiser add ``size(arr) > 0 AND arr IS NOT NULL`` below it,
    which evaluates a computed array three times.  ``computed`` columns are made before the array
    is exploded: made after it, they would drag their inputs (a whole text) along every row.
    """
    names = [*keep, *computed]
    rows = df.withColumns(computed).select(*names, F.explode_outer(arr).alias(name))
    return rows.filter(F.col(name).isNotNull())


def unnest_pos(df: DataFrame, keep: list[str], arr: Column, pos: str, name: str) -> DataFrame:
    """``unnest`` with the 0-based position; null elements are kept."""
    return df.select(*keep, F.posexplode_outer(arr).alias(pos, name)).filter(F.col(pos).isNotNull())


def once(df: DataFrame, *cols: str) -> DataFrame:
    """Pin computed columns, so that filters on them do not compute them a second time.

    Use it only where every consumer needs the columns: they can no longer be pruned.
    """
    rest = [c for c in df.columns if c not in cols]
    pinned = F.inline_outer(F.array(F.struct(*cols)))
    return df.select(*rest, pinned).select(*df.columns)


def py_slice(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` for ``start >= 0``; a negative ``end`` counts from the back."""
    stop = F.when(end < 0, F.length(text) + end).otherwise(end)
    return F.substring(text, start + 1, F.greatest(stop - start, F.lit(0)))


PAGE = 512  # characters


def pages(text: Column) -> Column:
    """Overlapping pieces of a text for ``page_slice``: page k starts at character ``512 k``.

    A substring walks from the first character, so many slices of one long text cost its length
    each; with pages a slice costs at most two pages.
    """
    return let(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)),
        lambda base: F.transform(base, lambda p, k: F.concat(p, F.coalesce(F.get(base, k + 1), F.lit("")))),
    )


def page_slice(text: Column, paged: Column, start: Column, end: Column) -> Column:
    """``py_slice(text, start, end)`` by way of the text's pages."""
    stop = F.when(end < 0, F.length(text) + end).otherwise(end)
    size = F.greatest(stop - start, F.lit(0))
    page = F.get(paged, (start / PAGE).cast("int"))
    short = F.coalesce(F.substring(page, start % PAGE + 1, size), F.lit(""))
    return F.when(size <= PAGE, F.when(start.isNotNull(), short)).otherwise(F.substring(text, start + 1, size))


def sorted_set(arr: Column) -> Column:
    """Sorted distinct elements.  ``array_distinct`` compares all pairs when elements are structs."""
    return let(
        F.sort_array(arr), lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))
    )


def literal(text: Column) -> Column:
    """``text`` as a regular expression that matches itself."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _chunks(arr: Column, size: int) -> Column:
    last = F.greatest(F.ceil(F.size(arr) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(arr, k * size + 1, F.lit(size)))


def scan(
    arr: Column,
    state: Column,
    state_type: str,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    out_type: str,
) -> Column:
    """Ordered scan of ``arr``: the array of ``emit(state, x)`` over all elements.

    ``step(state, x)`` is the next state; both functions see the state *before* ``x`` and must
    return exactly ``state_type`` and ``out_type``.
    """
    nothing = F.array().cast(f"array<{out_type}>")

    def inner(chunk: Column, first: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(first.alias("st"), nothing.alias("out")),
            lambda acc, x: F.struct(
                step(acc["st"], x).alias("st"),
                F.concat(acc["out"], F.array(emit(acc["st"], x))).alias("out"),
            ),
        )

    return let(
        arr,
        lambda a: F.aggregate(
            _chunks(a, CHUNK),
            F.struct(state.cast(state_type).alias("st"), F.array().cast(f"array<array<{out_type}>>").alias("out")),
            lambda acc, chunk: let(
                inner(chunk, acc["st"]),
                lambda r: F.struct(
                    r["st"].alias("st"), F.concat(acc["out"], F.array(r["out"])).alias("out")
                ),
            ),
            lambda acc: F.flatten(acc["out"]),
        ),
    )


def running_starts(lengths: Column, gap: int | Column = 0) -> Column:
    """Start offset of every piece when pieces of these lengths follow each other with a gap."""
    return scan(
        lengths,
        F.lit(0),
        "int",
        lambda st, n: st + n + gap,
        lambda st, n: st,
        "int",
    )


def space_tokens(text: Column) -> Column:
    """Pieces between single spaces (empty ones kept) as structs ``tok_ind, token, cs, ce``."""

    def placed(pieces: Column, starts: Column) -> Column:
        return F.transform(
            pieces,
            lambda p, i: F.struct(
                i.alias("tok_ind"),
                p.alias("token"),
                F.get(starts, i).alias("cs"),
                (F.get(starts, i) + F.length(p)).alias("ce"),
            ),
        )

    return let(
        F.split(text, F.lit(" "), -1),
        lambda pieces: let(
            running_starts(F.transform(pieces, lambda p: F.length(p)), 1), lambda starts: placed(pieces, starts)
        ),
    )


def find_all(text: Column, target: Column) -> Column:
    """0-based starts of the non-overlapping occurrences of ``target``, left to right."""
    found = let(
        F.split(text, literal(target), -1),
        lambda pieces: let(
            running_starts(F.transform(pieces, lambda p: F.length(p)), F.length(target)),
            lambda starts: F.transform(
                F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))),
                lambda s: (s - F.length(target)).cast("int"),
            ),
        ),
    )
    return F.when(F.length(target) > 0, found).otherwise(F.array().cast("array<int>"))


def run_lengths(sorted_arr: Column) -> Column:
    """Runs of equal neighbours in a sorted array as structs ``value, first, n`` (0-based first)."""
    return let(
        sorted_arr,
        lambda a: let(
            F.filter(
                F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), i)),
                lambda i: i.isNotNull(),
            ),
            lambda firsts: F.transform(
                firsts,
                lambda f, k: F.struct(
                    F.get(a, f).alias("value"),
                    f.alias("first"),
                    (F.coalesce(F.get(firsts, k + 1), F.size(a)) - f).alias("n"),
                ),
            ),
        ),
    )
