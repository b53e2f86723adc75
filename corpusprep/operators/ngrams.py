"""Character n-gram statistics per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions import arrays as A

CHARACTERS = 1 << 17  # counted at a time, unless one text has more
ROWS = 1 << 16  # of a batch that leaves the task


def _grams(text: Column, j: int, num: int) -> Column:
    """The j-character grams by start position: look at j characters, move on by one.

    A gram ``[i, i + j)`` counts only while ``i + j < length - num - 2``: the tail is left out.
    """
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{j}}}))."), F.lit(1))
    return F.slice(every, F.lit(1), F.greatest(F.length(text) - num - 2 - j, F.lit(0)))


def _strings(points: np.ndarray) -> pa.Array:
    """One string for each row of code points."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    sizes = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(axis=1)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(offsets), pa.py_buffer(data))


def _counted(texts: list[str], num: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """``(text, gram, count)`` of the grams of the texts, by sorting one integer for each place.

    The integer is the text's number followed by the gram's characters, numbered by the alphabet of
    these texts; where those do not fit into 63 bits, what stands before is replaced by its rank.
    """
    sizes = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    held = np.zeros(0x110000, np.int64)
    held[points] = 1
    alphabet = np.flatnonzero(held)
    held[alphabet] = np.arange(len(alphabet))
    codes = held[points]
    bits = max(int(len(alphabet) - 1).bit_length(), 1)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points)) - num - 2  # a gram of j needs more than j
    key = np.repeat(np.arange(len(texts)), sizes)
    used, first = max(int(len(texts) - 1).bit_length(), 1), np.zeros(0, np.int64)
    for j in range(1, num + 1):
        key = key[: max(len(points) - j + 1, 0)]
        if used + bits > 63:
            _, key = np.unique(key, return_inverse=True)
            used = max(int(len(key)).bit_length(), 1)
        key = key << bits | codes[j - 1 :]
        used += bits
        valid = left[: len(key)] > j
        sorted_keys = np.sort(key[valid])
        if not len(sorted_keys):
            return
        heads = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        counts = np.diff(np.append(heads, len(sorted_keys)))
        if used == j * bits + max(int(len(texts) - 1).bit_length(), 1):
            grams = sorted_keys[heads]
            text = grams >> (j * bits)
            shifts = np.arange(j - 1, -1, -1) * bits
            chars = (grams[:, None] >> shifts) & ((1 << bits) - 1)
        else:
            # Ranks hold no characters: they are read where a gram stands.
            places = np.flatnonzero(valid)
            first = places[np.argsort(key[valid], kind="stable")[heads]]
            text = np.searchsorted(np.cumsum(sizes), first, side="right")
            chars = codes[first[:, None] + np.arange(j)]
        for s in range(0, len(heads), ROWS):
            yield text[s : s + ROWS], _strings(alphabet[chars[s : s + ROWS]]), counts[s : s + ROWS]


def _together(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of a bounded number of characters."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > CHARACTERS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _counts(df: DataFrame, id_col: str, col: str, num: int) -> DataFrame:
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, gram string, cnt bigint, freq double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if b is None else b.decode("utf-8", "replace") for b in batch.column(1).to_pylist()]
            for s, e in _together(texts):
                part = [t or "" for t in texts[s:e]]
                ids, sizes = batch.column(0)[s:e], np.array([len(t) for t in part])
                for text, gram, n in _counted(part, num):
                    columns = [ids.take(pa.array(text)), gram, pa.array(n), pa.array(n / sizes[text])]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, "gram", "cnt", "freq"])

    return df.select(id_col, F.col(col).cast("string").cast("binary")).mapInArrow(work, schema)


def char_ngrams(
    df: DataFrame, id_col: str, col: str = "text", num: int = 5, neighbours: bool = False
) -> DataFrame:
    """Rows ``(id, gram, cnt, freq)``, with neighbour lists ``left`` and ``right`` on request.

    Grams of 1 to ``num`` characters are sorted and counted inside the task that reads the text, so
    nothing is shuffled.  The left neighbour of position 0 is the last character of the text.
    """
    if not neighbours:
        return _counts(df, id_col, col, num)
    text = F.col(col)
    lengths = range(1, num + 1)
    stats = [
        F.col("r.value").alias("gram"),
        F.col("r.n").cast("bigint").alias("cnt"),
        (F.col("r.n") / F.col("_len")).alias("freq"),
    ]
    def placed(j: int) -> Column:
        return F.transform(_grams(text, j, num), lambda g, i: F.struct(g.alias("gram"), i.alias("i")))

    def with_neighbours(t: Column) -> Column:
        grams, chars = t["grams"], t["chars"]

        def side(run: Column, char_at) -> Column:
            return F.transform(F.slice(grams, run["first"] + 1, run["n"]), lambda e: F.get(chars, char_at(e)))

        return F.transform(
            A.run_lengths(F.transform(grams, lambda e: e["gram"])),
            lambda run: F.struct(
                run["value"].alias("value"),
                run["n"].alias("n"),
                side(run, lambda e: F.pmod(e["i"] - 1, F.size(chars))).alias("left"),
                side(run, lambda e: e["i"] + F.length(e["gram"])).alias("right"),
            ),
        )

    # Sorted by gram, then position: the neighbour lists come out in text order.
    parts = F.struct(
        F.sort_array(F.concat(*[placed(j) for j in lengths])).alias("grams"), F.split(text, "").alias("chars")
    )
    rows = A.unnest(df, [id_col], A.let(parts, with_neighbours), "r", _len=F.length(text))
    return rows.select(id_col, *stats, F.col("r.left").alias("left"), F.col("r.right").alias("right"))
