"""Cleaning, tokenising and vocabulary encoding of whole text columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions import arrays as A
from corpusprep.functions import patterns as P
from corpusprep.functions.ranks import random_key
from corpusprep.operators.spans import texts


TOKENS = "array<struct<tok_ind:int,token:string,cs:int,ce:int>>"


# ---------------------------------------------------------------- column forms
def clean(text: Column) -> Column:
    """Drop NUL, U+FFFD and every character of the categories C* (unassigned ones too, by Python's
    tables, not the JVM's); tab, LF, CR and Zs become a space."""
    kept = F.regexp_replace(text, f"[{P.searched_class(P.DROPPED)}]", "")
    return F.regexp_replace(kept, f"[{P.flat_class(P.BLANKS)}]", " ")


def cjk_spaced(text: Column) -> Column:
    """A space on each side of every CJK ideograph."""
    return F.regexp_replace(text, f"([{P.CJK}])", " $1 ")


@F.pandas_udf(T.StringType())
def _without_accents(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None or text.isascii():
            return text
        bare = unicodedata.normalize("NFD", text)
        # A text has few distinct marks: one pass per mark, not one step per character.
        for mark in {c for c in set(bare) if unicodedata.category(c) == "Mn"}:
            bare = bare.replace(mark, "")
        return bare

    return texts.map(one)


def without_accents(text: Column) -> Column:
    """NFD without non-spacing marks; the JVM has no such function, hence Arrow batches."""
    return _without_accents(text)


def words_and_punctuation(text: Column) -> Column:
    """Whitespace split, then every punctuation character a token of its own."""
    return F.regexp_extract_all(text, F.lit(P.PUNCT_OR_RUN), F.lit(0))


def squeezed(text: Column, separate: bool = False) -> Column:
    """Whitespace runs become one space and the ends are trimmed.

    ``separate`` also sets off every character outside ``[A-Za-z0-9]`` with spaces; squeezed, that
    is the ASCII runs and the single other characters joined by one space each.
    """
    if separate:
        return F.array_join(F.regexp_extract_all(text, F.lit(P.ASCII_RUN_OR_OTHER), F.lit(0)), " ")
    return F.trim(F.regexp_replace(text, P.SPACE_RUN, " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, P.SPACE_EDGES, "")


STEPS = {
    "clean": clean,
    "cjk": cjk_spaced,
    "accents": without_accents,
    "lower": F.lower,
}


# ---------------------------------------------------------------- operators
def _replace(df: DataFrame, col: str, value: Column) -> DataFrame:
    return df.withColumn(col, value)


def clean_corpus(df: DataFrame, col: str = "text") -> DataFrame:
    return _replace(df, col, clean(F.col(col)))


def space_cjk(df: DataFrame, col: str = "text") -> DataFrame:
    return _replace(df, col, cjk_spaced(F.col(col)))


def strip_accents(df: DataFrame, col: str = "text") -> DataFrame:
    return _replace(df, col, without_accents(F.col(col)))


def decode_base64_column(df: DataFrame, col: str) -> DataFrame:
    """Base64 to UTF-8 text; null, ``nan`` and whatever does not decode become one space.

    Characters outside the alphabet are ignored and wrong padding is an error, as in Python.
    """
    # Runs are joined: replacing characters one by one costs many times as much where line breaks are frequent.
    alphabet = F.array_join(F.regexp_extract_all(F.col(col).cast("string"), F.lit("[A-Za-z0-9+/=]+"), F.lit(0)), "")

    def bytes_of(kept: Column) -> Column:
        ends = F.length(kept) - F.length(F.rtrim(kept, F.lit("=")))
        return F.try_to_binary(F.when((F.length(kept) % 4 == 0) & (ends <= 2), kept), F.lit("base64"))

    decoded = F.try_validate_utf8(A.let(alphabet, bytes_of).cast("string"))
    return _replace(
        df, col, F.when(F.col(col).cast("string") == "nan", " ").otherwise(F.coalesce(decoded, F.lit(" ")))
    )


def to_text(df: DataFrame, col: str) -> DataFrame:
    """Bytes to UTF-8 text without the invalid bytes; a string column passes through."""
    if isinstance(df.schema[col].dataType, T.StringType):
        return df
    return _replace(
        df, col, F.replace(F.make_valid_utf8(F.col(col).cast("string")), F.lit("�"), F.lit(""))
    )


def tokenize(
    df: DataFrame,
    id_col: str,
    col: str = "text",
    steps: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(id, pos, token)``; ``steps`` (clean, cjk, accents, lower) run first, in order."""
    text = F.col(col)
    for step in steps:
        text = STEPS[step](text)
    return A.unnest_pos(df, [id_col], words_and_punctuation(text), "pos", "token")


def whitespace_tokens(df: DataFrame, id_col: str, col: str = "text") -> DataFrame:
    """Rows ``(id, tok_ind, token, cs, ce)``: single-space split with character offsets."""
    tokens = F.arrow_udf(_space_tokens, TOKENS)(F.col(col).cast("string"))
    return A.unnest(df, [id_col], tokens, "t").select(id_col, "t.*")


def _space_tokens(column: pa.Array) -> pa.Array:
    """``A.space_tokens`` of a batch: positions are running sums of the pieces' lengths."""
    pieces: list[str] = []
    bounds = [0]
    for text in texts(column):
        if text is not None:
            pieces += text.split(" ")
        bounds.append(len(pieces))
    bounds = np.array(bounds, np.int32)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    past = np.concatenate([[0], np.cumsum(sizes + 1)])
    first = np.repeat(bounds[:-1], np.diff(bounds))
    start = past[:-1] - past[first]
    number = np.arange(len(pieces)) - first
    values = [pa.array(number, pa.int32()), pa.array(pieces, pa.string()), pa.array(start, pa.int32()), pa.array(start + sizes, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(values, ["tok_ind", "token", "cs", "ce"]))


def build_vocab(lines: DataFrame) -> DataFrame:
    """``(line_no, line)`` to ``(token, id)``; a repeated token keeps its last line number."""
    return lines.groupBy(stripped(F.col("line")).alias("token")).agg(F.max("line_no").alias("id"))


def encode_tokens(
    df: DataFrame,
    vocab: DataFrame,
    id_col: str,
    max_len: int | None = None,
    blank_id: int = 0,
    unk_id: int = 1,
    uncased: bool = True,
) -> DataFrame:
    """``(id, tokens)`` to ``(id, ids)``: unknown tokens get ``unk_id``; cut or padded to ``max_len``.

    The vocabulary is joined by token; Spark broadcasts it only while its measured size is under
    the session's broadcast limit.  Tokens beyond ``max_len`` never enter the join.
    """
    tokens = F.col("tokens") if max_len is None else F.slice("tokens", 1, max_len)
    looked_up = (
        df.select(id_col, F.posexplode_outer(tokens).alias("pos", "token"))
        .withColumn("token", F.lower("token") if uncased else F.col("token"))
        .join(vocab.select("token", F.col("id").alias("_vid")), "token", "left")
    )
    entry = F.when(
        F.col("pos").isNotNull(),
        F.struct("pos", F.coalesce(F.col("_vid"), F.lit(unk_id)).cast("bigint").alias("v")),
    )
    ids = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["v"])
    out = looked_up.groupBy(id_col).agg(ids.alias("ids"))
    if max_len is None:
        return out
    pad = F.array_repeat(F.lit(blank_id).cast("bigint"), F.greatest(F.lit(max_len) - F.size("ids"), F.lit(0)))
    return out.withColumn("ids", F.concat("ids", pad))


def truncate_pairs(
    df: DataFrame,
    id_col: str,
    max_tokens: int,
    seed: int = 0,
    a: str = "tokens_a",
    b: str = "tokens_b",
) -> DataFrame:
    """Shorten the longer of two token lists, one token at a time, until both fit in ``max_tokens``.

    Final lengths are closed-form (ties shorten ``b``); each removal takes the front or the back
    by a seeded coin, so the number of heads is the number of tokens cut from the front.
    """
    la, lb = F.size(a), F.size(b)
    short, long = F.least(la, lb), F.greatest(la, lb)
    m = F.lit(max_tokens)
    fits, only_long = la + lb <= m, 2 * short <= m
    keep_a = (
        F.when(fits, la)
        .when(only_long, F.when(la > lb, m - lb).otherwise(la))
        .otherwise(F.ceil(m / 2).cast("int"))
    )
    keep_b = (
        F.when(fits, lb)
        .when(only_long, F.when(la > lb, lb).otherwise(m - la))
        .otherwise(F.floor(m / 2).cast("int"))
    )

    def cut(name: str, size: Column, keep: Column) -> Column:
        flips = F.when(size > keep, F.sequence(F.lit(1), size - keep)).otherwise(F.array().cast("array<int>"))
        heads = F.size(
            F.filter(
                flips,
                lambda i: F.substring(
                    random_key(f"{seed}:{name}", F.concat_ws(":", F.col(id_col).cast("string"), i)), 1, 1
                )
                < "8",
            )
        )
        return A.let(heads, lambda h: F.slice(F.col(name), h + 1, keep))

    return df.withColumns({a: cut(a, la, keep_a), b: cut(b, lb, keep_b)})
