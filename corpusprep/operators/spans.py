"""Ordered steps over one item's spans, as Arrow functions: a batch of items in, one list for each out.

The expressions of an ordered scan copy what they have collected at every step; here a step is one
turn of a loop.  Missing values follow SQL: a comparison with one is unknown, and unknown is not kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from operator import lt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from corpusprep.operators import span_columns

SCANNED = 4096  # longest title, in characters, in which a value is searched from its start
PAGE = 512  # slices of a missing title are empty up to this size and missing beyond it
REPAIRED = "array<struct<txt:string,typ:string,s:int,e:int,line:int,src:string>>"
TAGGED = "array<struct<indexed_text:string,attribute_type:string,start_idx:int,end_idx:int>>"
BIO = "struct<tags:array<struct<word:string,tag:string>>,num_overlap:bigint>"
_RUN = re.compile(r"\w+|\W+")
_WORD_OR_SYMBOL = re.compile(r"\w+|[^\w\s]")


# ---------------------------------------------------------------- lists of a batch
def texts(arr: pa.Array) -> list[str | None]:
    try:
        return arr.to_numpy(zero_copy_only=False).tolist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in arr.cast(pa.binary()).to_pylist()]


def _values(arr: pa.Array) -> list:
    if pa.types.is_string(arr.type):
        return texts(arr)
    return arr.to_pylist() if arr.null_count else arr.to_numpy(zero_copy_only=False).tolist()


def lists(arr: pa.ListArray, names: list[str]) -> Iterator[list[tuple] | None]:
    """The lists of structs as lists of tuples of the named fields."""
    values = arr.flatten()
    columns = values.flatten()
    fields = [_values(columns[values.type.get_field_index(n)]) for n in names]
    rows, at = list(zip(*fields)), 0
    for n in _values(pc.list_value_length(arr)):
        yield None if n is None else rows[at : at + n]
        at += n or 0


def list_array(rows: Iterable[list[tuple] | None], fields: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    flat, offsets, missing = [], [0], []
    for row in rows:
        flat.extend(row or ())
        offsets.append(len(flat))
        missing.append(row is None)
    columns = list(zip(*flat)) or [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(missing, pa.bool_()))


def _key(row: tuple) -> tuple:
    """The order of SQL: missing values first, NaN last."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in row)


def _sorted_set(rows: list[tuple]) -> list[tuple]:
    keyed = sorted(((_key(r), r) for r in rows), key=lambda x: x[0])
    return [r for i, (k, r) in enumerate(keyed) if i == 0 or k != keyed[i - 1][0]]


def _rises(starts: list[tuple]) -> bool:
    try:
        return all(map(lt, starts, starts[1:]))
    except TypeError:  # a missing value
        return False


# ---------------------------------------------------------------- whole words
def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _edge(text: str, at: int) -> bool:
    return (at > 0 and _is_word(text[at - 1])) != (at < len(text) and _is_word(text[at]))


class Title:
    """First whole-word hits in one title; each value is searched once.

    A hit consists of whole runs of word or of other characters, so that in a long title only the
    places of the value's rarest run are compared.
    """

    def __init__(self, text: str):
        self.text, self.known, self.runs = text, {}, None

    def _places(self, target: str) -> Iterator[int]:
        text = self.text
        if self.runs is None:
            self.runs = {}
            for m in _RUN.finditer(text):
                self.runs.setdefault(m[0], []).append(m.start())
        ahead, found = min(((m.start(), self.runs.get(m[0], ())) for m in _RUN.finditer(target)), key=lambda x: len(x[1]))
        for at in found:
            if at >= ahead and text.startswith(target, at - ahead):
                yield at - ahead

    def _scanned(self, target: str) -> int:
        text, n = self.text, len(target)
        at = text.find(target)
        if at < 0:
            return -1
        head, tail, last = _is_word(target[0]), _is_word(target[-1]), len(text) - n
        while at >= 0:
            # A word begins or ends where a word character meets another character or the title's end.
            ahead = at > 0 and (c := text[at - 1]) != " " and (c.isalnum() or c == "_")
            if ahead != head:
                behind = at < last and (c := text[at + n]) != " " and (c.isalnum() or c == "_")
                if behind != tail:
                    return at
            at = text.find(target, at + 1)
        return -1

    def first(self, target: str | None) -> int:
        if not target:
            return -1
        found = self.known.get(target)
        if found is None:
            n, text = len(target), self.text
            if len(text) <= SCANNED:
                found = self._scanned(target)
            else:
                found = next((p for p in self._places(target) if _edge(text, p) and _edge(text, p + n)), -1)
            self.known[target] = found
        return found


# ---------------------------------------------------------------- repair
def _repair(title: str | None, anns: list[tuple], strict: bool) -> list[tuple]:
    """``line, s, e, typ, val, src, score`` in their order to ``txt, typ, s, e, line, src``."""
    text = title or ""
    search, out = Title(text), []
    if not _rises([a[:3] for a in anns]):
        anns = _sorted_set(anns)
    for line, s, e, typ, val, src, _ in anns:
        if e is not None and e < 0:
            e_at = s if title is None else len(text) + e
        else:
            e_at = s if e is None else max(e, s)
        piece = None if title is None and e_at - s > PAGE else text[s : max(e_at, s)]
        listed = src is not None and src != "title"
        if listed or (val is not None and val == piece):
            txt, start, end = piece, s, e
        elif val:
            txt, start = val, search.first(val)
            if start < 0:
                txt, start = piece, search.first(piece)
            if start < 0:
                continue
            end = start + len(txt)
        else:
            continue
        if strict or listed or txt:
            out.append((txt, typ, start, end, line, src))
    return out


def _all(*known: bool | None) -> bool | None:
    return False if False in known else None if None in known else True


def _holds(test: Callable, *values) -> bool | None:
    return None if None in values else test(*values)


def _kept(rows: list[tuple], strict: bool) -> list[tuple]:
    """What an ordered scan keeps; the state is the line, end and type that decide about the next."""
    line, end, kind, kept = -1, -1, "", []
    for row in rows:
        _, typ, s, e, at, src = row
        dropped = _all(
            _holds(lambda v: v == "title", src),
            _holds(lambda a, b: a >= b, line, at),
            _holds(lambda a, b: a < b, s, end),
            *(() if strict else (_holds(lambda a, b: a == b, kind, typ), _holds(lambda a, b: a >= b, end, e))),
        )
        if dropped is False:
            kept.append(row)
        other = src is not None and src != "title"
        if not other and (strict or dropped is not True):
            line, end, kind = at, e, typ
    return kept


def _kept_known(rows: list[tuple], strict: bool) -> list[tuple]:
    """``_kept`` where no value is missing."""
    line, end, kind, kept = -1, -1, "", []
    for row in rows:
        _, typ, s, e, at, src = row
        if src != "title":
            kept.append(row)
            continue
        dropped = s < end and line >= at and (strict or (kind == typ and end >= e))
        if not dropped:
            kept.append(row)
        if strict or not dropped:
            line, end, kind = at, e, typ
    return kept


_TEXT, _INT = pa.string(), pa.int32()
_REPAIRED = [("txt", _TEXT), ("typ", _TEXT), ("s", _INT), ("e", _INT), ("line", _INT), ("src", _TEXT)]
_SPAN = [("indexed_text", _TEXT), ("attribute_type", _TEXT), ("start_idx", _INT), ("end_idx", _INT)]
_ORDER = ["line_idx", "start_idx", "end_idx", "attribute_type", "attribute_value", "source", "score"]


def _deoverlapped(rows: list[tuple], strict: bool) -> list[tuple]:
    missing = any(None in r for r in rows)
    return (_kept if missing else _kept_known)(rows, strict)


def _by_position(rows: list[tuple]) -> list[tuple]:
    placed = [(s, e, typ, txt) for txt, typ, s, e, _, _ in rows]
    if not _rises([r[:2] for r in placed]):
        placed = _sorted_set(placed)
    return [(txt, typ, s, e) for s, e, typ, txt in placed]


def _items(title: pa.Array, anns: pa.ListArray) -> Iterator[tuple[str | None, list[tuple] | None]]:
    return zip(texts(title), lists(anns, _ORDER))


def repaired(strict: bool, deoverlap: bool):
    """``(title, anns) -> repaired``: sorted distinct annotations, without those beyond repair."""

    @F.arrow_udf(REPAIRED)
    def repaired_spans(title: pa.Array, anns: pa.Array) -> pa.Array:
        def one(text: str | None, rows: list[tuple] | None) -> list[tuple] | None:
            if rows is None:
                return None
            fixed = _repair(text, rows, strict)
            return _deoverlapped(fixed, strict) if deoverlap else fixed

        return list_array((one(t, a) for t, a in _items(title, anns)), _REPAIRED)

    return repaired_spans


def tagged(strict: bool, types: list[str] | None):
    """``(title, anns) -> tagged``: valid title annotations, repaired, without overlaps, by position."""

    def one(text: str | None, rows: list[tuple] | None) -> list[tuple] | None:
        return None if rows is None else _by_position(_deoverlapped(_repair(text, rows, strict), strict))

    def loops(title: pa.Array, anns: pa.ListArray) -> pa.ListArray:
        return list_array((one(t, a) for t, a in _items(title, anns)), _SPAN)

    def columns(title: pa.Array, anns: pa.ListArray) -> pa.ListArray:
        return span_columns.tagged(title, anns, strict, Title)

    @F.arrow_udf(TAGGED)
    def tagged_spans(title: pa.Array, anns: pa.Array) -> pa.Array:
        own = lambda rows: span_columns.title_spans(rows, types, strict)
        return span_columns.by_items(span_columns.valid(title), anns, span_columns.plain_annotations, columns, loops, own)

    return tagged_spans


# ---------------------------------------------------------------- tags
def _slice(title: str | None, s: int, e: int | None) -> str | None:
    """``arrays.page_slice``: a negative end counts from the back, a negative start in the first page."""
    text = title or ""
    stop = e if e is None or e >= 0 else None if title is None else len(text) + e
    size = 0 if stop is None else max(stop - s, 0)
    if size > PAGE and title is None:
        return None
    if s >= 0:
        return text[s : s + size]
    if size <= PAGE and s <= -PAGE:
        return ""
    held = text[: 2 * PAGE] if size <= PAGE else text
    at = s + 1
    first = at + len(held) if at < 0 else 0
    return held[max(first, 0) : max(first + size, 0)]


def _words(piece: str | None) -> list[str]:
    if not piece or piece == " ":
        return []
    return [piece] if piece.isalnum() else _WORD_OR_SYMBOL.findall(piece)


def _marks(n: int, biose: bool) -> list[str]:
    if not biose:
        return ["B", *["I"] * (n - 1)]
    return ["S"] if n == 1 else ["B", *["I"] * (n - 2), "E"]


def _tags(title: str | None, spans: list[tuple], biose: bool, by_type: bool) -> tuple[list[tuple] | None, int]:
    """Words with their tags, and how many spans are not among the accepted ones."""
    if by_type:
        ordered = [(typ, s, None if e is None else -e, e) for _, typ, s, e in spans]
    else:
        ordered = [(s, None if e is None else -e, typ, e) for _, typ, s, e in spans]
    try:
        ordered.sort()
    except TypeError:  # a missing value
        ordered.sort(key=_key)
    out, last, end, n, whole = [], 0, 0, 0, True
    for row in ordered:
        typ, s, e = (row[0], row[1], row[3]) if by_type else (row[2], row[0], row[3])
        if s is None or end is None or s < end:
            continue
        n, end = n + 1, e
        if title is not None and e is not None and e >= 0 and last >= 0:
            gap, piece = title[last:s], title[s:e]
        else:
            gap, piece = _slice(title, last, s), _slice(title, s, e)
            whole = whole and gap is not None and piece is not None
        for w in _words(gap):
            out.append((w, "O"))
        words = _words(piece)
        if len(words) == 1 and typ is not None:
            out.append((words[0], f"{'S' if biose else 'B'}-{typ.strip(' ').replace(' ', '##')}"))
        elif words:
            name = None if typ is None else typ.strip(" ").replace(" ", "##")
            out.extend((w, None if name is None else f"{m}-{name}") for w, m in zip(words, _marks(len(words), biose)))
        last = e or 0
    rest = _slice(title, last, None if title is None else len(title))
    out.extend((w, "O") for w in _words(rest))
    return (out if whole else None), len(spans) - n


def bio(scheme: str, order: str):
    """``(title, spans) -> tags, num_overlap``."""

    def loops(title: pa.Array, spans: pa.ListArray) -> pa.StructArray:
        found = [
            (None, None) if rows is None else _tags(text, rows, scheme == "BIOSE", order == "type")
            for text, rows in zip(texts(title), lists(spans, [n for n, _ in _SPAN]))
        ]
        tags = list_array((t for t, _ in found), [("word", _TEXT), ("tag", _TEXT)])
        return pa.StructArray.from_arrays([tags, pa.array([n for _, n in found], pa.int64())], ["tags", "num_overlap"])

    def columns(title: pa.Array, spans: pa.ListArray) -> pa.StructArray:
        return span_columns.bio(title, spans, scheme == "BIOSE", order == "type")

    @F.arrow_udf(BIO)
    def bio_of_spans(title: pa.Array, spans: pa.Array) -> pa.Array:
        return span_columns.by_items(span_columns.valid(title), spans, span_columns.plain_spans, columns, loops)

    return bio_of_spans
