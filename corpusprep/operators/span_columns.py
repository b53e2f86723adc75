"""The steps of ``spans`` over all items of a batch at once, as columns.

Most items know every value, list their annotations in order and lie inside their title; for those, slices,
overlaps, order and words are found by array operations on the batch's characters.  The other items go
through the loops of ``spans``, whose results these are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 17  # bytes of titles whose characters are held as columns at a time
_WORD, _SPACE, _SYMBOL = 1, 2, 3
_KINDS = np.zeros(0x110000, np.uint8)  # of characters, filled in as they occur
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


# ---------------------------------------------------------------- columns of a batch
def valid(arr: pa.Array) -> pa.Array:
    """A string array without malformed bytes."""
    try:
        arr.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in arr.cast(pa.binary()).to_pylist()], pa.string())
    return arr


def sizes(arr: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def list_of(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets(counts), pa.int32()), values)


def _bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without missing values, and where each string begins and the last ends."""
    if not len(arr):  # its buffers may be empty too
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, ends - ends[0]


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin, begin + 1, ..`` of each range, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _known(*arrays: pa.Array) -> np.ndarray:
    """Where no value is missing."""
    known = np.ones(len(arrays[0]), bool)
    for arr in arrays:
        if arr.null_count:
            known &= arr.is_valid().to_numpy(zero_copy_only=False)
    return known


def _ints(arr: pa.Array) -> np.ndarray:
    return pc.fill_null(arr, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(arr: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Strings as numbers that are in the strings' order."""
    coded = arr.dictionary_encode()
    names = coded.dictionary.to_pylist()
    ordered = sorted(names)
    rank = {n: i for i, n in enumerate(ordered)}
    return np.array([rank[n] for n in names], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.int64), ordered


def _order(*keys: np.ndarray) -> np.ndarray:
    """Row numbers in the order of the keys, none of them negative, the first deciding first."""
    bits = [int(k.max()).bit_length() if len(k) else 0 for k in keys]
    if sum(bits) > 62:
        return np.lexsort(keys[::-1])
    joined = keys[0]
    for key, n in zip(keys[1:], bits[1:]):
        joined = (joined << n) | key
    return np.argsort(joined, kind="stable")


class Titles:
    """The characters of a piece's titles, one after the other."""

    def __init__(self, title: pa.Array):
        self.title = title
        self.data, ends = _bytes(title)
        lead = (self.data & 0xC0) != 0x80
        self.ascii = bool(lead.all())
        if self.ascii:
            self.first = ends  # character at which a title begins, and the number of characters
            self.at = np.arange(len(self.data) + 1)  # byte at which a character begins
        else:
            self.at = np.append(np.flatnonzero(lead), len(self.data))
            self.first = np.searchsorted(self.at, ends)
        self.size = np.diff(self.first)

    def kinds(self) -> np.ndarray:
        """Whether each character is part of a word, space or a symbol."""
        if self.ascii:
            points = self.data
        else:
            points = np.frombuffer(self.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        found = _KINDS[points]
        if not found.all():
            for p in np.unique(points[found == 0]).tolist():
                c = chr(p)
                _KINDS[p] = _WORD if c.isalnum() or c == "_" else _SPACE if c.isspace() else _SYMBOL
            found = _KINDS[points]
        return found

    def slices(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The texts between two characters, counted from the piece's first."""
        low = self.at[begin]
        size = self.at[end] - low
        return _strings(self.data[_ranges(low, size)], offsets(size))

    def equal(self, begin: np.ndarray, end: np.ndarray, values: pa.Array) -> np.ndarray:
        """Whether the text between two characters is the value."""
        data, ends = _bytes(values)
        low, size = self.at[begin], np.diff(ends)
        same = self.at[end] - low == size
        rows = np.flatnonzero(same)
        told = size[rows]
        differing = np.flatnonzero(self.data[_ranges(low[rows], told)] != data[_ranges(ends[:-1][rows], told)])
        if len(differing):
            same[rows[np.searchsorted(np.cumsum(told), differing, "right")]] = False
        return same


def pieces(title: pa.Array) -> Iterator[tuple[int, int]]:
    """First item and number of items whose titles have about ``PIECE`` bytes together, one item at least."""
    ends = offsets(pc.fill_null(pc.binary_length(title), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(title):
        upto = max(int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1, at + 1)
        yield at, upto - at
        at = upto


def joined(parts: list[pa.Array]) -> pa.Array:
    """The parts as one array; what making them took goes back to the system, as several workers wait side by side."""
    whole = pa.concat_arrays(parts)
    parts.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
    return whole


def by_items(
    title: pa.Array, rows: pa.ListArray, plain: Callable, columns: Callable, loops: Callable, chosen: Callable = lambda lists: lists
) -> pa.Array:
    """``columns`` of the items that are ``plain``, ``loops`` of the others, in their order; both get the ``chosen`` rows."""
    done = []
    for at, n in pieces(title):
        texts, lists = title.slice(at, n), chosen(rows.slice(at, n))
        easy = plain(texts, lists)
        if easy.all():
            done.append(columns(texts, lists))
            continue
        own, other = np.flatnonzero(easy), np.flatnonzero(~easy)
        parts = [f(texts.take(pa.array(ids)), lists.take(pa.array(ids))) for f, ids in ((columns, own), (loops, other)) if len(ids)]
        back = np.argsort(np.concatenate([own, other]), kind="stable")
        done.append(pa.concat_arrays(parts).take(pa.array(back)))
    return joined(done) if done else loops(title, chosen(rows))


def _all_of(items: np.ndarray, good: np.ndarray, n: int) -> np.ndarray:
    """Items all of whose rows are good."""
    easy = np.ones(n, bool)
    easy[items[~good]] = False
    return easy


def _items_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


# ---------------------------------------------------------------- repair
def title_spans(anns: pa.ListArray, types: list[str] | None, strict: bool) -> pa.ListArray:
    """The annotations of titles with a valid start (and end) and one of the types."""
    values = anns.flatten()
    if not len(values):
        return anns
    columns = dict(zip([f.name for f in values.type], values.flatten()))
    keep = pc.and_(pc.greater_equal(columns["start_idx"], 0), pc.equal(columns["source"], "title"))
    if not strict:
        keep = pc.and_(keep, pc.greater_equal(columns["end_idx"], 0))
    if types is not None:
        keep = pc.and_(keep, pc.is_in(columns["attribute_type"], pa.array([t for t in types if t is not None], pa.string())))
    keep = pc.fill_null(keep, False)
    kept = np.bincount(_items_of(sizes(anns))[keep.to_numpy(zero_copy_only=False)], minlength=len(anns))
    own = pa.StructArray.from_arrays(
        [valid(c) if pa.types.is_string(c.type) else c for c in (x.filter(keep) for x in columns.values())], list(columns)
    )
    return pa.ListArray.from_arrays(pa.array(offsets(kept), pa.int32()), own, mask=anns.is_null())


def _columns(rows: pa.ListArray, *names: str) -> list[pa.Array]:
    values = rows.flatten()
    columns = values.flatten()
    return [columns[values.type.get_field_index(n)] for n in names]


def plain_annotations(title: pa.Array, anns: pa.ListArray) -> np.ndarray:
    """Items that know their title and every value and list the annotations in order, without repeats."""
    items = _items_of(sizes(anns))
    line, s, e, typ, val = _columns(anns, "line_idx", "start_idx", "end_idx", "attribute_type", "attribute_value")
    good = _known(line, s, e, typ, val)
    line, s, e = _ints(line), _ints(s), _ints(e)
    good &= (e >= 0) & (s >= 0)
    after = (line[1:] > line[:-1]) | ((line[1:] == line[:-1]) & ((s[1:] > s[:-1]) | ((s[1:] == s[:-1]) & (e[1:] > e[:-1]))))
    good[1:] &= after | (items[1:] != items[:-1])
    return _all_of(items, good, len(title)) & _known(title, anns)


def _searched(held: Titles, items: np.ndarray, values: pa.Array, begin: np.ndarray, end: np.ndarray, new_search: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the first whole-word hit of each value, else of the text it marks; start -1 if there is none."""
    starts, lengths = [], []
    own, at = np.unique(items, return_inverse=True)
    texts = held.title.take(pa.array(own)).to_pylist()
    last, search, text = -1, None, ""
    for i, val, b, e in zip(at.tolist(), values.to_pylist(), begin.tolist(), end.tolist()):
        if i != last:
            last, text = i, texts[i]
            search = new_search(text)
        found = search.first(val)
        if found < 0:
            val = text[b:e]
            found = search.first(val)
        starts.append(found)
        lengths.append(len(val))
    return np.array(starts, np.int64), np.array(lengths, np.int64)


def _dropped(items: np.ndarray, typ: np.ndarray, s: np.ndarray, e: np.ndarray, line: np.ndarray, strict: bool) -> np.ndarray:
    """What an ordered scan drops, each row compared with the last one that decides."""
    drop = np.zeros(len(s), bool)
    over = (items[1:] == items[:-1]) & (s[1:] < e[:-1]) & (line[:-1] >= line[1:])
    if strict:
        drop[1:] = over
        return drop
    drop[1:] = over & (typ[1:] == typ[:-1]) & (e[:-1] >= e[1:])
    upto, n = 0, len(s)
    # Behind a dropped row the last kept one decides, up to the next that is kept.
    for at in np.flatnonzero(drop).tolist():
        if at < upto:
            continue
        k, j = at - 1, at + 1
        while j < n and items[j] == items[k] and s[j] < e[k] and line[k] >= line[j] and typ[j] == typ[k] and e[k] >= e[j]:
            drop[j] = True
            j += 1
        if j < n:
            drop[j] = False
        upto = j + 1
    return drop


def tagged(title: pa.Array, anns: pa.ListArray, strict: bool, new_search: Callable) -> pa.ListArray:
    """Repaired annotations without overlaps, by position, of plain items."""
    n, held = len(title), Titles(title)
    items = _items_of(sizes(anns))
    line, s, e, typ, val = _columns(anns, "line_idx", "start_idx", "end_idx", "attribute_type", "attribute_value")
    line, s, e = _ints(line), _ints(s), _ints(e)
    typ, names = _coded(typ)
    size, first = held.size[items], held.first[items]
    begin, end = np.minimum(s, size), np.minimum(np.maximum(e, s), size)  # of the marked text
    keep = held.equal(first + begin, first + end, val)
    valued = pc.binary_length(val).to_numpy(zero_copy_only=False) > 0
    moved = np.flatnonzero(~keep & valued)
    if len(moved):
        found, length = _searched(held, items[moved], val.take(pa.array(moved)), begin[moved], end[moved], new_search)
        hit = found >= 0
        moved, found, length = moved[hit], found[hit], length[hit]
        s[moved] = begin[moved] = found
        e[moved] = end[moved] = found + length
        keep[moved] = True
    if not strict:
        keep &= end > begin
    rows = np.flatnonzero(keep)
    rows = rows[~_dropped(items[rows], typ[rows], s[rows], e[rows], line[rows], strict)]
    of, low, high, kind = items[rows], s[rows], e[rows], typ[rows]
    again = (of[1:] == of[:-1]) & ((low[1:] < low[:-1]) | ((low[1:] == low[:-1]) & (high[1:] <= high[:-1])))
    if again.any():
        rows = rows[_order(of, low, high, kind)]
        of, low, high, kind = items[rows], s[rows], e[rows], typ[rows]
        once = np.ones(len(rows), bool)
        once[1:] = (of[1:] != of[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (kind[1:] != kind[:-1])
        rows, of, low, high, kind = rows[once], of[once], low[once], high[once], kind[once]
    texts = held.slices(first[rows] + begin[rows], first[rows] + end[rows])
    kinds = pa.array(names, pa.string()).take(pa.array(kind))
    spans = pa.StructArray.from_arrays(
        [texts, kinds, pa.array(low, pa.int32()), pa.array(high, pa.int32())],
        ["indexed_text", "attribute_type", "start_idx", "end_idx"],
    )
    return list_of(np.bincount(of, minlength=n), spans)


# ---------------------------------------------------------------- tags
def plain_spans(title: pa.Array, spans: pa.ListArray) -> np.ndarray:
    """Items that know their title and every type and place, with all places inside the title."""
    items = _items_of(sizes(spans))
    typ, s, e = _columns(spans, "attribute_type", "start_idx", "end_idx")
    good = _known(typ, s, e)
    s, e = _ints(s), _ints(e)
    size = pc.fill_null(pc.utf8_length(title), 0).to_numpy(zero_copy_only=False)
    good &= (s >= 0) & (s <= e) & (e <= size[items])
    return _all_of(items, good, len(title)) & _known(title, spans)


def bio(title: pa.Array, spans: pa.ListArray, biose: bool, by_type: bool) -> pa.StructArray:
    """Words with their tags, and how many spans are not among the accepted ones, of plain items."""
    n, held = len(title), Titles(title)
    counts = sizes(spans)
    items = _items_of(counts)
    typ, s, e = _columns(spans, "attribute_type", "start_idx", "end_idx")
    typ, names = _coded(typ)
    s, e = _ints(s), _ints(e)
    shorter = int((e - s).max(initial=0)) - (e - s)
    order = _order(items, typ, s, shorter) if by_type else _order(items, s, shorter, typ)
    low, high = (held.first[items] + s)[order], (held.first[items] + e)[order]
    end, accepted = 0, []
    for i, (b, upto) in enumerate(zip(low.tolist(), high.tolist())):
        if b >= end:
            accepted.append(i)
            end = upto
    accepted = np.array(accepted, np.int64)
    low, high, own = low[accepted], high[accepted], typ[order][accepted]

    kinds = held.kinds()
    word = kinds == _WORD
    begins = np.ones(len(kinds) + 1, bool)  # a word begins here if there is one
    begins[1:-1] = ~word[:-1]
    begins[held.first] = begins[low] = begins[high] = True
    starts = np.flatnonzero((word & begins[:-1]) | (kinds == _SYMBOL))
    shown = kinds != _SPACE
    width = np.diff(held.at)
    bytes_before = offsets(np.where(shown, width, 0))
    data = held.data[shown if held.ascii else np.repeat(shown, width)]
    words = _strings(data, np.append(bytes_before[starts], bytes_before[-1]))

    if len(low):
        span = np.searchsorted(low, starts, "right") - 1
        inside = (span >= 0) & (starts < high[span])
    else:
        span, inside = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    at = np.flatnonzero(inside)
    span = span[at]
    leads = np.ones(len(at), bool)
    leads[1:] = span[1:] != span[:-1]
    mark = np.where(leads, 0, 1)
    if biose:
        closes = np.ones(len(at), bool)
        closes[:-1] = leads[1:]
        mark = np.where(closes, np.where(leads, 3, 2), mark)
    tag = np.zeros(len(starts), np.int64)
    tag[at] = 1 + 4 * own[span] + mark
    shown_names = [t.strip(" ").replace(" ", "##") for t in names]
    tags = pa.array(["O", *(f"{m}-{t}" for t in shown_names for m in "BIES")], pa.string()).take(pa.array(tag))

    listed = list_of(np.diff(np.searchsorted(starts, held.first)), pa.StructArray.from_arrays([words, tags], ["word", "tag"]))
    taken = np.bincount(items[order][accepted], minlength=n)
    return pa.StructArray.from_arrays([listed, pa.array(counts - taken, pa.int64())], ["tags", "num_overlap"])
