"""Byte-level BPE: text to ids of a rank file and back.

A text is cut without a regular expression: every code point becomes a symbol (its class and what
follows it), every symbol is a function from scanner state to scanner state, and as functions
compose associatively, the states before all characters come from one block-wise scan over whole
batches of texts.  The slices go through a cache to pair merging, many distinct slices side by side.
Ids keep the byte offset at which each of them ends, and decoding writes tokens to their offsets.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusprep.llm.span_cache import SpanCache, gather
from corpusprep.llm.words import chunks, text_bytes, word_hashes

# The pattern whose matches the scanner finds, and the contractions in it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

# Symbols: a letter, one that ends a contraction, the first of two that do, a number, any other, an
# apostrophe, a blank or another space before something visible, a space before one or at the end.
WORD_SYM, ONE_SYM, TWO_SYM, NUMBER_SYM, MARK_SYM, QUOTE_SYM, BLANK_SYM, SPACE_SYM, INNER_SYM = range(9)
SYMBOLS = 9
# States: the next character begins a token; in a word, ...; after a blank that joins what follows;
# after an apostrophe that began a token; inside a contraction of two letters.
FREE, WORD, DIGITS, MARKS, SPACES, JOINING, QUOTE, PAIR = range(8)
STATES = 8

BLOCK = 512  # symbols scanned one after the other, all blocks side by side
SHORT = 64  # bytes of the slices that are merged side by side
NONE = np.iinfo(np.int32).max
_ENCODERS: dict[str, "ByteBpe"] = {}


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the symbol's character begins a token."""
    if symbol in (WORD_SYM, ONE_SYM, TWO_SYM):
        if state == PAIR or state == QUOTE and symbol == ONE_SYM:
            return FREE, False
        if state == QUOTE and symbol == TWO_SYM:
            return PAIR, False
        return WORD, state not in (WORD, JOINING)
    if symbol == NUMBER_SYM:
        return DIGITS, state not in (DIGITS, JOINING)
    if symbol in (MARK_SYM, QUOTE_SYM):
        if state in (MARKS, QUOTE, JOINING):
            return MARKS, False
        return (QUOTE if symbol == QUOTE_SYM else MARKS), True
    if symbol == INNER_SYM:
        return SPACES, state != SPACES
    return (JOINING if symbol == BLANK_SYM else FREE), True


class Scanner:
    """Token starts from symbols; symbol + ``SYMBOLS`` is the same one at the start of a text."""

    def __init__(self):
        plain = [tuple(_step(s, y)[0] for s in range(STATES)) for y in range(SYMBOLS)]
        resets = [(f[FREE],) * STATES for f in plain]
        functions = [tuple(range(STATES)), *dict.fromkeys(plain + resets)]
        for f in functions:  # grows to all functions that sequences of symbols make
            for g in (*plain, *resets):
                if (h := tuple(g[s] for s in f)) not in functions:
                    functions.append(h)
        number = {f: i for i, f in enumerate(functions)}
        self.generator = np.array([number[f] for f in plain + resets], np.uint8)
        self.count = np.intp(len(functions))
        # Flat tables, by function * count + function and function * SYMBOLS + symbol.
        self.then = np.array([number[tuple(g[s] for s in f)] for f, g in product(functions, repeat=2)], np.uint8)
        self.begins = np.array([_step(f[FREE], y)[1] for f in functions for y in range(SYMBOLS)])

    def _before(self, functions: np.ndarray) -> np.ndarray:
        """The composition of all functions before each."""
        n = len(functions)
        if not n:
            return functions
        blocks = -(-n // BLOCK) if n > BLOCK else 1
        side = np.zeros(blocks * (BLOCK if blocks > 1 else n), np.uint8)
        side[:n] = functions
        side = side.reshape(blocks, -1).T.copy()
        out = np.empty_like(side)
        total = np.zeros(blocks, np.uint8)
        for i, row in enumerate(side):
            out[i] = total
            total = self.then.take(total * self.count + row)
        if blocks > 1:
            out = self.then.take(self._before(total) * self.count + out)
        return out.T.reshape(-1)[:n]

    def starts(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether each character begins a token; ``first`` marks the first ones of texts."""
        before = self._before(self.generator[symbols + first * np.uint8(SYMBOLS)])
        return self.begins.take(before * np.intp(SYMBOLS) + symbols) | first


def _symbols() -> np.ndarray:
    """The symbol of every code point if nothing follows it; its class (letter, number, white space
    or else a mark) is asked of the library, whose Unicode version is what counts."""
    import tiktoken

    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(map(chr, points))
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, MARK_SYM, np.uint8)
    for symbol, pattern in ((WORD_SYM, r"\p{L}+"), (NUMBER_SYM, r"\p{N}+"), (INNER_SYM, r"\s+")):
        found = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = symbol
    out[[ord(c) for c in ONE_LETTER]] = ONE_SYM
    out[ord("'")] = QUOTE_SYM
    return out


class ByteBpe:
    """Encoder and decoder of one rank file; one serves a Python worker."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("every single byte must have a rank")
        size = max(self.ranks.values()) + 1
        self.bytes = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.sizes = np.array([len(t) for t in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        pairs = {
            left * size + right: rank
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := get(token[:cut])) is not None and (right := get(token[cut:])) is not None
        }
        self.pair_dict, self.base = pairs, size
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)
        self.scanner, self.symbols = Scanner(), _symbols()
        self.cache = SpanCache(self._encoded, np.int32)

    # ------------------------------------------------------------ cutting
    def _symbols(self, points: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Symbols of code points; ``last`` marks the last ones of texts."""
        out = self.symbols.take(points)
        for a, b in TWO_LETTERS:
            at = np.flatnonzero(points[:-1] == ord(a))
            out[at[(points[at + 1] == ord(b)) & ~last[at]]] = TWO_SYM
        at = np.flatnonzero(out[:-1] == INNER_SYM)
        at = at[(out[at + 1] != INNER_SYM) & ~last[at]]  # a space before something visible
        out[at] = np.where(points[at] == 32, BLANK_SYM, SPACE_SYM)
        return out

    def slices(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (in bytes) of every slice of texts that lie end to end."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)  # of each code point
        heads = np.searchsorted(place, offsets[:-1][np.diff(offsets) > 0])
        first, last = np.zeros(len(points), bool), np.zeros(len(points), bool)
        first[heads] = True
        last[heads[1:] - 1] = last[-1] = True
        starts = place[self.scanner.starts(self._symbols(points, last), first)]
        return starts, np.append(starts[1:], len(data))

    # ------------------------------------------------------------ merging
    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)

    def _side_by_side(self, spans: list[bytes]) -> list[np.ndarray]:
        """Ids of slices of one length: in each round the pair of lowest rank, the leftmost of
        equal ones, is merged in every slice that has one."""
        ids = self.single[np.frombuffer(b"".join(spans), np.uint8).reshape(len(spans), -1)]
        done: list[np.ndarray] = [ids[0]] * len(spans)
        rank = self._rank_of(ids[:, :-1], ids[:, 1:])
        who = np.arange(len(spans))
        while True:
            width = ids.shape[1]
            at = rank.argmin(axis=1) if width > 1 else np.zeros(len(ids), np.int64)
            best = rank[np.arange(len(ids)), at] if width > 1 else np.full(len(ids), NONE)
            ended = best == NONE
            for row in np.flatnonzero(ended):
                done[who[row]] = ids[row]
            if ended.all():
                return done
            go = ~ended
            ids, rank, at, best, who = ids[go], rank[go], at[go], best[go], who[go]
            rows = np.arange(len(ids))
            ids[rows, at] = best
            # Each slice loses the place after its merge.
            keep = np.arange(width - 1)
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), axis=1)
            rank = np.take_along_axis(rank, keep[:-1] + (keep[:-1] >= at[:, None]), axis=1)
            left = at > 0
            rank[rows[left], at[left] - 1] = self._rank_of(ids[rows[left], at[left] - 1], ids[rows[left], at[left]])
            right = at < width - 2
            rank[rows[right], at[right]] = self._rank_of(ids[rows[right], at[right]], ids[rows[right], at[right] + 1])

    def _by_heap(self, span: bytes) -> np.ndarray:
        """Ids of a long slice: the pairs wait in a heap, by rank and place."""
        ids = [int(x) for x in self.single[np.frombuffer(span, np.uint8)]]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        of, base, n = self.pair_dict.get, self.base, len(ids)
        heap = [(r, i) for i in range(n - 1) if (r := of(ids[i] * base + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or of(ids[i] * base + ids[j]) != rank:
                continue  # a merge has changed this pair
            ids[i], ids[j], k = rank, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := of(rank * base + ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := of(ids[h] * base + rank)) is not None:
                heapq.heappush(heap, (r, h))
        return np.array([x for x in ids if x >= 0], np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slices, end to end, and how many each has; a slice that is a token stays whole."""
        spans = [t.encode() for t in texts]
        found: list = [None] * len(spans)
        lengths: dict[int, list[int]] = {}
        for i, span in enumerate(spans):
            if (rank := self.ranks.get(span)) is not None:
                found[i] = (rank,)
            elif len(span) > SHORT:
                found[i] = self._by_heap(span)
            else:
                lengths.setdefault(len(span), []).append(i)
        for members in lengths.values():
            for s in range(0, len(members), 16384):
                some = members[s : s + 16384]
                for i, ids in zip(some, self._side_by_side([spans[i] for i in some])):
                    found[i] = ids
        sizes = np.array([len(x) for x in found], np.int64)
        return np.concatenate(found).astype(np.int32), sizes

    # ------------------------------------------------------------ whole texts
    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end, where each id's bytes end in ``data``, and the bounds
        of the texts among the ids."""
        starts, ends = self.slices(data, offsets)
        ids, sizes = self.cache.of(data, starts, ends, word_hashes(data, starts, ends))
        if not np.array_equal(self.decode(ids), data):  # two slices of one hash
            raw = data.tobytes()
            ids, sizes = self._encoded([raw[s:e].decode() for s, e in zip(starts, ends)])
        before = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.cumsum(self.sizes[ids]), before[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, end to end."""
        return gather(self.flat, self.at[ids], self.sizes[ids])


def encoder(path: str) -> ByteBpe:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, ByteBpe(path))


def _arrays(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def _mapped(docs: DataFrame, value: str, added: dict[str, str], work) -> DataFrame:
    """``docs`` with the columns ``added`` (name to type) that ``work`` makes of a batch's column
    ``_value``; the other columns travel under plain names, whatever theirs are."""
    others = [c for c in docs.columns if c not in added]
    names = [f"_c{i}" for i in range(len(others))]
    slim = docs.select(*[docs[c].alias(n) for c, n in zip(others, names)], docs[value].alias("_value"))
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, columns in work(batch):
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, *columns], names=[*names, *added])

    made = slim.mapInArrow(run, ", ".join([*schema, *(f"{c} {t}" for c, t in added.items())]))
    return made.withColumnsRenamed(dict(zip(names, others)))


def encode(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` and ``id_ends`` (both array<int>) to every row of ``docs``.

    Ids are those of the rank file, each match of ``PATTERN`` merged apart and special strings
    taken as ordinary text; ``id_ends`` has the byte offset in the UTF-8 text at which each id
    ends.  Null and empty texts have empty arrays; repeated rows and ties do not matter, as every
    row stands alone.  Columns of these two names are replaced, others stay as they are.
    """

    def work(batch: pa.RecordBatch):
        bpe = encoder(ranks)
        for part in chunks(batch, "_value"):
            data, offsets = text_bytes(part.column("_value"))
            ids, ends, bounds = bpe.encode(data, offsets)
            yield part, [_arrays(ids, bounds), _arrays(ends - np.repeat(offsets[:-1], np.diff(bounds)), bounds)]

    return _mapped(docs, text, {"ids": "array<int>", "id_ends": "array<int>"}, work)


def decode(table: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of each row's ids.  Null or empty ids give no bytes;
    a column of this name is replaced, others stay as they are."""

    def work(batch: pa.RecordBatch):
        bpe = encoder(ranks)
        column = batch.column("_value")
        sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 18))) + 1
        for s, e in zip([0, *cuts], [*cuts, batch.num_rows]):
            if s == e:
                continue
            part = batch.slice(int(s), int(e - s))
            found = part.column("_value").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data = bpe.decode(found).tobytes()
            bounds = np.concatenate([[0], np.cumsum(bpe.sizes[found])])[np.concatenate([[0], np.cumsum(sizes[s:e])])]
            yield part, [pa.array([data[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary())]

    return _mapped(table, ids, {"decoded": "binary"}, work)


def bytes_between(bpe: ByteBpe, ids: np.ndarray, ends: np.ndarray, first: int, last: int) -> bytes:
    """Bytes ``first`` to ``last`` of an encoded text; only the tokens that lie there are decoded."""
    s, e = np.searchsorted(ends, [first, last], side="right")
    some = ids[s : e + 1]
    begin = int(ends[s] - bpe.sizes[ids[s]]) if len(some) else first
    return bpe.decode(some).tobytes()[max(first - begin, 0) : max(last - begin, 0)]
