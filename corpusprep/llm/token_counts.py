"""Exact token counts of every prefix of a text, for a sentencepiece BPE model.

No piece runs over a place where a space follows a character that is no space, so a text falls
into chunks that are counted apart.  Inside a chunk the count of every prefix comes from dynamic
programming: the last piece of a prefix is the one that ends there and agrees with the last piece
of the prefix before it, which holds if the two stay apart when merged together.  Deltas from
prefix to prefix are kept, so a truncation or budget question is a running sum, no new encoding.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.span_cache import SpanCache, gather
from corpusprep.llm.words import chunks, text_bytes, word_hashes

SPACE = "▁"
BASE = 0x9E3779B97F4A7C15  # of the hash of a run of characters, modulo 2^64
FEW = 64  # fewer chunks of like lengths than this are counted one after the other
KNOWN_PAIRS = 500_000  # entries of the table that goes with that
_COUNTERS: dict[str, "PrefixCounter"] = {}


class PrefixCounter:
    """Counts the tokens of all prefixes of strings; one counter serves a Python worker.

    The programming runs over many strings side by side, place by place: the hash of the last k
    characters names the piece, and a table of pairs tells whether it agrees with the one before.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not special(i)]
        self.score = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not special(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece of this model has a space after another character")
        if m.decode(m.encode("a  b ")) != "a  b ":
            raise ValueError("this model does not keep white space")
        self.longest = max(map(len, self.pieces))
        self.powers = np.array([pow(BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.piece_at = hashes[order], order.astype(np.int64)
        self.none = len(self.pieces)  # before the first piece
        self.bytes = self.none + 1  # a character that falls back to bytes
        self.pairs, self.agree = np.zeros(0, np.int64), np.zeros(0, bool)
        self.number = {piece: i for i, piece in enumerate(self.pieces)}
        self.fits: dict[int, bool] = {}
        sizes: dict[str, set[int]] = {}
        for piece in self.pieces:
            sizes.setdefault(piece[-1], set()).add(len(piece))
        self.sizes = {c: sorted(x, reverse=True) for c, x in sizes.items()}  # of the pieces with this last character
        self.cache = SpanCache(self._steps_of, np.int8)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * BASE + ord(c) + 1) & (1 << 64) - 1
        return h

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` from single characters gives just these two pieces."""
        parts = list(left + right)
        while len(parts) > 1:
            best = max((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == -np.inf:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts == [x for x in (left, right) if x]

    def _may_follow(self, key: int) -> bool:
        left, right = divmod(key, self.bytes + 1)
        name = lambda i: self.pieces[i] if i < self.none else ""
        return self._apart("" if left == self.bytes else name(left), name(right))

    def _agreeing(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether ``piece`` may follow ``before``, from the table of pairs."""
        key = before * (self.bytes + 1) + piece
        at = np.searchsorted(self.pairs, key)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == key[known]
        if not known.all():
            new = np.unique(key[~known])
            found = [self._may_follow(k) for k in new.tolist()]
            held = slice(0, len(self.pairs) if len(self.pairs) < 2_000_000 else 0)
            pairs = np.concatenate([self.pairs[held], new])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.agree = pairs[order], np.concatenate([self.agree[held], np.array(found, bool)])[order]
            return self._agreeing(before, piece)
        return self.agree[at]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of every prefix, the empty one first, of texts with spaces as the model's
        mark: a row for each text, and which places of the rows are used."""
        n, width = np.array([len(t) for t in texts]), max(map(len, texts))
        points = np.zeros((len(texts), width), np.uint64)
        inside = np.arange(width) < n[:, None]
        points[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        size_of = np.searchsorted(np.array([0x80, 0x800, 0x10000], np.uint64), points, side="right") + 1
        hashes = np.zeros((len(texts), width + 1), np.uint64)
        last = np.full((len(texts), width + 1), self.none, np.int64)
        count = np.zeros((len(texts), width + 1), np.int64)
        for end in range(1, width + 1):
            hashes[:, end] = hashes[:, end - 1] * np.uint64(BASE) + points[:, end - 1] + np.uint64(1)
            still = np.flatnonzero(n >= end)
            for size in range(min(self.longest, end), 0, -1):
                tail = hashes[still, end] - hashes[still, end - size] * self.powers[size]
                at = np.minimum(np.searchsorted(self.hashes, tail), self.none - 1)
                found = self.hashes[at] == tail
                if size == 1:  # a character of no piece goes as its bytes
                    lone = still[~found]
                    last[lone, end] = self.bytes
                    count[lone, end] = count[lone, end - 1] + size_of[lone, end - 1]
                rows, piece = still[found], self.piece_at[at[found]]
                fits = self._agreeing(last[rows, end - size], piece)
                rows, piece = rows[fits], piece[fits]
                last[rows, end] = piece
                count[rows, end] = count[rows, end - size] + 1
                if size == 1:
                    break
                taken = np.zeros(len(still), bool)
                taken[np.flatnonzero(found)[fits]] = True
                still = still[~taken]
                if not len(still):
                    break
        return count, inside

    def counts_along(self, text: str) -> np.ndarray:
        """As ``counts``, of one text: character by character, for long texts that have few beside them."""
        number, sizes, fits, base = self.number, self.sizes, self.fits, self.bytes + 1
        last, count = array("i", [self.none]), array("i", [0])
        for end, c in enumerate(text, 1):
            for size in sizes.get(c, ()):
                if size > end:
                    continue
                piece = number.get(text[end - size : end])
                if piece is None:
                    continue
                key = last[end - size] * base + piece
                fit = fits.get(key)
                if fit is None:
                    if len(fits) >= KNOWN_PAIRS:
                        fits.clear()
                    fit = fits[key] = self._may_follow(key)
                if fit:
                    last.append(piece)
                    count.append(count[end - size] + 1)
                    break
            else:
                lone = c not in number
                last.append(self.bytes if lone else self.none)
                count.append(count[end - 1] + len(c.encode()) if lone else 0)
        return np.array(count, np.int64)

    def _steps_of(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Steps of the counts, for chunks that begin with a space; each fits one signed byte."""
        sizes = np.array([len(x) for x in spans], np.int64)
        order = np.argsort(sizes, kind="stable")
        flat, at = [], 0
        while at < len(order):
            # Texts of like lengths side by side.
            most = 2 * sizes[order[at]] + 8
            some = order[at : min(at + 16384, int(np.searchsorted(sizes[order], most, side="right")))]
            whole = self.model.encode([spans[i][1:] for i in some], num_threads=1)
            marked = [spans[i].replace(" ", SPACE) for i in some]
            if len(some) < FEW:
                each = [self.counts_along(x) for x in marked]
                for row, (i, found) in enumerate(zip(some, each)):
                    if found[-1] != (len(whole[row]) if sizes[i] > 1 else 1):
                        each[row] = self._by_library(spans[i])
                flat += [np.diff(x).astype(np.int8) for x in each]
                at += len(some)
                continue
            count, inside = self.counts(marked)
            expected = np.where(sizes[some] > 1, [len(x) for x in whole], 1)
            for row in np.flatnonzero(count[np.arange(len(some)), sizes[some]] != expected):
                by_library = self._by_library(spans[some[row]])
                count[row, : len(by_library)] = by_library
            flat.append(np.diff(count, axis=1)[inside].astype(np.int8))
            at += len(some)
        begin = np.empty(len(sizes), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return gather(np.concatenate(flat), begin, sizes), sizes

    def _by_library(self, text: str) -> np.ndarray:
        """For a chunk on which the agreement rule fails: every prefix is encoded."""
        return np.array([0, 1, *(len(self.model.encode(text[1:e])) for e in range(2, len(text) + 1))])


def counter(path: str) -> PrefixCounter:
    return _COUNTERS.get(path) or _COUNTERS.setdefault(path, PrefixCounter(path))


def _chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of texts that each begin with a space: cut where a space follows something else."""
    space = data == 32
    mark = np.zeros(len(data), bool)  # the last byte of the model's own space character
    mark[2:] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    begins = space.copy()
    begins[1:] &= ~(space | mark)[:-1]
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(data))


def prefix_counts(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``prefix_steps`` to every row of ``docs``.

    ``prefix_steps`` has one signed byte for each code point, after a first one for the model's
    dummy space: the tokens of the first k > 0 code points are the sum of the first k + 1 bytes.
    Counts are those of the sentencepiece ``model`` without begin or end tokens, special strings
    as ordinary text.  Null and empty texts have no tokens and no steps.  Columns of these names
    are replaced, others stay as they are.
    """
    added = ["n_bytes", "n_tokens", "prefix_steps"]
    others = [c for c in docs.columns if c not in added]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(model)
        for batch in batches:
            for part in chunks(batch, "_tc_text"):
                data, offsets = text_bytes(part.column("_tc_text"))
                n_bytes = np.diff(offsets)
                spaced = np.insert(data, offsets[:-1], 32)
                edges = offsets + np.arange(len(offsets))
                starts, ends = _chunk_spans(spaced, edges)
                flat, sizes = counts.cache.of(spaced, starts, ends, word_hashes(spaced, starts, ends))
                bounds = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, edges)]
                sums = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
                tokens = np.where(n_bytes > 0, np.diff(sums[bounds]), 0)
                steps = [flat[s:e].tobytes() if n else b"" for s, e, n in zip(bounds, bounds[1:], n_bytes)]
                yield pa.RecordBatch.from_arrays(
                    [*part.select(names).columns, pa.array(n_bytes), pa.array(tokens), pa.array(steps, pa.binary())],
                    names=[*names, *added],
                )

    # Other columns travel under plain names, whatever theirs are.
    names = [f"_c{i}" for i in range(len(others))]
    slim = docs.select(*[docs[c].alias(n) for c, n in zip(others, names)], docs[text].alias("_tc_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    made = slim.mapInArrow(work, f"{schema}, n_bytes bigint, n_tokens bigint, prefix_steps binary")
    return made.withColumnsRenamed(dict(zip(names, others)))


def budget_prefix(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)[1:]
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def truncated(table: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """Adds ``fit_text``, the longest prefix of the text with at most ``budget`` tokens, to the
    result of ``prefix_counts`` without encoding anything."""

    @F.arrow_udf("int")
    def fit(steps: pa.Array) -> pa.Array:
        return pa.array([budget_prefix(x.as_py(), budget) for x in steps], pa.int32())

    return table.withColumn("fit_text", F.substring(F.coalesce(F.col(text), F.lit("")), F.lit(1), fit("prefix_steps")))
