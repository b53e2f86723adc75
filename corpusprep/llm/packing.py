"""Documents packed into token sequences along a Hilbert curve.

A document's words are hashed to directions in a space of few dimensions; the mean direction is
its place, and the place's Hilbert key its order.  Documents are range-sorted by that key, laid
end to end and cut every ``length`` tokens, so neighbours share sequences and only the very last
sequence is short.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored
from corpusprep.llm.span_cache import SpanCache
from corpusprep.llm.words import LOWER, SPACES, chunks, mix, text_bytes, word_hashes, word_spans

DIMS = 3
KEY_BITS = 16  # bits of the Hilbert key for each dimension
CUT = 1 << 18  # tokens cut into pieces at a time
LENGTH = 4096
# Kinds of bytes: 0 blanks, 1 letters and digits, 2 signs, 3 what stays with all it touches but blanks.
_KIND = np.full(256, 2, np.uint8)
_KIND[SPACES] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[39, *range(128, 256)]] = 3
_CACHES: dict[str, SpanCache] = {}


def word_ids(path: str) -> SpanCache:
    """Token ids of blank-separated words, for a tokenizer that drops white space.

    Many words go through the tokenizer as one text, parted by its first special token; a word
    that could hold a special token goes alone.  One cache serves a Python worker.
    """
    if path in _CACHES:
        return _CACHES[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    mark, token = min((i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes, run = [], [], []

        def together() -> None:
            ids = np.array(tokenizer.encode_batch_fast([f" {token} ".join(run)], add_special_tokens=False)[0].ids, np.uint32)
            marks = ids == mark
            flat.append(ids[~marks])
            sizes.append(np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1)
            run.clear()

        for word in words:
            if "<|" in word:
                if run:
                    together()
                flat.append(np.array(tokenizer.encode(word, add_special_tokens=False).ids, np.uint32))
                sizes.append([len(flat[-1])])
            else:
                run.append(word)
                if len(run) == 2000:
                    together()
        if run:
            together()
        return np.concatenate(flat), np.concatenate(sizes)

    return _CACHES.setdefault(path, SpanCache(encode, np.uint32))


def tokenizer_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(data, starts, ends, rows)``: spans whose tokens, end to end, are those of the texts.

    The tokenizer lowers letters, drops blanks, and parts letters and digits from signs, but for
    an apostrophe before letters; so do the spans, within ASCII.  Texts that may hold a special
    token's string are cut at blanks only.
    """
    data, offsets = text_bytes(column)
    if len(data) and not ((data[:-1] == 60) & (data[1:] == 124)).any():
        data = LOWER[data]
        kind = _KIND[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = ((kind[1:] == 0) != (kind[:-1] == 0)) | (kind[1:] * kind[:-1] == 2)
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        seen = kind[starts] != 0
        starts, ends = starts[seen], ends[seen]
    else:
        starts, ends = word_spans(data, offsets)
    return data, starts, ends, np.searchsorted(starts, offsets)


def hilbert_keys(coords: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """Hilbert curve index of integer points (rows of ``coords``), by Gray-code rotations."""
    x = [coords[:, i].astype(np.int64) for i in range(coords.shape[1])]
    n = len(x)
    # Undo the curve's rotations and reflections from the highest bit down.
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            set_ = (x[i] & level) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where((x[-1] & level) != 0, flip ^ (level - 1), flip)
        level >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ flip) >> b) & 1)
    return key


def _directions(size: int) -> np.ndarray:
    """A fixed direction for every hash slot, components in [-1, 1)."""
    slots = np.arange(size * DIMS, dtype=np.uint64)
    return (mix(slots + np.uint64(77)) >> np.uint64(11)).astype(np.float64).reshape(size, DIMS) / (1 << 52) - 1


def tokenized(docs: DataFrame, doc_id: str, text: str, path: str, end_id: int) -> DataFrame:
    """``_id, key, n, ids`` of every row: its tokens with the end id as little-endian uint16 or
    uint32 (``wide``) and its Hilbert key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, slots = word_ids(path), _directions(1 << 12)
        for batch in batches:
            for part in chunks(batch, "_text"):
                data, starts, ends, rows = tokenizer_spans(part.column("_text"))
                hashes = word_hashes(data, starts, ends)
                flat, sizes = cache.of(data, starts, ends, hashes)
                bounds = np.concatenate([[0], np.cumsum(sizes)])[rows]
                n = np.diff(bounds)
                # The place of a document: the mean of its words' directions.
                place = slots[(hashes & np.uint64(len(slots) - 1)).astype(np.int64)]
                sums = np.vstack([np.zeros(DIMS), np.cumsum(place, 0)])[rows]
                mean = np.diff(sums, axis=0) / np.maximum(np.diff(rows), 1)[:, None]
                grid = np.clip((mean * 2 + 1) / 2, 0, 1 - 2.0**-KEY_BITS) * (1 << KEY_BITS)
                ids = np.insert(flat, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                narrow = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else None
                used = ids if narrow is None else narrow
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        pa.array(hilbert_keys(grid.astype(np.int64))),
                        pa.array(n + 1),
                        pa.array([used[s:e].tobytes() for s, e in zip(bounds, bounds[1:])], pa.binary()),
                    ],
                    names=["_id", "key", "n", "ids"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(
        work, f"_id {kind}, key bigint, n bigint, ids binary"
    )


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, length: int = LENGTH
) -> DataFrame:
    """One row per piece: ``_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``tokenizer`` is the path of a tokenizers file that drops white space.  Every document's tokens
    and one ``end_id`` are laid along the curve and cut at multiples of ``length``; each token lies in exactly
    one piece, sequences are gapless from offset 0 and all but the last are full.  ``ids`` are
    little-endian uint32.  A null text is empty: its piece is the end id alone.  Repeated rows are
    packed each; equal texts stand side by side, in the order of their ids (null first).
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = stored(tokenized(docs, doc_id, text, tokenizer, end_id))
    kind = tokens.schema["_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, number = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column("n").to_numpy()
            before = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["_id", "n", "ids"]).columns, pa.array(np.full(len(n), number, np.int32)), pa.array(before)],
                names=["_id", "n", "ids", "part", "before"],
            )

    # The id is part of the range key, so that equal texts spread over partitions.
    laid = tokens.repartitionByRange(parts, "key", "_id").sortWithinPartitions("key", "_id")
    laid = stored(laid.mapInArrow(place, f"_id {kind}, n bigint, ids binary, part int, before bigint"))
    # Tokens before each partition: as many rows as there are partitions.
    totals = laid.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """About ``CUT`` tokens at a time; a longer document stands alone."""
        for batch in batches:
            block = np.cumsum(batch.column("n").to_numpy()) // CUT
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
            yield from (batch.slice(int(s), int(e - s)) for s, e in zip(edges, edges[1:]) if s < e)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, starts, sizes, begins, raws = [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("n", "ids", "at"))
            for row, (n, raw, at) in enumerate(zip(*columns)):
                ids = _ids(raw, n)
                edges = [0, *range(length - at % length, n, length), n]
                for s, e in zip(edges, edges[1:]):
                    rows.append(row)
                    starts.append(s)
                    sizes.append(e - s)
                    begins.append(at + s)
                    raws.append(ids[s:e].tobytes())
            begin = np.array(begins, np.int64)
            took = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(took),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    batch.column("n").take(took),
                    pa.array(begin // length),
                    pa.array(begin % length),
                    pa.array([zlib.crc32(x) for x in raws], pa.int64()),
                    pa.array(raws, pa.binary()),
                ],
                names=["_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"],
            )

    placed = laid.join(F.broadcast(bases), "part").select("_id", "n", "ids", (F.col("base") + F.col("before")).alias("at"))
    return placed.mapInArrow(
        cut,
        f"_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
        "ids_crc32 bigint, ids binary",
    )
