"""Ranked lexical search with hashed max-sketches.

An index row folds a document's term frequencies into ``slots`` coordinatewise maxima, beside the
exact counts.  A term's impact in a document grows with its frequency, so the impact of a slot's
maximum is at least that of every term hashed there, whatever the corpus totals are: sketches stay
right when documents are added.  A batch of queries looks its terms' slots up in many sketches by
one matrix product, which bounds all scores from above; documents are then scored exactly in
descending order of their bounds until no bound reaches the k-th best score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusprep.functions.durable import stored
from corpusprep.llm.words import chunks, words_of

SLOTS = 2048  # a power of two
CEILING = 255  # frequencies from here on are kept as this one, whose impact counts as the limit
LIMIT = 1_000_000  # what no impact reaches
QUERIES, QUERY_TERMS = 512, 8192  # searched for at a time; a longer query stands alone
CELLS = 1 << 21  # of a matrix of documents and query terms
NO_ID = np.iinfo(np.int64).max
# ASCII characters between terms.
BETWEEN = np.zeros(256, bool)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    BETWEEN[_first : _last + 1] = True


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of an array as byte strings."""
    ends = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _runs(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What ``_binary`` has packed: the values and their bounds."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data[ends[0] : ends[-1]].tobytes(), kind), (ends - ends[0]) // size


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of texts in order of text and hash, their frequencies, where each text's
    begin, and the number of terms of each text."""
    _, _, _, hashes, bounds = words_of(texts, separators=BETWEEN)
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    head = np.ones(len(hashes), bool)
    head[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(head)
    counts = np.diff(np.append(first, len(hashes)))
    return hashes[first], counts, np.searchsorted(rows[first], np.arange(len(texts) + 1)), np.diff(bounds)


def index(docs: DataFrame, id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """A stored table ``_id, n, peaks, terms, counts`` with a row for every row of ``docs``.

    ``n`` is the number of terms (lower-cased runs of letters, digits and non-ASCII characters),
    ``peaks`` one byte a slot, ``terms`` the distinct terms' 64-bit hashes in order, ``counts`` their
    frequencies.  Null and empty texts have none; repeated rows are documents of their own; other
    columns of ``docs`` play no part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                terms, counts, bounds, n = _counted(part.column("_text"))
                peaks = np.zeros((part.num_rows, slots), np.uint8)
                order = np.argsort(counts, kind="stable")  # the last value written is the largest
                rows = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                peaks[rows[order], (terms[order] & np.uint64(slots - 1)).astype(np.int64)] = np.minimum(counts[order], CEILING)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        pa.array(n.astype(np.int64)),
                        _binary(peaks.reshape(-1), np.arange(part.num_rows + 1) * slots),
                        _binary(terms, bounds),
                        _binary(counts.astype(np.uint32), bounds),
                    ],
                    names=["_id", "n", "peaks", "terms", "counts"],
                )

    slim = docs.select(docs[id].cast("bigint").alias("_id"), docs[text].alias("_text"))
    return stored(slim.mapInArrow(work, "_id bigint, n bigint, peaks binary, terms binary, counts binary"))


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Searcher:
    """The best ``k`` documents so far for each query of a block, over slices of the index."""

    def __init__(self, queries: list[np.ndarray], weights: dict[int, int], totals: tuple[int, int], k: int, slots: int):
        known = np.array(sorted(weights), np.uint64)
        weight = np.array([weights[int(t)] for t in known], np.int64)
        self.known, self.k, self.slots, (self.n_docs, self.n_terms) = known, k, slots, totals
        lists = [np.unique(q[np.isin(q, known)], return_counts=True) for q in queries]
        width = max((len(t) for t, _ in lists), default=0)
        # Terms of each query as numbers in ``known`` (the number after the last: none) and weights.
        self.terms = np.full((len(lists), width), len(known), np.int64)
        self.weights = np.zeros((len(lists), width), np.int64)
        slot = (known & np.uint64(slots - 1)).astype(np.int64)
        self.slot, column = np.unique(slot, return_inverse=True)
        self.by_slot = np.zeros((len(self.slot), len(lists)))
        for q, (terms, repeats) in enumerate(lists):
            at = np.searchsorted(known, terms)
            self.terms[q, : len(at)], self.weights[q, : len(at)] = at, weight[at] * repeats
            np.add.at(self.by_slot[:, q], column[at], weight[at] * repeats)
        self.at_once = max(1, CELLS // (len(known) + len(lists) + 1))
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(len(lists))  # a score to reach; the k-th best once there are k
        self.bounded = self.scored = 0  # pairs looked up and pairs scored exactly

    def _keep(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, place = order[place < self.k], place[place < self.k]
        self.query, self.score, self.id = query[order], score[order], ids[order]
        full = place == self.k - 1
        self.least[self.query[full]] = self.score[full]

    def _bounds(self, peaks: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Documents by queries: what no score exceeds.  Sums of integers, a little is added in
        case they pass 2^53."""
        tf = peaks[:, self.slot].astype(np.int64)
        impact = np.where(tf == CEILING, LIMIT, _impact(tf, m[:, None]))
        return impact.astype(np.float64) @ self.by_slot * (1 + 1e-9)

    def _frequencies(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Documents by known terms (and a last column of zeros): exact frequencies of ``rows``."""
        sizes = np.diff(bounds)[rows]
        doc = np.repeat(np.arange(len(rows)), sizes)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[rows], sizes)
        at = np.searchsorted(self.known, terms[within])
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == terms[within[hit]]
        out = np.zeros((len(rows), len(self.known) + 1), np.int64)
        out[doc[hit], at[hit]] = counts[within[hit]]
        return out

    def add(self, ids: np.ndarray, n: np.ndarray, peaks: np.ndarray, terms: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> None:
        """Search some rows of the index."""
        if not len(self.known):
            return
        m = 25 + (75 * n * self.n_docs) // max(self.n_terms, 1)
        upper = self._bounds(peaks, m)
        self.bounded += upper.size
        doc, query = np.nonzero(upper >= self.least)
        if not len(doc):
            return
        rows, doc = np.unique(doc, return_inverse=True)
        exact = self._frequencies(rows, terms, counts, bounds)
        bound = upper[rows[doc], query]
        order = np.lexsort((-bound, query))
        doc, query, bound = doc[order], query[order], bound[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        begin, size = 0, 2 * self.k
        while len(doc):
            # The next documents of every query, by descending bounds.
            now = place < begin + size
            for s in range(0, int(now.sum()), self.at_once):
                d, q = doc[now][s : s + self.at_once], query[now][s : s + self.at_once]
                tf = exact[d[:, None], self.terms[q]]
                score = (self.weights[q] * _impact(tf, m[rows[d]][:, None])).sum(axis=1)
                self.scored += len(d)
                good = score >= self.least[q]
                self._keep(q[good], score[good], ids[rows[d[good]]])
            begin, size = begin + size, 2 * size
            left = ~now & (bound >= self.least[query])
            doc, query, bound, place = doc[left], query[left], bound[left], place[left]


def _slices(batch: pa.RecordBatch, at_once: int, slots: int):
    for s in range(0, batch.num_rows, at_once):
        part = batch.slice(s, at_once)
        terms, bounds = _runs(part.column("terms"), np.uint64)
        counts, _ = _runs(part.column("counts"), np.uint32)
        peaks, _ = _runs(part.column("peaks"), np.uint8)
        ids = part.column("_id").fill_null(NO_ID).to_numpy()
        yield ids, part.column("n").to_numpy(), peaks.reshape(-1, slots), terms, counts.astype(np.int64), bounds


def _document_frequencies(table: DataFrame, known: np.ndarray) -> dict[int, int]:
    """Documents with each of the terms ``known`` (sorted); terms of none are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            terms, _ = _runs(batch.column("terms"), np.uint64)
            at = np.searchsorted(known, terms)
            hit = at < len(known)
            hit[hit] = known[at[hit]] == terms[hit]
            total += np.bincount(at[hit], minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "df"])

    found = table.select("terms").mapInArrow(work, "at bigint, df bigint").groupBy("at").agg(F.sum("df").alias("df"))
    return {int(known[r["at"]]): r["df"] for r in found.collect()}


def _blocks(queries: DataFrame, id: str, text: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and terms of the distinct queries, a bounded number at a time."""
    ids, terms, held = [], [], 0
    for row in queries.select(queries[id].alias("_id"), queries[text].alias("_text")).distinct().toLocalIterator():
        found = words_of(pa.array([row["_text"]], pa.string()), separators=BETWEEN)[3]
        if ids and (len(ids) == QUERIES or held + len(found) > QUERY_TERMS):
            yield ids, terms
            ids, terms, held = [], [], 0
        ids.append(row["_id"])
        terms.append(found)
        held += len(found)
    if ids:
        yield ids, terms


def search(table: DataFrame, queries: DataFrame, k: int = 10, id: str = "item_id", text: str = "text") -> DataFrame:
    """``id, rank, doc_id, score``: the ``k`` best documents of an ``index`` for every query.

    A query's terms are cut like a document's, repeats count, scores are integers and above 0, equal
    ones go by ascending document id, rows without an id last.  Null and empty queries find nothing;
    repeated rows of ``queries`` are one query, different texts of one id are ranked apart; an empty
    index or no queries give no rows.  Only ``k`` rows of a query leave a task, and the driver holds
    one block of queries (``QUERIES``, ``QUERY_TERMS``) at a time.
    """
    spark = table.sparkSession
    n_docs, n_terms = table.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    first = table.select("peaks").first()
    slots = len(first["peaks"]) if first else SLOTS
    kind = queries.schema[id].dataType
    schema = f"_q int, _key {kind.simpleString()}, doc_id bigint, score bigint"
    key_type = to_arrow_type(kind)
    found = []
    for keys, terms in _blocks(queries, id, text):
        df = _document_frequencies(table, np.unique(np.concatenate(terms)))
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}

        def work(batches: Iterator[pa.RecordBatch], keys=keys, terms=terms, weights=weights) -> Iterator[pa.RecordBatch]:
            best = Searcher(terms, weights, (n_docs, n_terms), k, slots)
            for batch in batches:
                for part in _slices(batch, best.at_once, slots):
                    best.add(*part)
            named = pa.array([keys[q] for q in best.query], key_type)
            ids = pa.array(best.id, mask=best.id == NO_ID)
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.query.astype(np.int32)), named, ids, pa.array(best.score)], names=["_q", "_key", "doc_id", "score"]
            )

        rows = table.mapInArrow(work, schema)
        order = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.append(stored(ranked.select(F.col("_key").alias(id), "rank", "doc_id", "score")))
    if not found:
        return spark.createDataFrame([], f"`{id}` {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole
