"""BM25 scores of documents for a batch of queries, by an inverted index in document-range blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusprep.functions import arrays as A
from corpusprep.functions.durable import stored
from corpusprep.operators.text import words_and_punctuation

POSTINGS, DOCUMENTS = 1 << 14, 1 << 10  # of a block, unless one document has more postings
READ = 1 << 23  # bytes of an index file's row group, or a hundred blocks: what a writer or reader holds
QUERIES, QUERY_TERMS = 512, 8192  # evaluated at a time; a longer query stands alone
INDEX = (
    "n_docs bigint, n_texts bigint, n_tokens bigint, doc_ids array<{id}>, lengths array<int>, terms array<string>,"
    " max_tf array<int>, min_length array<int>, starts array<int>, docs array<int>, tfs array<int>"
)


def word_tokens(text: Column) -> Column:
    """Lower-cased words and punctuation characters of a text in any language."""
    return words_and_punctuation(F.lower(text))


def _term_counts(tokens: Column) -> Column:
    """Structs ``value, first, n`` of the distinct tokens, counted inside the row."""
    return A.run_lengths(F.sort_array(tokens))


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """``(term, df, idf, n_docs, avg_len)`` over ``(doc_id, tokens)``.

    A document contributes each term once, so the map-side combine already shrinks common terms.
    """
    totals = docs.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("len")
        ).alias("t")
    )
    terms = A.unnest(docs, [], F.array_distinct("tokens"), "term").groupBy("term").agg(
        F.count(F.lit(1)).alias("df")
    )
    with_totals = terms.withColumn("_t", totals.scalar())
    return with_totals.select(
        "term",
        "df",
        _idf(F.col("_t.n"), F.col("df")).alias("idf"),
        F.col("_t.n").alias("n_docs"),
        F.col("_t.len").alias("avg_len"),
    )


# ---------------------------------------------------------------- inverted index
def _lists(values, bounds) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds, np.int32)), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def _block(ids: pa.Array, n_tokens: np.ndarray, sizes: np.ndarray, terms: pa.Array, tfs: np.ndarray) -> list[pa.Array]:
    """One index row of successive documents; ``n_tokens`` is -1 for a null list."""
    coded = terms.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    docs = np.repeat(np.arange(len(ids)), sizes)[order]
    starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    tfs = tfs[order]
    heads = starts[:-1]
    most = np.maximum.reduceat(tfs, heads) if len(heads) else tfs
    least = np.minimum.reduceat(sizes[docs], heads) if len(heads) else tfs
    one = lambda values: _lists(values, [0, len(values)])
    texts = n_tokens >= 0
    return [
        pa.array([len(ids)]), pa.array([int(texts.sum())]), pa.array([int(n_tokens[texts].sum())]),
        one(ids), one(sizes), one(coded.dictionary), one(most), one(least), one(starts), one(docs), one(tfs),
    ]


def build_index(docs: DataFrame) -> DataFrame:
    """A stored inverted index of ``(doc_id, tokens)``: a row for each block of successive documents.

    Inside a block postings are grouped by term, with the greatest frequency and the least length
    (distinct terms) of the documents that hold it, which bound the impact of the term in the block
    whatever the parameters and the corpus totals are.  Documents are read once and not shuffled.
    """
    counted = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.size("tokens"), F.lit(-1)).alias("n"), _term_counts(F.col("tokens")).alias("c")
    ).select("id", "n", F.col("c.value").alias("terms"), F.col("c.n").alias("tfs"))
    schema = INDEX.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy().astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            terms, tfs = batch.column("terms").flatten(), batch.column("tfs").flatten().to_numpy()
            n = batch.column("n").to_numpy()
            full = np.diff(begin[1:] // POSTINGS, prepend=0) + (np.arange(batch.num_rows) % DOCUMENTS == 0)
            cuts = [0, *np.flatnonzero(full), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s < e:
                    span = slice(begin[s], begin[e])
                    made = _block(batch.column("id")[s:e], n[s:e], sizes[s:e], terms[begin[s] : begin[e]], tfs[span])
                    yield pa.RecordBatch.from_arrays(made, names=names)

    return stored(counted.mapInArrow(work, schema), READ)


def _asked_blocks(queries: DataFrame) -> Iterator[tuple[list, list[dict[str, int]]]]:
    """Ids and term counts of a bounded number of queries at a time."""
    counts = A.unnest(queries, ["query_id"], F.col("tokens"), "term").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy("query_id").agg(F.collect_list(F.struct("term", "n")).alias("c"))
    ids, found, held = [], [], 0
    for row in each.toLocalIterator():
        if ids and (len(ids) == QUERIES or held + len(row["c"]) > QUERY_TERMS):
            yield ids, found
            ids, found, held = [], [], 0
        ids.append(row["query_id"])
        found.append({c["term"]: c["n"] for c in row["c"]})
        held += len(row["c"])
    if ids:
        yield ids, found


def _document_counts(index: DataFrame, wanted: pa.Array) -> dict[str, int]:
    """How many documents hold each of the terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts")):
                at = pc.index_in(terms.values, value_set=wanted)
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                np.add.at(total, at.drop_null().to_numpy(), np.diff(starts.values.to_numpy())[hit])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([wanted.take(pa.array(held)), pa.array(total[held])], names=["term", "df"])

    found = index.select("terms", "starts").mapInArrow(work, "term string, df bigint")
    return {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}


class Totals(NamedTuple):
    n_docs: int
    n_texts: int  # documents whose tokens are not null
    n_tokens: int


class Params(NamedTuple):
    k1: float = 2.0
    k2: float = 1.0
    b: float = 0.5


class BlockSearch:
    """Scores of a block of queries over blocks of the index, with the ``k`` best kept for each.

    A block is evaluated only for the queries whose bound there reaches the k-th best score so far.
    A term of negative weight (in more than half of the documents) adds nothing to a bound.
    """

    def __init__(self, counts: list[dict[str, int]], df: dict[str, int], totals: Totals, k: int | None, params: Params, digits: int | None):
        self.k, self.k1, self.b, self.digits = k, params.k1, params.b, digits
        self.average = totals.n_tokens / max(totals.n_texts, 1)
        at = {t: i for i, t in enumerate(df)}
        self.terms = pa.array(list(df), pa.string())
        self.counts = np.zeros((len(counts), len(df)))  # queries by terms
        for q, c in enumerate(counts):
            for term, n in c.items():
                if term in at:
                    self.counts[q, at[term]] = n
        idf = np.array([math.log((totals.n_docs - n + 0.5) / (n + 0.5)) for n in df.values()])
        own = self.counts * (params.k2 + 1) / (self.counts + params.k2)
        self.weights = self.counts * idf * (self.k1 + 1) * np.where(self.counts > 0, own, 0)
        self.least = np.full(len(counts), -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), None
        self.seen = self.evaluated = 0  # pairs of a query and a block that share a term, and those scored

    def _impact(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf / (tf + self.k1 * (1 - self.b + self.b * length / self.average))

    def scores(self, row: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, places in the block and scores of the pairs that may be among the best."""
        at = pc.index_in(self.terms, value_set=row["terms"])
        held = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        at = at.drop_null().to_numpy()
        weights, mine = self.weights[:, held], self.counts[:, held] > 0
        asks = mine.any(axis=1)
        best = self._impact(row["max_tf"].to_numpy()[at], row["min_length"].to_numpy()[at])
        bound = np.maximum(weights, 0) @ best * (1 + 1e-9) + 1e-6
        go = np.flatnonzero(asks & (bound >= self.least))
        self.seen += int(asks.sum())
        self.evaluated += len(go)
        if not len(go):
            return go, go, np.zeros(0)
        lengths, starts = row["lengths"].to_numpy(), row["starts"].to_numpy()
        sizes = starts[at + 1] - starts[at]
        place = np.arange(int(sizes.sum())) + np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes)
        doc, tf = row["docs"].to_numpy()[place], row["tfs"].to_numpy()[place]
        impact = np.zeros((len(lengths), len(held)))
        impact[doc, np.repeat(np.arange(len(held)), sizes)] = self._impact(tf, lengths[doc])
        score = weights[go] @ impact.T
        shared = mine[go].astype(np.float32) @ (impact > 0).T.astype(np.float32) > 0
        if self.digits is not None:
            score = np.round(score, self.digits)
        if self.k is not None:
            shared &= score >= self.least[go][:, None]
        q, d = np.nonzero(shared)
        return go[q], d, score[q, d]

    def keep(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids = ids if self.id is None else pa.concat_arrays([self.id, ids])
        rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
        order = np.lexsort((rank, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, place = order[place < self.k], place[place < self.k]
        self.query, self.score, self.id = query[order], score[order], ids.take(pa.array(order))
        full = place == self.k - 1
        self.least[self.query[full]] = self.score[full]


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].values for c in ("doc_ids", "lengths", "terms", "max_tf", "min_length", "starts", "docs", "tfs")}


def _searched(index: DataFrame, queries: DataFrame, k: int | None, params: Params, digits: int | None) -> DataFrame:
    """``_q, query_id, doc_id, score``; with ``k`` at most as many rows of a query from each task."""
    totals = Totals(*(x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_texts"), F.sum("n_tokens")).first()))
    key, doc = queries.schema["query_id"].dataType, index.schema["doc_ids"].dataType.elementType
    schema = f"_q int, query_id {key.simpleString()}, doc_id {doc.simpleString()}, score double"
    key_type, doc_type = to_arrow_type(key), to_arrow_type(doc)
    found = []
    for keys, counts in _asked_blocks(queries):
        df = _document_counts(index, pa.array(sorted(set().union(*counts)), pa.string()))

        def work(batches: Iterator[pa.RecordBatch], keys=keys, counts=counts, df=df) -> Iterator[pa.RecordBatch]:
            best = BlockSearch(counts, df, totals, k, params, digits)
            named = pa.array(keys, key_type)

            def rows(query: np.ndarray, ids: pa.Array, score: np.ndarray) -> pa.RecordBatch:
                columns = [pa.array(query.astype(np.int32)), named.take(pa.array(query)), ids.cast(doc_type), pa.array(score)]
                return pa.RecordBatch.from_arrays(columns, names=["_q", "query_id", "doc_id", "score"])

            for row in _blocks_of(batches):
                query, place, score = best.scores(row)
                ids = row["doc_ids"].take(pa.array(place))
                if k is None:
                    yield rows(query, ids, score)
                else:
                    best.keep(query, score, ids)
            if best.id is not None:
                yield rows(best.query, best.id, best.score)

        found.append(index.mapInArrow(work, schema))
        if len(found) > 1:  # one block's queries at a time are held
            found[-2:] = [stored(found[-2].unionByName(found[-1]))]
    return found[0] if found else index.sparkSession.createDataFrame([], schema)


def bm25(
    docs: DataFrame, queries: DataFrame, k1: float = 2.0, k2: float = 1.0, b: float = 0.5
) -> DataFrame:
    """``(query_id, doc_id, score)`` for every pair that shares a term; other pairs score 0.

    ``docs`` is ``(doc_id, tokens)`` with unique ids, ``queries`` is ``(query_id, tokens)``.
    The length norm uses the number of distinct terms of a document but the average token count,
    idf is not floored, and a term repeated in the query counts once per repetition.  Scores are
    made block by block of a ``build_index``, so no pair is shuffled.
    """
    return _searched(build_index(docs), queries, None, Params(k1, k2, b), None).drop("_q")


def search(
    index: DataFrame, queries: DataFrame, k: int, k1: float = 2.0, k2: float = 1.0, b: float = 0.5, digits: int | None = None
) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the ``k`` best documents of a ``build_index`` per query.

    The same as ``top_documents(bm25(...), k)``, but blocks of documents whose bound is below the
    k-th best score are skipped and at most ``k`` rows of a query leave a task.  ``digits`` rounds
    scores before they are compared; ties go to the smaller document id.
    """
    return top_documents(_searched(index, queries, k, Params(k1, k2, b), digits).drop("_q"), k)


def score_pairs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores for the requested ``(query_id, doc_id)`` pairs, 0 where no term is shared."""
    return pairs.join(scores, ["query_id", "doc_id"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def top_documents(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows per query with their ``rank``; ties go to the smaller document id.

    The rank filter lets Spark drop all but k rows per query and task before the shuffle.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
