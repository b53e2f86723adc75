"""The inverted index in document-range blocks against plain scores of every pair."""

import math
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusprep.operators import retrieval
from corpusprep.operators.retrieval import BlockSearch, Params, Totals


def _plain(docs, queries, digits=6):
    """Every pair that shares a term: ``{query: [(-score, doc)]}``."""
    some = [t for t in docs.values() if t is not None]
    n, average = len(docs), sum(map(len, some)) / max(len(some), 1)
    df = Counter(t for d in some for t in set(d))
    out = {}
    for q, terms in queries.items():
        found = []
        for i, d in docs.items():
            tf, total = Counter(d or []), 0.0
            for t, qf in Counter(terms).items():
                if tf[t]:
                    idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
                    total += qf * idf * 3 * tf[t] / (tf[t] + 2 * (0.5 + 0.5 * len(tf) / average)) * qf * 2 / (qf + 1)
            if set(terms) & set(tf):
                found.append((-round(total, digits), i))
        out[q] = sorted(found)
    return out


def _corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["été", ".", "漢"]
    docs = {i: [rng.choice(words[: rng.choice([4, 20, 63])]) for _ in range(rng.randint(1, 60))] + ["the"] * (i % 3 > 0) for i in range(300)}
    docs |= {i: ["copy", "of", "w1"] for i in range(300, 340)}  # ties past k
    docs |= {400: None, 401: [], 402: ["half"] * 5, 403: [w for w in words for _ in range(50)]}
    queries = {1: ["w1", "w1", "the"], 2: ["the"], 3: ["copy"], 4: [], 5: ["nowhere"], 6: words, 7: ["the", "."]}
    return docs, queries


@pytest.mark.parametrize("postings", [1 << 14, 40])
def test_search_equals_plain_scores(spark, monkeypatch, postings):
    monkeypatch.setattr(retrieval, "POSTINGS", postings)
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    docs, queries = _corpus(1)
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, tokens array<string>").repartition(3)
    q = spark.createDataFrame(list(queries.items()), "query_id int, tokens array<string>")
    plain = _plain(docs, queries)
    index = retrieval.build_index(d)
    got = retrieval.search(index, q, 5, digits=6).orderBy("query_id", "rank").collect()
    want = [(q, i, s, r + 1) for q, found in plain.items() for r, (s, i) in enumerate(found[:5])]
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got] == [(q, i, rank) for q, i, _, rank in want]
    assert [r.score for r in got] == pytest.approx([-s for *_, s, _ in want], abs=2e-6)
    every = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(d, q).collect()}
    assert set(every) == {(q, i) for q, found in plain.items() for _, i in found}
    assert all(math.isclose(every[q, i], -s, abs_tol=1e-6) for q, found in plain.items() for s, i in found)


def test_search_with_names_as_ids_and_empty_tables(spark):
    d = spark.createDataFrame([("b", ["x"]), ("a", ["x"]), ("c", ["y", "z"])], "doc_id string, tokens array<string>")
    q = spark.createDataFrame([("q", ["x", "z"])], "query_id string, tokens array<string>")
    got = retrieval.search(retrieval.build_index(d), q, 2).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["c", "a"]
    assert retrieval.search(retrieval.build_index(d.limit(0)), q, 2).collect() == []
    assert retrieval.search(retrieval.build_index(d), q.limit(0), 2).collect() == []


def test_blocks_below_the_best_scores_are_skipped(spark):
    rng = random.Random(2)
    filler = lambda: [f"w{rng.randrange(50)}" for _ in range(20)]
    docs = [(i, ["rare"] * ((1 + i % 3) * (i < 100)) + ["w"] * (i % 20 < 11) + filler()) for i in range(4000)]
    docs += [(4000 + i, ["rare"] + [f"x{rng.randrange(5000)}" for _ in range(500)]) for i in range(50)]
    index = retrieval.build_index(spark.createDataFrame(docs, "doc_id int, tokens array<string>").coalesce(1))
    rows = index.toArrow()
    blocks = list(retrieval._blocks_of(rows.to_batches()))
    assert len(blocks) > 5
    counts = [{"rare": 1, "w": 1}]
    df = retrieval._document_counts(index, pa.array(["rare", "w"]))
    assert df == {"rare": 150, "w": 2200}  # the second weighs less than nothing
    totals = Totals(4050, 4050, sum(len(t) for _, t in docs))
    skipping, plain = (BlockSearch(counts, df, totals, k, Params(), None) for k in (10, None))
    every = []
    for row in blocks:
        query, place, score = skipping.scores(row)
        skipping.keep(query, score, row["doc_ids"].take(pa.array(place)))
        _, place, score = plain.scores(row)
        every += zip((-score).tolist(), row["doc_ids"].take(pa.array(place)).to_pylist())
    assert skipping.id.to_pylist() == [i for _, i in sorted(every)[:10]]
    assert plain.evaluated == plain.seen == skipping.seen and skipping.evaluated < skipping.seen / 2


def test_at_most_k_rows_of_a_query_leave_a_task(spark):
    docs, queries = _corpus(3)
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, tokens array<string>").repartition(4)
    q = spark.createDataFrame(list(queries.items()), "query_id int, tokens array<string>")
    rows = retrieval._searched(retrieval.build_index(d), q, 5, Params(), None)
    most = rows.groupBy(F.spark_partition_id(), "_q").count().agg(F.max("count")).first()[0]
    assert most == 5


def test_index_blocks_and_row_groups_are_bounded(spark, monkeypatch):
    """Short texts share a block only up to a number of them, and readers hold a row group of few blocks."""
    monkeypatch.setattr(retrieval, "READ", 1 << 10)
    monkeypatch.setattr(retrieval, "DOCUMENTS", 5)
    rows = [(i, ["w", f"t{i}"]) for i in range(1003)]
    index = retrieval.build_index(spark.createDataFrame(rows, "doc_id bigint, tokens array<string>").coalesce(1))
    assert index.agg(F.max("n_docs"), F.sum("n_docs")).first() == (5, 1003)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in index.inputFiles()]
    assert max(f.metadata.row_group(g).num_rows for f in files for g in range(f.num_row_groups)) <= 100
    best = retrieval.search(index, spark.createDataFrame([(1, ["t7"])], "query_id int, tokens array<string>"), 3).collect()
    assert [r.doc_id for r in best] == [7]
