"""The stages of the pipeline, each on rows with nulls, empty texts and repeated rows."""

import corpus_pipeline
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, "no id", "en", "s", 5), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9002, "", "en", "s", 0)],
        docs.schema,
    )
    rows = docs.unionAll(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, SF_DIR)
        assert kept.columns == docs.columns
        assert 0.5 * rows.count() < kept.count() <= rows.count()
        assert stage(spark, rows.limit(0), SF_DIR).count() == 0
    assert corpus_pipeline.packed(spark, rows.limit(0), SF_DIR).count() == 0


CLASHING = ["n_lines", "n_dropped", "keep_runs", "_text_hash", "_key", "_hash", "_id", "_fp", "component_id", "n_hit", "_own1", "_c0", "row", "count"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without ids, of one id, repeated ones, ties, long texts, and other columns of many names."""
    shared = "This very line is shared by many of the documents here."
    body = lambda i: " ".join(f"word{i}x{j}" for j in range(60))
    rows = [(1, body(1)), (1, body(1)), (None, body(1)), (2, body(2)), (2, body(3)), (3, body(3) + " end"), (None, None), (None, None)]
    rows += [(4, None), (4, None), (5, ""), (6, ""), (None, body(7)), (None, body(7)), (None, body(7) + " end"), (8, body(8))]
    rows += [(i, f"{body(i)}\n{shared}") for i in range(20, 27)] + [(40, " ".join(f"w{j}" for j in range(50_000)))]
    made = spark.createDataFrame([(*r, *[f"{c}{i}" for c in CLASHING]) for i, r in enumerate(rows)], ", ".join(["doc_id bigint", "text string", *[f"{c} string" for c in CLASHING]]))
    return made.repartition(3)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s.__name__)
def test_other_columns_stay_whatever_their_names(spark, odd, stage):
    kept = stage(spark, odd, SF_DIR)
    assert kept.dtypes == odd.dtypes
    before = {tuple(r[2:]) for r in odd.collect()}
    assert {tuple(r[2:]) for r in kept.collect()} <= before
    assert stage(spark, odd.limit(0), SF_DIR).count() == 0


def test_lines_keep_every_row_and_the_last_holder(spark, odd):
    got = corpus_pipeline.lines(spark, odd, SF_DIR).collect()
    assert len(got) == odd.count()
    assert [r.doc_id for r in got if r.text and "\n" in r.text] == [26]
    assert sum(r.text is None for r in got) == 4


def test_one_row_of_each_group_stays(spark, odd):
    got = corpus_pipeline.near_duplicates(spark, odd, SF_DIR).select("doc_id", "text").collect()
    first = lambda r: (r.text or str(r.text)).split(" ")[0]
    have = sorted(((r.doc_id or 0, first(r)) for r in got if r.doc_id is None or r.doc_id < 10))
    # Texts 1 to 3, 7 and 8 once each, under a true id where there is one; null texts once for an id.
    assert [h for h in have if h[1].startswith("word1x")] == [(1, "word1x0")]
    assert [h for h in have if h[1].startswith("word2x")] == [(2, "word2x0")]
    assert len([h for h in have if h[1].startswith("word3x")]) == 1
    assert [h for h in have if h[1].startswith("word7x")] == [(0, "word7x0")]
    assert [h for h in have if h[1].startswith("word8x")] == [(8, "word8x0")]
    assert sorted(h for h in have if h[1] in ("", "None")) == [(0, "None"), (4, "None"), (5, ""), (6, "")]
    assert len(got) == 1 + 1 + 1 + 1 + 1 + 4 + 7 + 1


def test_quality_and_benchmarks_judge_equal_texts_alike(spark, odd):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("text").filter("length(text) > 80").first()[0]
    leaky = spark.createDataFrame([(1, item), (1, item), (None, item), (2, "clean"), (None, None)], "doc_id bigint, text string")
    got = corpus_pipeline.clean_of_benchmarks(spark, leaky, SF_DIR).collect()
    assert sorted((tuple(r) for r in got), key=repr) == [(2, "clean"), (None, None)]
    kept = {}
    for r in corpus_pipeline.quality(spark, odd, SF_DIR).collect():
        kept.setdefault((r.doc_id, r.text), []).append(1)
    all_rows = {}
    for r in odd.collect():
        all_rows.setdefault((r.doc_id, r.text), []).append(1)
    assert all(kept[k] == all_rows[k] for k in kept)


def test_run_leaves_no_group_and_no_leak(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR))
    pieces = corpus_pipeline.run(spark, SF_DIR)
    left = {r[0] for r in docs.select("doc_id").collect()}
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == left
    found = corpus_pipeline.near_dup.near_duplicates(docs).filter("_id <> component_id")
    assert found.count() == 0
    leaks = corpus_pipeline.decontaminate.contamination(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))
    assert leaks.filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("name", sorted(k for k in contract.oracle_sql() if k.startswith("op")))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df, rel = contract.queries()[name](spark, SF_DIR), con.sql(contract.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    place = [rel.columns.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in place) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected
