"""Named queries over the driver tables: ``(spark, sf_dir) -> DataFrame`` with flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions import arrays as A
from corpusprep.functions.durable import stored
from corpusprep.functions.marks import numbered
from corpusprep.operators import annotate as an
from corpusprep.operators import chunks, evaluate, knowledge, logs, ngrams, relations, retrieval, sampling, text
from corpusprep.plans import standins as v
from corpusprep.plans import training_sets as jobs
from corpusprep.sources.writers import concat_sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _six(col: str | Column) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: _six(c) for c in cols})


# ---------------------------------------------------------------- retrieval
@query
def bm25_top10(spark, sf):
    index = retrieval.build_index(v.doc_tokens(spark, sf))
    return retrieval.search(index, v.query_tokens(spark, sf), 10, digits=6)


@query
def bm25_scores(spark, sf):
    return _rounded(retrieval.bm25(v.doc_tokens(spark, sf), v.query_tokens(spark, sf)), "score")


@query
def bm25_term_stats(spark, sf):
    return _rounded(retrieval.corpus_stats(v.doc_tokens(spark, sf)), "idf", "avg_len")


# ---------------------------------------------------------------- text
def _docs(spark, sf):
    return v.documents(spark, sf).select("doc_id", "text")


@query
def clean_corpus(spark, sf):
    return text.clean_corpus(_docs(spark, sf))


@query
def decode_base64(spark, sf):
    return text.decode_base64_column(_docs(spark, sf).withColumn("text", F.base64(F.encode("text", "UTF-8"))), "text")


@query
def to_text(spark, sf):
    pages = v.table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("html"))
    return text.to_text(pages, "html")


@query
def parse_attribute_pairs(spark, sf):
    return an.parse_attribute_pairs(v.part_attributes(spark, sf))


@query
def explode_description(spark, sf):
    return an.explode_description(v.descriptions(spark, sf))


@query
def strip_accents(spark, sf):
    return text.strip_accents(_docs(spark, sf))


@query
def space_cjk(spark, sf):
    return text.space_cjk(_docs(spark, sf))


@query
def squeeze_whitespace(spark, sf):
    return relations.squeeze_whitespace(_docs(spark, sf), separate=True)


@query
def strip_replacement_char(spark, sf):
    return relations.strip_replacement_char(_docs(spark, sf))


@query
def tokenize(spark, sf):
    return text.tokenize(_docs(spark, sf), "doc_id", steps=("clean", "cjk", "lower"))


@query
def whitespace_tokens(spark, sf):
    return text.whitespace_tokens(_docs(spark, sf), "doc_id")


@query
def build_vocab(spark, sf):
    return text.build_vocab(v.name_lines(spark, sf))


@query
def encode_tokens(spark, sf):
    ids = text.encode_tokens(v.doc_tokens(spark, sf), v.word_vocab(spark, sf), "doc_id")
    return ids.select("doc_id", F.posexplode("ids").alias("pos", "id"))


@query
def encode_tokens_padded(spark, sf):
    ids = text.encode_tokens(v.doc_tokens(spark, sf), v.word_vocab(spark, sf), "doc_id", max_len=128)
    return ids.select("doc_id", F.posexplode("ids").alias("pos", "id"))


@query
def truncate_pairs(spark, sf):
    cut = text.truncate_pairs(v.token_pairs(spark, sf), "pair_id", 64)
    return cut.select(
        "pair_id", F.array_join("tokens_a", " ").alias("text_a"), F.array_join("tokens_b", " ").alias("text_b")
    )


@query
def char_ngrams(spark, sf):
    return ngrams.char_ngrams(_docs(spark, sf), "doc_id")


@query
def char_ngram_neighbours(spark, sf):
    turns = v.turns(spark, sf).select("turn_no", "text")
    grams = ngrams.char_ngrams(turns, "turn_no", neighbours=True)
    return grams.select(
        "turn_no", "gram", "cnt", F.array_join("left", "").alias("left"), F.array_join("right", "").alias("right")
    )


# ---------------------------------------------------------------- sampling
def _orders(spark, sf):
    return v.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query
def head(spark, sf):
    return sampling.head(_orders(spark, sf), "o_orderkey")


@query
def ratio_sample(spark, sf):
    return sampling.ratio_sample(_orders(spark, sf), "o_orderkey", 0.3, seed=3)


@query
def random_split(spark, sf):
    return sampling.random_split(_orders(spark, sf), "o_orderkey", 0.2, seed=7)


@query
def stratified_sample(spark, sf):
    return sampling.stratified_sample(v.labelled(spark, sf), "row_id", 0.3, seed=1)


@query
def stratum_report(spark, sf):
    return sampling.stratum_report(sampling.stratified_sample(v.labelled(spark, sf), "row_id", 0.3, seed=1))


@query
def part_sizes(spark, sf):
    return sampling.part_sizes(_orders(spark, sf), 7)


@query
def assign_part(spark, sf):
    return sampling.assign_part(_orders(spark, sf).select("o_orderkey"), "o_orderkey", 7)


@query
def fixed_batches(spark, sf):
    return sampling.fixed_batches(_orders(spark, sf).select("o_orderkey"), "o_orderkey", 64, fill=True, seed=5)


@query
def dedup_clicks(spark, sf):
    return sampling.dedup_clicks(v.clicks(spark, sf))


@query
def click_log(spark, sf):
    clicks = v.clicks(spark, sf)
    later = clicks.withColumn("click_timestamp", F.col("click_timestamp") + 1)
    return sampling.click_log(clicks, later, offline=False)


@query
def sample_users(spark, sf):
    return sampling.sample_users(v.clicks(spark, sf), 10, seed=2)


# ---------------------------------------------------------------- evaluation
def _matched(pattern):
    def run(spark, sf):
        return evaluate.match_triples(*v.triples(spark, sf), pattern)

    run.__name__ = f"match_triples_{pattern}"
    return run


for _pattern in ("only_head_index", "whole_span", "whole_text", "only_head_text"):
    query(_matched(_pattern))


@query
def prf_eps(spark, sf):
    return _rounded(evaluate.prf(evaluate.match_triples(*v.triples(spark, sf))), "precision", "recall", "f1")


@query
def prf_percent(spark, sf):
    counts = evaluate.match_triples(*v.triples(spark, sf), "whole_text")
    return _rounded(evaluate.prf(counts, "percent"), "precision", "recall", "f1")


@query
def sample_accuracy(spark, sf):
    return _rounded(evaluate.sample_accuracy(*v.tags(spark, sf)), "sample_acc")


@query
def epoch_means(spark, sf):
    return _rounded(evaluate.epoch_means(v.batch_metrics(spark, sf), ["loss", "ent_acc"]), "loss", "ent_acc")


@query
def running_means(spark, sf):
    means = evaluate.running_means(v.batch_metrics(spark, sf), ["loss", "ent_acc"])
    return _rounded(means.select("run", "epoch", "batch", "avg_loss", "avg_ent_acc"), "avg_loss", "avg_ent_acc")


@query
def best_so_far(spark, sf):
    metrics = v.batch_metrics(spark, sf).select("run", "batch", "loss")
    return evaluate.best_so_far(metrics, "loss", order="batch")


# ---------------------------------------------------------------- annotations
def _spans(df, *keep):
    return an.spans(df, *keep)


@query
def filter_types(spark, sf):
    kept = an.filter_types(v.annotated_lines(spark, sf), ["size", "brand"])
    return A.unnest(kept, ["item_id"], F.col("anns"), "a").select(
        "item_id", "a.attribute_value", "a.attribute_type", "a.start_idx", "a.end_idx"
    )


@query
def repair_deoverlap(spark, sf):
    return _spans(an.repair_and_deoverlap(v.annotated_lines(spark, sf)), "item_id")


@query
def repair_strict(spark, sf):
    return _spans(an.repair_and_deoverlap(v.annotated_lines(spark, sf), mode="strict"), "item_id")


@query
def drop_duplicates(spark, sf):
    tagged = an.repair_and_deoverlap(v.annotated_lines(spark, sf)).select("item_id", "title", "tagged")
    return an.drop_empty_and_duplicate(tagged).select("item_id", "title", F.size("tagged").alias("n_spans"))


@query
def attribute_types(spark, sf):
    return an.tag_names(v.annotated_lines(spark, sf))


@query
def count_type_value(spark, sf):
    return an.count_type_value(an.repair_and_deoverlap(v.annotated_lines(spark, sf)))


@query
def count_type(spark, sf):
    return an.count_type(an.repair_and_deoverlap(v.annotated_lines(spark, sf)))


@query
def count_source_type(spark, sf):
    return an.count_source_type(v.annotated_lines(spark, sf))


@query
def count_source_type_strict(spark, sf):
    return an.count_source_type(v.annotated_lines(spark, sf), mode="strict")


@query
def values_by_type(spark, sf):
    grouped = an.values_by_type(v.annotated_lines(spark, sf))
    return grouped.select("item_id", F.explode("type_values").alias("attr_type", "vals")).select(
        "item_id", "attr_type", F.array_join("vals", " ").alias("vals")
    )


@query
def select_rare_values(spark, sf):
    return an.select_rare_values(stored(v.word_counts(spark, sf)), 0.2, 50)


@query
def value_count_report(spark, sf):
    counts = stored(v.word_counts(spark, sf))
    return an.value_count_report(counts, an.select_rare_values(counts, 0.2, 50))


@query
def new_value_split(spark, sf):
    tagged = numbered(an.repair_and_deoverlap(v.annotated_lines(spark, sf)).select("item_id", "tagged"))
    counts = stored(an.count_type_value(tagged))
    flagged = an.flag_new_value(
        tagged, an.select_rare_values(counts, 0.2, 40), an.small_type_values(counts, 40)
    )
    return flagged.select("item_id", "is_test")


def _tag_rows(df):
    return A.unnest_pos(df, ["item_id"], F.col("tags"), "pos", "t").select("item_id", "pos", "t.word", "t.tag")


@query
def bio_tags(spark, sf):
    return _tag_rows(an.bio_tags(an.repair_and_deoverlap(v.annotated_lines(spark, sf))))


@query
def bioes_tags(spark, sf):
    tagged = an.repair_and_deoverlap(v.annotated_lines(spark, sf))
    return _tag_rows(an.bio_tags(tagged, scheme="BIOSE", order="position"))


@query
def bio_overlaps(spark, sf):
    return an.bio_tags(an.repair_and_deoverlap(v.annotated_lines(spark, sf))).select("item_id", "num_overlap")


def _set_rows(df):
    return df.select("item_id", an.bio_text(F.col("tags")).alias("bio"), "num_overlap", "is_test")


@query
def build_single_value_set(spark, sf):
    return _set_rows(jobs.build_single_value_set(v.annotated_lines(spark, sf)))


@query
def build_multi_value_set(spark, sf):
    return _set_rows(jobs.build_multi_value_set(v.annotated_lines(spark, sf), keep=()))


@query
def build_new_value_set(spark, sf):
    return _set_rows(jobs.build_new_value_set(v.annotated_lines(spark, sf), keep=()))


@query
def build_training_set(spark, sf):
    return _set_rows(jobs.build_training_set(v.annotated_lines(spark, sf), keep=()))


@query
def build_training_set_new_value(spark, sf):
    return _set_rows(jobs.build_training_set(v.annotated_lines(spark, sf), "new-value", keep=()))


# ---------------------------------------------------------------- relations
@query
def normalize_samples(spark, sf):
    words = F.split("text", " ", -1)
    raw = v.turns(spark, sf).select(
        "turn_no",
        words.alias("tokens"),
        F.array(F.array(F.get(words, F.lit(0)), F.col("role"), F.element_at(words, -1))).alias("spo_list"),
    )
    samples = relations.normalize_samples(raw, "etl_span", "train", order="turn_no")
    return samples.select("id", "text", F.explode("relation_list").alias("r")).select("id", "text", "r.*")


@query
def char_spans(spark, sf):
    samples, _ = relations.attach_char_spans(v.line_samples(spark, sf))
    return A.unnest(samples, ["id"], F.col("relation_list"), "r").select(
        "id",
        "r.subject",
        "r.object",
        F.col("r.subj_char_span.s").alias("subj_s"),
        F.col("r.subj_char_span.e").alias("subj_e"),
        F.col("r.obj_char_span.s").alias("obj_s"),
        F.col("r.obj_char_span.e").alias("obj_e"),
    )


@query
def validate_spans(spark, sf):
    samples, _ = relations.attach_char_spans(v.line_samples(spark, sf))
    clean, bad = relations.validate_spans(samples)
    side = lambda df, name: df.select("id", F.lit(name).alias("side"), F.size("relation_list").alias("n_rel"))
    return side(clean, "clean").unionByName(side(bad, "bad"))


@query
def token_spans(spark, sf):
    docs = _docs(spark, sf)
    lines = docs.select("doc_id", F.split("text", "\n", -1).alias("ls")).select(
        "doc_id",
        F.posexplode(
            F.arrays_zip(
                F.col("ls").alias("line"),
                A.running_starts(F.transform("ls", lambda x: F.length(x)), 1).alias("s"),
            )
        ).alias("span_no", "x"),
    )
    char_spans = lines.filter(F.length("x.line") > 0).select(
        "doc_id", "span_no", F.col("x.s").alias("s"), (F.col("x.s") + F.length("x.line")).alias("e")
    )
    return relations.token_spans(char_spans, text.whitespace_tokens(docs, "doc_id"), keys=("doc_id",))


@query
def attach_token_spans(spark, sf):
    samples, _ = relations.attach_char_spans(v.line_samples(spark, sf))
    aligned = relations.attach_token_spans(samples, text.whitespace_tokens(samples, "id"))
    return aligned.select("id", F.explode("relation_list").alias("r")).select(
        "id",
        F.col("r.subj_char_span.s").alias("subj_cs"),
        F.col("r.obj_char_span.s").alias("obj_cs"),
        F.col("r.subj_tok_span.s").alias("subj_ts"),
        F.col("r.subj_tok_span.e").alias("subj_te"),
        F.col("r.obj_tok_span.s").alias("obj_ts"),
        F.col("r.obj_tok_span.e").alias("obj_te"),
    )


@query
def sliding_windows(spark, sf):
    windows = relations.sliding_windows(v.long_samples(spark, sf), 100, 50)
    return windows.select(
        "id", "win", "text", "tok_offset", "char_offset", F.size("relation_list").alias("n_rel")
    )


@query
def sliding_window_relations(spark, sf):
    windows = relations.sliding_windows(v.long_samples(spark, sf), 100, 50)
    return A.unnest(windows, ["id", "win"], F.col("relation_list"), "r").select(
        "id",
        "win",
        "r.subject",
        "r.object",
        F.col("r.subj_tok_span.s").alias("subj_ts"),
        F.col("r.obj_tok_span.e").alias("obj_te"),
        F.col("r.subj_char_span.s").alias("subj_cs"),
        F.col("r.obj_char_span.e").alias("obj_ce"),
    )


@query
def sliding_windows_test(spark, sf):
    return relations.sliding_windows(_docs(spark, sf).withColumnRenamed("doc_id", "id"), 64, 64, "test")


# ---------------------------------------------------------------- logs
@query
def extract_series(spark, sf):
    return logs.extract_series(v.document_logs(spark, sf))


@query
def third_decimal(spark, sf):
    return logs.third_decimal(v.decimal_lines(spark, sf))


@query
def block_pick(spark, sf):
    return logs.block_pick(v.tuple_log(spark, sf))


@query
def slice_sections(spark, sf):
    return logs.slice_sections(v.train_log(spark, sf))


@query
def run_blocks(spark, sf):
    return logs.run_blocks(v.test_log(spark, sf), v.RUN_MARKER)


@query
def run_blocks_max(spark, sf):
    blocks = logs.run_blocks(v.test_log(spark, sf), v.RUN_MARKER, drop_last=True)
    cells = blocks.select("path", F.col("run").alias("epoch"), F.col("idx").alias("col"), F.col("value").try_cast("double").alias("value"))
    return logs.pairwise_max(cells, ["path"])


@query
def align_runs(spark, sf):
    return logs.align_runs(*v.accuracy_logs(spark, sf))


@query
def pair_metrics(spark, sf):
    return _rounded(logs.pair_metrics(v.pseudo_log(spark, sf))[0], "all")


@query
def pair_metrics_errors(spark, sf):
    return logs.pair_metrics(v.pseudo_log(spark, sf))[1]


@query
def pairwise_max(spark, sf):
    return logs.pairwise_max(v.hourly_matrix(spark, sf))


# ---------------------------------------------------------------- chunks, knowledge base, union
@query
def cumulative_sizes(spark, sf):
    return chunks.cumulative_sizes(v.supplier_chunks(spark, sf))


@query
def locate_rows(spark, sf):
    return chunks.locate_rows(v.row_numbers(spark, sf), v.supplier_chunks(spark, sf))


@query
def invert_kb(spark, sf):
    lists = knowledge.invert_kb(v.brand_kb(spark, sf), page=100)
    return lists.withColumn("entries", F.array_join("entries", ","))


@query
def invert_kb_reverse(spark, sf):
    lists = knowledge.invert_kb(v.brand_kb(spark, sf), reverse=True, page=100)
    return lists.withColumn("entries", F.array_join("entries", ","))


@query
def concat_texts(spark, sf):
    first = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), "text")
    second = v.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return concat_sources(first, second)
