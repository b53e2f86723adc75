"""The operators' inputs, derived by Spark from the driver tables.

Every view uses all rows and whole texts of the tables it reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions import arrays as A
from corpusprep.functions import patterns as P
from corpusprep.functions.blocks import running
from corpusprep.operators import span_columns
from corpusprep.operators.annotate import ANNOTATION
from corpusprep.operators.logs import split_lines
from corpusprep.operators.retrieval import word_tokens

RUN_MARKER = "start"
_ANNOTATION_FIELDS = [
    ("attribute_value", pa.string()),
    ("attribute_type", pa.string()),
    ("source", pa.string()),
    ("score", pa.float64()),
    ("start_idx", pa.int32()),
    ("end_idx", pa.int32()),
    ("line_idx", pa.int32()),
]
LINES_PER_DOC = 1 << 31  # item ids: document id and line number, an int, in one bigint; turns alike


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document texts, spread over the cores if the file has fewer splits than that.

    Text work happens inside the row; a small file with one row group would be one task.  On a
    large table the splits outnumber the cores and nothing is shuffled.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, "doc_id")


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", word_tokens(F.col("text")).alias("tokens"))


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), word_tokens(F.col("text")).alias("tokens")
    )


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: ``(item_id, title)``."""
    docs = documents(spark, sf_dir)
    return A.unnest_pos(docs, ["doc_id"], F.split("text", "\n", -1), "n", "title").select(
        (F.col("doc_id") * LINES_PER_DOC + F.col("n")).alias("item_id"), "title"
    )


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a description, its lines set apart as that column does."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("item_id"), F.replace("text", F.lit("\n"), F.lit("\x01")).alias("description")
    )


def part_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as attribute texts, with a repeated key, both separators and a part that is no pair."""
    pieces = [
        F.concat(F.lit(" Type : "), "p_type"),
        F.concat(F.lit("no pair; Brand:"), "p_brand", F.lit(" ||| "), F.col("p_size").cast("string"), F.lit(","), "p_name"),
        F.concat(F.lit("a:b:"), "p_brand", F.lit("；type:"), "p_name"),
    ]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.concat_ws(";", *pieces).alias("attrs"))


def annotated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with noisy annotations: one per word.

    Some start one character late, some run over the next word, some belong to a description.
    """

    return doc_lines(spark, sf_dir).withColumn("anns", F.arrow_udf(_annotations, f"array<{ANNOTATION}>")("title"))


def _annotations(titles: pa.Array) -> pa.Array:
    held = span_columns.valid(titles)
    done = [_annotated(held.slice(at, n)) for at, n in span_columns.pieces(held)]
    return span_columns.joined(done) if done else _annotated(held)


def _annotated(titles: pa.Array) -> pa.Array:
    words = pc.split_pattern(titles, " ")
    n = span_columns.sizes(words)
    first = span_columns.offsets(n)
    value = words.flatten()
    size = pc.utf8_length(value).to_numpy(zero_copy_only=False).astype(np.int64)
    i = np.arange(len(size)) - np.repeat(first[:-1], n)
    before = span_columns.offsets(size + 1)
    start = before[:-1] - np.repeat(before[first[:-1]], n)
    following = np.append(size[1:], 0) + 1
    stretch = np.where((i % 11 == 0) & (i + 1 < np.repeat(n, n)), following, 0)
    columns = [
        value,
        pa.array(["size", "colour code", "brand"]).take(pa.array(size % 3)),
        pa.array(["description", "title"]).take(pa.array((i % 13 != 0).astype(np.int8))),
        pa.array(np.ones(len(size))),
        pa.array(start + (i % 7 == 0), pa.int32()),
        pa.array(start + size + stretch, pa.int32()),
        pa.array(np.zeros(len(size), np.int32)),
    ]
    anns = pa.StructArray.from_arrays(columns, [name for name, _ in _ANNOTATION_FIELDS])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), anns, mask=titles.is_null())


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as samples with one relation: first word, last word."""
    words = F.split("text", " ", -1)
    rel = F.struct(
        F.get(words, F.lit(0)).alias("subject"),
        F.lit("first-last").alias("predicate"),
        F.element_at(words, -1).alias("object"),
    )
    return doc_lines(spark, sf_dir).select(
        F.col("item_id").cast("string").alias("id"), F.col("title").alias("text")
    ).withColumn("relation_list", F.array(rel))


def long_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as samples; every word is related to the third word after it."""

    def relations(toks: Column) -> Column:
        span = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))

        def one(t: Column, i: Column) -> Column:
            obj = F.get(toks, i + 3)
            return F.struct(
                t["token"].alias("subject"),
                F.lit("near").alias("predicate"),
                obj["token"].alias("object"),
                span(t["cs"], t["ce"]).alias("subj_char_span"),
                span(obj["cs"], obj["ce"]).alias("obj_char_span"),
                span(i, i + 1).alias("subj_tok_span"),
                span(i + 3, i + 4).alias("obj_tok_span"),
            )

        return F.filter(F.transform(toks, one), lambda r: r["object"].isNotNull())

    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"),
        "text",
        A.let(A.space_tokens(F.col("text")), relations).alias("relation_list"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("turn_no", F.col("conv_id") * LINES_PER_DOC + F.col("turn"))


def token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn with the next one as two token lists."""
    rows = turns(spark, sf_dir)
    now = rows.select("conv_id", "turn", F.col("turn_no").alias("pair_id"), F.split("text", " ").alias("tokens_a"))
    following = rows.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.split("text", " ").alias("tokens_b")
    )
    return now.join(following, ["conv_id", "turn"]).select("pair_id", "tokens_a", "tokens_b")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clicks; the article is the value without its fraction."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.floor("value").cast("bigint").alias("click_article_id"),
        F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("bigint").alias("click_timestamp"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the distinct status codes of their lines as labels."""
    lines = table(spark, sf_dir, "lineitem")
    code = lambda c: F.ascii(F.col(c))
    codes = (
        lines.select("l_orderkey", F.explode(F.array(code("l_returnflag"), code("l_linestatus"))).alias("label"))
        .groupBy("l_orderkey")
        .agg(F.collect_set("label").alias("labels"))
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return orders.join(codes, F.col("row_id") == F.col("l_orderkey"), "left").select("row_id", "labels")


def triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(gold, pred)``: part - flag - supplier per order; the prediction misses high-tax lines and
    mistakes the flag of highly discounted ones."""
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    span = lambda c: F.struct(F.col(c).cast("int").alias("s"), (F.col(c) + 2).cast("int").alias("e"))
    rows = lines.join(part, "l_partkey").join(supplier, "l_suppkey").select(
        F.col("l_orderkey").alias("sample_id"),
        F.col("p_name").alias("subject"),
        F.col("l_returnflag").alias("predicate"),
        F.col("s_name").alias("object"),
        span("l_linenumber").alias("subj_tok_span"),
        span("l_suppkey").alias("obj_tok_span"),
        "l_tax",
        "l_discount",
    )
    pred = rows.filter(F.col("l_tax") < 0.07).withColumn(
        "predicate", F.when(F.col("l_discount") > 0.05, "X").otherwise(F.col("predicate"))
    )
    return rows.drop("l_tax", "l_discount"), pred.drop("l_tax", "l_discount")


def tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(pred, gold)`` tags per order line; heavily taxed lines are predicted wrongly."""
    rows = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("pos"))
        .agg(F.max(F.ascii("l_returnflag")).alias("tag"), F.max("l_tax").alias("l_tax"))
    )
    pred = rows.withColumn("tag", F.when(F.col("l_tax") > 0.07, F.col("tag") + 1).otherwise(F.col("tag")))
    return pred.drop("l_tax"), rows.drop("l_tax")


def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training batches: run = user, epoch = day, batch = event id."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.dayofmonth("ts").alias("epoch"),
        F.col("event_id").alias("batch"),
        F.col("value").alias("loss"),
        (F.col("value") / 7).alias("ent_acc"),
    )


def _event_lines(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """Events as log lines: one log per user, lines numbered from 0."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("path"), "event_id", line.alias("line")
    )
    return running(events, ["path"], "event_id", {"line_no": ("count", F.lit(1))}, exclusive=True).select(
        "path", "line_no", "line"
    )


def _value() -> Column:
    return F.col("value").cast("string")


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _event_lines(
        spark,
        sf_dir,
        F.when((kind == "signup") & (F.col("event_id") % 3 == 0), F.concat(F.lit(P.RESULTS_MARKER), F.lit(" Total epoch7:")))
        .when(kind == "signup", P.RESULTS_MARKER)
        .when(kind == "error", F.concat(F.lit("Total epoch"), (F.col("event_id") % 50 + 1).cast("string"), F.lit(":")))
        .otherwise(F.concat(kind, F.lit(" f1 = "), _value())),
    )


def test_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _event_lines(
        spark,
        sf_dir,
        F.when(kind == "signup", f"run {RUN_MARKER}")
        .when(kind == "click", "'test_triples'")
        .otherwise(F.concat(F.lit("score 0."), F.col("event_id").cast("string"), F.lit(" end"))),
    )


def tuple_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_lines(
        spark,
        sf_dir,
        F.concat(F.col("event_type"), F.lit(" ("), _value(), F.lit(", "), F.col("event_id").cast("string"), F.lit(")")),
    )


def pseudo_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    acc = lambda who: F.concat(
        F.lit(f"{{'{who}val_ent_seq_acc': "),
        _value(),
        F.lit(f", '{who}val_head_rel_acc': "),
        F.col("event_id").cast("string"),
        F.lit(f", '{who}val_tail_rel_acc': 0.5, 'time': 1}}"),
    )
    return _event_lines(
        spark,
        sf_dir,
        F.when(kind == "signup", acc("student "))
        .when(kind == "view", acc(""))
        .when(kind == "error", "noise")
        .otherwise(F.concat(F.lit("generate pseudo label,Z_RATIO: "), _value(), F.lit(", NUMBER: 7 "))),
    )


def accuracy_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two logs of one run each, from the events and from the orders."""

    def line(value: Column, key: Column) -> Column:
        return F.concat(
            F.lit("t_ent_sample_acc: "),
            value.cast("string"),
            F.lit(", t_head_rel_sample_acc: "),
            key.cast("string"),
            F.lit(", t_tail_rel_sample_acc: 0.25,lr: 1"),
        )

    a = table(spark, sf_dir, "events").select(
        F.lit("a").alias("path"), F.col("event_id").alias("line_no"), line(F.col("value"), F.col("event_id")).alias("line")
    )
    b = table(spark, sf_dir, "orders").select(
        F.lit("b").alias("path"),
        F.col("o_orderkey").alias("line_no"),
        line(F.col("o_totalprice"), F.col("o_orderkey")).alias("line"),
    )
    return a, b


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log text per document: an evaluation line for every line of it."""
    lines = F.transform(
        split_lines(F.col("text")), lambda x: F.concat(F.lit("eval f1 = "), F.length(x).cast("string"), F.lit("\n"))
    )
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("path"), F.array_join(lines, "").alias("text")
    )


def decimal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as text, one log per order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"),
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.concat_ws(
            " ", F.col("l_quantity").cast("string"), F.col("l_tax").cast("string"), F.col("l_extendedprice").cast("string")
        ).alias("line"),
    )


def hourly_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest event value per day (epoch) and hour (column)."""
    return table(spark, sf_dir, "events").groupBy(
        F.dayofmonth("ts").alias("epoch"), F.hour("ts").alias("col")
    ).agg(F.max("value").alias("value"))


def supplier_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per supplier, as long as its order lines."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("chunk_id")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as row numbers, shifted so that some are negative and some out of range."""
    return table(spark, sf_dir, "orders").select(
        (F.floor(F.col("o_totalprice") / 7) - 5000).cast("bigint").alias("idx")
    ).distinct()


def brand_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("key"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("value")
    )


def name_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as the lines of a vocabulary file."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.col("p_name").alias("line"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of every word per language, as value counts per type."""
    words = A.unnest(
        documents(spark, sf_dir).withColumnRenamed("lang", "attr_type"),
        ["attr_type"],
        F.split("text", "[ \n]"),
        "value_content",
    )
    return (
        words.filter(F.col("value_content") != "")
        .groupBy("attr_type", "value_content")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def word_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary from the benchmark texts: a word's id is its smallest item plus two."""
    return (
        table(spark, sf_dir, "benchmark")
        .select("item_id", F.explode(word_tokens(F.col("text"))).alias("token"))
        .groupBy("token")
        .agg((F.min("item_id") + 2).alias("id"))
    )
