"""Rows whose group or order is null stay."""

from pyspark.sql import functions as F

from corpusprep.functions.blocks import running
from corpusprep.operators.evaluate import sample_accuracy


def test_running_keeps_null_groups(spark):
    rows = [(None, 1, 5), (None, 1 << 40, 7), ("a", 2, 1), ("a", 3, 2)]
    df = spark.createDataFrame(rows, "run string, at bigint, v bigint")
    got = running(df, ["run"], "at", {"total": ("sum", F.col("v"))}).collect()
    assert {(r.run, r.at, r.total) for r in got} == {(None, 1, 5), (None, 1 << 40, 12), ("a", 2, 1), ("a", 3, 3)}


def test_text_tags_have_an_accuracy(spark):
    gold = spark.createDataFrame([(1, 0, "B-x"), (1, 1, "O"), (2, 0, "O")], "sample_id int, pos int, tag string")
    pred = spark.createDataFrame([(1, 0, "B-x"), (1, 1, "O"), (2, 0, "B-x")], "sample_id int, pos int, tag string")
    assert sample_accuracy(pred, gold).first()[0] == 0.5
