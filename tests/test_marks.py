import random

import pytest
from pyspark.sql import functions as F

from corpusprep.functions import marks
from corpusprep.operators import annotate as an
from corpusprep.plans import training_sets as jobs


@pytest.mark.parametrize("looked_up", [marks.LOOKED_UP, 0])
def test_marks_are_the_rows_named(spark, monkeypatch, looked_up):
    monkeypatch.setattr(marks, "LOOKED_UP", looked_up)
    held = marks.numbered(spark.range(3000, numPartitions=3).repartition(5, "id").filter("id > 20"))
    wanted = F.col("id").isin(random.Random(1).sample(range(3000), 700))
    out = marks.with_marks(held.filter("id % 3 > 0"), held.filter(wanted).select(marks.ROW), "m").withColumn("w", wanted)
    assert out.filter("m <> w").count() == 0 and out.filter("m").count() > 400
    assert marks.with_marks(held, held.filter("false").select(marks.ROW), "m").filter("m").count() == 0
    nothing = held.filter("false")
    assert marks.with_marks(nothing, nothing.select(marks.ROW), "m").count() == 0


def test_a_value_filter_passes_its_values(spark):
    rows = spark.range(20000).select((F.col("id") % 7).cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    values = rows.filter("b < '2'")
    passes = marks.value_filter(values, ["a", "b"], values.count())
    out = rows.withColumn("p", passes(F.col("a"), F.col("b")))
    assert out.filter("b < '2' and not p").count() == 0
    assert out.filter("b >= '2' and p").count() < 0.2 * out.filter("b >= '2'").count()


def test_repeats_with_equal_or_missing_ids_and_titles(spark):
    span = "array<struct<indexed_text:string,attribute_type:string,start_idx:int,end_idx:int>>"
    x, y = [("a", "A", 0, 1)], [("a", None, 0, 1)]
    rows = [(3, "t", x, "p"), (1, "t", x, "q"), (1, "t", x, "q"), (2, None, x, "r"), (None, None, x, "s"), (4, "", x, "t"), (1, "u", x, "v"), (7, "t", y, "w"), (6, "t", y, "x"), (None, "n", x, "z"), (5, "t", [], "y")]
    rows += [(8, "t", [("A", None, 0, 1)], "k"), (9, "t", [(None, "A", 0, 1)], "l")]  # the same but for the missing value's place
    df = spark.createDataFrame(rows, f"item_id int, title string, tagged {span}, other string")
    got = {(r.item_id, r.title, r.other) for r in an.drop_empty_and_duplicate(df).collect()}
    assert got == {(1, "t", "q"), (2, None, "r"), (4, "", "t"), (1, "u", "v"), (6, "t", "x"), (None, "n", None), (8, "t", "k"), (9, "t", "l")}
    assert an.drop_empty_and_duplicate(df).count() == len(got)


def _items(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        words = [rng.choice(["red", "blue", "hat"]), f"w{rng.randint(0, 90)}"]
        title = " ".join(words)
        anns = [(words[0], "A", "title", 1.0, 0, len(words[0]), 0), (words[1], "B", "title", 1.0, len(words[0]) + 1, len(title), 0)]
        rows.append((i, title, anns))
    return spark.createDataFrame(rows, f"item_id bigint, title string, anns array<{an.ANNOTATION}>")


@pytest.mark.parametrize(
    "build",
    [
        jobs.build_multi_value_set,
        jobs.build_new_value_set,
        jobs.build_training_set,
        lambda items, **kw: jobs.build_training_set(items, "new-value", **kw),
    ],
)
def test_jobs_store_each_row_once_and_only_what_is_kept(spark, monkeypatch, build):
    seen = []

    def noted(df, *args, store=marks.stored):
        seen.append(df.columns)
        return store(df, *args)

    for module in (marks, an, jobs):
        monkeypatch.setattr(module, "stored", noted)
    items = _items(spark)
    narrow = build(items, keep=())
    assert "anns" not in narrow.columns
    assert [c for c in seen if "anns" in c] == [] and len([c for c in seen if "title" in c]) == 1
    wide = build(items)
    assert {"anns", "item_id", "title", "tagged", "tags", "num_overlap", "is_test"} == set(wide.columns)
    flags = lambda df: sorted((r.item_id, r.num_overlap, r.is_test) for r in df.collect())
    assert flags(narrow) == flags(wide)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "title" in line]
