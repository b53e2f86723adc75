import hashlib
import math
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from corpusprep.functions.blocks import running
from corpusprep.operators import chunks, sampling


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_ratio_sample_is_exact_and_by_hash(spark):
    for n, ratio in ((100, 0.29), (7, 0.0), (7, 1.0), (1, 0.5), (1000, 0.3)):
        got = {r.id for r in sampling.ratio_sample(spark.range(n), "id", ratio, seed=4).collect()}
        assert got == set(sorted(range(n), key=lambda i: key(4, i))[: int(n * ratio)])


def test_random_split_is_exact_and_disjoint(spark):
    for n in (1, 3, 10, 101):
        rows = sampling.random_split(spark.range(n), "id", 0.2).collect()
        assert sorted(r.id for r in rows) == list(range(n))
        assert sum(r.is_test for r in rows) == math.ceil(n * 0.2)


def test_stratified_hot_label(spark):
    rows = [(i, [1]) for i in range(10)] + [(i, [2, 2, 1]) for i in range(10, 12)] + [(12, []), (13, None)]
    df = spark.createDataFrame(rows, "row_id bigint, labels array<int>")
    strata = sampling.stratified_sample(df, "row_id", 0.3)
    report = {r.label: (r.total, r.sampled, r.rest) for r in sampling.stratum_report(strata).collect()}
    assert report == {1: (12, 4, 8), 2: (2, 1, 1), -1: (2, 1, 1)}


def test_parts(spark):
    assert [r["size"] for r in sampling.part_sizes(spark.range(10), 3).orderBy("part").collect()] == [3, 3, 4]
    placed = sampling.assign_part(spark.range(10).withColumn("o", F.col("id") * 1000), "o", 3).orderBy("id").collect()
    assert [r.part for r in placed] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    with pytest.raises(Exception, match="fewer rows"):
        sampling.assign_part(spark.range(2), "id", 3).collect()


def test_fixed_batches(spark):
    for n, size in ((10, 4), (8, 4), (3, 4), (9, 4)):
        rows = sampling.fixed_batches(spark.range(n), "id", size, fill=True).collect()
        assert sorted(r.id for r in rows if not r.filler) == list(range(n))
        last = [r for r in rows if r.batch == (n - 1) // size]
        assert len(last) == (size if n > size else n)
        earlier = {r.id for r in rows if not r.filler and r.batch < n // size}
        assert all(r.id in earlier for r in rows if r.filler)


def test_sample_users(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 1), (2, 5, 1), (3, 6, 2)], "user_id bigint, click_article_id bigint, click_timestamp bigint")
    got = sampling.sample_users(df, 2).collect()
    assert len({r.user_id for r in got}) == 2 and len(got) == 2
    with pytest.raises(Exception, match="fewer users"):
        sampling.sample_users(df, 4).collect()


def test_head_and_ordinal(spark):
    assert [r.id for r in sampling.head(spark.range(50), "id", 3).collect()] == [0, 1, 2]
    rows = sampling.with_ordinal(spark.range(5).withColumn("o", F.col("id") * 100000 - 7), "o").orderBy("o").collect()
    assert [r.ordinal for r in rows] == [0, 1, 2, 3, 4]


def test_running_values_do_not_depend_on_the_block(spark):
    rng = random.Random(6)
    # One hot group holds most rows.
    rows = [("hot" if rng.random() < 0.8 else "cold", i, rng.choice([None, 1, 5, 9])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, x int")
    kinds = {k: (k, F.col("x")) for k in ("sum", "count", "max", "last")}
    for exclusive in (False, True):
        got = {r.o: r for r in running(df, ["g"], "o", kinds, exclusive=exclusive, block=7).collect()}
        for g, o, x in rows:
            seen = [v for h, p, v in rows if h == g and (p < o if exclusive else p <= o) and v is not None]
            want = (sum(seen), len(seen), max(seen, default=None), seen[-1] if seen else None)
            r = got[o]
            assert (r["sum"], r["count"], r["max"], r["last"]) == want


def test_locate_rows(spark):
    sizes = spark.createDataFrame([(0, 3), (1, 0), (2, 2)], "chunk_id int, n_rows bigint")
    idx = spark.createDataFrame([(i,) for i in (0, 3, 4, -1, -5, -6, 5)], "idx bigint")
    got = {r.idx: (r.chunk_id, r.row_in_chunk, r.status) for r in chunks.locate_rows(idx, sizes).collect()}
    assert got == {
        0: (0, 0, "ok"), 3: (2, 0, "ok"), 4: (2, 1, "ok"), -1: (2, 1, "ok"), -5: (0, 0, "ok"),
        -6: (None, None, "out_of_range"), 5: (None, None, "out_of_range"),
    }
    assert [r.cumulative for r in chunks.cumulative_sizes(sizes).orderBy("chunk_id").collect()] == [3, 3, 5]


def test_running_values_over_a_sparse_order(spark):
    """Every row lies in a block of its own: totals are carried through the wider tables."""
    n, gap = 70_000, 1 << 32
    df = spark.range(n).select(
        F.lit("g").alias("g"), ((F.col("id") - 100) * gap).alias("o"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("w")
    )
    kinds = {"s": ("sum", F.col("v")), "c": ("count", F.lit(1)), "m": ("max", F.col("v")), "l": ("last", F.col("w")), "x": ("xor", F.col("v"))}
    got = running(df, ["g"], "o", kinds).orderBy("o").toPandas()
    v = [i % 7 for i in range(n)]
    assert got.s.tolist() == list(accumulate(v)) and got.c.tolist() == list(range(1, n + 1))
    assert got.x.tolist() == list(accumulate(v, lambda a, b: a ^ b)) and got.m.tolist() == list(accumulate(v, max))
    assert got.l.tolist() == [i - i % 3 for i in range(n)]


def test_locate_rows_in_one_giant_and_many_small_chunks(spark):
    sizes = [(0, 10_000_000)] + [(i, 1 + i % 2) for i in range(1, 20_001)]
    total = sum(n for _, n in sizes)
    asked = [0, 9_999_999, 10_000_000, 10_000_001, 10_000_001, 10_000_003, total - 1, -1, -total, total, -total - 1, None]
    got = chunks.locate_rows(
        spark.createDataFrame([(i,) for i in asked], "idx bigint"), spark.createDataFrame(sizes, "chunk_id int, n_rows bigint")
    )
    found = sorted([(r.idx, r.chunk_id, r.row_in_chunk) for r in got.collect() if r.status == "ok"])
    assert found == sorted([
        (0, 0, 0), (9_999_999, 0, 9_999_999), (10_000_000, 1, 0), (10_000_001, 1, 1), (10_000_001, 1, 1), (10_000_003, 3, 0),
        (total - 1, 20_000, 0), (-1, 20_000, 0), (-total, 0, 0),
    ])
    assert got.filter("status = 'out_of_range'").count() == 3
