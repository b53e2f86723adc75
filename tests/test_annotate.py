"""Repair, de-overlap, tags and rare values: hand cases and brute force on random input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusprep.functions import arrays as A
from corpusprep.operators import annotate as an
from corpusprep.operators import spans as span_steps
from corpusprep.plans import training_sets as jobs

ITEM = f"item_id bigint, title string, anns array<{an.ANNOTATION}>"


def items(spark, *rows):
    """Rows of (title, [(value, type, start, end), ...])."""
    data = [
        (i, title, [(v, t, "title", 1.0, s, e, 0) for v, t, s, e in anns]) for i, (title, anns) in enumerate(rows)
    ]
    return spark.createDataFrame(data, ITEM)


def tagged(df, **kw):
    rows = an.repair_and_deoverlap(df, **kw).orderBy("item_id").collect()
    return [[(t.attribute_type, t.start_idx, t.end_idx) for t in r.tagged] for r in rows]


def test_scan_keeps_overlaps_of_other_types(spark):
    df = items(spark, ("abcdefghi", [("abcde", "A", 0, 5), ("cd", "A", 2, 4), ("efgh", "B", 4, 8), ("ghi", "B", 6, 9)]))
    assert tagged(df) == [[("A", 0, 5), ("B", 4, 8), ("B", 6, 9)]]
    assert tagged(df, mode="strict") == [[("A", 0, 5), ("B", 4, 8)]]


def test_repair_counts_code_points_and_respects_word_edges(spark):
    df = items(
        spark,
        ("😀😀 redder, red x", [("red", "A", 0, 3)]),
        ("a+b c", [("+b", "A", 3, 5)]),  # "+" follows a word character: an edge
        ("+b c", [("+b", "A", 3, 4), ("zz", "B", 3, 4)]),  # no edge before a leading "+"; slice repairs
        ("abc", [("zz", "A", 1, 2), ("", "B", 0, 0), ("x", "C", -1, 2)]),
    )
    assert tagged(df) == [[("A", 11, 14)], [("A", 1, 3)], [("A", 3, 4), ("B", 3, 4)], []]


@pytest.mark.parametrize("scanned", [4096, 0])
def test_whole_word_search_equals_python(spark, monkeypatch, scanned):
    monkeypatch.setattr(an, "_SCANNED", scanned)  # 0: every title gets a run index
    rng = random.Random(1)
    alphabet = "ab1_é .-+́字²\x1f"
    rows = [
        ("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))), "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3))))
        for _ in range(3000)
    ]
    got = (
        spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, v string")
        .select("i", A.let(an._searchable(F.col("t")), lambda x: an._whole_word_start(F.col("t"), x, F.col("v"))).alias("p"))
        .orderBy("i")
        .collect()
    )
    expected = []
    for t, v in rows:
        m = re.search(r"\b" + re.escape(v) + r"\b", t)
        expected.append(m.start() if m else -1)
    assert [r.p for r in got] == expected


@pytest.mark.parametrize("mode", ["default", "strict"])
def test_deoverlap_equals_brute_force(spark, mode):
    rng = random.Random(2)
    title = "".join(chr(97 + i % 26) for i in range(700))
    rows = []
    for _ in range(30):
        spans = []
        for _ in range(rng.choice([0, 3, 40, 600])):  # more than one scan chunk
            s = rng.randint(0, 690)
            e = rng.randint(s + 1, min(700, s + 12))
            spans.append((title[s:e], rng.choice("AB"), s, e))
        rows.append((title, spans))

    def expected(spans):
        kept, last = [], None
        for v, t, s, e in sorted(set(spans), key=lambda a: (a[2], a[3], a[1], a[0])):
            clash = last is not None and s < last[1]
            drop = clash and (mode == "strict" or (t == last[0] and e <= last[1]))
            if not drop:
                kept.append((t, s, e))
            if mode == "strict" or not drop:
                last = (t, e)
        return sorted(kept, key=lambda x: (x[1], x[2], x[0]))

    assert tagged(items(spark, *rows), mode=mode) == [expected(spans) for _, spans in rows]


def test_slices_equal_their_text(spark):
    df = items(spark, ("red shoe big", [("shoe", "A", 3, 8), ("big", "B", 1, 2)]))
    (row,) = an.repair_and_deoverlap(df).collect()
    assert all(row.title[t.start_idx : t.end_idx] == t.indexed_text for t in row.tagged)


def bio(df, **kw):
    out = an.bio_tags(an.repair_and_deoverlap(df), **kw).orderBy("item_id").collect()
    return [([tuple(t) for t in r.tags], r.num_overlap) for r in out]


def test_bio_visits_by_type_unless_told_otherwise(spark):
    df = items(spark, ("red shoe big", [("shoe", "brand", 4, 8), ("red", "colour code", 0, 3)]))
    assert bio(df) == [([("red", "O"), ("shoe", "B-brand"), ("big", "O")], 1)]
    assert bio(df, order="position") == [([("red", "B-colour##code"), ("shoe", "B-brand"), ("big", "O")], 0)]


def test_biose(spark):
    df = items(spark, ("new york city", [("new york city", "place", 0, 13)]), ("rome", [("rome", "place", 0, 4)]))
    assert [[t for _, t in tags] for tags, _ in bio(df, scheme="BIOSE")] == [
        ["B-place", "I-place", "E-place"],
        ["S-place"],
    ]


def test_page_slice_equals_python(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab😀 é") for _ in range(3000))
    spans = [(rng.randint(0, 3100), rng.randint(-20, 3100)) for _ in range(300)]
    df = spark.createDataFrame([(text, spans)], "t string, sp array<struct<s:int,e:int>>")
    got = df.select(
        A.let(A.pages(F.col("t")), lambda p: F.transform("sp", lambda x: A.page_slice(F.col("t"), p, x["s"], x["e"])))
    ).first()[0]
    assert got == [text[s:e] for s, e in spans]


def _depth(counts, ratio, threshold):
    """The search for the depth, value by value."""
    types = {}
    for t, _, c in counts:
        types.setdefault(t, []).append(c)
    types = {t: sorted(cs) for t, cs in types.items() if sum(cs) >= 4 * threshold}
    target = int(sum(map(sum, types.values())) * ratio)

    def covered(k):
        if k == 1:
            return sum(cs[0] for cs in types.values())
        return sum(c for cs in types.values() for c in cs[:k] if c < threshold)

    k = 1
    while covered(k) < target and not (k >= 2 and covered(k) == covered(k - 1)):
        k += 1
    return {t: [c for c in cs[:k] if c < threshold] for t, cs in types.items()}


@pytest.mark.parametrize("seed", range(6))
def test_rare_values_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    counts = [
        (t, f"{t}{i}", rng.choice([1, 1, 1, 2, 3, rng.randint(1, 12), rng.randint(1, 60)]))
        for t in "abcd"
        for i in range(rng.randint(1, 60))
    ]
    ratio, threshold = rng.choice([(0.2, 5), (0.05, 10), (0.9, 8), (0.5, 3)])
    df = spark.createDataFrame(counts, "attr_type string, value_content string, count bigint")
    got = {}
    for r in an.select_rare_values(df, ratio, threshold).collect():
        got.setdefault(r.attr_type, []).append(r["count"])
    expected = {t: cs for t, cs in _depth(counts, ratio, threshold).items() if cs}
    assert {t: sorted(cs) for t, cs in got.items()} == expected


def test_new_value_flag(spark):
    df = an.repair_and_deoverlap(items(spark, ("red shoe", [("red", "A", 0, 3)]), ("blue shoe", [("blue", "A", 0, 4)]), ("x", [("x", "S", 0, 1)])))
    rare = spark.createDataFrame([("A", "red")], "attr_type string, value_content string")
    small = spark.createDataFrame([("S", "x")], "attr_type string, value_content string")
    flags = lambda p: [r.is_test for r in an.flag_new_value(df, rare, small, p=p).orderBy("item_id").collect()]
    assert flags(0.0) == [True, False, False]
    assert flags(1.0 - 2**-31) == [True, False, True]


def test_drop_duplicates_keeps_smallest_id(spark):
    same = ("red shoe", [("red", "A", 0, 3)])
    df = an.repair_and_deoverlap(items(spark, ("none", []), same, same, ("red shoe", [("shoe", "A", 4, 8)])))
    assert sorted(r.item_id for r in an.drop_empty_and_duplicate(df).collect()) == [1, 3]


def test_attribute_pairs(spark):
    df = spark.createDataFrame([(1, "Color:Red|||Blue;Size: L ;bad；size:M"), (2, "a:b:c")], "item_id bigint, attrs string")
    got = [(r.attr, r.value) for r in an.parse_attribute_pairs(df).orderBy("attr", "pos").collect()]
    assert got == [("color", "red"), ("color", "blue"), ("size", "m")]


def test_explode_description(spark):
    df = spark.createDataFrame([(1, "['One', 'TWO']"), (2, "A\x01b")], "item_id bigint, description string")
    got = [(r.item_id, r.line_idx, r.line) for r in an.explode_description(df).orderBy("item_id", "line_idx").collect()]
    assert got == [(1, 0, "one"), (1, 1, "two"), (2, 0, "A"), (2, 1, "b")]


@pytest.mark.parametrize("build", [jobs.build_multi_value_set, jobs.build_new_value_set, jobs.build_training_set])
def test_jobs_split_all_rows_and_keep_none_empty(spark, build):
    rng = random.Random(4)
    words = ["red", "blue", "shoe", "hat", "big"]
    rows = []
    for i in range(300):
        title = " ".join([rng.choice(words), rng.choice(words), f"w{rng.randint(0, 150)}"])
        w = title.split(" ")
        rows.append((title, [(w[0], "A", 0, len(w[0])), (w[2], "B", title.rindex("w"), len(title))] if i % 7 else []))
    out = build(items(spark, *rows)).select("item_id", "is_test", F.size("tagged").alias("n")).collect()
    assert len({r.item_id for r in out}) == len(out)
    assert all(r.n > 0 for r in out)
    assert {r.is_test for r in out} == {True, False}
    if build is jobs.build_multi_value_set:
        assert len(out) == sum(1 for _, a in rows if a)


@pytest.mark.parametrize("scanned", [4096, 0])
def test_span_steps_know_missing_values(monkeypatch, scanned):
    monkeypatch.setattr(span_steps, "SCANNED", scanned)
    ann = lambda v, s, e, src="title", typ="A": (0, s, e, typ, v, src, 1.0)
    fixed = lambda title, rows, strict=False: span_steps._repair(title, rows, strict)
    assert fixed("red shoe", [ann("shoe", 5, 9), ann("red", 0, 3)]) == [("red", "A", 0, 3, 0, "title"), ("shoe", "A", 4, 8, 0, "title")]
    assert fixed(None, [ann("x", 0, 3), ann("x", 0, 3, "description")]) == [("", "A", 0, 3, 0, "description")]
    assert fixed("red", [ann("", 0, None)], True) == [("", "A", 0, None, 0, "title")]
    assert fixed("red", [ann("red", 0, 3, None), ann("zz", 0, 3, None)]) == [("red", "A", 0, 3, 0, None)] * 2
    kept = span_steps._kept([("a", "A", 0, 4, None, "title"), ("b", "A", 2, 3, 0, "title"), ("c", "A", 5, 6, 0, "title")], True)
    assert [k[0] for k in kept] == ["a", "c"]  # whether "b" overlaps is unknown
    assert span_steps._tags("a b", [("b", None, 2, 3)], False, True) == ([("a", "O"), ("b", None)], 0)


def test_repair_and_tags_run_outside_of_row_expressions(spark):
    df = an.bio_tags(an.repair_and_deoverlap(items(spark, ("red shoe", [("red", "A", 0, 3)]))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
