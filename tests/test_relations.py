import random
import re

import pytest
from pyspark.sql import functions as F

from corpusprep.operators import relations as rel
from corpusprep.operators import text

SPAN = "struct<s:int,e:int>"
REL = "array<struct<subject:string,predicate:string,object:string>>"


def test_normalize_formats(spark):
    casrel = spark.createDataFrame([(5, "a� b", [["a�", "r", "b"]]), (9, "c", [])], "n int, text string, triple_list array<array<string>>")
    got = rel.normalize_samples(casrel, "casrel", "train", order="n").orderBy("id").collect()
    assert [(r.id, r.text, [tuple(x) for x in r.relation_list]) for r in got] == [
        ("train_0", "a b", [("a", "r", "b")]),
        ("train_1", "c", []),
    ]
    etl = spark.createDataFrame([(["x", "y"], [["x", "r", "y"]])], "tokens array<string>, spo_list array<array<string>>")
    assert rel.normalize_samples(etl, "etl_span", "test", add_id=False).first().text == "x y"
    nyt = spark.createDataFrame(
        [("s t", [("s", "l", "t")])], "sentText string, relationMentions array<struct<em1Text:string,label:string,em2Text:string>>"
    )
    assert tuple(rel.normalize_samples(nyt, "raw_nyt", "test", add_id=False).first().relation_list[0]) == ("s", "l", "t")
    with pytest.raises(ValueError):
        rel.normalize_samples(nyt, "other", "test")


def test_squeeze_leaves_test_relations(spark):
    df = spark.createDataFrame([("a  b", [("a  ", "r", " b")])], f"text string, relation_list {REL}")
    assert tuple(rel.squeeze_whitespace(df).first().relation_list[0]) == ("a", "r", "b")
    assert tuple(rel.squeeze_whitespace(df, data_type="test").first().relation_list[0]) == ("a  ", "r", " b")


def spans_of(spark, text_, entity, ignore_subword):
    df = spark.createDataFrame([(text_, entity)], "t string, e string")
    return [tuple(x) for x in df.select(rel.entity_spans(F.col("t"), F.col("e"), ignore_subword)).first()[0]]


def test_entity_spans(spark):
    assert spans_of(spark, "a b a a b", "a", True) == [(0, 1), (4, 5)]
    assert spans_of(spark, "12 and 2", "2", False) == [(7, 8)]
    assert spans_of(spark, "x\\Ey \\E", "\\E", False) == [(1, 3), (5, 7)]


def test_entity_spans_equal_python(spark):
    rng = random.Random(5)
    rows = [
        ("".join(rng.choice("ab1 😀.") for _ in range(rng.randint(0, 30))), "".join(rng.choice("ab1 .") for _ in range(rng.randint(1, 3))))
        for _ in range(1500)
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, e string")
    got = df.select(
        "i", rel.entity_spans(F.col("t"), F.col("e"), True).alias("w"), rel.entity_spans(F.col("t"), F.col("e"), False).alias("p")
    ).orderBy("i").collect()
    for (t, e), r in zip(rows, got):
        words = [(m.start(), m.end() - 2) for m in re.finditer(re.escape(f" {e} "), f" {t} ")]
        digit = lambda k: 0 <= k < len(t) and t[k].isdigit()
        plain = [
            m.span() for m in re.finditer(re.escape(e), t) if not (e[0].isdigit() and (digit(m.start() - 1) or digit(m.end())))
        ]
        assert ([tuple(x) for x in r.w], [tuple(x) for x in r.p]) == (words, plain)


def test_char_spans_pair_all_occurrences_and_report_misses(spark):
    df = spark.createDataFrame(
        [("1", "a b a c b", [("a", "r", "b")], [("c", "T")]), ("2", "a", [("a", "r", "zz")], [])],
        f"id string, text string, relation_list {REL}, entity_list array<struct<text:string,type:string>>",
    )
    out, miss = rel.attach_char_spans(df)
    first = out.filter("id = '1'").first()
    assert [(tuple(r.subj_char_span), tuple(r.obj_char_span)) for r in first.relation_list] == [
        ((0, 1), (2, 3)), ((0, 1), (8, 9)), ((4, 5), (2, 3)), ((4, 5), (8, 9))
    ]
    assert [tuple(e.char_span) for e in first.entity_list] == [(6, 7)]
    assert [r.id for r in miss.collect()] == ["2"]


def test_validate_spans(spark):
    ddl = f"array<struct<subject:string,predicate:string,object:string,subj_char_span:{SPAN},obj_char_span:{SPAN}>>"
    good = (" red", "r", "shoe ", (0, 4), (5, 10))
    off = ("red", "r", "shoe", (0, 3), (5, 9))
    tab = ("\tred", "r", "shoe", (0, 4), (5, 9))
    blank = ("  ", "r", "shoe", (0, 2), (5, 9))
    rows = [("ok", " red shoe ", [good]), ("mix", " red shoe ", [good, off]), ("bad", " red shoe ", [tab, blank]), ("none", "x", [])]
    clean, bad = rel.validate_spans(spark.createDataFrame(rows, f"id string, text string, relation_list {ddl}"))
    assert {r.id: [(x.subject, tuple(x.subj_char_span)) for x in r.relation_list] for r in clean.collect()} == {
        "ok": [("red", (1, 4))],
        "mix": [("red", (1, 4))],
    }
    assert {r.id: [x.stake for x in r.relation_list] for r in bad.collect()} == {"mix": [None, 0], "bad": [0, 0]}


def test_token_spans(spark):
    toks = text.whitespace_tokens(spark.createDataFrame([("1", "new york a")], "id string, text string"), "id")
    spans = spark.createDataFrame([("1", 0, 0, 8), ("1", 1, 3, 9)], "id string, span_no int, s int, e int")
    got = {r.span_no: (r.ts, r.te) for r in rel.token_spans(spans, toks).collect()}
    assert got == {0: (0, 2), 1: (-1, -1)}


def test_attach_token_spans_covers_all_lists(spark):
    ent = f"array<struct<text:string,type:string,char_span:{SPAN}>>"
    rels = f"array<struct<subject:string,predicate:string,object:string,subj_char_span:{SPAN},obj_char_span:{SPAN}>>"
    ev = f"array<struct<trigger_char_span:{SPAN},argument_list:array<struct<char_span:{SPAN}>>>>"
    df = spark.createDataFrame(
        [("1", "a bb c dd", [("a", "r", "c", (0, 1), (5, 6))], [("bb", "T", (2, 4))],
          [((7, 9), [((0, 1),), ((2, 6),)]), ((5, 6), [])])],
        f"id string, text string, relation_list {rels}, entity_list {ent}, event_list {ev}",
    )
    r = rel.attach_token_spans(df, text.whitespace_tokens(df, "id")).first()
    assert (tuple(r.relation_list[0].subj_tok_span), tuple(r.relation_list[0].obj_tok_span)) == ((0, 1), (2, 3))
    assert tuple(r.entity_list[0].tok_span) == (1, 2)
    assert [tuple(e.trigger_tok_span) for e in r.event_list] == [(3, 4), (2, 3)]
    assert [tuple(a.tok_span) for a in r.event_list[0].argument_list] == [(0, 1), (1, 3)]


def test_attach_token_spans_equals_token_spans_on_any_tokens(spark):
    """Nested, empty, shared and unordered tokens, spans without ends, ids that repeat, ids without tokens or null."""
    rng = random.Random(4)
    ids = [str(i // 2 if i < 6 else i) for i in range(40)] + [None]
    span = lambda: rng.choice([None, (None, 3), (2, None)]) if rng.random() < 0.1 else (rng.randint(0, 200), rng.randint(0, 200))
    rows = [(i, "x", [("a", span(), span()) for _ in range(rng.randint(0, 5))] if rng.random() < 0.9 else None) for i in ids]
    toks = []
    for i in [*dict.fromkeys(ids[:36]), None]:
        at = 0
        for k in range(rng.randint(0, 60)):
            size = rng.randint(0, 6)
            toks.append((i, rng.randint(0, 9) if i in ("3", "9") else k, "t", at, at + size * (30 if i == "8" else 1)))
            at += size + 1 if rng.random() < 0.9 else 0
    rng.shuffle(toks)
    df = spark.createDataFrame(rows, f"id string, text string, relation_list array<struct<subject:string,subj_char_span:{SPAN},obj_char_span:{SPAN}>>")
    tokens = spark.createDataFrame(toks, "id string, tok_ind int, token string, cs int, ce int")
    flat = [(i, 2 * k + j, *(x or (None, None))) for i, _, rels in rows for k, r in enumerate(rels or ()) for j, x in enumerate(r[1:])]
    spans = spark.createDataFrame(flat, "id string, span_no int, s int, e int")
    expected = {(r.id, r.span_no): (r.ts, r.te) for r in rel.token_spans(spans, tokens).collect() if r.id is not None}
    got = rel.attach_token_spans(df, tokens)
    found = [((r.id, 2 * k + j), x) for r in got.collect() for k, q in enumerate(r.relation_list or ()) for j, x in enumerate((q.subj_tok_span, q.obj_tok_span))]
    assert len(found) == len(flat) and {k: tuple(x) for k, x in found if x} == expected
    assert all(x is None for (i, _), x in found if i is None)


def test_attach_token_spans_moves_a_row_for_a_sample(spark, tmp_path):
    """A sample's 3,000 tokens and 2,000 spans meet as packed rows, none for each token or span."""
    df = spark.createDataFrame([(str(i), "a b " * 1500) for i in range(4)], "id string, text string").repartition(2)
    spans = F.expr("transform(sequence(0, 999), i -> struct(named_struct('s', 4 * i, 'e', 4 * i + 1) as subj_char_span, named_struct('s', 4 * i + 2, 'e', 4 * i + 3) as obj_char_span))")
    got = rel.attach_token_spans(df.withColumn("relation_list", spans.cast(f"array<struct<subj_char_span:{SPAN},obj_char_span:{SPAN}>>")), text.whitespace_tokens(df, "id"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.split("MapInArrow")[0] and plan.count("Generate") == 1
    assert all([tuple(r.subj_tok_span), tuple(r.obj_tok_span)] == [(2 * k, 2 * k + 1), (2 * k + 1, 2 * k + 2)] for x in got.collect() for k, r in enumerate(x.relation_list))


def starts(spark, n, max_len, stride):
    df = spark.createDataFrame([("1", " ".join(f"t{i}" for i in range(n)))], "id string, text string")
    return [r.tok_offset for r in rel.sliding_windows(df, max_len, stride, "test").orderBy("win").collect()]


def test_window_starts(spark):
    assert starts(spark, 4, 4, 2) == [0, 2]
    assert starts(spark, 3, 4, 2) == [0]
    for n in (1, 5, 9, 10, 11, 30):
        want = []
        for s in range(0, n, 3):
            want.append(s)
            if s + 10 > n:
                break
        assert starts(spark, n, 10, 3) == want


def test_subword_starts_move_left(spark):
    tok = "array<struct<tok_ind:int,token:string,cs:int,ce:int>>"
    pieces = ["un", "##be", "##liev", "##able", "x"]
    toks, at = [], 0
    for i, p in enumerate(pieces):
        size = len(p.replace("##", ""))
        toks.append((i, p, at, at + size))
        at += size
    df = spark.createDataFrame([("1", "unbelievablex", toks)], f"id string, text string, toks {tok}")
    out = rel.sliding_windows(df, 3, 2, "test", tokens="toks", subword=True).orderBy("win").collect()
    assert [(r.tok_offset, r.text) for r in out] == [(0, "unbeliev"), (0, "unbeliev"), (4, "x")]


def test_windows_rebase_labels_but_not_events(spark):
    rels = (
        f"array<struct<subject:string,object:string,subj_tok_span:{SPAN},obj_tok_span:{SPAN},subj_char_span:{SPAN},obj_char_span:{SPAN}>>"
    )
    ev = f"array<struct<trigger_tok_span:{SPAN},argument_list:array<struct<tok_span:{SPAN}>>>>"
    df = spark.createDataFrame(
        [("1", "a b c d", [("c", "d", (2, 3), (3, 4), (4, 5), (6, 7)), ("a", "d", (0, 1), (3, 4), (0, 1), (6, 7))],
          [((3, 4), [((0, 1),), ((2, 3),)])])],
        f"id string, text string, relation_list {rels}, event_list {ev}",
    )
    first, second = rel.sliding_windows(df, 3, 2).orderBy("win").collect()
    assert (first.text, first.relation_list, first.event_list) == ("a b c", [], [])
    assert second.text == "c d"
    (r,) = second.relation_list
    assert (tuple(r.subj_tok_span), tuple(r.obj_char_span)) == ((0, 1), (2, 3))
    (e,) = second.event_list
    assert tuple(e.trigger_tok_span) == (3, 4)
    assert [tuple(a.tok_span) for a in e.argument_list] == [(2, 3)]


def test_windows_look_their_relations_up(spark):
    """Every window keeps the order of the list, also of spans that end before they begin; none walks the whole list."""
    span = lambda s, e: (s, e)
    rels = [("x", "p", "y", span(0, 1), span(0, 1), span(s, e), span(s, s + 1)) for s, e in [(6, 7), (2, 3), (9, 8), (2, 1), (0, 1), (7, 8)]]
    sp = "struct<s:int,e:int>"
    schema = (
        "id string, text string, relation_list array<struct<subject:string,predicate:string,object:string,"
        f"subj_char_span:{sp},obj_char_span:{sp},subj_tok_span:{sp},obj_tok_span:{sp}>>"
    )
    df = spark.createDataFrame([("a", " ".join("abcdefghij"), rels), ("b", "a b", None)], schema)
    out = rel.sliding_windows(df, 4, 2)
    found = {(r.id, r.win): r.relation_list and [x.subj_tok_span.s + r.tok_offset for x in r.relation_list] for r in out.collect()}
    assert found == {("a", 0): [2, 2, 0], ("a", 1): [2, 2], ("a", 2): [6, 7], ("a", 3): [6, 9, 7], ("a", 4): [9], ("b", 0): None}
    assert "_relation_list" in out._jdf.queryExecution().analyzed().toString()
