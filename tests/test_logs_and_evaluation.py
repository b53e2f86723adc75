import re

import pytest

from corpusprep.functions import patterns as P
from corpusprep.operators import evaluate, knowledge, logs


def log(spark, *lines, path="p"):
    return spark.createDataFrame([(path, i, x) for i, x in enumerate(lines)], "path string, line_no bigint, line string")


def test_sections(spark):
    df = log(spark, "x", P.RESULTS_MARKER, "a", P.RESULTS_MARKER, "Total epoch3:", "y", "Total epoch9:", P.RESULTS_MARKER, "b")
    got = logs.slice_sections(df).orderBy("line_no").collect()
    assert [(r.section, r.line, r.epoch) for r in got] == [(1, "a", 2), (1, P.RESULTS_MARKER, 2), (2, "b", None)]


def test_line_with_marker_and_end_switches(spark):
    both = P.RESULTS_MARKER + " Total epoch4:"
    df = log(spark, both, "a", both, "b", both, P.RESULTS_MARKER, "c", "Total epoch6:", "d", P.RESULTS_MARKER, "e", both, "f", both, "g")
    got = logs.slice_sections(df).orderBy("line_no").collect()
    assert [(r.section, r.line, r.epoch) for r in got] == [
        (1, "a", 3), (2, P.RESULTS_MARKER, 5), (2, "c", 5), (3, "e", 3), (4, "g", None)
    ]


def test_block_pick(spark):
    lines = [x for v in range(1, 7) for x in ["-"] * 5 + [f"12 3.x (0.{v}, 7)"]]
    got = logs.block_pick(log(spark, *lines)).orderBy("pos").collect()
    assert [r.value for r in got] == ["0.5", "0.6", "0.4", "0.2", "0.3"]


def test_third_decimal(spark):
    got = logs.third_decimal(log(spark, "1.1 2.2 3.3", "x", "1.0 2.0 3.5 4.0", "1.0 2")).orderBy("line_no").collect()
    assert [r.value for r in got] == ["3.5", None]


def test_run_blocks(spark):
    df = log(spark, "start", "test_triples", "0.1", "a 0.25 0.3", "test_triples", "q", "0.5", "start", "test_triples", "-", "0.75")
    got = logs.run_blocks(df, "start").orderBy("run", "idx").collect()
    assert [(r.run, r.idx, r.value) for r in got] == [(1, 0, "0.25"), (1, 1, "0.5"), (2, 0, "0.75")]
    assert [r.run for r in logs.run_blocks(df, "start", drop_last=True).collect()] == [1, 1]


def test_align_runs_cuts_one_behind(spark):
    line = "t_ent_sample_acc: 0.{0}, t_head_rel_sample_acc: 0.{0}, t_tail_rel_sample_acc: 1"
    a, b = log(spark, line.format(1), "noise", line.format(2)), log(spark, *[line.format(i) for i in range(3, 8)])
    got = logs.align_runs(a, b).orderBy("rn").collect()
    assert [(r.rn, r.ent_a, r.ent_b) for r in got] == [(1, 0.1, 0.3), (2, 0.2, 0.4), (3, None, 0.5)]


def acc(who, x):
    return f"{{'{who}val_ent_seq_acc': {x}, '{who}val_head_rel_acc': 1, '{who}val_tail_rel_acc': 2, 'z': 0}}"


def test_pairs(spark):
    pseudo = "generate pseudo label,Z_RATIO: {}, NUMBER: 4 "
    df = log(
        spark, pseudo.format(9), acc("student ", 0.1), pseudo.format(1), acc("", 0.2), "noise", pseudo.format(2),
        acc("student ", 0.3), pseudo.format(3), acc("", 0.4), acc("", 0.5), pseudo.format(4), acc("", 0.6),
    )
    pairs, errors = logs.pair_metrics(df)
    assert [(r.kind, r["all"], r.score) for r in pairs.orderBy("grp").collect()] == [("teacher", 3.2, 2.0), ("student", 3.3, 3.0)]
    assert [(r.grp, r.n_acc) for r in errors.collect()] == [(4, 2)]


def test_series_equals_python(spark):
    text = "x f1 = 0.5\n f1 = 1 2\n\nf1 = 3\n f1 =4\n\t f1 = 5"
    df = spark.createDataFrame([("p", text)], "path string, text string")
    got = [(r.i, r.value) for r in logs.extract_series(df).orderBy("i").collect()]
    assert got == list(enumerate(re.findall(r"\sf1\s=([\s\d\.]+)\n", text)))
    assert len(got) == 3


def test_pairwise_max(spark):
    rows = [(e, c, float(10 * e + (c * 7) % 5)) for e in (1, 2, 3) for c in range(6)]
    got = {(r.epoch, r.col): r.value for r in logs.pairwise_max(spark.createDataFrame(rows, "epoch int, col int, value double")).collect()}
    cell = {(e, c): v for e, c, v in rows}
    assert got == {(e, c): max(cell[e, c], cell[e, c + 1]) for e in (2, 3) for c in range(3)}


def test_pairwise_max_labels_epochs_by_position(spark):
    rows = [("p", e, c, float(10 * e + c)) for e in (1, 3, 5) for c in range(4)] + [(None, 7, 0, 1.0), (None, 9, 1, 2.0)]
    got = logs.pairwise_max(spark.createDataFrame(rows, "path string, epoch int, col int, value double"), ["path"]).collect()
    assert {(r.path, r.epoch, r.col): r.value for r in got} == {
        ("p", 2, 0): 31.0, ("p", 2, 1): 32.0, ("p", 3, 0): 51.0, ("p", 3, 1): 52.0, (None, 2, 0): 2.0
    }


TRIPLE = "sample_id int, subject string, predicate string, object string, subj_tok_span struct<s:int,e:int>, obj_tok_span struct<s:int,e:int>"


def test_match_triples(spark):
    gold = [(1, "new york", "in", "us a", (0, 2), (3, 5)), (1, "new york", "in", "us a", (0, 2), (3, 5)), (2, "a", "r", "b", (0, 1), (1, 2))]
    pred = [(1, "new town", "in", "us b", (0, 1), (3, 5)), (3, "a", "r", "b", (0, 1), (1, 2))]
    g, p = spark.createDataFrame(gold, TRIPLE), spark.createDataFrame(pred, TRIPLE)
    counts = {k: tuple(evaluate.match_triples(g, p, k).first()) for k in ("only_head_index", "whole_span", "whole_text", "only_head_text")}
    assert counts == {"only_head_index": (1, 2, 2), "whole_span": (0, 2, 2), "whole_text": (0, 2, 2), "only_head_text": (1, 2, 2)}
    with pytest.raises(ValueError):
        evaluate.match_triples(g, p, "other")


def test_prf(spark):
    df = spark.createDataFrame([(0, 0, 5)], "correct_num bigint, pred_num bigint, gold_num bigint")
    assert tuple(evaluate.prf(df, "percent").first())[3:] == (0.0, 0.0, 0.0)
    p, r, f = tuple(evaluate.prf(spark.createDataFrame([(1, 2, 4)], df.schema)).first())[3:]
    assert (round(p, 6), round(r, 6), round(f, 6)) == (0.5, 0.25, 0.333333)


def test_sample_accuracy(spark):
    ddl = "sample_id int, pos int, tag int"
    gold = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 5), (3, 0, 1)], ddl)
    pred = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 4)], ddl)
    assert round(evaluate.sample_accuracy(pred, gold).first()[0], 6) == 0.333333


def test_best_so_far(spark):
    df = spark.createDataFrame([("r", e, v) for e, v in enumerate([0.5, 0.5, 0.7, 0.6])], "run string, epoch int, f1 double")
    got = evaluate.best_so_far(df, "f1").orderBy("epoch").collect()
    assert [(r.best_before, r.improved) for r in got] == [(None, True), (0.5, False), (0.5, True), (0.7, False)]


def test_kb(spark):
    kb = spark.createDataFrame([("T", 0, "x"), ("T", 1, "y"), ("T", 2, "x"), ("U", 3, "x")], "key string, pos bigint, value string")
    lists = lambda **kw: {(r.name, r.page): r.entries for r in knowledge.invert_kb(kb, **kw).collect()}
    assert lists() == {("T", 0): ["x", "y", "x"], ("U", 0): ["x"]}
    assert lists(reverse=True) == {("x", 0): ["T", "T", "U"], ("y", 0): ["T"]}
    assert lists(page=2) == {("T", 0): ["x", "y"], ("T", 1): ["x"], ("U", 0): ["x"]}
