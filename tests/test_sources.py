import csv
import json

import pytest
from pyspark.sql import functions as F

from corpusprep.operators import annotate as an
from corpusprep.plans import training_sets as jobs
from corpusprep.sources import readers, writers


def _write_csv(path, cell):
    anns = [("red, \"x\"", "colour code", "title", 0.5, 0, 3, 0), ("l", "size", "description", 1, 1, 2, 0)]
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["title", "other", "Category ID", "item_id", "shop_id", "model_id", "description", "extraction_right_value_list_all"])
        w.writerow(["red\nshoe", "-", 7, 1, 2, 3, "d", cell(anns)])


def test_read_annotations(spark, tmp_path):
    for name, cell, kind in (("j.csv", json.dumps, "json"), ("p.csv", repr, "literal")):
        _write_csv(tmp_path / name, cell)
        r = readers.read_annotations(spark, str(tmp_path / name), kind).first()
        assert (r.category_id, r.item_id, r.shop_id, r.model_id, r.title, r.description) == (7, 1, 2, 3, "red\nshoe", "d")
        assert [tuple(a) for a in r.anns] == [("red, \"x\"", "colour code", "title", 0.5, 0, 3, 0), ("l", "size", "description", 1.0, 1, 2, 0)]


def test_read_jsonl_and_kb(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": "a"}\n{"x": 2}\n')
    assert [tuple(r) for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int, y string").orderBy("x").collect()] == [(1, "a"), (2, None)]
    (tmp_path / "kb.json").write_text('{"T": ["x", "y"],\n "U": ["x"]}')
    rows = readers.read_kb(spark, str(tmp_path / "kb.json")).orderBy("pos").collect()
    assert [(r.key, r.value) for r in rows] == [("T", "x"), ("T", "y"), ("U", "x")]


def test_read_documents_stops_at_the_gap(spark, tmp_path):
    for n in (1, 2, 4):
        (tmp_path / f"doc{n:03d}.txt").write_text(f"l{n}\nm{n}\n")
    read = lambda start, mode: readers.read_documents(spark, str(tmp_path), "doc", start, 9, mode)
    assert sorted((r.num, r.line_no, r.line) for r in read(1, "line").collect()) == [(1, 0, "l1"), (1, 1, "m1"), (2, 0, "l2"), (2, 1, "m2")]
    assert sorted(r.num for r in read(1, "document_str").collect()) == [1, 2]
    assert [r.lines for r in read(4, "document_list").collect()] == [["l4", "m4"]]
    assert read(0, "line").count() == 0


def test_listing_and_stats(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.xls", "sub/b.xls", "c.xlsx", "d.XLS"):
        (tmp_path / name).write_text("x")
    assert sorted(r.path.split("/")[-1] for r in readers.scan_files(spark, str(tmp_path)).collect()) == ["a.xls", "b.xls"]
    (tmp_path / "t.txt").write_text("a\nb\n" + "c" * 9000)
    r = readers.file_stats(spark, str(tmp_path / "t.txt")).first()
    assert (r.n_lines, r.n_blocks) == (3, 2)
    (tmp_path / "crlf.txt").write_bytes(b"a\r\n" * 4096)
    r = readers.file_stats(spark, str(tmp_path / "crlf.txt")).first()
    assert (r.n_lines, r.n_blocks) == (4096, 1)


def test_log_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_bytes(b"a\rb\r\nc\n\nd\n")
    rows = readers.read_log_lines(spark, str(tmp_path / "log.txt")).orderBy("line_no").collect()
    assert [r.line for r in rows] == ["a", "b", "c", "", "d"]


def _items(spark):
    rows = [(i, "red shoe", [("red", "colour code", "title", 1.0, 0, 3, 0)]) for i in range(3)]
    return spark.createDataFrame(rows, f"item_id bigint, title string, anns array<{an.ANNOTATION}>")


def test_write_split(spark, tmp_path):
    rows = jobs.build_multi_value_set(_items(spark), test_ratio=0.3)
    writers.write_split(rows.filter(~F.col("is_test")), rows.filter("is_test"), str(tmp_path / "out"))
    bio = spark.read.text(str(tmp_path / "out/train_bio"), lineSep="\n\n").collect()
    assert [r.value for r in bio] == ["red B-colour##code\nshoe O"] * 2
    counts = {r.attr_type: r["count"] for r in spark.read.json(str(tmp_path / "out/test_attr_count")).collect()}
    assert counts == {"colour code": 1, "test_amount": 1}
    assert spark.read.json(str(tmp_path / "out/tag_names")).first().tag == "colour##code"
    assert spark.read.text(str(tmp_path / "out/num_overlap")).first().value == "0#0"
    assert spark.read.parquet(str(tmp_path / "out/train")).count() == 2


def test_write_split_leaves_all_or_none(spark, tmp_path):
    rows = jobs.build_multi_value_set(_items(spark), test_ratio=0.3)
    train, test, out = rows.filter(~F.col("is_test")), rows.filter("is_test"), str(tmp_path / "out")
    writers.write_split(train, test, out)
    kept = sorted(p.name for p in (tmp_path / "out").iterdir())
    broken = test.withColumn("title", F.when(F.col("item_id") >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        writers.write_split(train.limit(0), broken, out)
    assert spark.read.parquet(f"{out}/train").count() == 2 and sorted(p.name for p in (tmp_path / "out").iterdir()) == kept
    writers.write_split(train.limit(0), test, out, tagged=False)
    assert spark.read.parquet(f"{out}/train").count() == 0 and not (tmp_path / "out/train_bio").exists()
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_single_value_set_keeps_untagged_rows(spark):
    df = _items(spark).withColumn("title", F.when(F.col("item_id") == 0, "").otherwise(F.upper("title")))
    out = jobs.build_single_value_set(df).orderBy("item_id").collect()
    assert [r.tags and [t.word for t in r.tags] for r in out] == [None, ["red", "shoe"], ["red", "shoe"]]


def test_concat_append_publish_json(spark, tmp_path):
    a, b = spark.createDataFrame([("a",)], "value string"), spark.createDataFrame([("b",)], "value string")
    assert [tuple(r) for r in writers.concat_sources(a, b).orderBy("src").collect()] == [(0, "a"), (1, "b")]
    target = str(tmp_path / "lines")
    writers.overwrite(b, target, "text")
    writers.overwrite(a, target, "text")
    writers.append_source(b, target)
    assert sorted(r.value for r in spark.read.text(target).collect()) == ["a", "b"]
    writers.publish(a, str(tmp_path / "pub"))
    assert writers.verify_publish(a, str(tmp_path / "pub"))
    assert not writers.verify_publish(a.unionByName(b), str(tmp_path / "pub"))
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None)], "id int, v string")
    pub = str(tmp_path / "rows")
    writers.publish(rows, pub)
    assert writers.verify_publish(rows.repartition(3).select("v", "id"), pub)
    traded = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, None)], "id int, v string")
    changed = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "null")], "id int, v string")
    assert not writers.verify_publish(traded, pub) and not writers.verify_publish(changed, pub)
    for part in sorted((tmp_path / "rows").glob("part-*"))[:1]:
        part.unlink()
    assert not writers.verify_publish(rows, pub)
    writers.publish(rows, pub)
    for part in (tmp_path / "rows.manifest").glob("part-*"):
        part.unlink()
    assert not writers.verify_publish(rows, pub)
    writers.write_json_array(spark.range(3), str(tmp_path / "arr"), "id")
    assert json.loads(spark.read.text(str(tmp_path / "arr")).first().value) == [{"id": 0}, {"id": 1}, {"id": 2}]
