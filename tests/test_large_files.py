"""Files read in splits against the same files read whole."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from corpusprep.operators.logs import split_lines
from corpusprep.sources import lines, readers


@pytest.fixture
def splits(spark):
    """Sets the size of the splits, put back afterwards."""
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


CONTENTS = [b"", b"a", b"a\n", b"\n", b"\r", b"a\r", b"a\r\n", b"\r\n\r\n", b"a\rb\r\nc\n\nd\n", b"x\n\r\ny\r\r\nz", "é\r\n漢字\n\r".encode()]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 20])
def test_lines_and_totals_of_files_cut_everywhere(spark, tmp_path, splits, size):
    for i, content in enumerate(CONTENTS):
        (tmp_path / f"f{i:02d}.log").write_bytes(content)
    splits(size)
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_name").alias("f"), split_lines(F.col("value")).alias("l"), F.regexp_replace("value", "\r\n?", "\n").alias("t"))
    want = {r.f: (r.l, len(r.t)) for r in whole.collect()}
    got = lines.numbered_lines(spark, str(tmp_path))
    found = {}
    for r in got.orderBy("path", "line_no").collect():
        held = found.setdefault(r.path[-7:], [])
        assert r.line_no == len(held)
        held.append(r.line)
    assert found == {f: held for f, (held, _) in want.items() if held}
    totals = {r.path[-7:]: (r.n_lines, r.n_chars) for r in lines.line_totals(spark, str(tmp_path)).collect()}
    assert totals == {f: (len(held), n) for f, (held, n) in want.items() if n}


def _random_csv(rng, rows, line_end):
    cells = ["", "a", "x,y", 'say "hi"', "two\nlines", "a\r\nb", '"', '","', "\n", "é\n\n漢", '5" disk', "end,\n"]
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=line_end)
    w.writerow(["id", "one", "two"])
    for i in range(rows):
        w.writerow([i, rng.choice(cells), rng.choice(cells)])
    return out.getvalue().encode()


@pytest.mark.parametrize("size", [40, 150, 1 << 20])
def test_quoted_csv_equals_one_task(spark, tmp_path, splits, size):
    rng = random.Random(size)
    (tmp_path / "a.csv").write_bytes(_random_csv(rng, 60, "\n"))
    (tmp_path / "b.csv").write_bytes(_random_csv(rng, 30, "\r\n"))
    splits(size)
    read = lambda p: sorted((r.id, r.one, r.two) for r in lines.read_csv(spark, p).collect())
    for name in ("a.csv", "b.csv"):
        whole = spark.read.csv(str(tmp_path / name), header=True, multiLine=True, escape='"')
        # Whether CR LF in a cell stays there depends on the first line end that reader meets.
        lf = lambda v: v and v.replace("\r\n", "\n")
        assert read(str(tmp_path / name)) == sorted((r.id, lf(r.one), lf(r.two)) for r in whole.collect())


def test_quotes_in_unquoted_cells_open_nothing(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,v,w\n1,5" disk,x\n2,"a\nb",y\n3,z"",w\n4,c,"d ""e"",\nf"\n')
    got = sorted(tuple(r) for r in lines.read_csv(spark, str(tmp_path / "q.csv")).collect())
    assert got == [("1", '5" disk', "x"), ("2", "a\nb", "y"), ("3", 'z""', "w"), ("4", "c", 'd "e",\nf')]


def test_csv_files_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"2\n3"\n')
    (tmp_path / "b.csv").write_text("y,z,x\n4,5,6\n\n")
    got = sorted((r.x, r.y, r.z) for r in lines.read_csv(spark, str(tmp_path)).collect())
    assert got == [("1", "2\n3", None), ("6", "4", "5")]


def test_a_log_is_read_by_many_tasks(spark, tmp_path, splits):
    (tmp_path / "big.log").write_text("".join(f"line {i}\r\n" if i % 3 else f"line {i}\r" for i in range(20_000)))
    splits(10_000)
    got = readers.read_log_lines(spark, str(tmp_path / "big.log"))
    assert spark.read.text(str(tmp_path / "big.log")).rdd.getNumPartitions() > 10
    assert got.filter(F.col("line") != F.concat(F.lit("line "), F.col("line_no"))).count() == 0
    assert got.count() == 20_000
