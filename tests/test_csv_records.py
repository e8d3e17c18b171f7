import csv
import io
import random

import pytest

from reviewloom.sources import readers, writers
from reviewloom.sources.csv_records import csv_records, read_csv_records


def write(path, rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode())


def made_rows(n, seed=1):
    rng = random.Random(seed)
    parts = ["plain", 'say "hi"', "two\nlines", "\n\n", "a,b", "é中", '"', "\r\nx", " ", "long " * 30]
    return [(str(i), "".join(rng.choices(parts, k=rng.randrange(1, 5)))) for i in range(n)]


@pytest.fixture
def small_splits(settings):
    settings(
        spark__sql__files__maxPartitionBytes="4096", spark__sql__files__openCostInBytes="1024"
    )


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_of_many_splits(spark, tmp_path, small_splits, end):
    rows = made_rows(1500)
    write(tmp_path / "a.csv", [("n", "text"), *rows], end)
    records = csv_records(spark, str(tmp_path / "a.csv"))
    assert records.select("block").distinct().count() >= 20
    back = read_csv_records(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((int(r.n), r.text) for r in back) == [(int(n), text) for n, text in rows]


def test_a_field_longer_than_several_splits(spark, tmp_path, small_splits):
    rows = [("0", "a"), ("1", "line\n" * 6000), ("2", 'b "c"\n'), ("3", "d" * 20_000), ("4", "e")]
    write(tmp_path / "a.csv", [("n", "text"), *rows])
    back = read_csv_records(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((r.n, r.text) for r in back) == rows


def test_numbers_follow_files_and_lines(spark, tmp_path, small_splits):
    rows = [made_rows(400, seed) for seed in range(3)]
    for i, part in enumerate(rows):
        write(tmp_path / f"part{i}.csv", [("n", "text"), *part])
    write(tmp_path / "part3.csv", [("n", "text")])
    texts = [text for part in rows for _, text in part]
    got = readers.numbered_text_csv(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r.row, r.text) for r in got] == list(enumerate(texts))


def test_blank_lines_missing_and_surplus_fields_as_in_the_plain_reader(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('n,text\n\n1,a\n\n2\n3,b,surplus\n4,""\n5,"open\nto the end\n')
    plain = spark.read.csv(str(path), header=True, multiLine=True, escape='"')
    got = sorted((r.n, r.text) for r in read_csv_records(spark, str(path)).collect())
    want = sorted((r.n, r.text) for r in plain.collect())
    assert [(n, (t or "").rstrip("\n")) for n, t in got] == [(n, (t or "").rstrip("\n")) for n, t in want]


def test_typed_rows_and_no_rows(spark, tmp_path):
    write(tmp_path / "a.csv", [("n", "text"), ("7", "x\ny"), ("8", "")])
    rows = read_csv_records(spark, str(tmp_path / "a.csv"), "n INT, text STRING").collect()
    assert [(r.n, r.text) for r in rows] == [(7, "x\ny"), (8, None)]
    write(tmp_path / "b.csv", [("n", "text")])
    assert read_csv_records(spark, str(tmp_path / "b.csv")).columns == ["n", "text"]
    assert read_csv_records(spark, str(tmp_path / "b.csv")).count() == 0


def test_what_the_writer_writes(spark, tmp_path, small_splits):
    rows = [(int(n), text) for n, text in made_rows(600, 5)]
    writers.write_csv(spark.createDataFrame(rows, "n INT, text STRING"), str(tmp_path / "t"))
    back = readers.read_text_csv(spark, str(tmp_path / "t")).collect()
    assert sorted((int(r.n), r.text) for r in back) == rows
