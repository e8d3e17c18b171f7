import gzip
import json

import pytest
from helpers import REVIEW_DDL, make_reviews, py_id
from pyspark.sql import functions as F

from reviewloom.runtime import release_scratch, scratch_path, shared_folder, stored_table
from reviewloom.sources import readers, writers

LINES = [
    '{"text":"a","rating":4.0,"title":"t","asin":"A","product_category":"C"}',
    "",
    "   ",
    "{bad",
    "[1]",
    '"s"',
    "17",
    '{"text":"c","rating":"4"}',
    '  {"text":"d","rating":null,"title":null}  ',
    '{"text":"e","rating":"x","extra":{"deep":1}}',
    '{"text":"é\\u00e9 😀","asin":5}',
]


def test_jsonl_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(LINES), encoding="utf-8")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt", encoding="utf-8") as out:
        out.write("\n".join(LINES))
    (tmp_path / "c.jsonl").write_bytes(b'{"text":"bad \xff utf"}\n')
    one = readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r.text, r.rating) for r in one] == [
        ("a", 4.0), ("c", 4.0), ("d", None), ("e", None), ("éé 😀", None)]
    assert one[0].product_category == "C" and one[4].asin == "5"
    assert readers.read_jsonl(spark, str(tmp_path / "b.jsonl.gz")).count() == 5
    assert readers.read_jsonl(spark, str(tmp_path / "c.jsonl")).count() == 1


def test_strict_jsonl_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"a"}\n{bad\n', encoding="utf-8")
    with pytest.raises(Exception):
        readers.read_jsonl_strict(spark, str(tmp_path / "a.jsonl"), "text STRING").collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text(LINES[0] + "\n", encoding="utf-8")
    (tmp_path / "MANIFEST.json").write_text(
        json.dumps({"files": ["one.jsonl", "gone.jsonl", str(tmp_path / "one.jsonl")]}, indent=2))
    rows, missing = readers.read_shards(spark, str(tmp_path / "MANIFEST.json"))
    assert rows.count() == 2
    assert [r.path for r in missing.collect()] == [str(tmp_path / "gone.jsonl")]
    with pytest.raises(FileNotFoundError):
        readers.read_shards(spark, str(tmp_path / "absent.json"))


def test_parquet_and_glob(spark, tmp_path):
    frame = spark.createDataFrame([("a", 5.0, 1)], "text STRING, rating DOUBLE, extra INT")
    frame.write.parquet(str(tmp_path / "dev-1.parquet"))
    frame.select("text").write.parquet(str(tmp_path / "dev-2.parquet"))
    frame.write.parquet(str(tmp_path / "other.parquet"))
    one = readers.read_reviews_parquet(spark, str(tmp_path / "dev-1.parquet"))
    assert [tuple(r) for r in one.collect()] == [("a", 5.0, "", "", "", 2)]
    both = readers.read_reviews_glob(spark, str(tmp_path), "dev-*.parquet")
    assert sorted(r.rating for r in both.collect()) == [0.0, 5.0]
    with pytest.raises(FileNotFoundError):
        readers.read_reviews_glob(spark, str(tmp_path), "none-*.parquet")
    with pytest.raises(FileNotFoundError):
        readers.read_reviews_parquet(spark, str(tmp_path / "absent.parquet"))
    with pytest.raises(ValueError):
        readers.read_reviews_parquet(spark, "")


def test_csv_round_trip(spark, tmp_path):
    texts = ['quote " and, comma', "two\nlines", " padded ", "", "crlf\r\nend", "back\\slash", "'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n INT, text STRING")
    writers.write_csv(df.repartition(2), str(tmp_path / "t"))
    back = readers.read_text_csv(spark, str(tmp_path / "t"))
    assert {int(r.n): r.text for r in back.collect()} == dict(enumerate(texts))
    writers.write_csv(df.select("n"), str(tmp_path / "u"))
    with pytest.raises(ValueError, match="text"):
        readers.read_text_csv(spark, str(tmp_path / "u"))


def test_inline_rows(spark):
    rows = [{"text": "a", "rating": 5}, {"text": "b", "rating": "1", "label": 2}, {"asin": "Z"}]
    out = readers.reviews_from_rows(spark, rows, with_label=True).orderBy("seq").collect()
    assert [(r.seq, r.text, r.rating, r.asin, r.label) for r in out] == [
        (0, "a", 5.0, "", 2), (1, "b", 1.0, "", 2), (2, "", 0.0, "Z", 0)]
    assert readers.reviews_from_rows(spark, []).count() == 0


def test_id_sets(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\n y \nx\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("z\n", encoding="utf-8")
    paths = [str(tmp_path / n) for n in ("a.txt", "b.txt", "gone.txt")]
    assert sorted(r.id for r in readers.read_id_set(spark, paths).collect()) == ["x", "y", "z"]
    assert readers.read_id_set(spark, [paths[2], ""]).count() == 0
    more = spark.createDataFrame([("w",)], "id STRING")
    assert readers.load_blocklist(spark, paths, [more]).count() == 4
    seen = str(tmp_path / "seen")
    writers.append_ids(more, seen)
    writers.append_ids(more, seen)
    assert readers.read_id_set(spark, [seen]).count() == 1
    writers.write_blocklist(readers.read_id_set(spark, paths), str(tmp_path / "block"))
    assert [r.value for r in spark.read.text(str(tmp_path / "block")).collect()] == ["x", "y", "z"]


def test_mixed_lines(spark, tmp_path):
    lines = ['{"text":"one"}', "plain text", '{"other":1}', "[1, 2]", "", '{"text":""}', "{broken"]
    (tmp_path / "m.txt").write_text("\n".join(lines), encoding="utf-8")
    got = [r.text for r in readers.read_text_lines_mixed(spark, str(tmp_path / "m.txt")).collect()]
    assert got == ["one", "plain text", "{broken"]


def test_requests(spark):
    bodies = [(1, '{"text":"a"}'), (2, '{"texts":["b","c"]}'), (3, "{}"), (4, "bad"), (5, '{"texts":[]}')]
    df = spark.createDataFrame(bodies, "n INT, body STRING")
    got = readers.unnest_requests(df).collect()
    assert [(r.n, r.position, r.text) for r in got] == [(1, 0, "a"), (2, 0, "b"), (2, 1, "c")]


def test_jsonl_sink_keeps_nulls_and_unicode(spark, tmp_path):
    df = spark.createDataFrame([("é😀", None)], "text STRING, title STRING")
    writers.write_jsonl(df, str(tmp_path / "j"))
    line = spark.read.text(str(tmp_path / "j")).first().value
    assert line == '{"text":"é😀","title":null}'


def test_snapshot_shards(spark, tmp_path):
    rows = make_reviews(400)
    df = spark.createDataFrame(rows, REVIEW_DDL).repartition(4)
    manifest = writers.write_snapshot(df, str(tmp_path), 70, shard_size=16).collect()
    sizes = {}
    for r in manifest:
        sizes.setdefault(r.product_category, []).append(r["rows"])
    counts = {c: sum(r[5] == c for r in rows) for c in ("Books", "Toys", "Pets")}
    for category, n in counts.items():
        n = min(n, 70)
        want = [16] * (n // 16) + ([n % 16] if n % 16 else [])
        assert sorted(sizes[category], reverse=True) == want
    found, missing = readers.read_manifest(spark, str(tmp_path / "MANIFEST.json"))
    assert not missing and len(found) == len(manifest)
    content = json.loads((tmp_path / "MANIFEST.json").read_text())
    assert content["total"] == sum(min(n, 70) for n in counts.values())
    back = readers.read_jsonl(spark, found)
    want = {}
    for r in sorted(rows):
        want.setdefault(r[5], []).append(r)
    for category, group in want.items():
        got = sorted(r.text for r in back.filter(F.col("product_category") == category).collect())
        assert got == sorted(r[1] for r in group[:70])


def test_snapshot_of_unusual_categories(spark, tmp_path):
    names = ["A/B & C", "50% off+more", "", "plain"]
    rows = [(i, f"text {i}", 3.0, "", "A", names[i % 4]) for i in range(20)]
    folder = tmp_path / "with blank"
    manifest = writers.write_snapshot(spark.createDataFrame(rows, REVIEW_DDL), str(folder), 4)
    assert {r.product_category: r["rows"] for r in manifest.collect()} == dict.fromkeys(names, 4)
    found, missing = readers.read_manifest(spark, str(folder / "MANIFEST.json"))
    assert len(found) == 4 and not missing
    back = readers.read_jsonl(spark, found).groupBy("product_category").count().collect()
    assert {r.product_category: r["count"] for r in back} == dict.fromkeys(names, 4)


def test_line_numbers_over_file_splits(spark, tmp_path, settings):
    settings(spark__sql__files__maxPartitionBytes="2048", spark__sql__files__openCostInBytes="1")
    for name, n in (("a.txt", 700), ("b.txt", 30)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(n)))
    got = writers.numbered_lines(spark, str(tmp_path)).collect()
    assert len(got) == 730
    for r in got:
        assert r.value == f"{r.file.rsplit('/', 1)[1]} line {r.line}"


def test_pool_ids(spark, tmp_path):
    for name, n in (("s0.json.gz", 5), ("s1.json.gz", 3)):
        with gzip.open(tmp_path / name, "wt", encoding="utf-8") as out:
            for i in range(n):
                out.write(json.dumps({"text": f"{name} {i}", "rating": 3, "asin": None}) + "\n")
    pool = {r.id: r for r in writers.pool_rows(spark, str(tmp_path)).collect()}
    assert set(pool) == {f"s0.json.gz:{i}" for i in range(5)} | {f"s1.json.gz:{i}" for i in range(3)}
    assert pool["s1.json.gz:2"].text == "s1.json.gz 2" and pool["s1.json.gz:2"].asin == ""
    assert "rating" not in writers.pool_rows(spark, str(tmp_path)).columns
    limited = {r.id for r in writers.pool_rows(spark, str(tmp_path), limit_per_file=2).collect()}
    assert limited == {f"s{f}.json.gz:{i}" for f in (0, 1) for i in (0, 1)}
    with gzip.open(tmp_path / "s2.json.gz", "wt") as out:
        out.write("{bad\n")
    with pytest.raises(Exception):
        writers.pool_rows(spark, str(tmp_path)).collect()


def test_scored_todo_and_category_tables(spark, tmp_path):
    df = spark.createDataFrame([("i", "t", 0.1, 0.2, 0.7)],
                               "id STRING, text STRING, p_neg DOUBLE, p_neu DOUBLE, p_pos DOUBLE")
    writers.write_parquet(df, str(tmp_path / "s"))
    assert readers.read_scored(spark, str(tmp_path / "s")).first().probs == [0.1, 0.2, 0.7]
    todo = spark.createDataFrame([("i", "a,b", "", "A", "C", "neg")],
                                 "id STRING, text STRING, title STRING, asin STRING,"
                                 " product_category STRING, label STRING")
    writers.write_csv(todo, str(tmp_path / "todo"))
    assert readers.read_todo_csv(spark, str(tmp_path / "todo")).first().text == "a,b"
    for category in ("X", "Y"):
        writers.write_jsonl(df.select("text"), str(tmp_path / category))
    both = readers.read_category_tables(
        spark, {c: str(tmp_path / c) for c in ("X", "Y")}, "text STRING")
    assert {r.product_category for r in both.collect()} == {"X", "Y"}


def test_blocklist_ids(spark):
    df = spark.createDataFrame(make_reviews(50), REVIEW_DDL)
    want = {py_id(r[1], r[4]) for r in make_reviews(50)}
    assert {r.id for r in writers.blocklist_ids(df, df).collect()} == want


def test_runtime_helpers(spark, plan_of):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(shared_folder(spark).rstrip("/"))
    small = stored_table(spark.range(10).toDF("k"))
    big = stored_table(spark.range(1000).toDF("k"))
    assert "BroadcastHashJoin" in plan_of(big.join(small, "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(big.join(small, "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scratch_is_released(spark, monkeypatch):
    monkeypatch.setattr("reviewloom.runtime._scratch", set())
    table = stored_table(spark.range(10))
    file = table.inputFiles()[0]
    assert table.count() == 10 and readers.path_exists(spark, file)
    release_scratch(spark)
    assert not readers.path_exists(spark, file)
