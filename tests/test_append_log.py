"""Appends that are whole or not there, and are made once."""

import pytest
from pyspark.sql import functions as F

from reviewloom.sources.append_log import AppendLog, append_batches
from reviewloom.sources.readers import list_names
from reviewloom.streaming.sources import file_stream, run_batches

SCHEMA = "id BIGINT, version STRING"


@pytest.fixture
def log(spark, tmp_path):
    return AppendLog(spark, f"file://{tmp_path}/table")


def _rows(spark, start, end):
    return spark.range(start, end).withColumn("version", F.lit(None).cast("string"))


def _ids(table):
    return sorted(r["id"] for r in table.collect())


def test_versions_and_repeated_batches(spark, log):
    assert _ids(log.read(SCHEMA)) == []
    assert log.append(_rows(spark, 0, 5), "a") == 1
    assert log.append(_rows(spark, 5, 9), "b") == 2
    assert log.append(_rows(spark, 50, 60), "a") == 1  # known, not written
    assert log.append(_rows(spark, 0, 0), "empty") == 3
    assert log.append(_rows(spark, 9, 10)) == 4
    assert _ids(log.read(SCHEMA)) == list(range(10))
    assert _ids(log.read(SCHEMA, until=1)) == list(range(5))
    assert [e["batch"] for e in log.entries()][:3] == ["a", "b", "empty"]
    assert log.remove_leftovers() == 0


def test_failed_write_is_not_seen(spark, log):
    log.append(_rows(spark, 0, 5), "a")
    bad = _rows(spark, 5, 2000).repartition(8).withColumn(
        "id", F.when(F.col("id") == 1999, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id"))
    )
    with pytest.raises(Exception, match="lost"):
        log.append(bad, "b")
    assert _ids(log.read(SCHEMA)) == list(range(5))
    assert log.append(_rows(spark, 5, 7), "b") == 2
    assert _ids(log.read(SCHEMA)) == list(range(7))
    log.remove_leftovers()
    assert len(list_names(spark, f"{log.path}/data")) == 2
    assert _ids(log.read(SCHEMA)) == list(range(7))


def test_killed_between_rows_and_entry(spark, log, monkeypatch):
    log.append(_rows(spark, 0, 5), "a")

    def die(entry):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(log, "_enter", die)
        with pytest.raises(KeyboardInterrupt):
            log.append(_rows(spark, 5, 9), "b")
    assert _ids(log.read(SCHEMA)) == list(range(5))
    assert log.append(_rows(spark, 5, 9), "b") == 2
    assert _ids(log.read(SCHEMA)) == list(range(9))
    assert log.remove_leftovers() == 1


def test_a_taken_version_is_not_replaced(spark, log, monkeypatch):
    """Another writer takes the number between the look at the log and the rename."""
    log.append(_rows(spark, 0, 5), "a")
    last, calls = log._last, []

    def stale():
        calls.append(1)
        return 0 if len(calls) == 2 else last()  # first the batch is looked up

    monkeypatch.setattr(log, "_last", stale)
    assert log.append(_rows(spark, 5, 9), "b") == 2
    assert _ids(log.read(SCHEMA)) == list(range(9))
    assert [e["batch"] for e in log.entries()] == ["a", "b"]


def test_two_runs_of_a_batch_at_once(spark, log, monkeypatch):
    """The slower of two runs of one batch finds the other's entry and removes its own rows."""
    other = AppendLog(spark, log.path)
    enter = log._enter

    def late(entry):
        other.append(_rows(spark, 0, 5), "a")
        return enter(entry)

    monkeypatch.setattr(log, "_enter", late)
    assert log.append(_rows(spark, 0, 5), "a") == 1
    assert _ids(log.read(SCHEMA)) == list(range(5))
    assert len(list_names(spark, f"{log.path}/data")) == 1


def test_batches_of_a_stream_that_run_again(spark, log, tmp_path):
    source = f"{tmp_path}/source"
    _rows(spark, 0, 40).repartition(4).write.parquet(source)
    step = append_batches(log, "ids")

    def again(batch, number):
        step(batch, number)
        step(batch, number)

    run_batches(file_stream(spark, source, SCHEMA, max_files=1), again)
    assert _ids(log.read(SCHEMA)) == list(range(40))
    assert len(log.entries()) == 4
