"""Every registered query against its SQL twin, on the smallest test tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import __spark_entry__ as spark_entry  # noqa: E402
from check_queries import TABLES, compare  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(spark_entry.queries()))
def test_query(spark, con, name):
    status, note, _ = compare(spark, con, name, SF_DIR)
    assert status in ("ok", "rows"), note


@pytest.mark.parametrize("name", [
    "balanced_train", "split_dev_eval", "sample_stratified", "head_rows", "sample_uniform",
    "cap_per_category", "topk_uncertain", "topk_per_class", "select_margin", "select_uncertain",
    "select_uncertain_capped", "drop_blocked", "merge_labels", "stream_topk", "stream_sample"])
def test_query_planned_for_large_tables(spark, con, name, settings):
    """Without automatic broadcasts the rows are the same."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1",
             spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    status, note, _ = compare(spark, con, name, SF_DIR)
    assert status == "ok", note


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
