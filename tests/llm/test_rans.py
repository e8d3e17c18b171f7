import zlib

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from reviewloom.llm import rans

DOCS = "doc_id BIGINT, text STRING, ids STRING"


def table_of(ids):
    found, counts = np.unique(ids, return_counts=True)
    return rans.Table(found, rans.scaled(found, counts))


@pytest.mark.parametrize("n", [1, 5, 255, 256, 257, 65_536, 65_537, 200_000])
def test_block_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 40_000
    payload = rans.encode_block(ids, table_of(ids))
    assert (rans.decode_block(payload, table_of(ids)) == ids).all()


def test_one_symbol_and_other_shapes():
    same = np.full(10_000, 7)
    assert (rans.decode_block(rans.encode_block(same, table_of(same)), table_of(same)) == same).all()
    ids = np.random.default_rng(0).integers(0, 50_000, 9_999)
    payload = rans.encode_block(ids, table_of(ids), lanes=3, every=4)
    assert (rans.decode_block(payload, table_of(ids)) == ids).all()


def test_skewed_ids_take_less_room():
    ids = np.random.default_rng(1).zipf(1.5, 300_000) % 1000
    found, counts = np.unique(ids, return_counts=True)
    p = counts / counts.sum()
    bits = 8 * len(rans.encode_block(ids, table_of(ids)))
    assert bits < 1.05 * len(ids) * -(p * np.log2(p)).sum() + 8 * 20_000


def test_frequencies_add_up():
    for counts in ([1], [1, 10**15], list(range(1, 5000))):
        f = rans.scaled(np.arange(len(counts)), np.array(counts))
        assert f.sum() == 1 << rans.SCALE_BITS and f.min() >= 1


def expected(rows, tokenizer, end):
    from reviewloom.llm.tokens import encoder

    encode, start, out = encoder(tokenizer).tokenizer, 0, []
    coded = [(d, encode.encode(t or "", add_special_tokens=False).ids + [end]) for d, t, _ in rows]
    for doc_id, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes())):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, path):
    return [
        (r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids)))
        for r in rans.read_archive(spark, path).orderBy("start").collect()
    ]


ROWS = [(2**60 + 1, "large id", "x"), (5, "The cat sat.", "x"), (3, None, "x"), (4, "", "x"),
        (None, "no id here", "x"), (5, "The cat sat.", "x"), (5, "Another text", "y"),
        (9, "word " * 70_000, "x"), (-1, "café \U0001f600", None)]


def test_archive_of_odd_rows(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_IDS", 16)
    rans.write_archive(spark.createDataFrame(ROWS, DOCS).repartition(3), str(tmp_path / "a"), tokenizer, 1)
    assert read(spark, str(tmp_path / "a")) == expected(ROWS, tokenizer, 1)


def test_empty_table(spark, tokenizer, tmp_path):
    rans.write_archive(spark.createDataFrame([], DOCS), str(tmp_path / "a"), tokenizer, 1)
    assert read(spark, str(tmp_path / "a")) == []


def test_damage_is_found(spark, tokenizer, tmp_path):
    path = str(tmp_path / "a")
    rans.write_archive(spark.createDataFrame(ROWS[:4], DOCS), path, tokenizer, 1)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("crc32", F.lit(1).cast("long"))
    blocks.write.parquet(f"{path}/bad/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{path}/bad/table")
    with pytest.raises(PythonException, match="wrong checksum"):
        read(spark, f"{path}/bad")


def test_query(spark, tokenizer):
    from reviewloom.llm.queries import op1_rans_token_ids

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    found = op1_rans_token_ids(spark, sf).orderBy("start").collect()
    assert [tuple(r) for r in found] == expected([tuple(r) for r in docs], tokenizer, 1)


def test_payloads_are_read_without_a_shuffle(spark, tmp_path, tokenizer, settings, plan_of):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    rows = [(i, f"some words {i}", None) for i in range(50)]
    path = str(tmp_path / "archive")
    rans.write_archive(spark.createDataFrame(rows, DOCS), path, tokenizer, 1)
    found = rans.read_archive(spark, path)
    assert "SortMergeJoin" not in plan_of(found)
    assert sorted(map(tuple, found.select("doc_id").collect())) == [(i,) for i in range(50)]
