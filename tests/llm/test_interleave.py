import zlib
from collections import Counter

import pytest

from reviewloom.llm import interleave

SCHEMA = "doc_id BIGINT, text STRING, source STRING, shard STRING, _place STRING, rank STRING"


def make(n):
    return [(i, f"text {i}", "hot" if i % 3 == 0 else f"s{i % 7}", "x", "y", "z") for i in range(n)]


def shards_of(rows, shards):
    groups = {}
    for r in rows:
        groups.setdefault(r.shard, []).append(r)
    sizes = [len(groups.get(i, [])) for i in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for group in groups.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    assert sorted(r.place for r in rows) == list(range(len(rows)))
    ordered = sorted(rows, key=lambda r: r.place)
    assert [(r.shard, r.slot) for r in ordered] == sorted((r.shard, r.slot) for r in rows)
    return groups


@pytest.mark.parametrize("n,shards", [(1000, 16), (1003, 7), (5, 16), (16, 16), (1, 3)])
def test_every_shard_has_the_mixture(spark, n, shards):
    rows = make(n)
    found = interleave.deal(spark.createDataFrame(rows, SCHEMA).repartition(5), shards, 1, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.text, r["_place"], r["rank"]) for r in found) == [(r[0], r[1], "y", "z") for r in rows]
    whole = Counter(r[2] for r in rows)
    for group in shards_of(found, shards).values():
        mine = Counter(r.source for r in group)
        for source, count in whole.items():
            assert abs(mine[source] - count / shards) <= 2
    # any stretch has the mixture, so one that begins anywhere has it too
    ordered = [r.source for r in sorted(found, key=lambda r: r.place)]
    part = ordered[n // 3 : n // 3 + n // 4]
    assert abs(part.count("hot") - len(part) * whole["hot"] / n) <= 2


def test_partitioning_does_not_matter_but_the_seed_does(spark):
    df = spark.createDataFrame(make(500), SCHEMA)
    first, again, other = (
        {r.doc_id: r.place for r in interleave.deal(df.repartition(p), 4, seed, ["doc_id"]).collect()}
        for p, seed in ((1, 1), (9, 1), (9, 2)))
    assert first == again != other


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, None, None, "x", "y", "z")] * 40 + [(1, "", "a", None, None, None)] * 3
    found = interleave.deal(spark.createDataFrame(rows, SCHEMA), 4, 1, ["doc_id", "text"]).collect()
    groups = shards_of(found, 4)
    assert all(any(r.source is None for r in g) for g in groups.values())
    assert interleave.deal(spark.createDataFrame([], SCHEMA), 4, 1, ["doc_id"]).collect() == []


def test_written_shards(spark, tmp_path):
    rows = make(300)
    interleave.write_shards(spark.createDataFrame(rows, SCHEMA).drop("shard"), str(tmp_path / "s"), 5, 3)
    found = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(r[0], r[1]) for r in rows]
    assert sorted(Counter(r.shard for r in found).values()) == [60] * 5
    assert sorted(p.name for p in (tmp_path / "s").glob("shard=*")) == [f"shard={i}" for i in range(5)]


def test_query(spark):
    from reviewloom.llm.queries import op13_interleaved_shards

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op13_interleaved_shards(spark, sf).collect()
    assert len(found) == len(docs) and {r.law for r in found} == {"rows"}
    for r in found:
        data = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
