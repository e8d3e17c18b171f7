import zlib
from collections import defaultdict

import numpy as np
import pytest

from reviewloom.llm import packing
from reviewloom.llm.subset_sum import best_fill

DOCS = "doc_id BIGINT, text STRING, length STRING"


def brute_fill(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    return max(sums)


@pytest.mark.parametrize("seed", range(30))
def test_best_fill(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(0, 30, 6)}
    room = int(rng.integers(0, 120))
    taken = best_fill(sorted(counts, reverse=True), counts, room)
    assert all(0 < k <= counts[n] for n, k in taken.items())
    positive = {n: c for n, c in counts.items() if n}
    assert sum(n * k for n, k in taken.items()) == brute_fill(positive, room)


def test_patterns_use_every_length_once():
    rng = np.random.default_rng(5)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 4097, 900), rng.integers(1, 10**9, 900))}
    used = defaultdict(int)
    found = packing.patterns(counts, 4096)
    for taken, times in found:
        assert sum(n * k for n, k in taken.items()) <= 4096
        for n, k in taken.items():
            used[n] += k * times
    assert used == counts and len(found) <= 4096
    filled = sum(n * c for n, c in counts.items())
    assert filled / (4096 * sum(times for _, times in found)) > 0.95


def check(rows, pieces, tokenizer, window):
    from reviewloom.llm.tokens import encoder

    encode = encoder(tokenizer).tokenizer
    coded = sorted((d or 0, encode.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id or 0].append(p)
    texts = defaultdict(list)
    for d, ids in coded:
        texts[d].append(ids)
    assert by_doc.keys() == texts.keys()
    for d, all_ids in texts.items():
        wanted = sorted((s, ids[s : s + window], len(ids)) for ids in all_ids for s in range(0, len(ids), window))
        found = sorted((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist(), p.doc_tokens) for p in by_doc[d])
        assert found == wanted
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(sequences) == list(range(len(sequences)))


ROWS = [(2**60 + 1, "large id", "x"), (3, None, "x"), (4, "", "x"), (None, "no id", "x"),
        (5, "The cat sat.", "x"), (5, "The cat sat.", "x"), (5, "another", "y"),
        (9, "word " * 9_001, "x")] + [(20 + i, "same text here " * (i % 5), "z") for i in range(200)]


@pytest.mark.parametrize("window", [16, 4096])
def test_pieces(spark, tokenizer, window):
    pieces = packing.pack(spark.createDataFrame(ROWS, DOCS).repartition(5), tokenizer, 2, window)
    check(ROWS, pieces.collect(), tokenizer, window)


def test_partitioning_does_not_matter(spark, tokenizer):
    one = packing.pack(spark.createDataFrame(ROWS, DOCS).coalesce(1), tokenizer, 2)
    many = packing.pack(spark.createDataFrame(ROWS, DOCS).repartition(7), tokenizer, 2)
    assert sorted(one.collect(), key=str) == sorted(many.collect(), key=str)


def test_a_task_has_one_python_worker(spark, tokenizer, monkeypatch):
    plans, stored = [], packing.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(packing, "stored", seen)
    pieces = packing.pack(spark.createDataFrame(ROWS, DOCS), tokenizer, 2, 16)
    plans.append(pieces._jdf.queryExecution().executedPlan().toString())
    assert [plan.count("MapInArrow") for plan in plans] == [1, 1]
    check(ROWS, pieces.collect(), tokenizer, 16)


def test_empty_table(spark, tokenizer):
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer, 2).collect() == []


def test_query(spark, tokenizer):
    from reviewloom.llm.queries import op2_bin_slack_packing

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    found = op2_bin_slack_packing(spark, sf).collect()
    check(docs, packing.pack(spark.createDataFrame(docs, DOCS), tokenizer, 2).collect(), tokenizer, 4096)
    total = sum(r.length for r in found)
    assert total / (4096 * len({r.sequence_id for r in found})) > 0.98
    crcs = sorted((r.doc_id, r.start, r.ids_crc32) for r in found)
    pieces = packing.pack(spark.createDataFrame(docs, DOCS), tokenizer, 2).collect()
    assert crcs == sorted((p.doc_id, p.start, zlib.crc32(bytes(p.ids))) for p in pieces)
