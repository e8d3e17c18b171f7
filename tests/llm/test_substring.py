import random
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm import substring

DOCS = "doc_id BIGINT, text STRING, spans STRING"


def brute(rows, window):
    texts = [(t or "").encode().split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, *_), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((doc_id, len(w), len(gone), kept))
    return sorted(out, key=str)


def found(spark, rows, window=35):
    df = substring.without_repeats(spark.createDataFrame(rows, DOCS).repartition(3), window)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passages = [[word() for _ in range(rng.randrange(20, 120))] for _ in range(12)]
    line = [f"l{i}" for i in range(20)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            at = rng.randrange(len(words) + 1)
            words[at:at] = p[a:b] if rng.random() < 0.5 else p
        if i % 2:
            words[len(words) // 2 : len(words) // 2] = line
        if i % 9 == 0:
            words += ["Is", "onhe."] * rng.randrange(10, 40)
        rows.append((i // 2, rng.choice([" ", "\n", "\t "]).join(words), "x"))
    return rows + rows[:10]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows, 35)


@pytest.mark.parametrize("common", [0, 3])
def test_common_anchors(spark, monkeypatch, common):
    monkeypatch.setattr(substring, "SEGMENTS", common)
    rows = corpus(7)
    assert found(spark, rows) == brute(rows, 35)


def test_other_windows(spark):
    rows = corpus(3)[:60]
    assert found(spark, rows, 12) == brute(rows, 12)
    with pytest.raises(ValueError):
        found(spark, rows, 11)


def test_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(34))
    rows = [(1, None, None), (2, "", None), (None, text, None), (3, text, None), (4, text + " y", None),
            (5, f"a {text} y b", None), (6, "é\x1cß\x85z " * 60, None), (6, "é\x1cß\x85z " * 60, None), (7, "one " * 40_000, None)]
    assert found(spark, rows) == brute(rows, 35)
    assert found(spark, []) == []


@pytest.mark.parametrize("seed", range(20))
def test_automaton_counts(seed):
    rng = np.random.default_rng(seed)
    sequences = [rng.integers(0, 3, rng.integers(1, 30)).tolist() for _ in range(6)]
    automaton = substring.Automaton(sequences, [1] * 6)
    for size in (1, 3, 5):
        seen = Counter(tuple(s[i : i + size]) for s in sequences for i in range(len(s) - size + 1))
        for s in [*sequences, rng.integers(0, 4, 40).tolist()]:
            got = list(automaton.occurrences(s, size))
            wanted = [0] * (size - 1) + [seen[tuple(s[i : i + size])] for i in range(len(s) - size + 1)]
            assert got == wanted[: len(s)]


def test_query(spark):
    import hashlib

    from reviewloom.llm.queries import op6_suffix_automata

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    result = [tuple(r) for r in op6_suffix_automata(spark, sf).collect()]
    wanted = [(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in brute(rows, 35)]
    assert sorted(result, key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("width", [1, 2, 3, 8, 24, 31])
def test_least_places(width):
    values = np.random.default_rng(width).integers(0, 9, 200).astype(np.uint64)
    wanted = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
    assert substring.least_places(values, width).tolist() == wanted
