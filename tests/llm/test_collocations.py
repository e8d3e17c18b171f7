import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reviewloom.llm import collocations as c

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, code STRING, n STRING"
LOWER = {ord(x): ord(x) + 32 for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, least, top, share=80):
    grams, sizes = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            sizes[lang] += len(words)
            for n in range(1, 5):
                grams[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in grams.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        held = defaultdict(int)
        for g, a in candidates.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    held[g[i : i + n]] = max(held[g[i : i + n]], a)
        scored = []
        for g, a in candidates.items():
            if 100 * held[g] >= share * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in c.collocations(df, **options).collect())


def texts(rng, n):
    words = [f"w{i}" for i in range(40)] + ["été", "日本", "Word", "\U0001f600x"]
    weights = [1 / (i + 1) for i in range(len(words))]
    for _ in range(n):
        parts = rng.choices(words, weights, k=rng.randrange(0, 40))
        parts = [x + rng.choice(["", "", "", ".", ", ", "\t", "\n", "  "]) for x in parts]
        if rng.random() < 0.3:
            parts.insert(rng.randrange(len(parts) + 1), "a fixed Phrase of words")
        yield " ".join(parts)


@pytest.mark.parametrize("least,top,partitions", [(5, 50, 3), (30, 2000, 7)])
def test_against_brute_force(spark, least, top, partitions):
    rng = random.Random(least)
    rows = [(i, t, rng.choice(["a", "a", "b", None, "und"]), "x", "y") for i, t in enumerate(texts(rng, 900))]
    rows += [(None, None, None, None, None), (1, "", "a", "x", "y"), (2, " \t.\n!", "c", "x", "y")]
    rows += [(3, "same text again and again", "a", "x", "y")] * 400
    rows += [(4, "x y x y x y x y " * 5000 + "end. " + "q" * 10_000 + " r", "d", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    wanted = brute(rows, least, top)
    assert found(df, least=least, top=top) == wanted and len(wanted) > 40


def test_a_pair_in_a_third_of_all_places(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"hot pair {rng.choice('abcdefghijkl')}{rng.randrange(40)}" for _ in range(30)), "a", "x", "y")
            for i in range(600)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(9), least=8, top=100) == brute(rows, 8, 100)


def test_no_rows_and_no_candidates(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, "one two three", "a", "x", "y")], SCHEMA)) == []


def windows_of(texts, pairs):
    """Windows of texts by the operator's own chunks, as code tuples."""
    bits = bytes([255]) * (1 << (c.SET_BITS - 3))
    batch = pa.record_batch({"text": pa.array(texts), "lang": pa.array(["a"] * len(texts))})
    total = Counter()
    for made in c._window_rows(1, bits, 5, pairs)(iter([batch])):
        for data in made["automaton"]:
            codes, labels, counts = c.Automaton.from_bytes(data.as_py()).windows()
            padded = np.concatenate([np.zeros(1, np.uint64), codes])
            for *key, n in zip(*[padded[x].tolist() for x in labels], counts.tolist()):
                total[tuple(key)] += n
    return total


@pytest.mark.parametrize("pairs", [True, False])
def test_long_texts_are_split_without_loss(monkeypatch, pairs):
    rng = random.Random(7)
    sample = [" ".join(texts(rng, 30)) for _ in range(4)] + ["a b", "lone", "", "x" * 400 + " y z"]
    whole = windows_of(sample, pairs)
    less = 1 if pairs else 2
    assert sum(whole.values()) == sum(max(len(p) - less, 0) for t in sample for p in pieces(t))
    for size in (1, 7, 50, 333):
        monkeypatch.setattr(c, "BLOCK_BYTES", size)
        monkeypatch.setattr(c, "CHUNK_WORDS", size)
        assert windows_of(sample, pairs) == whole


def random_windows(rng, n, vocabulary):
    labels = np.sort(rng.integers(1, vocabulary + 1, (4, n)), axis=1)
    labels = [rng.permutation(x) for x in labels]
    end = rng.integers(2, 5, n)
    return [np.where(end > d, x, 0) for d, x in enumerate(labels)]


@pytest.mark.parametrize("seed", range(4))
def test_automata_keep_and_add_windows(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    codes = np.sort(rng.integers(1, 2**64, 30, np.uint64))
    total, automata = Counter(), []
    for _ in range(5):
        labels, counts, _ = c._sorted_sums(random_windows(rng, 400, len(codes)), rng.integers(1, 2**40 if seed else 3, 400))
        automaton = c.Automaton.from_bytes(c.Automaton.build(codes, labels, counts).to_bytes())
        automata.append(automaton)
        own, local, weight = automaton.windows()
        padded = [0, *own.tolist()]
        got = {tuple(padded[x] for x in key): n for *key, n in zip(*[x.tolist() for x in local], weight.tolist())}
        every = [0, *codes.tolist()]
        want = {tuple(every[x] for x in key): n for *key, n in zip(*[x.tolist() for x in labels], counts.tolist())}
        assert got == want
        total.update(want)
    for bits in (c._RANK_BITS, 4):  # the second one has too few bits for all words
        monkeypatch.setattr(c, "_RANK_BITS", bits)
        all_codes, labels, counts = c.united(automata)
        padded = [0, *all_codes.tolist()]
        got = [(tuple(padded[x] for x in key), n) for *key, n in zip(*[x.tolist() for x in labels], counts.tolist())]
        assert dict(got) == total and [k for k, _ in got] == sorted(total)


def test_equal_states_are_kept_once():
    codes = np.arange(1, 1001, dtype=np.uint64)
    first = np.arange(1, 501)
    labels = [np.repeat(first, 2), np.repeat(first, 2), np.repeat(first, 2), np.tile([7, 9], 500)]
    automaton = c.Automaton.build(codes, labels, np.tile([3, 4], 500))
    assert len(automaton.arrays[7]) == 1 and len(automaton.arrays[8]) == 2


def test_words_that_share_a_code_lead_to_another_seed(spark, monkeypatch):
    rows = [(i, "one two three", "a", "x", "y") for i in range(40)]
    monkeypatch.setattr(c, "_word_rows", lambda seed: _shared(seed))
    words, seed = c.all_words(spark.createDataFrame(rows, SCHEMA).select("text", "lang"))
    assert seed == 2 and {(r.word, r.f) for r in words.collect()} == {("one", 40), ("two", 40), ("three", 40)}


def _shared(seed):
    def run(batches):
        codes = [5, 5, 6] if seed == 1 else [4, 5, 6]
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch({"lang": ["a"] * 3, "code": pa.array(codes, pa.int64()),
                                   "word": ["one", "two", "three"], "f": pa.array([n] * 3, pa.int64())})

    return run


def test_query(spark):
    from reviewloom.llm.queries import op11_automaton_collocations

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op11_automaton_collocations(spark, sf).collect()) == brute(rows, 30, 2000)
