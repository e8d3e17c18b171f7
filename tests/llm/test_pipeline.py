import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from reviewloom.llm import minhash

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, uid STRING, label STRING"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "uid", "label"]


def rows_of(seed=1, n=150):
    rng = random.Random(seed)
    en, de = ([f"{p}{rng.choice('abcde')}{rng.choice(s)}" for _ in range(900)] for p, s in (("th", ["ing", "er"]), ("sch", ["ung", "lich"])))
    word = lambda lang: rng.choice(en if lang == "en" else de) + rng.choice("aeiou") + str(rng.randrange(99)) * 0
    passage = [f"pass{i}" for i in range(60)]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [word(lang) + rng.choice("xyzw") * rng.randrange(4) for _ in range(rng.randrange(5, 200))]
        if i % 7 == 0:
            words[3:3] = passage
        rows.append((i, " ".join(words), lang, rng.choice(["a", "b", "b", None]), 1, "u", None))
    for i in range(20):  # near and exact copies
        words = rows[i][1].split()
        if i % 2 and len(words) > 100:
            words[50] = "changed"
        rows.append((n + i, "\n".join(words), "en", "a", 1, "u", None))
    rows += [(900, None, None, None, None, None, None), (901, "12 34 --", "en", "a", 8, "u", None), (None, "no id but words here", "en", "b", 3, "u", None),
             rows[3], rows[3], (902, "", "en", "a", 0, "u", None), (903, "word " * 20_000, "en", None, 9, "u", "x")]
    return rows


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def run(spark, name, rows):
    return stage(name)(spark, spark.createDataFrame(rows, DOCS).repartition(3), None)


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixture", "packed"]


def test_language_keeps_every_text_with_letters(spark):
    rows = rows_of()
    found = run(spark, "language", rows)
    assert found.columns == COLUMNS
    kept = Counter((r.doc_id, r.text, r.source, r.n_chars, r.uid, r.label) for r in found.collect())
    assert kept == Counter((r[0], r[1], *r[3:]) for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    right = [r.lang == dict((x[0], x[2]) for x in rows)[r.doc_id] for r in found.collect() if r.doc_id is not None and r.doc_id < 150]
    assert sum(right) > 0.95 * len(right)


def groups(rows):
    sets = [minhash.shingles(minhash.words_of(r[1]), 5) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    return sets, [root(i) for i in range(len(rows))]


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = rows_of()
    found = run(spark, "near_duplicates", rows)
    assert found.columns == COLUMNS
    sets, roots = groups(rows)
    by_root, wanted = defaultdict(list), Counter()
    for r, s, g in zip(rows, sets, roots):
        if s:
            by_root[g].append(r)
        else:
            wanted[r] += 1
    for members in by_root.values():
        wanted[min(members, key=lambda r: (r[0] is None, r[0] or 0))] += 1
    assert Counter(map(tuple, found.collect())) == wanted


def test_near_duplicates_tell_groups_by_links_not_by_ids(spark):
    row = lambda doc_id, text: (doc_id, text, "en", "a", 1, "u", None)
    alone = [row(6, "a text"), row(6, "quite another text"), row(None, "no id"), row(None, "no id here either")]
    copies = [f"one text that {i} rows have" for i in range(8)]
    rows = [*alone, *(row(i, t) for t in copies for i in (None, 20, 6)), *(row(None, c) for c in ["both without", "Both  without"])]
    found = Counter(map(tuple, run(spark, "near_duplicates", rows).collect()))
    assert found.pop(rows[-1], 0) + found.pop(rows[-2], 0) == 1
    assert found == Counter([*alone, *(row(6, t) for t in copies)])


def test_passages_are_cut(spark):
    rows = rows_of()
    found = run(spark, "repeated_passages", rows)
    assert found.columns == COLUMNS
    seen = Counter()
    texts = [(r[1] or "").encode().split() for r in rows]
    for w in texts:
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    wanted = Counter()
    for r, w in zip(rows, texts):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        text = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else r[1]
        wanted[(r[0], text, *r[2:4], len(text) if gone else r[4], *r[5:])] += 1
    assert Counter(map(tuple, found.collect())) == wanted


def test_mixture_repeats_and_drops_whole_documents(spark):
    rows = rows_of()
    found = run(spark, "mixture", rows)
    assert found.columns == COLUMNS
    before, after = Counter(rows), Counter(map(tuple, found.collect()))
    assert set(after) <= set(before) and all(after[r] <= 3 * before[r] for r in after)
    words = lambda c: {s: sum(n * len((r[1] or "").split()) for r, n in c.items() if r[3] == s) for s in ("a", "b", None)}
    sizes, taken = words(before), words(after)
    total = sum(sizes.values())
    assert abs(sum(taken.values()) - total) < 0.02 * total
    assert taken["a"] == pytest.approx(min(3 * sizes["a"], total * 5 / 8), rel=0.02) or taken["a"] > sizes["a"]


def test_whole_run(spark, tmp_path, tokenizer):
    rows = rows_of()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found and all(r.offset + r.length <= 4096 for r in found)
    ids = {r.doc_id for r in found}
    assert ids <= {r[0] for r in rows} and 901 not in ids and 900 not in ids
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["language", "near_duplicates", "repeated_passages", "mixture"])
def test_columns_of_any_name_and_type_stay(spark, name):
    extra = ["_row_uid", "_words", "_again", "again", "copies", "size", "c1", "_hash", "rank"]
    schema = DOCS + "".join(f", {c} STRING" for c in extra) + ", pairs MAP<STRING, INT>"
    rows = [(*r, *[f"{c} {i % 9}" for c in extra], {"k": i % 5}) for i, r in enumerate(rows_of(n=60))]
    found = stage(name)(spark, spark.createDataFrame(rows, schema).repartition(3), None)
    assert found.columns == [*COLUMNS, *extra, "pairs"]
    given = {(r[0], r[5:16], r[16]["k"]) for r in rows}
    kept = found.collect()
    assert kept and all((r[0], tuple(r)[5:16], r.pairs["k"]) in given for r in kept)
