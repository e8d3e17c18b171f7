import math

import numpy as np
import pytest
from helpers import REVIEW_DDL, accepted, make_reviews, py_id
from pyspark.sql import functions as F

from reviewloom.operators import scoring, selection


def letter_logits(text):
    return [F.length(text) * 0.1, F.length(F.replace(text, F.lit("o"), F.lit(""))) * 0.11,
            F.lit(1.3)]


def py_scores(text):
    z = np.array([len(text) * 0.1, len(text.replace("o", "")) * 0.11, 1.3])
    e = np.exp(z - z.max())
    p = e / e.sum()
    best = np.sort(p)[::-1]
    return int(p.argmax()), float(-(p * np.log(p)).sum() + 1 - (best[0] - best[1]))


@pytest.fixture(scope="module")
def pool(spark):
    rows = make_reviews(900, 8)
    return rows, spark.createDataFrame(rows, REVIEW_DDL).repartition(6).cache()


def brute(rows, blocked, words, per_category, total, quotas=None, k=0):
    seen, chosen = {}, []
    for row, rid in accepted(rows, blocked, words):
        if per_category and seen.get(row[5], 0) >= per_category:
            continue
        seen[row[5]] = seen.get(row[5], 0) + 1
        chosen.append((row[0], rid, *py_scores(row[1])))
        if total and len(chosen) >= total:
            break
    ranked = sorted(chosen, key=lambda c: (-round(c[3], 9), c[0]))
    if quotas is None:
        return {c[0] for c in ranked[:k]}
    return {c[0] for y in range(3) for c in [c for c in ranked if c[2] == y][: quotas[y]]}


@pytest.mark.parametrize("caps", [(0, 0), (60, 0), (0, 90), (60, 90)])
def test_select_uncertain(spark, pool, caps):
    rows, df = pool
    bad = {py_id("hot text of all", "a0")}
    blocked = spark.createDataFrame([(b,) for b in bad], "id STRING")
    scorer = scoring.expression_scorer(letter_logits)
    common = dict(blocked=blocked, words=3, per_category=caps[0], total=caps[1])
    got = selection.select_uncertain(df, scorer, quotas=[10, 0, 25], **common).collect()
    assert {r.seq for r in got} == brute(rows, bad, 3, *caps, quotas=[10, 0, 25])
    for r in got:
        label, score = py_scores(r.text)
        assert r.pred_label == label and math.isclose(r.uncertainty, score, abs_tol=1e-9)
        assert r.id == py_id(r.text, r.asin) and len(r.probs) == 3
    got = selection.select_uncertain(df, scorer, k=30, **common).collect()
    assert {r.seq for r in got} == brute(rows, bad, 3, *caps, k=30)


def test_select_needs_a_size(pool):
    with pytest.raises(ValueError):
        selection.select_uncertain(pool[1], scoring.expression_scorer(letter_logits))


def test_prepare_batch(spark):
    rows = [(f"i{n}", "t", "", "a", "c", p, q, 1 - p - q)
            for n, (p, q) in enumerate([(0.9, 0.05), (0.4, 0.3), (0.5, 0.5), (0.34, 0.33), (0.4, 0.3)])]
    df = spark.createDataFrame(rows, "id STRING, text STRING, title STRING, asin STRING,"
                               " product_category STRING, p_neg DOUBLE, p_neu DOUBLE, p_pos DOUBLE")
    todo = selection.prepare_batch(df, 3, "least_confidence")
    assert todo.columns == ["id", "text", "title", "asin", "product_category", "label"]
    pick = lambda name: [r.id for r in
                         selection.prepare_batch(df, 3, name).collect()]
    assert pick("least_confidence") == ["i3", "i1", "i4"]
    assert pick("margin")[:2] == ["i2", "i3"]
    assert pick("Entropy")[0] == "i3"
    with pytest.raises(ValueError, match="no such strategy"):
        selection.prepare_batch(df, 3, "random")


def test_pandas_scorer_keeps_rows(pool):
    rows, df = pool

    def load():
        return lambda texts: [[0.2, 0.3, 0.5] for _ in texts]

    scored = scoring.score(df, scoring.pandas_scorer(load))
    assert scored.filter("p_pos = 0.5").count() == len(rows)

    def short():
        return lambda texts: [[1.0, 0.0, 0.0]]

    with pytest.raises(Exception, match="different number of rows"):
        scoring.score(df, scoring.pandas_scorer(short)).agg(F.sum("p_neg")).collect()


def test_pandas_scorer_gets_small_batches(spark):
    rows = spark.range(3000, numPartitions=1).selectExpr("id AS seq", "repeat('t', 50000) AS text")

    def load():
        def run(texts):
            assert len(texts) <= 512 and texts.str.len().sum() <= 2 * (1 << 22)
            return [[0.2, 0.3, 0.5] for _ in texts]

        return run

    scored = scoring.score(rows, scoring.pandas_scorer(load))
    assert scored.filter("p_pos = 0.5").count() == 3000


def test_filter_runs_below_a_python_scorer(pool, plan_of):
    scorer = scoring.pandas_scorer(lambda: lambda texts: [[1.0, 0.0, 0.0]] * len(texts))
    plan = plan_of(scoring.score(pool[1], scorer).filter("rating > 4"))
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("Filter", plan.index("ArrowEvalPython")) > 0


def test_predict_columns(pool):
    out = scoring.predict(pool[1], scoring.expression_scorer(letter_logits), threshold=0.5)
    for r in out.limit(50).collect():
        best = max(r.p_neg, r.p_neu, r.p_pos)
        assert r.confidence == best and (r.label == "abstain") == (best < 0.5)


def test_weights_need_a_valid_rating(spark):
    df = spark.createDataFrame([("a", 5.0, [0.0, 0.1, 0.9]), ("b", 3.0, [0.7, 0.2, 0.1])],
                               "text STRING, rating DOUBLE, probs ARRAY<DOUBLE>")
    got = [round(r.sample_weight, 6) for r in scoring.weight_rows(df).collect()]
    assert got == [0.93, round((0.3 + 0.49) * 0.5 * 0.8, 6)]
    bad = df.withColumn("rating", F.lit(9.0))
    with pytest.raises(Exception, match="no class for rating"):
        scoring.weight_rows(bad).collect()


def test_merge_labels_newest_batch_wins(spark):
    pool = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id STRING, label INT")
    human = spark.createDataFrame(
        [("a", "pos", 1), ("a", "neu", 2), ("b", "7", 3), ("c", "neg", 1), ("c", "pos", 1)],
        "id STRING, label STRING, batch INT")
    got = selection.merge_human_labels(pool, human, batch="batch").collect()
    assert {(r.id, r.label, r.label_source) for r in got} == {
        ("a", 1, "human"), ("b", 1, "pool"), ("c", 0, "human")}
    assert [r.id for r in selection.quarantine_labels(human).collect()] == ["b"]


def test_training_learns_and_weights_count(spark):
    rows = [(i, "good great fine" if i % 3 else "bad poor broken", 5.0 if i % 3 else 1.0, "", f"A{i}",
             "C", 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, REVIEW_DDL + ", w DOUBLE")
    model = scoring.train_classifier(df, "w", num_features=64, max_iter=20)
    report = scoring.evaluate_scorer(df, scoring.model_scorer(model)).first()
    assert report.accuracy == 1.0 and report["rows"] == 60
    short = scoring.train_classifier(df, num_features=64, max_tokens=1, max_iter=5)
    assert scoring.score(df, scoring.model_scorer(short)).count() == 60
    # Rows of weight zero must not influence the fit.
    poisoned = df.unionByName(df.withColumns({"rating": 6 - F.col("rating"), "w": F.lit(0.0)}))
    again = scoring.train_classifier(poisoned, "w", num_features=64, max_iter=20)
    assert scoring.evaluate_scorer(df, scoring.model_scorer(again)).first().accuracy == 1.0


def test_best_of_grid(spark):
    rows = [(i, "good great" if i % 2 else "bad poor", 5.0 if i % 2 else 1.0, "", "A", "C")
            for i in range(40)]
    df = spark.createDataFrame(rows, REVIEW_DDL)
    model, options, f1 = scoring.best_of(df, df, [{"reg_param": 0.1}, {"max_iter": 2}], num_features=32)
    assert options == {"reg_param": 0.1} and f1 == 1.0
    assert scoring.score(df, scoring.model_scorer(model)).count() == 40
    with pytest.raises(ValueError):
        scoring.best_of(df, df, [])


def test_best_of_grid_reads_each_table_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text_of(n):
        read.add(1)
        return "good great" if n % 2 else "bad poor"

    rows = [(i, 5.0 if i % 2 else 1.0, i % 5 / 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, "n INT, rating DOUBLE, w DOUBLE")
    df = df.select(text_of("n").alias("text"), "rating", "w")
    grid = [{"reg_param": 0.1}, {"max_iter": 2}, {"reg_param": 0.5}]
    _, options, f1 = scoring.best_of(df, df, grid, sample_weight="w", num_features=32, max_tokens=1)
    assert options == {"reg_param": 0.1} and f1 == 1.0
    assert read.value == 80
