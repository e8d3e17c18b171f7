import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import metrics, validate
from reviewloom.operators.conform import conform_schema, ensure_label, gold_rows, rating_to_int


def labelled(spark, pairs):
    return spark.createDataFrame(pairs, "label INT, pred_label INT")


def py_macro_f1(pairs):
    classes = sorted({x for pair in pairs for x in pair})
    scores = []
    for c in classes:
        tp = sum(t == c == p for t, p in pairs)
        wrong = sum((t == c) != (p == c) for t, p in pairs)
        scores.append(2 * tp / (2 * tp + wrong) if tp else 0.0)
    return sum(scores) / len(scores)


@pytest.mark.parametrize("pairs", [
    [(0, 0), (1, 1), (2, 2), (0, 1), (2, 1)], [(0, 1), (0, 1), (1, 0)], [(2, 2)], [(0, 2), (1, 2)],
    [(random.Random(4).randrange(3), random.Random(i).randrange(3)) for i in range(200)]])
def test_evaluate(spark, pairs):
    report = metrics.evaluate(labelled(spark, pairs)).first()
    assert math.isclose(report.accuracy, sum(t == p for t, p in pairs) / len(pairs))
    assert math.isclose(report.f1_macro, py_macro_f1(pairs))
    for t in range(3):
        for p in range(3):
            assert report.confusion_matrix[t][p] == pairs.count((t, p))
    present = sorted({x for pair in pairs for x in pair})
    long = {(r.label, r.pred_label): r["rows"] for r in
            metrics.confusion_matrix(labelled(spark, pairs)).collect()}
    assert long == {(t, p): pairs.count((t, p)) for t in present for p in present}


def test_evaluate_empty(spark):
    df = labelled(spark, [(0, 0)]).filter("label > 5").withColumn(
        "probs", F.array(F.lit(0.1), F.lit(0.2), F.lit(0.7)))
    report = metrics.evaluate(df, probs="probs").first()
    assert (report["rows"], report.accuracy, report.f1_macro, report.loss) == (0, 0.0, 0.0, 0.0)
    assert metrics.confusion_matrix(df).count() == 0


def test_class_weights(spark):
    df = labelled(spark, [(0, 0)] * 6 + [(1, 0)] * 3)
    got = {r.label: r.weight for r in metrics.class_weights(df).collect()}
    inverse = np.array([1 / 6, 1 / 3, 1.0])
    assert np.allclose([got[c] for c in range(3)], inverse / inverse.mean())
    assert metrics.class_weight_list(df, configured=[1, 2, 3]) == [1.0, 2.0, 3.0]


def test_quantiles_are_exact(spark):
    rng = random.Random(9)
    rows = [("hot", 7.25)] * 900
    rows += [(rng.choice(["a", "b", "hot"]), rng.choice([-1, 1]) * rng.expovariate(0.01))
             for _ in range(1500)]
    rows += [("one", 3.0), ("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(5)
    got = {r.k: r for r in metrics.latency_summary(df, "k", "v").collect()}
    for key in {r[0] for r in rows}:
        values = [v for k, v in rows if k == key and v is not None]
        row = got[key]
        assert row["rows"] == len(values)
        want = (np.mean(values), *np.percentile(values, [50, 95])) if values else (0.0, 0.0, 0.0)
        assert np.allclose((row["mean"], row.p50, row.p95), want)
    near = {r.k: r for r in metrics.latency_summary(df, "k", "v", exact=False).collect()}
    assert near["hot"].p50 == 7.25


def test_coverage(spark):
    rows = [([0.9, 0.05, 0.05], 0), ([0.5, 0.3, 0.2], 1), ([0.1, 0.65, 0.25], 1)]
    df = spark.createDataFrame(rows, "probs ARRAY<DOUBLE>, label INT")
    got = {r.threshold: r for r in metrics.coverage(df, [0.5, 0.65, 0.99]).collect()}
    assert (got[0.5].answered, got[0.65].answered, got[0.99].answered) == (3, 2, 0)
    assert math.isclose(got[0.5].answered_accuracy, 2 / 3) and got[0.99].answered_accuracy == 0.0


def test_metrics_shuffle_one_row_per_task(spark, plan_of):
    df = labelled(spark, [(0, 0), (1, 2)])
    plan = plan_of(metrics.evaluate(df))
    assert "hashpartitioning" not in plan and plan.count("SinglePartition") == 1


REVIEW = "text STRING, rating INT, title STRING, asin STRING, product_category STRING"


def test_validation_report(spark):
    df = spark.createDataFrame([("a", 1, "", "X", "C"), ("b", 5, "", "Y", "C")], REVIEW)
    report = validate.assert_valid(df)
    assert report["rows"] == 2 and report["columns_present"] and report["metadata_types_ok"]
    assert report["categories_present"] and report["categories"] == 1


def test_validation_errors(spark):
    good = ("a", 3, "t", "X", "C")
    with pytest.raises(ValueError, match="rating"):
        validate.assert_valid(spark.createDataFrame([good, ("a", 6, "", "X", "C")], REVIEW))
    with pytest.raises(ValueError, match="text"):
        validate.assert_valid(spark.createDataFrame([good, (" 　", 3, "", "X", "C")], REVIEW))
    with pytest.raises(ValueError, match="title"):
        validate.assert_valid(spark.createDataFrame([good, ("a", 3, " ", "X", "C")], REVIEW),
                              allow_empty_title=False)
    with pytest.raises(ValueError, match="lacks the columns"):
        validate.validate_reviews(spark.createDataFrame([("a",)], "text STRING"))
    stars = spark.createDataFrame([("a", "4x", "", "X", "C"), ("a", "nan", "", "X", "C"),
                                   ("a", "4", "", "X", "C"), ("a", None, "", "X", "C")],
                                  REVIEW.replace("rating INT", "rating STRING"))
    assert validate.invalid_rows(stars).count() == 3


def test_check_split(spark):
    df = spark.createDataFrame([("a", 0, "", "X", "C"), ("", 9, None, "Y", "C")], REVIEW)
    assert tuple(validate.check_split(df).first()) == (2, 1, 1, 1)


def test_conform(spark):
    df = spark.createDataFrame([("a", "4.0", 9), (None, "bad", 8)], "text STRING, rating STRING, x INT")
    out = conform_schema(df, with_label=True)
    assert out.columns == ["text", "rating", "title", "asin", "product_category", "label"]
    assert [tuple(r) for r in out.collect()] == [("a", 4.0, "", "", "", 2), ("", 0.0, "", "", "", 0)]
    assert [r.rating for r in rating_to_int(spark.createDataFrame(
        [(3.9,), (-1.5,), (None,), (math.nan,)], "rating DOUBLE")).collect()] == [3, -1, 0, 0]
    kept = spark.createDataFrame([("1", 5.0), ("x", 5.0), (None, 1.0)], "label STRING, rating DOUBLE")
    assert [r.label for r in ensure_label(kept).collect()] == [1, 2, 0]
    assert [tuple(r) for r in gold_rows(kept.select(F.lit(2).alias("label"))).collect()] == [
        ("", "", 2)] * 3
