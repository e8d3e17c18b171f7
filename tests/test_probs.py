import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom import functions as fn


def values(spark, kind, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"n INT, x {kind}")
    out = df.orderBy("n").select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in out]


PROBS = [[0.4, 0.4, 0.2], [1.0, 0.0, 0.0], [0.5, 0.5], [1.0], [0.2, 0.3, 0.5], [0.1, 0.65, 0.25],
         [1 / 3, 1 / 3, 1 / 3]]


def test_softmax_matches_numpy(spark):
    rng = np.random.default_rng(1)
    logits = [list(map(float, z)) for z in rng.normal(0, 5, (50, 3))]
    logits += [[0.0, 0.0, 10.0], [0.0] * 3, [1000.0, -1000.0, 0.0]]
    for z, p in zip(logits, values(spark, "ARRAY<DOUBLE>", logits, fn.softmax("x"))):
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(p, e / e.sum(), atol=1e-12)


def test_abstain(spark):
    # A sure and an undecided row, and the threshold between them.
    logits = [[0.0, 0.0, 10.0], [0.0, 0.0, 0.0]]
    label = fn.abstain_label(fn.softmax("x"), 0.5)
    assert values(spark, "ARRAY<DOUBLE>", logits, label) == ["positive", "abstain"]
    # A confidence equal to the threshold answers.
    assert values(spark, "ARRAY<DOUBLE>", [[0.1, 0.65, 0.25]], fn.abstain_label("x")) == ["neutral"]


def test_argmax_takes_first_of_ties(spark):
    assert values(spark, "ARRAY<DOUBLE>", PROBS, fn.argmax("x")) == [0, 0, 0, 0, 2, 1, 0]


def test_uncertainty_measures(spark):
    got = values(spark, "ARRAY<DOUBLE>", PROBS, fn.entropy("x"), fn.margin("x"), fn.uncertainty("x"))
    for p, (h, m, u) in zip(PROBS, got):
        clipped = np.clip(np.array(p), 1e-12, 1.0)
        want_h = float(-(clipped * np.log(clipped)).sum())
        best = sorted(p, reverse=True)
        want_m = best[0] - best[1] if len(best) > 1 else 1.0
        assert math.isclose(h, want_h, abs_tol=1e-12)
        assert math.isclose(m, want_m, abs_tol=1e-12)
        assert math.isclose(u, want_h + 1 - want_m, abs_tol=1e-12)


def test_strategies(spark):
    p = [[0.2, 0.3, 0.5]]
    assert values(spark, "ARRAY<DOUBLE>", p, fn.strategy_score("least_confidence", "x"))[0] == 0.5
    assert math.isclose(values(spark, "ARRAY<DOUBLE>", p, fn.strategy_score("MARGIN", "x"))[0], -0.2)
    with pytest.raises(ValueError, match="no such strategy"):
        fn.strategy_score("random", "x")


def test_normalize_probs(spark):
    given = [None, "[0.1,0.2]", "0.1,0.2", " 0.1 , 0.2 ", "x,y", "", "{}"]
    got = values(spark, "STRING", given, fn.normalize_probs("x"))
    assert got == [[], [0.1, 0.2], [0.1, 0.2], [0.1, 0.2], [], [], []]


def test_instance_weight(spark):
    rows = [(0.9, True, 5.0, 0.93), (0.9, False, 3.0, 0.93 * 0.5 * 0.8), (0.5, True, None, 0.65)]
    df = spark.createDataFrame(rows, "conf DOUBLE, ok BOOLEAN, rating DOUBLE, want DOUBLE")
    for row in df.withColumn("w", fn.instance_weight("conf", F.col("ok"), F.col("rating"))).collect():
        assert math.isclose(row.w, row.want)


def test_losses_agree(spark):
    rng = np.random.default_rng(2)
    rows = [([float(v) for v in z], int(k)) for z, k in zip(rng.normal(0, 3, (30, 3)), rng.integers(0, 3, 30))]
    df = spark.createDataFrame(rows, "z ARRAY<DOUBLE>, label INT")
    out = df.select(
        fn.cross_entropy(fn.softmax("z"), "label").alias("a"),
        fn.cross_entropy_from_logits("z", "label").alias("b"),
        fn.cross_entropy(fn.softmax("z"), "label", [2.0, 3.0, 4.0]).alias("c"),
        "label",
    ).collect()
    for row in out:
        assert math.isclose(row.a, row.b, rel_tol=1e-9)
        assert math.isclose(row.c, row.a * [2.0, 3.0, 4.0][row.label], rel_tol=1e-12)


def test_loss_from_logits_survives_underflow(spark):
    got = values(spark, "ARRAY<DOUBLE>", [[0.0, 2000.0, 0.0]], fn.cross_entropy_from_logits("x", F.lit(0)))
    assert got == [2000.0]


def test_sql_prob_functions(spark):
    fn.register_functions(spark)
    row = spark.sql(
        "SELECT prob_argmax(array(0.4D, 0.4D, 0.2D)) a, predict_label(array(0.1D, 0.65D, 0.25D)) b,"
        " round(prob_uncertainty(array(0.5D, 0.5D)), 6) c, prob_margin(array(1D)) d,"
        " round(score_entropy(array(0.5D, 0.5D)), 6) e, score_least_confidence(array(0.25D, 0.75D)) f"
    ).first()
    assert tuple(row) == (0, "neutral", round(math.log(2) + 1, 6), 1.0, round(math.log(2), 6), 0.25)
