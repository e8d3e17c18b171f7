"""Queries over class probabilities: scoring, selection, metrics, weights, label merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import metrics, scoring, selection
from ..operators.conform import ensure_label
from ..plans.jobs import gold_records, human_gold, labelling_queue
from ..runtime import stored_table
from . import views
from .registry import query
from .views import ctes, reviews, sql_letter_scores, sql_stars, sql_words, table

_LABEL = sql_stars("rating")
# Class weights used by the loss queries.
WEIGHTS = (1.5, 0.9, 0.6)
THRESHOLDS = (0.4, 0.5, 0.65, 0.8)


def _rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


@query(
    "softmax",
    ctes("scored")
    + "SELECT id, round(p_neg, 6) AS p_neg, round(p_neu, 6) AS p_neu, round(p_pos, 6) AS p_pos"
    " FROM scored",
)
def softmax(spark, sf_dir):
    p = fn.softmax(F.array("z0", "z1", "z2"))
    rows = views.logits(spark, sf_dir).select("id", p.alias("p"))
    return rows.select(
        "id",
        *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p_neg", "p_neu", "p_pos"))],
    )


def _tied(spark, sf_dir):
    """Probabilities with many exact ties."""
    step = F.size(F.filter("embedding", lambda x: x > 0)) % 4
    step = step.cast("double")
    p = F.array(step / 10, F.lit(0.2), F.lit(0.8) - step / 10)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), p.alias("probs"))


@query(
    "argmax",
    """SELECT vec_id AS id, CASE WHEN step / 10 >= 0.2 AND step / 10 >= 0.8 - step / 10
       THEN 0 WHEN 0.2 >= 0.8 - step / 10 THEN 1 ELSE 2 END AS pred_label
FROM (SELECT vec_id, len([x FOR x IN embedding IF x > 0]) % 4 AS step FROM embeddings)""",
)
def argmax(spark, sf_dir):
    return _tied(spark, sf_dir).select("id", fn.argmax("probs").alias("pred_label"))


@query(
    "predict_abstain",
    ctes("measured")
    + """SELECT id, CASE WHEN conf < 0.65 THEN 'abstain' WHEN pred_label = 0 THEN 'negative'
       WHEN pred_label = 1 THEN 'neutral' ELSE 'positive' END AS label,
       round(conf, 6) AS confidence, round(p_neg, 6) AS p_neg, round(p_neu, 6) AS p_neu,
       round(p_pos, 6) AS p_pos FROM measured""",
)
def predict_abstain(spark, sf_dir):
    rows = scoring.predict(views.scored(spark, sf_dir))
    return _rounded(
        rows.select("id", "label", "confidence", "p_neg", "p_neu", "p_pos"),
        "confidence", "p_neg", "p_neu", "p_pos",
    )


@query("entropy", ctes("measured") + "SELECT id, round(h, 6) AS entropy FROM measured")
def entropy(spark, sf_dir):
    return views.scored(spark, sf_dir).select("id", F.round(fn.entropy("probs"), 6).alias("entropy"))


@query("margin", ctes("measured") + "SELECT id, round(conf - mid, 6) AS margin FROM measured")
def margin(spark, sf_dir):
    return views.scored(spark, sf_dir).select("id", F.round(fn.margin("probs"), 6).alias("margin"))


@query(
    "uncertainty",
    ctes("measured") + "SELECT id, round(h + 1 - (conf - mid), 6) AS uncertainty FROM measured",
)
def uncertainty(spark, sf_dir):
    return views.scored(spark, sf_dir).select(
        "id", F.round(fn.uncertainty("probs"), 6).alias("uncertainty")
    )


def _batch(spark, sf_dir, strategy):
    rows = views.scored(spark, sf_dir)
    for name in ("text", "title", "asin", "product_category"):
        rows = rows.withColumn(name, F.lit(""))
    return selection.prepare_batch(rows, 60, strategy).select("id", "label")


def _batch_sql(score: str) -> str:
    return ctes("measured") + f"SELECT id, '' AS label FROM measured ORDER BY {score} DESC, id LIMIT 60"


@query("select_least_confidence", _batch_sql("1 - conf"))
def select_least_confidence(spark, sf_dir):
    return _batch(spark, sf_dir, "least_confidence")


@query("select_margin", _batch_sql("-(conf - mid)"))
def select_margin(spark, sf_dir):
    return _batch(spark, sf_dir, "margin")


@query("select_entropy", _batch_sql("h_batch"))
def select_entropy(spark, sf_dir):
    return _batch(spark, sf_dir, "entropy")


def _candidates(spark, sf_dir):
    return selection.candidate_rows(views.scored(spark, sf_dir)).withColumn("seq", F.col("id"))


_TOPK = (
    ctes("measured")
    + """SELECT id, pred_label, round(h + 1 - (conf - mid), 6) AS uncertainty FROM measured
ORDER BY h + 1 - (conf - mid) DESC, id LIMIT 80"""
)
_TOPK_CLASS = (
    ctes("measured")
    + """SELECT id, pred_label, round(h + 1 - (conf - mid), 6) AS uncertainty FROM measured
QUALIFY row_number() OVER (PARTITION BY pred_label ORDER BY h + 1 - (conf - mid) DESC, id)
        <= [30, 0, 20][pred_label + 1]"""
)


def _top(rows):
    return _rounded(rows.select("id", "pred_label", "uncertainty"), "uncertainty")


@query("topk_uncertain", _TOPK)
def topk_uncertain(spark, sf_dir):
    return _top(selection.top_k(_candidates(spark, sf_dir), "uncertainty", 80))


@query("topk_uncertain_histogram", _TOPK)
def topk_uncertain_histogram(spark, sf_dir):
    return _top(selection.top_k(_candidates(spark, sf_dir), "uncertainty", 80))


@query("topk_per_class", _TOPK_CLASS)
def topk_per_class(spark, sf_dir):
    return _top(selection.top_k_per_class(_candidates(spark, sf_dir), "uncertainty", [30, 0, 20]))


@query("topk_per_class_histogram", _TOPK_CLASS)
def topk_per_class_histogram(spark, sf_dir):
    rows = selection.top_k_per_class(
        _candidates(spark, sf_dir), "uncertainty", [30, 0, 20]
    )
    return _top(rows)


_POOL = (
    ctes("firsts", "toxic_ids")[:-1]
    + f""",
pool AS (
  SELECT * FROM firsts WHERE id NOT IN (SELECT id FROM toxic_ids) AND {sql_words('text')} >= 5)"""
)
_CHOSEN = (
    _POOL
    + """,
capped AS (
  SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY product_category ORDER BY seq) <= 40),
chosen AS (SELECT * FROM capped ORDER BY seq LIMIT 600),
"""
    + sql_letter_scores("chosen")
)


def _select(spark, sf_dir, **options):
    rows = selection.select_uncertain(
        reviews(spark, sf_dir, False),
        scoring.expression_scorer(views.letter_logits),
        blocked=views.toxic_ids(spark, sf_dir),
        words=5,
        **options,
    )
    return rows.select(
        "id", "seq", "text", "title", "asin", "product_category", "rating", "pred_label",
        F.round("uncertainty", 6).alias("uncertainty"),
    )


_PICKED = """
SELECT id, seq, text, title, asin, product_category, rating, pred_label,
       round(uncertainty, 6) AS uncertainty FROM letter_scored
"""


@query(
    "select_uncertain",
    _POOL + ",\n" + sql_letter_scores("pool") + _PICKED
    + "QUALIFY row_number() OVER (PARTITION BY pred_label ORDER BY uncertainty DESC, seq)"
    " <= [30, 50, 20][pred_label + 1]",
)
def select_uncertain(spark, sf_dir):
    return _select(spark, sf_dir, quotas=[30, 50, 20])


@query(
    "select_uncertain_capped",
    _CHOSEN + _PICKED + "ORDER BY uncertainty DESC, seq LIMIT 100",
)
def select_uncertain_capped(spark, sf_dir):
    return _select(spark, sf_dir, k=100, per_category=40, total=600)


@query(
    "score_pool",
    ctes("reviews")[:-1] + ",\n" + sql_letter_scores("reviews")
    + """
SELECT seq, round(p_neg, 6) AS p_neg, round(p_neu, 6) AS p_neu, round(p_pos, 6) AS p_pos
FROM letter_scored""",
)
def score_pool(spark, sf_dir):
    rows = scoring.score(
        reviews(spark, sf_dir, False), scoring.expression_scorer(views.letter_logits)
    )
    return _rounded(rows.select("seq", "p_neg", "p_neu", "p_pos"), "p_neg", "p_neu", "p_pos")


@query(
    "score_pool_pandas",
    ctes("reviews")[:-1] + ",\n" + sql_letter_scores("reviews")
    + """
SELECT seq, round(p_neg, 6) AS p_neg, round(p_neu, 6) AS p_neu, round(p_pos, 6) AS p_pos
FROM letter_scored""",
)
def score_pool_pandas(spark, sf_dir):
    letters = views.LETTERS

    def load_model():
        import numpy as np

        def run(texts):
            size = texts.str.len().to_numpy() + 1
            z = np.stack([w * texts.str.count(c).to_numpy() / size for c, w in letters], axis=1)
            powers = np.exp(z - z.max(axis=1, keepdims=True))
            return powers / powers.sum(axis=1, keepdims=True)

        return run

    rows = scoring.score(reviews(spark, sf_dir, False), scoring.pandas_scorer(load_model))
    return _rounded(rows.select("seq", "p_neg", "p_neu", "p_pos"), "p_neg", "p_neu", "p_pos")


@query(
    "instance_weights",
    ctes("measured")
    + """SELECT id, round((0.3 + 0.7 * conf) * CASE WHEN pred_label = label THEN 1 ELSE 0.5 END
       * CASE WHEN rating = 3 THEN 0.8 ELSE 1 END, 6) AS sample_weight FROM measured""",
)
def instance_weights(spark, sf_dir):
    rows = scoring.weight_rows(views.scored(spark, sf_dir))
    return _rounded(rows.select("id", "sample_weight"), "sample_weight")


_LOSS = "-ln([p_neg, p_neu, p_pos][label + 1])"


@query(
    "weighted_loss",
    ctes("measured")
    + f"""SELECT count(*) AS rows, round(avg({_LOSS} * {list(WEIGHTS)}[label + 1] * rating), 6) AS loss
FROM measured""",
)
def weighted_loss(spark, sf_dir):
    rows = views.scored(spark, sf_dir)
    return _rounded(metrics.mean_loss(rows, "probs", "label", WEIGHTS, "rating"), "loss")


@query(
    "logit_loss",
    ctes("measured") + f"SELECT id, round({_LOSS}, 6) AS loss FROM measured",
)
def logit_loss(spark, sf_dir):
    z = F.array("z0", "z1", "z2")
    return views.logits(spark, sf_dir).select(
        "id", F.round(fn.cross_entropy_from_logits(z, "label"), 6).alias("loss")
    )


_F1 = """f1 AS (
  SELECT c.label, 2.0 * count(*) FILTER (m.label = c.label AND m.pred_label = c.label)
         / (count(*) FILTER (m.label = c.label) + count(*) FILTER (m.pred_label = c.label)) AS f1
  FROM (SELECT label FROM measured UNION SELECT pred_label FROM measured) c, measured m
  GROUP BY c.label)"""


@query(
    "metrics",
    ctes("measured")[:-1]
    + f""",
{_F1}
SELECT count(*) AS rows, round(avg(CAST(label = pred_label AS DOUBLE)), 6) AS accuracy,
       (SELECT round(avg(f1), 6) FROM f1) AS f1_macro,
       round(avg({_LOSS} * {list(WEIGHTS)}[label + 1]), 6) AS loss FROM measured""",
)
def evaluate(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    report = metrics.evaluate(rows, probs="probs", class_weights=WEIGHTS)
    return _rounded(report.drop("confusion_matrix"), "accuracy", "f1_macro", "loss")


@query(
    "confusion_matrix",
    ctes("measured")[:-1]
    + """,
present AS (SELECT label FROM measured UNION SELECT pred_label FROM measured)
SELECT t.label, p.label AS pred_label, count(m.id) AS rows
FROM present t CROSS JOIN present p
LEFT JOIN measured m ON m.label = t.label AND m.pred_label = p.label GROUP BY ALL""",
)
def confusion(spark, sf_dir):
    return metrics.confusion_matrix(_candidates(spark, sf_dir))


@query(
    "abstain_coverage",
    ctes("measured")
    + f"""SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (conf >= t) AS answered,
       round(count(*) FILTER (conf >= t) / count(*), 6) AS coverage,
       round(1 - count(*) FILTER (conf >= t) / count(*), 6) AS abstain_rate,
       round(coalesce(count(*) FILTER (conf >= t AND label = pred_label)
             / nullif(count(*) FILTER (conf >= t), 0), 0), 6) AS answered_accuracy
FROM measured, (SELECT unnest({list(THRESHOLDS)}) AS t) GROUP BY t""",
)
def abstain_coverage(spark, sf_dir):
    rows = metrics.coverage(views.scored(spark, sf_dir), THRESHOLDS)
    return _rounded(rows, "coverage", "abstain_rate", "answered_accuracy")


@query(
    "latency_summary",
    """SELECT event_type, count(value) AS rows, round(avg(value), 6) AS mean,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY event_type""",
)
def latency_summary(spark, sf_dir):
    rows = metrics.latency_summary(table(spark, sf_dir, "events"), "event_type", "value")
    return _rounded(rows, "mean", "p50", "p95")


@query(
    "merge_labels",
    ctes("human_labels", "reviews")
    + f"""SELECT seq, coalesce(CASE lower(trim(h.label)) WHEN 'neg' THEN 0 WHEN 'neu' THEN 1
       WHEN 'positive' THEN 2 END, {_LABEL}) AS label,
       CASE WHEN h.label IS NULL OR h.label = '7' THEN 'pool' ELSE 'human' END AS label_source
FROM reviews LEFT JOIN human_labels h USING (seq)""",
)
def merge_labels(spark, sf_dir):
    pool = ensure_label(reviews(spark, sf_dir, False))
    merged = selection.merge_human_labels(pool, views.human_labels(spark, sf_dir), key="seq")
    return merged.select("seq", "label", "label_source")


@query(
    "quarantine_labels",
    ctes("human_labels") + "SELECT seq, label FROM human_labels WHERE label = '7'",
)
def quarantine_labels(spark, sf_dir):
    return selection.quarantine_labels(views.human_labels(spark, sf_dir))


def _answered(spark, sf_dir):
    """Reviews with a human label as a labelling tool would hand them back."""
    human = views.human_labels(spark, sf_dir)
    return reviews(spark, sf_dir).join(human, "seq")


@query(
    "gold_records",
    ctes("human_labels", "reviews")
    + """SELECT id, text, asin, rating, -1 AS pred_label, 0.0::DOUBLE AS uncertainty,
       CASE lower(trim(h.label)) WHEN 'neg' THEN 0 WHEN 'neu' THEN 1 WHEN 'positive' THEN 2 END
         AS label
FROM reviews JOIN human_labels h USING (seq)""",
)
def gold_query(spark, sf_dir):
    rows = gold_records(_answered(spark, sf_dir))
    return rows.select("id", "text", "asin", "rating", "pred_label", "uncertainty", "label")


@query(
    "human_gold",
    ctes("human_labels", "reviews")
    + """SELECT text, asin, CASE lower(trim(h.label)) WHEN 'neg' THEN 0 WHEN 'neu' THEN 1
       ELSE 2 END AS label
FROM reviews JOIN human_labels h USING (seq) WHERE h.label <> '7'""",
)
def human_gold_query(spark, sf_dir):
    return human_gold(_answered(spark, sf_dir))


@query(
    "labelling_queue",
    ctes("eval_side")
    + f"""SELECT seq, id, {_LABEL} AS default_label FROM reviews
WHERE id NOT IN (SELECT id FROM eval_side) AND {sql_words("title || '  ' || text")} >= 40""",
)
def labelling_queue_query(spark, sf_dir):
    queue = labelling_queue(reviews(spark, sf_dir), views.eval_side(spark, sf_dir), words=40)
    return queue.select("seq", "id", "default_label")


@query(
    "agreement_filter",
    ctes("measured") + "SELECT id, label FROM measured WHERE pred_label = label",
)
def agreement_filter(spark, sf_dir):
    from ..operators.filters import agreeing_rows

    return agreeing_rows(_candidates(spark, sf_dir)).select("id", "label")


@query(
    "token_counts",
    f"SELECT doc_id AS seq, CAST({sql_words('text')} AS INTEGER) AS tokens FROM documents",
)
def token_counts(spark, sf_dir):
    tokenizer = scoring.text_features()[0]
    rows = tokenizer.transform(reviews(spark, sf_dir, False).select("seq", "text"))
    return rows.select("seq", F.size("tokens").alias("tokens"))


@query(
    "merge_training_rows",
    ctes("train_side", "eval_side", "toxic_ids", "human_labels")[:-1]
    + f""",
base AS (
  SELECT id, {_LABEL} AS label FROM train_side
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
answers AS (
  SELECT id, h.label AS spelling, r.seq % 3 AS batch
  FROM reviews r JOIN human_labels h USING (seq)
  UNION ALL
  SELECT id, 'neu' AS spelling, 1 AS batch FROM base WHERE id < '4'),
readable AS (
  SELECT id, batch, CASE lower(trim(spelling)) WHEN 'neg' THEN 0 WHEN 'neu' THEN 1
         WHEN 'positive' THEN 2 END AS label
  FROM answers WHERE spelling <> '7'),
newest AS (
  SELECT id, label FROM readable
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch DESC, label) = 1)
SELECT coalesce(b.id, n.id) AS id, coalesce(n.label, b.label) AS label,
       CASE WHEN n.id IS NULL THEN 'train' ELSE 'human' END AS label_source
FROM base b FULL JOIN newest n ON b.id = n.id
WHERE coalesce(b.id, n.id) NOT IN (SELECT id FROM toxic_ids)""",
)
def merge_training_rows_query(spark, sf_dir):
    """Human rows that train has and that it lacks, some with several answers for one id."""
    from ..plans.jobs import merge_training_rows

    train = views.train_side(spark, sf_dir)
    columns = ("id", "text", "rating", "title", "asin", "product_category")
    answers = _answered(spark, sf_dir).select(*columns, "label", (F.col("seq") % 3).alias("batch"))
    known = train.filter("id < '4'").select(
        *columns, F.lit("neu").alias("label"), F.lit(1).cast("bigint").alias("batch")
    )
    merged = merge_training_rows(
        train, answers.unionByName(known), views.toxic_ids(spark, sf_dir), batch="batch"
    )
    return merged.select("id", "label", "label_source")


# Model fits are iterative. SQL states which rows a fit and its report have to cover, and Spark
# whether the figures hold what they promise. Features and iterations are the defaults. Classes
# come from the language, which can be learned from the words.

_CLASS = "CASE asin WHEN 'en' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END"
_MODEL_SIDES = (
    ctes("train_side", "eval_side")[:-1]
    + """,
dev_side AS (
  SELECT * FROM train_side WHERE seq % 5 = 0 AND id NOT IN (SELECT id FROM eval_side)),
fit_side AS (
  SELECT * FROM train_side WHERE id NOT IN (SELECT id FROM eval_side)
    AND id NOT IN (SELECT id FROM dev_side))
"""
)


@query(
    "featurize",
    f"""SELECT doc_id AS seq, CAST({sql_words('text')} AS INTEGER) AS tokens, true AS all_terms
FROM documents""",
)
def featurize(spark, sf_dir):
    from pyspark.ml import Pipeline

    rows = reviews(spark, sf_dir, False).select("seq", "text")
    features = Pipeline(stages=scoring.text_features()).fit(rows).transform(rows)
    different = F.size(F.array_distinct("tokens"))
    hashed = F.size(F.unwrap_udt("tf")["indices"])  # a few words may share a feature
    fits = (hashed <= different) & (hashed >= F.floor(different * 0.95) - 2)
    return features.select("seq", F.size("tokens").alias("tokens"), fits.alias("all_terms"))


def _sides(spark, sf_dir):
    """Three sides that share no id, with classes that words tell.

    They are stored: fits and metrics read them many times, and ids are computed once.
    """
    from ..operators.filters import drop_blocked

    rest = views.train_side(spark, sf_dir).withColumn("label", F.expr(_CLASS))
    evaluation = stored_table(views.eval_side(spark, sf_dir).withColumn("label", F.expr(_CLASS)))
    rest = stored_table(drop_blocked(rest, evaluation.select("id").distinct()))
    dev = rest.filter("seq % 5 = 0")
    return stored_table(drop_blocked(rest, dev.select("id").distinct())), dev, evaluation


def _largest_share(rows):
    counts = metrics.label_distribution(rows)
    return counts.agg(F.max("rows") / F.sum("rows")).first()[0]


@query(
    "train_evaluate",
    _MODEL_SIDES
    + """SELECT 'dev' AS split, count(*) AS rows, true AS better_than_largest_class FROM dev_side
UNION ALL
SELECT 'eval', count(*), true FROM eval_side""",
)
def train_evaluate(spark, sf_dir):
    from ..plans.jobs import train_and_evaluate

    train, dev, evaluation = _sides(spark, sf_dir)
    _, report = train_and_evaluate(train, dev, evaluation)
    share = F.when(F.col("split") == "dev", _largest_share(dev)).otherwise(_largest_share(evaluation))
    return report.select(
        "split", "rows", (F.col("accuracy") > share).alias("better_than_largest_class")
    )


@query(
    "score_with_model",
    _MODEL_SIDES + "SELECT seq, true AS answered, true AS sums_to_one FROM eval_side",
)
def score_with_model(spark, sf_dir):
    train, _dev, evaluation = _sides(spark, sf_dir)
    model = scoring.train_classifier(train)
    rows = scoring.predict(evaluation.drop("label"), scoring.model_scorer(model), threshold=0.0)
    total = F.col("p_neg") + F.col("p_neu") + F.col("p_pos")
    return rows.select(
        "seq",
        F.col("label").isin("negative", "neutral", "positive").alias("answered"),
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
    )


@query(
    "best_of_grid",
    _MODEL_SIDES
    + """SELECT count(*) AS dev_rows, true AS from_grid, true AS better_than_one_class
FROM dev_side""",
)
def best_of_grid(spark, sf_dir):
    train, dev, _evaluation = _sides(spark, sf_dir)
    grid = [{"reg_param": 0.1}, {"reg_param": 0.01}]
    _, options, f1 = scoring.best_of(train, dev, grid)
    # One class alone reaches a macro-F1 of a third at most.
    return dev.agg(F.count(F.lit(1)).alias("dev_rows")).withColumns(
        {
            "from_grid": F.lit(options["reg_param"] in (0.1, 0.01)),
            "better_than_one_class": F.lit(f1 > 1 / 3),
        }
    )


@query(
    "retrain",
    _MODEL_SIDES
    + "SELECT count(*) AS rows, true AS better_than_largest_class FROM eval_side",
)
def retrain_query(spark, sf_dir):
    """Every third row of the fit side comes back as a human answer instead."""
    from ..plans.jobs import retrain

    train, _dev, evaluation = _sides(spark, sf_dir)
    names = F.element_at(F.array(*map(F.lit, ("neg", "neu", "pos"))), F.col("label") + 1)
    human = train.filter("seq % 3 = 0").withColumn("label", names)
    _, report = retrain(
        train.filter("seq % 3 <> 0"),
        human,
        evaluation,
        scoring.expression_scorer(views.letter_logits),
    )
    better = F.col("accuracy") > _largest_share(evaluation)
    return report.select("rows", better.alias("better_than_largest_class"))
