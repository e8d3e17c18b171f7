"""Review-like views over the test tables, in Spark and as DuckDB common table expressions.

``documents`` plays the review table: ``doc_id`` is the arrival number, ``lang`` the asin,
``source`` the category. The stars follow from ``doc_id``. ``labels`` marks which reviews are
blocked (toxic) and which belong to the eval side (those that have a label row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.probs import softmax3
from ..functions.text import WHITESPACE_CLASS, stable_id
from ..runtime import compute_once

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_reviews(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("seq"),
        "text",
        (1 + F.col("doc_id") % 5).cast("double").alias("rating"),
        F.concat("source", F.lit(" / "), "lang").alias("title"),
        F.col("lang").alias("asin"),
        F.col("source").alias("product_category"),
    )


def reviews(spark: SparkSession, sf_dir: str, with_id: bool = True) -> DataFrame:
    rows = documents_as_reviews(table(spark, sf_dir, "documents"))
    return compute_once(rows, "id", stable_id()) if with_id else rows


def _judged(spark: SparkSession, sf_dir: str, condition: str = "true") -> DataFrame:
    chosen = table(spark, sf_dir, "labels").filter(condition)
    return chosen.select(F.col("doc_id").alias("seq"))


def _reviews_where(spark: SparkSession, sf_dir: str, judged: DataFrame, how: str) -> DataFrame:
    # The ids are computed after the join, for the remaining rows only.
    rows = reviews(spark, sf_dir, with_id=False).join(judged, "seq", how)
    return compute_once(rows, "id", stable_id())


def toxic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = _judged(spark, sf_dir, "toxic = 1")
    return _reviews_where(spark, sf_dir, toxic, "left_semi").select("id").distinct()


def train_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews_where(spark, sf_dir, _judged(spark, sf_dir), "left_anti")


def eval_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews_where(spark, sf_dir, _judged(spark, sf_dir), "left_semi")


def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelling = (
        F.when(F.col("toxic") == 1, " NEG ")
        .when(F.col("doc_id") % 7 == 0, "7")
        .when(F.col("quality") == 1, "positive")
        .otherwise("neu")
    )
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("seq"), spelling.alias("label")
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three logits from whole vectors: sums over every third component, from the i-th on."""

    def total(start: int) -> Column:
        part = F.filter("embedding", lambda x, i: i % 3 == start)
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double"))

    z = [(8 * total(start)).alias(f"z{start}") for start in range(3)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") % 3).alias("label"),
        (1 + F.col("vec_id") % 5).cast("double").alias("rating"),
        *z,
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = softmax3(F.col("z0"), F.col("z1"), F.col("z2"))
    rows = logits(spark, sf_dir).select(
        "id", "label", "rating", p[0].alias("p_neg"), p[1].alias("p_neu"), p[2].alias("p_pos")
    )
    return rows.withColumn("probs", F.array("p_neg", "p_neu", "p_pos"))


# Fixed values of the stand-in classifier: one letter and one scale per class.
LETTERS = (("t", 40.0), ("n", 40.0), ("e", 26.0))


def letter_logits(text: Column) -> list[Column]:
    """Stand-in for a trained model: how often three letters occur in the whole text."""
    size = F.length(text) + 1
    return [
        F.lit(scale) * (F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit(""))))
        / size
        for letter, scale in LETTERS
    ]


def events_as_reviews(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat("event_type", F.lit(" "), "props").alias("text"),
        (1 + F.col("event_id") % 5).cast("double").alias("rating"),
        F.lit("").alias("title"),
        F.col("user_id").cast("string").alias("asin"),
        F.col("event_type").alias("product_category"),
    )


# DuckDB side -----------------------------------------------------------------------------

WS = WHITESPACE_CLASS


def sql_norm(text: str) -> str:
    """Strip, collapse and lower-case, step by step."""
    return (
        f"lower(regexp_replace(regexp_replace(regexp_replace({text}, '^{WS}+', ''),"
        f" '{WS}+$', ''), '{WS}+', ' ', 'g'))"
    )


def sql_id(text: str, asin: str) -> str:
    return f"sha1(concat({sql_norm(text)}, chr(1), lower({asin})))"


def sql_words(text: str) -> str:
    norm = sql_norm(text)
    return f"CASE WHEN {norm} = '' THEN 0 ELSE len(string_split({norm}, ' ')) END"


def sql_stars(rating: str) -> str:
    return f"CASE WHEN {rating} <= 2 THEN 0 WHEN {rating} >= 4 THEN 2 ELSE 1 END"


def sql_entropy(eps: str) -> str:
    """Entropy of ``p_neg, p_neu, p_pos`` clipped to [eps, 1]."""
    clipped = [f"least(greatest({p}, {eps}), 1)" for p in ("p_neg", "p_neu", "p_pos")]
    return "-(" + " + ".join(f"{p} * ln({p})" for p in clipped) + ")"


_REVIEWS = f"""reviews AS MATERIALIZED (
  SELECT doc_id AS seq, text, CAST(1 + doc_id % 5 AS DOUBLE) AS rating,
         concat(source, ' / ', lang) AS title, lang AS asin, source AS product_category,
         {sql_id('text', 'lang')} AS id
  FROM documents)"""
_LABEL = sql_stars("rating")
_PARTS = {
    "reviews": _REVIEWS,
    "toxic_ids": """toxic_ids AS (
  SELECT DISTINCT id FROM reviews WHERE seq IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
    "train_side": """train_side AS (
  SELECT * FROM reviews WHERE seq NOT IN (SELECT doc_id FROM labels))""",
    "eval_side": """eval_side AS (
  SELECT * FROM reviews WHERE seq IN (SELECT doc_id FROM labels))""",
    "human_labels": """human_labels AS (
  SELECT doc_id AS seq, CASE WHEN toxic = 1 THEN ' NEG ' WHEN doc_id % 7 = 0 THEN '7'
         WHEN quality = 1 THEN 'positive' ELSE 'neu' END AS label FROM labels)""",
    "firsts": """firsts AS (
  SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)""",
    "logits": """logits AS (
  SELECT vec_id AS id, label % 3 AS label, CAST(1 + vec_id % 5 AS DOUBLE) AS rating,
         8 * list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(1, len(embedding) + 1, 3)]) AS z0,
         8 * list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(2, len(embedding) + 1, 3)]) AS z1,
         8 * list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(3, len(embedding) + 1, 3)]) AS z2
  FROM embeddings)""",
    "scored": """scored AS (
  SELECT id, label, rating, exp(z0 - m) / d AS p_neg, exp(z1 - m) / d AS p_neu,
         exp(z2 - m) / d AS p_pos
  FROM (SELECT *, exp(z0 - m) + exp(z1 - m) + exp(z2 - m) AS d
        FROM (SELECT *, greatest(z0, z1, z2) AS m FROM logits) a) b)""",
    "measured": f"""measured AS (
  SELECT *, greatest(p_neg, p_neu, p_pos) AS conf,
         p_neg + p_neu + p_pos - greatest(p_neg, p_neu, p_pos) - least(p_neg, p_neu, p_pos) AS mid,
         CASE WHEN p_neg >= p_neu AND p_neg >= p_pos THEN 0
              WHEN p_neu >= p_pos THEN 1 ELSE 2 END AS pred_label,
         {sql_entropy("1e-12")} AS h, {sql_entropy("1e-8")} AS h_batch
  FROM scored)""",
    "review_events": f"""review_events AS (
  SELECT event_id AS seq, ts, concat(event_type, ' ', props) AS text,
         CAST(1 + event_id % 5 AS DOUBLE) AS rating, CAST(user_id AS VARCHAR) AS asin,
         event_type AS product_category, value,
         {sql_id("concat(event_type, ' ', props)", "CAST(user_id AS VARCHAR)")} AS id
  FROM events)""",
}
_NEEDS = {
    "toxic_ids": ["reviews"],
    "train_side": ["reviews"],
    "eval_side": ["reviews"],
    "firsts": ["reviews"],
    "scored": ["logits"],
    "measured": ["logits", "scored"],
}


def sql_letter_scores(source: str) -> str:
    """CTEs ``letter_scored``: the stand-in classifier over ``source``, with uncertainty."""
    z = ", ".join(
        f"{scale} * (length(text) - length(replace(text, '{letter}', ''))) / (length(text) + 1)"
        f" AS z{i}"
        for i, (letter, scale) in enumerate(LETTERS)
    )
    return f"""letter_logits AS (SELECT *, {z} FROM {source}),
letter_probs AS (
  SELECT * EXCLUDE (z0, z1, z2, m, d), exp(z0 - m) / d AS p_neg, exp(z1 - m) / d AS p_neu,
         exp(z2 - m) / d AS p_pos
  FROM (SELECT *, exp(z0 - m) + exp(z1 - m) + exp(z2 - m) AS d
        FROM (SELECT *, greatest(z0, z1, z2) AS m FROM letter_logits) a) b),
letter_scored AS (
  SELECT *, list_sort([p_neg, p_neu, p_pos], 'DESC') AS ranked,
         CASE WHEN p_neg >= p_neu AND p_neg >= p_pos THEN 0
              WHEN p_neu >= p_pos THEN 1 ELSE 2 END AS pred_label,
         -(p_neg * ln(p_neg) + p_neu * ln(p_neu) + p_pos * ln(p_pos))
           + (1 - (ranked[1] - ranked[2])) AS uncertainty
  FROM letter_probs)"""


def ctes(*names: str, extra: str = "") -> str:
    """``WITH`` clause with the named views and what they need, plus ``extra`` definitions."""
    order: list[str] = []
    for name in names:
        for part in [*_NEEDS.get(name, []), name]:
            if part not in order:
                order.append(part)
    parts = [_PARTS[name] for name in order] + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n"
