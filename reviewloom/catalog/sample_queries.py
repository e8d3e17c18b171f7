"""Queries that filter by ids, drop copies, sample, split and compare sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, filters, leakage, metrics, sampling, sketches, validate
from ..runtime import stored_table
from ..sources.writers import snapshot_rows
from . import views
from .registry import query
from .views import SEED, ctes, reviews, sql_stars, sql_words

_LABEL = sql_stars("rating")
_HASH = f"md5(concat(id, ':{SEED}'))"
_ROW_HASH = f"md5(concat(id, ':', seq, ':{SEED}'))"


@query(
    "drop_blocked",
    ctes("toxic_ids")
    + "SELECT seq, id FROM reviews WHERE id NOT IN (SELECT id FROM toxic_ids)",
)
def drop_blocked(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("seq", "id")
    return filters.drop_blocked(rows, views.toxic_ids(spark, sf_dir))


@query(
    "drop_blocked_filter",
    ctes("toxic_ids")
    + "SELECT seq, id FROM reviews WHERE id NOT IN (SELECT id FROM toxic_ids)",
)
def drop_blocked_filter(spark, sf_dir):
    rows = stored_table(reviews(spark, sf_dir).select("seq", "id"))
    blocked = stored_table(views.toxic_ids(spark, sf_dir))
    return filters.drop_blocked(rows, blocked, by_filter=True)


@query(
    "drop_labelled",
    ctes("eval_side")
    + "SELECT seq, id FROM reviews WHERE id NOT IN (SELECT id FROM eval_side)",
)
def drop_labelled(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("seq", "id")
    return filters.drop_labelled(rows, views.eval_side(spark, sf_dir))


@query("dedup", ctes("firsts") + "SELECT seq, id, rating, title, text FROM firsts")
def dedup_query(spark, sf_dir):
    rows = dedup.dedup_keep_first(reviews(spark, sf_dir))
    return rows.select("seq", "id", "rating", "title", "text")


@query("dedup_narrow", ctes("firsts") + f"SELECT seq, id, {_LABEL} AS label FROM firsts")
def dedup_narrow(spark, sf_dir):
    from ..functions import label_from_rating

    rows = reviews(spark, sf_dir).select("seq", "id", label_from_rating().alias("label"))
    return dedup.first_arrivals(rows, carry=["label"])


@query(
    "head_rows",
    "SELECT doc_id AS seq, lang AS asin FROM documents ORDER BY doc_id LIMIT 150",
)
def head_rows(spark, sf_dir):
    return filters.head_rows(reviews(spark, sf_dir, False), 150).select("seq", "asin")


@query(
    "cap_total",
    "SELECT doc_id AS seq, lang AS asin FROM documents ORDER BY doc_id LIMIT 700",
)
def cap_total(spark, sf_dir):
    rows = filters.head_rows(reviews(spark, sf_dir, False), 700)
    return rows.select("seq", "asin")


@query(
    "sample_uniform",
    ctes("reviews") + f"SELECT seq, id FROM reviews ORDER BY {_ROW_HASH}, id, seq LIMIT 120",
)
def sample_uniform(spark, sf_dir):
    rows = reviews(spark, sf_dir).select("seq", "id")
    return filters.sample_rows(rows, 120, SEED, key=("id", "seq"))


_CAPPED = """SELECT doc_id AS seq, source AS product_category FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10"""


@query("cap_per_category", _CAPPED)
def cap_per_category(spark, sf_dir):
    rows = reviews(spark, sf_dir, False).select("seq", "product_category")
    return filters.cap_per_group(rows, 10)


@query("cap_per_category_histogram", _CAPPED)
def cap_per_category_histogram(spark, sf_dir):
    rows = reviews(spark, sf_dir, False).select("seq", "product_category")
    return filters.cap_per_group(rows, 10)


@query(
    "snapshot_rows",
    """SELECT doc_id AS seq, text, CAST(1 + doc_id % 5 AS INTEGER) AS rating,
       source AS product_category, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank
FROM documents QUALIFY rank <= 25""",
)
def snapshot_query(spark, sf_dir):
    rows = snapshot_rows(reviews(spark, sf_dir, False), 25)
    return rows.select("seq", "text", "rating", "product_category", "rank")


_ACCEPTED = (
    ctes("firsts", "toxic_ids")[:-1]
    + f""",
accepted AS (
  SELECT *, {_LABEL} AS label FROM firsts
  WHERE id NOT IN (SELECT id FROM toxic_ids) AND {sql_words('text')} >= 3)
"""
)
_BALANCED = (
    _ACCEPTED
    + f"""SELECT seq, id, label, rating, text, asin, product_category FROM accepted
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_HASH}, id) <= 100"""
)


def _balanced(spark, sf_dir):
    rows = sampling.balanced_train(
        reviews(spark, sf_dir, False),
        per_class=100,
        seed=SEED,
        blocked=views.toxic_ids(spark, sf_dir),
        words=3,
    )
    return rows.select("seq", "id", "label", "rating", "text", "asin", "product_category")


@query("balanced_train", _BALANCED)
def balanced_train(spark, sf_dir):
    return _balanced(spark, sf_dir)


@query("balanced_train_histogram", _BALANCED)
def balanced_train_histogram(spark, sf_dir):
    return _balanced(spark, sf_dir)


def _labelled(spark, sf_dir):
    """Reviews whose label is unknown for one star value, so that a stratum is NULL."""
    label = F.when(F.col("rating") != 4, F.expr("CASE WHEN rating <= 2 THEN 0"
                                                " WHEN rating >= 4 THEN 2 ELSE 1 END"))
    return reviews(spark, sf_dir).select("seq", "id", label.alias("label"))


_LABELLED = (
    ctes("reviews")[:-1]
    + f""",
labelled AS (SELECT seq, id, CASE WHEN rating <> 4 THEN {_LABEL} END AS label FROM reviews),
totals AS (SELECT count(*) AS total FROM labelled),
shares AS (
  SELECT label, count(*) AS rows, any_value(total) AS total,
         (count(*) * 101) // any_value(total) AS base, (count(*) * 101) % any_value(total) AS part
  FROM labelled, totals WHERE label IS NOT NULL GROUP BY label),
seats AS (
  SELECT label, rows, CAST(base + CASE WHEN row_number() OVER (ORDER BY part DESC, label)
         <= 101 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats FROM shares)
"""
)


@query("quota_allocation", _LABELLED + "SELECT label, rows, seats FROM seats")
def quota_allocation(spark, sf_dir):
    counts = metrics.label_distribution(_labelled(spark, sf_dir))
    return sampling.allocate_quota(counts, 101).drop("total")


@query(
    "sample_stratified",
    _LABELLED
    + f""", drawn AS (
  SELECT seq, id, label FROM labelled JOIN seats USING (label)
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_ROW_HASH}, id, seq) <= seats),
filled AS (
  SELECT seq, id, label FROM labelled WHERE seq NOT IN (SELECT seq FROM drawn)
  QUALIFY row_number() OVER (ORDER BY {_ROW_HASH}, id, seq) <= 101 - (SELECT sum(seats) FROM seats))
SELECT * FROM drawn UNION ALL SELECT * FROM filled""",
)
def sample_stratified(spark, sf_dir):
    return sampling.sample_stratified(_labelled(spark, sf_dir), 101, SEED, key=("id", "seq"))


_SPLIT = (
    _ACCEPTED[: _ACCEPTED.rindex("accepted AS")]
    + f"""accepted AS (SELECT * FROM firsts WHERE id NOT IN (SELECT id FROM toxic_ids)),
split AS (
  SELECT seq, id, product_category, text,
         CASE WHEN row_number() OVER (PARTITION BY product_category ORDER BY {_HASH}, id) <= 5
              THEN 'dev' ELSE 'eval' END AS split
  FROM accepted
  QUALIFY row_number() OVER (PARTITION BY product_category ORDER BY {_HASH}, id) <= 20)
"""
)


def _split(spark, sf_dir):
    return sampling.split_dev_eval(
        reviews(spark, sf_dir, False),
        5,
        15,
        SEED,
        blocked=views.toxic_ids(spark, sf_dir),
    )


@query("split_dev_eval", _SPLIT + "SELECT seq, id, product_category, text, split FROM split")
def split_dev_eval(spark, sf_dir):
    return _split(spark, sf_dir).select("seq", "id", "product_category", "text", "split")


@query(
    "split_dev_eval_histogram",
    _SPLIT + "SELECT seq, id, product_category, text, split FROM split",
)
def split_dev_eval_histogram(spark, sf_dir):
    rows = _split(spark, sf_dir)
    return rows.select("seq", "id", "product_category", "text", "split")


@query(
    "split_diagnostics",
    _SPLIT
    + """SELECT a.product_category, a.seen, coalesce(d.dev_rows, 0) AS dev_rows,
       coalesce(d.eval_rows, 0) AS eval_rows,
       coalesce(d.dev_rows, 0) < 5 OR coalesce(d.eval_rows, 0) < 15 AS short
FROM (SELECT product_category, count(*) AS seen FROM accepted GROUP BY 1) a
LEFT JOIN (SELECT product_category, count(*) FILTER (split = 'dev') AS dev_rows,
                  count(*) FILTER (split = 'eval') AS eval_rows FROM split GROUP BY 1) d
  USING (product_category)""",
)
def split_diagnostics(spark, sf_dir):
    rows = reviews(spark, sf_dir, False)
    accepted = sampling.split_candidates(rows, blocked=views.toxic_ids(spark, sf_dir))
    accepted = stored_table(accepted)  # the ids of all texts are computed once
    split = sampling.split_dev_eval(rows, 5, 15, SEED, candidates=accepted)
    return sampling.split_diagnostics(accepted, split, 5, 15)


@query(
    "split_check",
    _SPLIT
    + """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS null_rows,
       CAST(0 AS BIGINT) AS rating_out_of_range, count(*) FILTER (length(text) = 0) AS empty_texts
FROM split""",
)
def split_check(spark, sf_dir):
    return validate.check_split(_split(spark, sf_dir))


@query(
    "leakage_report",
    ctes("train_side", "eval_side")
    + """SELECT (SELECT count(DISTINCT id) FROM train_side) AS train_unique,
       (SELECT count(DISTINCT id) FROM eval_side) AS eval_rows,
       (SELECT count(DISTINCT id) FROM train_side WHERE id IN (SELECT id FROM eval_side)) AS shared""",
)
def leakage_report(spark, sf_dir):
    return leakage.leakage_report(views.train_side(spark, sf_dir), views.eval_side(spark, sf_dir))


@query(
    "leakage_sketches",
    ctes("train_side", "eval_side")
    + """SELECT (SELECT count(DISTINCT id) FROM train_side) AS train_unique,
       (SELECT count(DISTINCT id) FROM eval_side) AS eval_rows,
       (SELECT count(DISTINCT id) FROM train_side WHERE id IN (SELECT id FROM eval_side)) AS shared""",
)
def leakage_sketches(spark, sf_dir):
    """Exact at these sizes, since a sketch holds 65,536 ids."""
    sides = [views.train_side(spark, sf_dir), views.eval_side(spark, sf_dir)]
    shards = [stored_table(sketches.id_sketches(rows, "product_category")) for rows in sides]
    return sketches.approx_leakage_report(*shards)


@query(
    "distinct_sketches",
    ctes("reviews")
    + "SELECT product_category, count(DISTINCT id) AS ids FROM reviews GROUP BY ALL",
)
def distinct_sketches(spark, sf_dir):
    fine = sketches.id_sketches(reviews(spark, sf_dir), "product_category", "asin")
    merged = sketches.merge_sketches(stored_table(fine), "product_category")
    return merged.select("product_category", sketches.distinct_estimate().alias("ids"))


@query(
    "leakage_ids",
    ctes("train_side", "eval_side")
    + "SELECT id FROM train_side INTERSECT SELECT id FROM eval_side",
)
def leakage_ids(spark, sf_dir):
    return leakage.leakage_ids(views.train_side(spark, sf_dir), views.eval_side(spark, sf_dir))


@query(
    "blocklist",
    ctes("toxic_ids", "eval_side")
    + "SELECT id FROM toxic_ids UNION SELECT id FROM eval_side",
)
def blocklist(spark, sf_dir):
    return filters.union_id_sets(
        views.toxic_ids(spark, sf_dir), views.eval_side(spark, sf_dir).select("id")
    )


@query(
    "label_distribution",
    ctes("train_side", "eval_side")
    + f"""SELECT 'train' AS split, {_LABEL} AS label, count(*) AS rows FROM train_side GROUP BY ALL
UNION ALL SELECT 'eval' AS split, {_LABEL} AS label, count(*) AS rows FROM eval_side GROUP BY ALL""",
)
def label_distribution(spark, sf_dir):
    from ..operators.conform import ensure_label

    sides = views.train_side(spark, sf_dir).withColumn("split", F.lit("train")).unionByName(
        views.eval_side(spark, sf_dir).withColumn("split", F.lit("eval"))
    )
    return metrics.label_distribution(ensure_label(sides), "split", "label")


@query(
    "class_weights",
    ctes("reviews")
    + f""", counts AS (
  SELECT c.label, count(r.seq) AS rows, 1.0 / greatest(count(r.seq), 1) AS inverse
  FROM (VALUES (0), (1), (2)) c(label)
  LEFT JOIN (SELECT seq, {_LABEL} AS label FROM reviews) r USING (label) GROUP BY c.label)
SELECT label, rows, round(inverse / avg(inverse) OVER (), 6) AS weight FROM counts""",
)
def class_weights(spark, sf_dir):
    from ..operators.conform import ensure_label

    weights = metrics.class_weights(ensure_label(reviews(spark, sf_dir, False)))
    return weights.withColumn("weight", F.round("weight", 6))
