"""Queries over single rows: schema, text, labels, casts, validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import conform as schema_ops
from ..operators import validate
from ..operators.filters import category_filter, min_words
from ..sources import writers
from ..sources.readers import mixed_texts, unnest_requests
from . import views
from .registry import query
from .views import SEED, WS, ctes, reviews, sql_norm, sql_stars, sql_words, table

# Rating spellings by position: plain, padded, suffixed, not a number, empty and so on.
RATING_TEXTS = ["4", "4.0", " 4 ", "4d", "abc", "1e1", "0x10", "", "2.5", "3.5", "-1", ".5", "1_0"]


def _messy(spark, sf_dir):
    texts = F.array(*[F.lit(t) for t in RATING_TEXTS])
    position = (F.col("doc_id") % len(RATING_TEXTS)).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("doc_id") % 9 > 0, F.col("text")).alias("text"),
        F.get(texts, position).alias("rating"),
        F.col("lang").alias("asin"),
        F.col("source").alias("extra"),
    )


_TEXT_LIST = "[" + ", ".join(f"'{t}'" for t in RATING_TEXTS) + "]"
_MESSY = f"""messy AS (
  SELECT doc_id AS seq, CASE WHEN doc_id % 9 > 0 THEN text END AS text,
         {_TEXT_LIST}[CAST(doc_id % {len(RATING_TEXTS)} AS INTEGER) + 1] AS rating, lang AS asin
  FROM documents),
numbers AS (
  SELECT *, CASE WHEN regexp_matches(rating, '^{WS}*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?{WS}*$')
                 THEN TRY_CAST(trim(rating) AS DOUBLE) END AS number
  FROM messy)"""


@query(
    "conform",
    f"""WITH {_MESSY}
SELECT seq, coalesce(text, '') AS text, coalesce(number, 0.0) AS rating, '' AS title,
       coalesce(asin, '') AS asin, '' AS product_category,
       {sql_stars('coalesce(number, 0.0)')} AS label
FROM numbers""",
)
def conform(spark, sf_dir):
    return schema_ops.conform_schema(_messy(spark, sf_dir), with_label=True, keep=("seq",))


@query(
    "safe_cast",
    f"""WITH {_MESSY}
SELECT seq, coalesce(number, 0.0) AS as_float,
       coalesce(CAST(trunc(number) AS INTEGER), -1) AS as_int FROM numbers""",
)
def safe_cast(spark, sf_dir):
    return _messy(spark, sf_dir).select(
        "seq",
        fn.safe_float("rating", 0.0, textual=True).alias("as_float"),
        fn.safe_int("rating", -1, textual=True).alias("as_int"),
    )


@query(
    "default_label",
    f"""WITH {_MESSY}
SELECT seq, CASE WHEN number IS NOT NULL THEN {sql_stars('number')} END AS default_label
FROM numbers""",
)
def default_label(spark, sf_dir):
    return _messy(spark, sf_dir).select(
        "seq", fn.label_or_null("rating", textual=True).alias("default_label")
    )


@query("stable_id", ctes("reviews") + "SELECT seq, id FROM reviews")
def stable_id(spark, sf_dir):
    return reviews(spark, sf_dir).select("seq", "id")


@query(
    "normalize_text",
    f"SELECT doc_id AS seq, {sql_norm('text')} AS normalized,"
    f" regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '') AS stripped FROM documents",
)
def normalize_text(spark, sf_dir):
    return reviews(spark, sf_dir, False).select(
        "seq",
        fn.normalize_text("text").alias("normalized"),
        fn.strip_ws("text").alias("stripped"),
    )


@query(
    "word_count",
    f"SELECT doc_id AS seq, CAST({sql_words('text')} AS INTEGER) AS words FROM documents",
)
def word_count(spark, sf_dir):
    return reviews(spark, sf_dir, False).select("seq", fn.word_count("text").alias("words"))


@query(
    "display_text",
    """SELECT seq, CASE WHEN length(joined) > 400 THEN substr(joined, 1, 400) || ' ...'
                  ELSE joined END AS display_text
FROM (SELECT doc_id AS seq, trim(trim(concat(source, ' / ', lang), WS) || '  ' || trim(text, WS), WS)
             AS joined
      FROM documents, (SELECT array_to_string(list_transform("""
    + str(fn.text.WHITESPACE_CODE_POINTS)
    + ", lambda x: chr(x)), '') AS WS))",
)
def display_text(spark, sf_dir):
    return reviews(spark, sf_dir, False).select("seq", fn.display_text().alias("display_text"))


_RATING = "CASE doc_id % 8 WHEN 6 THEN NULL WHEN 7 THEN 'nan'::DOUBLE ELSE doc_id % 8 END"


def _ratings(spark, sf_dir):
    step = F.col("doc_id") % 8
    stars = F.when(step == 7, F.lit(float("nan"))).when(step < 6, step.cast("double"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), stars.alias("rating"))


@query(
    "label_from_rating",
    f"""SELECT seq, CASE WHEN isnan(rating) THEN 1 WHEN coalesce(rating, 0) <= 2 THEN 0
       WHEN rating >= 4 THEN 2 ELSE 1 END AS label
FROM (SELECT doc_id AS seq, CAST({_RATING} AS DOUBLE) AS rating FROM documents)""",
)
def label_from_rating(spark, sf_dir):
    return _ratings(spark, sf_dir).select("seq", fn.label_from_rating("rating").alias("label"))


@query(
    "rating_to_class",
    f"""SELECT seq, CASE WHEN rating IS NULL OR isnan(rating) OR rating < 1 OR rating > 5 THEN NULL
       WHEN rating <= 2 THEN 0 WHEN rating >= 4 THEN 2 ELSE 1 END AS class_id
FROM (SELECT doc_id AS seq, CAST({_RATING} AS DOUBLE) AS rating FROM documents)""",
)
def rating_to_class(spark, sf_dir):
    return _ratings(spark, sf_dir).select("seq", fn.rating_to_class("rating").alias("class_id"))


@query(
    "class_to_text",
    """SELECT doc_id AS seq, CASE doc_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral'
       WHEN 2 THEN 'positive' ELSE 'unknown' END AS name FROM documents""",
)
def class_to_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), fn.class_to_text(F.col("doc_id") % 4).alias("name")
    )


@query(
    "ensure_label",
    f"""SELECT doc_id AS seq, coalesce(quality, {sql_stars('1 + doc_id % 5')}) AS label
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def ensure_label(spark, sf_dir):
    given = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("seq"), F.col("quality").cast("string").alias("label")
    )
    rows = reviews(spark, sf_dir, False).join(given, "seq", "left")
    return schema_ops.ensure_label(rows).select("seq", "label")


@query(
    "normalize_label",
    ctes("human_labels")
    + """SELECT seq, CASE lower(trim(label)) WHEN 'neg' THEN 0 WHEN 'neu' THEN 1
       WHEN 'positive' THEN 2 END AS label FROM human_labels""",
)
def normalize_label(spark, sf_dir):
    return views.human_labels(spark, sf_dir).select(
        "seq", fn.normalize_human_label("label").alias("label")
    )


@query(
    "normalize_probs",
    """SELECT vec_id AS seq, CASE vec_id % 5 WHEN 0 THEN 0 WHEN 4 THEN 0 ELSE 2 END AS size,
       CASE WHEN vec_id % 5 IN (1, 2, 3) THEN (vec_id % 10) / 10.0::DOUBLE END AS first,
       CASE WHEN vec_id % 5 IN (1, 2, 3) THEN (vec_id % 3) / 4.0::DOUBLE END AS second
FROM embeddings""",
)
def normalize_probs(spark, sf_dir):
    a = F.concat(F.lit("0."), (F.col("vec_id") % 10).cast("string"))
    b = F.get(F.array(F.lit("0.0"), F.lit("0.25"), F.lit("0.5")), (F.col("vec_id") % 3).cast("int"))
    kind = F.col("vec_id") % 5
    text = (
        F.when(kind == 1, F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]")))
        .when(kind == 2, F.concat_ws(",", a, b))
        .when(kind == 3, F.concat_ws(" , ", a, b))
        .when(kind == 4, "x,y")
    )
    parsed = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq"), fn.normalize_probs(text).alias("p")
    )
    return parsed.select(
        "seq",
        F.size("p").alias("size"),
        F.get("p", F.lit(0)).alias("first"),
        F.get("p", F.lit(1)).alias("second"),
    )


@query(
    "min_words",
    f"SELECT doc_id AS seq FROM documents WHERE {sql_words('text')} >= 50",
)
def min_words_query(spark, sf_dir):
    return min_words(reviews(spark, sf_dir, False), 50).select("seq")


@query(
    "category_filter",
    "SELECT doc_id AS seq, source AS product_category FROM documents"
    " WHERE source IN ('src1', 'src3', 'src11')",
)
def category_filter_query(spark, sf_dir):
    rows = category_filter(reviews(spark, sf_dir, False), ["src1", "src3", "src11"])
    return rows.select("seq", "product_category")


def _to_check(spark, sf_dir):
    """Reviews with some broken stars, texts and titles."""
    step = F.col("seq") % 11
    return reviews(spark, sf_dir, False).withColumns(
        {
            "rating": F.when(step == 3, 6.0).when(step == 5, float("nan"))
            .when(step != 7, F.col("rating")),
            "text": F.when(F.col("seq") % 13 == 4, " \t ").otherwise(F.col("text")),
            "title": F.when(F.col("seq") % 17 == 2, "").otherwise(F.col("title")),
        }
    )


_TO_CHECK = f"""checked AS (
  SELECT doc_id AS seq, source AS product_category,
         doc_id % 11 IN (3, 5, 7) AS bad_rating,
         regexp_matches(CASE WHEN doc_id % 13 = 4 THEN ' ' ELSE text END, '^{WS}*$') AS bad_text,
         doc_id % 17 = 2 AS bad_title
  FROM documents)"""


@query(
    "validate_report",
    f"""WITH {_TO_CHECK}
SELECT count(*) AS rows, count(*) FILTER (bad_rating) AS bad_ratings,
       count(*) FILTER (bad_text) AS empty_texts, count(*) FILTER (bad_title) AS empty_titles,
       count(DISTINCT product_category) AS categories, true AS columns_present,
       count(*) FILTER (bad_rating) = 0 AS rating_range_ok,
       count(*) FILTER (bad_text) = 0 AS text_nonempty,
       count(*) FILTER (bad_title) = 0 AS title_ok,
       true AS metadata_types_ok, count(DISTINCT product_category) > 0 AS categories_present
FROM checked""",
)
def validate_report(spark, sf_dir):
    return validate.validate_reviews(_to_check(spark, sf_dir), allow_empty_title=False)


@query(
    "invalid_rows",
    f"""WITH {_TO_CHECK}
SELECT seq, array_to_string(list_filter([CASE WHEN bad_rating THEN 'rating' END,
       CASE WHEN bad_text THEN 'text' END, CASE WHEN bad_title THEN 'title' END],
       lambda x: x IS NOT NULL), ',') AS reasons
FROM checked WHERE bad_rating OR bad_text OR bad_title""",
)
def invalid_rows(spark, sf_dir):
    broken = validate.invalid_rows(_to_check(spark, sf_dir), allow_empty_title=False)
    return broken.select("seq", F.concat_ws(",", "reasons").alias("reasons"))


@query(
    "explode_texts",
    """WITH parts AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN [text] ELSE string_split(text, chr(10)) END
         AS texts FROM conversations)
SELECT conv_id, turn, unnest(range(len(texts))) :: INTEGER AS position, unnest(texts) AS text
FROM parts""",
)
def explode_texts(spark, sf_dir):
    one = F.to_json(F.struct("text"))
    many = F.to_json(F.struct(F.split("text", "\n").alias("texts")))
    requests = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", one).otherwise(many).alias("body")
    )
    return unnest_requests(requests)


@query(
    "text_lines_mixed",
    f"""SELECT conv_id, turn,
       regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '') AS text
FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations)
WHERE NOT regexp_matches(text, '^{WS}*$')""",
)
def text_lines_mixed(spark, sf_dir):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    line = F.when(F.col("role") == "user", flat).otherwise(
        F.to_json(F.struct(fn.strip_ws(flat).alias("text")))
    )
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))
    return mixed_texts(lines, "line")


_COLLAPSED = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"


@query(
    "sql_functions",
    ctes("reviews", "human_labels")
    + f"""SELECT seq, id, CAST({sql_words('text')} AS INTEGER) AS words,
       md5(regexp_replace(regexp_replace(text, '^{WS}+', ''),
                          '{WS}+$', '')) AS stripped,
       md5({_COLLAPSED}) AS collapsed, md5(lower({_COLLAPSED})) AS normal,
       CASE WHEN seq % 4 = 0 THEN NULL ELSE rating + 0.5 END AS number,
       {sql_stars('rating')} AS stars, {sql_stars('rating')} AS label,
       CASE WHEN rating <> 4 THEN {sql_stars('rating')} END AS class,
       CASE WHEN rating <> 2 THEN {sql_stars('rating')} END AS or_null,
       ['negative', 'neutral', 'positive', 'unknown'][seq % 4 + 1] AS named,
       CASE lower(trim(h.label)) WHEN 'neg' THEN 0 WHEN 'neu' THEN 1 WHEN 'positive' THEN 2 END
         AS human
FROM reviews LEFT JOIN human_labels h USING (seq)""",
)
def sql_functions(spark, sf_dir):
    fn.register_functions(spark)
    human = views.human_labels(spark, sf_dir).withColumnRenamed("label", "spelling")
    rows = reviews(spark, sf_dir, False).join(human, "seq", "left")
    return rows.selectExpr(
        "seq",
        "stable_id(text, asin) AS id",
        "word_count(text) AS words",
        "md5(strip_ws(text)) AS stripped",
        "md5(collapse_ws(text)) AS collapsed",
        "md5(normalize_text(text)) AS normal",
        "parse_number(CASE WHEN seq % 4 = 0 THEN 'x1' ELSE concat(' ', rating + 0.5D, ' ') END)"
        " AS number",
        "label_of_stars(rating) AS stars",
        "label_from_rating(rating) AS label",
        "rating_to_class(CASE WHEN rating = 4 THEN 9D ELSE rating END) AS class",
        "label_or_null(CASE WHEN rating <> 2 THEN rating END) AS or_null",
        "class_to_text(CAST(seq % 4 AS INT)) AS named",
        "normalize_human_label(spelling) AS human",
    )


@query(
    "sql_functions_probs",
    ctes("measured")
    + """SELECT id, pred_label, round(conf - mid, 6) AS margin, round(h, 6) AS entropy,
       round(h + 1 - (conf - mid), 6) AS uncertainty,
       CASE WHEN conf < 0.5 THEN 'abstain' ELSE ['negative', 'neutral', 'positive'][pred_label + 1]
       END AS half, CASE WHEN conf < 0.65 THEN 'abstain'
       ELSE ['negative', 'neutral', 'positive'][pred_label + 1] END AS predicted,
       round(1 - conf, 6) AS least, round(mid - conf, 6) AS by_margin, round(h_batch, 6) AS by_entropy
FROM measured""",
)
def sql_functions_probs(spark, sf_dir):
    fn.register_functions(spark)
    return views.scored(spark, sf_dir).selectExpr(
        "id",
        "prob_argmax(probs) AS pred_label",
        "round(prob_margin(probs), 6) AS margin",
        "round(prob_entropy(probs), 6) AS entropy",
        "round(prob_uncertainty(probs), 6) AS uncertainty",
        "abstain_label(probs, 0.5D) AS half",
        "predict_label(probs) AS predicted",
        "round(score_least_confidence(probs), 6) AS least",
        "round(score_margin(probs), 6) AS by_margin",
        "round(score_entropy(probs), 6) AS by_entropy",
    )


@query(
    "shuffle_rows",
    ctes("reviews")[:-1]
    + f""", placed AS (
  SELECT seq, id, row_number() OVER (ORDER BY md5(concat_ws(':', id, seq, '{SEED}')), id, seq) - 1
         AS place FROM reviews)
SELECT seq, id, place FROM placed""",
)
def shuffle_rows(spark, sf_dir):
    """The stored order of a seeded shuffle, read back with the place of each row."""
    from ..operators.sampling import shuffle_rows as shuffled
    from ..runtime import scratch_path

    path = scratch_path(spark, "shuffled")
    rows = shuffled(reviews(spark, sf_dir).select("id", "seq"), SEED, ("id", "seq"))
    rows.select(F.to_json(F.struct("seq", "id")).alias("value")).write.text(path)
    lines = writers.numbered_lines(spark, path)
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    base = files.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    row = F.from_json("value", "seq BIGINT, id STRING")
    return lines.join(base, "file").select(row["seq"].alias("seq"), row["id"].alias("id"),
                                           (F.col("base") + F.col("line")).alias("place"))


@query(
    "limit_per_file",
    ctes("reviews")[:-1]
    + """, snapshot AS (
  SELECT *, row_number() OVER (PARTITION BY product_category ORDER BY seq) - 1 AS place
  FROM reviews QUALIFY place < 30)
SELECT text, product_category FROM snapshot WHERE place % 8 < 3""",
)
def limit_per_file(spark, sf_dir):
    from ..plans import jobs
    from ..runtime import scratch_path

    out = scratch_path(spark, "limited")
    jobs.snapshot(reviews(spark, sf_dir, False), out, 30, shard_size=8)
    rows = jobs.make_pool(spark, f"{out}/shards", f"{out}/pool.csv", limit_per_file=3)
    return rows.select("text", "product_category")
