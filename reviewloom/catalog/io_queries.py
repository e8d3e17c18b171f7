"""Queries that go through files: readers, writers, snapshots, pools and whole jobs.

Files are written under the shared scratch folder of the session and read back.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stable_id
from ..operators import scoring
from ..operators.conform import ensure_label
from ..plans import jobs
from ..runtime import scratch_path
from ..sources import readers, writers
from ..sources.append_log import AppendLog
from . import views
from .registry import query
from .views import SEED, ctes, reviews, sql_letter_scores, sql_stars, sql_words, table

SCORER = scoring.expression_scorer(views.letter_logits)

_PLAIN = """SELECT doc_id, coalesce(text, '') AS text, 0.0::DOUBLE AS rating, '' AS title,
       '' AS asin, '' AS product_category, 0 AS label FROM documents"""


@query("scan_parquet", _PLAIN)
def scan_parquet(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    return readers.read_reviews_parquet(spark, path, keep=("doc_id",))


@query("scan_glob", _PLAIN)
def scan_glob(spark, sf_dir):
    return readers.read_reviews_glob(spark, sf_dir, "documents*", with_label=True, keep=("doc_id",))


_FIELDS = {"seq": "bigint", **readers.LINE_FIELDS}
_ROWS = "SELECT seq, text, rating, title, asin, product_category FROM reviews"


def _lines(spark, sf_dir):
    path = scratch_path(spark, "reviews.jsonl")
    writers.write_jsonl(reviews(spark, sf_dir, False), path)
    return path


@query("scan_jsonl", ctes("reviews") + _ROWS)
def scan_jsonl(spark, sf_dir):
    return readers.read_jsonl(spark, _lines(spark, sf_dir), _FIELDS)


@query("scan_jsonl_strict", ctes("reviews") + _ROWS)
def scan_jsonl_strict(spark, sf_dir):
    schema = ", ".join(f"{name} {kind}" for name, kind in _FIELDS.items())
    return readers.read_jsonl_strict(spark, _lines(spark, sf_dir), schema)


@query("scan_csv", "SELECT doc_id AS seq, coalesce(text, '') AS text FROM documents")
def scan_csv(spark, sf_dir):
    path = scratch_path(spark, "texts.csv")
    writers.write_csv(reviews(spark, sf_dir, False).select("seq", "text"), path)
    return readers.read_text_csv(spark, path).select(F.col("seq").cast("bigint"), "text")


@query(
    "inline_rows",
    "SELECT CAST(n_nationkey AS BIGINT) AS seq, n_name AS text, CAST(1 + n_nationkey % 5 AS DOUBLE) AS rating,"
    " CAST(n_regionkey AS VARCHAR) AS asin FROM nation",
)
def inline_rows(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    rows = [
        {"text": n.n_name, "rating": 1 + n.n_nationkey % 5, "asin": n.n_regionkey} for n in nations
    ]
    return readers.reviews_from_rows(spark, rows).select("seq", "text", "rating", "asin")


@query(
    "scan_manifest",
    ctes("reviews")
    + "SELECT text, rating, title, asin, product_category FROM reviews",
)
def scan_manifest(spark, sf_dir):
    out = scratch_path(spark, "snapshot")
    rows = reviews(spark, sf_dir, False)
    writers.write_jsonl(rows, f"{out}/all.jsonl")
    writers.write_file_manifest(spark, f"{out}/MANIFEST.json", ["all.jsonl", "absent.jsonl"])
    found, _missing = readers.read_shards(spark, f"{out}/MANIFEST.json")
    return found


@query("id_set", ctes("reviews") + "SELECT DISTINCT id FROM reviews")
def id_set(spark, sf_dir):
    path = scratch_path(spark, "seen")
    ids = reviews(spark, sf_dir).select("id")
    writers.append_ids(ids, path)
    writers.append_ids(ids, path)
    return readers.read_id_set(spark, [path, f"{path}-absent"])


@query(
    "blocklist_file",
    ctes("reviews", "toxic_ids")
    + "SELECT DISTINCT id FROM reviews",
)
def blocklist_file(spark, sf_dir):
    out = scratch_path(spark, "blocklist")
    jobs.build_blocklist(spark, [_lines(spark, sf_dir)], out)
    return readers.read_id_set(spark, [out])


_SNAPSHOT = """snapshot AS (
  SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY product_category ORDER BY seq) <= 30)"""


@query(
    "snapshot_manifest",
    ctes("reviews")[:-1]
    + f""",
{_SNAPSHOT},
shards AS (
  SELECT product_category, count(*) AS rows FROM (
    SELECT product_category,
           (row_number() OVER (PARTITION BY product_category ORDER BY seq) - 1) // 8 AS shard
    FROM snapshot) GROUP BY product_category, shard)
SELECT product_category, rows FROM shards""",
)
def snapshot_manifest(spark, sf_dir):
    out = scratch_path(spark, "snapshot")
    manifest = jobs.snapshot(reviews(spark, sf_dir, False), out, 30, shard_size=8)
    return manifest.select("product_category", "rows")


@query(
    "pool",
    ctes("reviews")[:-1]
    + f""",
{_SNAPSHOT}
SELECT concat('category=', product_category, ':', shard, ':', line) AS id,
       text, title, asin, product_category
FROM (SELECT *, (place - 1) // 8 AS shard, (place - 1) % 8 AS line
      FROM (SELECT *, row_number() OVER (PARTITION BY product_category ORDER BY seq) AS place
            FROM snapshot) a) b""",
)
def pool(spark, sf_dir):
    out = scratch_path(spark, "snapshot")
    jobs.snapshot(reviews(spark, sf_dir, False), out, 30, shard_size=8)
    rows = jobs.make_pool(spark, f"{out}/shards", f"{out}/pool.csv")
    # Spark names the files; a shard's number is the place of its first row among the others.
    pattern = r"^(.*)/([^/]*):(\d+)$"
    parts = [F.regexp_extract("id", pattern, i).alias(n) for i, n in enumerate(("folder", "file", "line"), 1)]
    rows = rows.select(*parts, "text", "title", "asin", "product_category")
    order = reviews(spark, sf_dir, False).groupBy("text", "title").agg(F.min("seq").alias("seq"))
    firsts = rows.filter("line = '0'").join(order, ["text", "title"])
    by_folder = Window.partitionBy("folder").orderBy("seq", "file")
    shards = firsts.select("folder", "file", (F.row_number().over(by_folder) - 1).alias("shard"))
    named = F.concat_ws(":", "folder", "shard", "line").alias("id")
    return rows.join(shards, ["folder", "file"]).select(
        named, "text", "title", "asin", "product_category"
    )


_SIDES = (
    ctes("train_side", "eval_side", "toxic_ids")[:-1]
    + f""",
clean AS (
  SELECT *, {sql_stars('rating')} AS label FROM train_side
  WHERE id NOT IN (SELECT id FROM eval_side) AND {sql_words('text')} >= 3
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
drawn AS (
  SELECT * FROM clean
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', id, '{SEED}')), id) <= 40),
"""
)


@query(
    "prepare_splits",
    _SIDES
    + f"""sides AS (
  SELECT 'train' AS split, id, seq, label FROM drawn UNION ALL
  SELECT 'dev', id, seq, {sql_stars('rating')} FROM train_side UNION ALL
  SELECT 'eval', id, seq, {sql_stars('rating')} FROM eval_side)
SELECT split, id, seq, label FROM sides""",
)
def prepare_splits(spark, sf_dir):
    out = scratch_path(spark, "prepared")
    evaluation = views.eval_side(spark, sf_dir)
    jobs.prepare(
        views.train_side(spark, sf_dir),
        views.train_side(spark, sf_dir),
        evaluation,
        out,
        per_class=40,
        blocked=evaluation.select("id").distinct(),
        words=3,
        seed=SEED,
    )
    sides = [
        spark.read.parquet(f"{out}/{name}.parquet").select(
            F.lit(name).alias("split"), "id", "seq", "label"
        )
        for name in ("train", "dev", "eval")
    ]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


@query(
    "build_splits",
    ctes("reviews")[:-1]
    + f""",
listed AS (
  SELECT *, CASE WHEN seq % 3 = 2 THEN 0 WHEN seq % 3 = 1 THEN 1 ELSE 2 END AS place FROM reviews),
firsts AS (
  SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, seq) = 1),
split AS (
  SELECT *, row_number() OVER (PARTITION BY product_category
                               ORDER BY md5(concat_ws(':', id, '{SEED}')), id) AS rank FROM firsts)
SELECT text, rating, title, asin, product_category,
       CASE WHEN rank <= 5 THEN 'dev' ELSE 'eval' END AS split FROM split WHERE rank <= 20""",
)
def build_splits(spark, sf_dir):
    """Three shards, listed against the order of their names: the first listed copy is kept."""
    out = scratch_path(spark, "splits")
    rows = reviews(spark, sf_dir, False)
    names = ["z.jsonl", "m.jsonl", "a.jsonl"]
    for name, rest in zip(names, (2, 1, 0)):
        part = rows.filter(F.col("seq") % 3 == rest).orderBy("seq").drop("seq")
        writers.write_jsonl(part, f"{out}/{name}")
    writers.write_file_manifest(spark, f"{out}/MANIFEST.json", names)
    jobs.build_splits(spark, f"{out}/MANIFEST.json", out, 5, 15, SEED)
    sides = [
        spark.read.parquet(f"{out}/{name}.parquet").withColumn("split", F.lit(name))
        for name in ("dev", "eval")
    ]
    both = sides[0].unionByName(sides[1])
    return both.select("text", F.col("rating").cast("double"), "title", "asin", "product_category", "split")


_GOLD = (
    ctes("human_labels", "reviews")[:-1]
    + """,
answers AS (
  SELECT id, seq, CASE lower(trim(h.label)) WHEN 'neg' THEN 0 WHEN 'neu' THEN 1
         WHEN 'positive' THEN 2 END AS label
  FROM reviews JOIN human_labels h USING (seq) WHERE h.label <> '7')
SELECT id, label FROM answers
QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1"""
)


@query("gold_append", _GOLD)
def gold_append(spark, sf_dir):
    out = scratch_path(spark, "gold")
    answers = reviews(spark, sf_dir).join(views.human_labels(spark, sf_dir), "seq")
    jobs.ingest_labels(answers, out, seq="seq")
    gold, _bad = jobs.ingest_labels(answers, out, seq="seq")  # known ids are not added again
    return gold.select("id", "label")


@query("gold_append_log", _GOLD)
def gold_append_log(spark, sf_dir):
    log = AppendLog(spark, scratch_path(spark, "gold"))
    answers = reviews(spark, sf_dir).join(views.human_labels(spark, sf_dir), "seq")
    for _ in range(2):  # the second run of a batch adds nothing
        gold, _bad = jobs.ingest_label_batch(answers, log, "first", seq="seq")
    return gold.select("id", "label")


@query(
    "category_tables",
    "SELECT event_id AS seq, event_type AS product_category FROM events",
)
def category_tables(spark, sf_dir):
    out = scratch_path(spark, "categories")
    rows = views.events_as_reviews(table(spark, sf_dir, "events")).drop("ts")
    kinds = [r[0] for r in rows.select("product_category").distinct().collect()]
    rows.withColumnRenamed("product_category", "category").write.partitionBy("category").json(out)
    folders = {kind: f"{out}/category={kind}" for kind in kinds}
    schema = "seq BIGINT, text STRING, rating DOUBLE, title STRING, asin STRING"
    merged = readers.read_category_tables(spark, folders, schema)
    return merged.select("seq", "product_category")


@query(
    "metrics_file",
    ctes("reviews") + f"SELECT {sql_stars('rating')} AS label, count(*) AS rows FROM reviews GROUP BY 1",
)
def metrics_file(spark, sf_dir):
    from ..operators.metrics import label_distribution

    path = scratch_path(spark, "metrics")
    writers.write_metrics(label_distribution(ensure_label(reviews(spark, sf_dir, False))), path)
    return spark.read.schema("label INT, rows BIGINT").json(path)


@query(
    "line_ids",
    ctes("reviews") + "SELECT id FROM reviews",
)
def line_ids(spark, sf_dir):
    rows = readers.read_jsonl(spark, _lines(spark, sf_dir))
    return rows.select(stable_id().alias("id"))


@query(
    "predict_file",
    ctes("reviews")[:-1] + ",\n" + sql_letter_scores("reviews")
    + """
SELECT row_number() OVER (ORDER BY seq) - 1 AS row,
       CASE WHEN ranked[1] < 0.65 THEN 'abstain' WHEN pred_label = 0 THEN 'negative'
       WHEN pred_label = 1 THEN 'neutral' ELSE 'positive' END AS label,
       round(ranked[1], 6) AS confidence, round(p_neg, 6) AS p_neg, round(p_neu, 6) AS p_neu,
       round(p_pos, 6) AS p_pos FROM letter_scored""",
)
def predict_file(spark, sf_dir):
    out = scratch_path(spark, "predicted")
    rows = reviews(spark, sf_dir, False).orderBy("seq")
    writers.write_csv(rows.select("text"), f"{out}/in.csv")
    jobs.predict_csv(spark, f"{out}/in.csv", f"{out}/out.csv", SCORER, threshold=0.65)
    numbers = ("confidence", "p_neg", "p_neu", "p_pos")
    schema = "row BIGINT, label STRING, " + ", ".join(f"{n} DOUBLE" for n in numbers)
    back = spark.read.schema(schema).csv(f"{out}/out.csv", header=True)
    return back.select("row", "label", *[F.round(n, 6).alias(n) for n in numbers])


@query(
    "weight_file",
    ctes("reviews")[:-1] + ",\n" + sql_letter_scores("reviews")
    + f"""
SELECT seq, round((0.3 + 0.7 * ranked[1])
       * CASE WHEN pred_label = {sql_stars('rating')} THEN 1 ELSE 0.5 END
       * CASE WHEN rating = 3 THEN 0.8 ELSE 1 END, 6) AS sample_weight FROM letter_scored""",
)
def weight_file(spark, sf_dir):
    out = scratch_path(spark, "weights.csv")
    jobs.weight_rows(reviews(spark, sf_dir, False), SCORER, out)
    back = spark.read.csv(out, header=True, multiLine=True, escape='"')
    return back.select(
        F.col("seq").cast("bigint"),
        F.round(F.col("sample_weight").cast("double"), 6).alias("sample_weight"),
    )


@query(
    "score_job",
    ctes("reviews", "toxic_ids")[:-1] + ",\n" + sql_letter_scores("reviews")
    + """
SELECT seq, id AS content_id, round(p_neg, 6) AS p_neg, round(p_neu, 6) AS p_neu,
       round(p_pos, 6) AS p_pos
FROM letter_scored WHERE id NOT IN (SELECT id FROM toxic_ids)""",
)
def score_job(spark, sf_dir):
    out = scratch_path(spark, "scored")
    rows = reviews(spark, sf_dir, False)
    blocked = views.toxic_ids(spark, sf_dir)
    scored = jobs.score_pool(rows, SCORER, f"{out}/rows", blocked, f"{out}/seen")
    seen = readers.read_id_set(spark, [f"{out}/seen"]).withColumnRenamed("id", "content_id")
    noted = scored.join(seen, "content_id")
    return noted.select(
        "seq", "content_id", *[F.round(n, 6).alias(n) for n in ("p_neg", "p_neu", "p_pos")]
    )


@query(
    "todo_file",
    ctes("reviews")[:-1] + ",\n" + sql_letter_scores("reviews")
    + """
SELECT id, text, title, asin, product_category FROM (
  SELECT DISTINCT ON (id) * FROM letter_scored ORDER BY id, seq)
ORDER BY 1 - ranked[1] DESC, id LIMIT 40""",
)
def todo_file(spark, sf_dir):
    from ..operators.dedup import dedup_keep_first

    out = scratch_path(spark, "todo")
    writers.write_parquet(
        scoring.score(dedup_keep_first(reviews(spark, sf_dir)), SCORER).drop("probs"),
        f"{out}/scored",
    )
    scored = readers.read_scored(spark, f"{out}/scored")
    jobs.batch_for_labelling(scored, f"{out}/todo.csv", 40, "least_confidence")
    todo = readers.read_todo_csv(spark, f"{out}/todo.csv")
    return todo.select("id", "text", "title", "asin", "product_category")


@query(
    "select_job",
    ctes("firsts", "toxic_ids")[:-1]
    + """,
pool AS (SELECT * FROM firsts WHERE id NOT IN (SELECT id FROM toxic_ids)),
"""
    + sql_letter_scores("pool")
    + """
SELECT id, seq, text, product_category, rating, pred_label, round(uncertainty, 6) AS uncertainty
FROM letter_scored
QUALIFY row_number() OVER (PARTITION BY pred_label ORDER BY uncertainty DESC, seq)
        <= [15, 25, 10][pred_label + 1]""",
)
def select_job(spark, sf_dir):
    out = scratch_path(spark, "selected")
    picked = jobs.select_for_labelling(
        reviews(spark, sf_dir, False),
        SCORER,
        out,
        f"{out}/seen",
        quotas=[15, 25, 10],
        blocked=views.toxic_ids(spark, sf_dir),
    )
    noted = picked.join(readers.read_id_set(spark, [f"{out}/seen"]), "id")
    columns = ("id", "seq", "text", "product_category", "rating", "pred_label")
    return noted.select(*columns, F.round("uncertainty", 6).alias("uncertainty"))
