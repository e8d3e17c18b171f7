"""Streaming queries, run over what the tables hold and returned as batch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import label_from_rating, stable_id
from ..operators import scoring, selection
from ..operators.conform import fill_defaults
from ..operators.filters import drop_blocked
from ..streaming import operators as ops
from ..runtime import scratch_path
from ..sources.append_log import AppendLog, append_batches
from ..streaming.sources import category_stream, file_stream, run_append, run_batches
from . import views
from .registry import query
from .views import SEED, ctes, sql_letter_scores, sql_stars, table

_LABEL = sql_stars("rating")


#: Files that a table is dealt to, in no order of arrival; each is a batch of its own.
BATCHES = 6
#: Row groups of these files are small, so that several tasks read the one file of a batch.
_WRITING = {"parquet.block.size": 4 << 20}


def _stream(spark, sf_dir, name):
    rows = table(spark, sf_dir, name)
    path = scratch_path(spark, name)
    dealt = rows.repartition(BATCHES, F.xxhash64(*rows.columns[:1]))
    dealt.write.options(**_WRITING).parquet(path)
    return file_stream(spark, path, rows.schema, max_files=1)


def _documents(spark, sf_dir):
    return views.documents_as_reviews(_stream(spark, sf_dir, "documents"))


def _events(spark, sf_dir):
    rows = views.events_as_reviews(_stream(spark, sf_dir, "events"))
    return rows.withColumn("id", stable_id())


@query(
    "stream_ingest",
    ctes("reviews") + "SELECT seq, text, rating, title, asin, product_category FROM reviews",
)
def stream_ingest(spark, sf_dir):
    rows = run_append(fill_defaults(_documents(spark, sf_dir)))
    return rows.select("seq", "text", "rating", "title", "asin", "product_category")


@query(
    "stream_drop_blocked",
    ctes("toxic_ids")
    + "SELECT seq, id FROM reviews WHERE id NOT IN (SELECT id FROM toxic_ids)",
)
def stream_drop_blocked(spark, sf_dir):
    rows = _documents(spark, sf_dir).withColumn("id", stable_id())
    return run_append(drop_blocked(rows.select("seq", "id"), views.toxic_ids(spark, sf_dir)))


_FIRST_EVENTS = """SELECT seq, id, rating, product_category FROM review_events
QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1"""


@query("stream_dedup", ctes("review_events") + _FIRST_EVENTS)
def stream_dedup(spark, sf_dir):
    rows = views.events_as_reviews(table(spark, sf_dir, "events"))
    first = ops.run_first_numbers(_events(spark, sf_dir).select("id", "seq"), rows=rows)
    return first.select("seq", "id", "rating", "product_category")


@query("stream_dedup_watermark", ctes("review_events") + "SELECT DISTINCT id FROM review_events")
def stream_dedup_watermark(spark, sf_dir):
    rows = _events(spark, sf_dir).select("id", "seq", "ts")
    return run_append(ops.dedup_within(rows, "ts", "365 days")).select("id")


@query(
    "stream_label_counts",
    ctes("review_events")
    + f"SELECT product_category, {_LABEL} AS label, count(*) AS rows FROM review_events GROUP BY ALL",
)
def stream_label_counts(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("label", label_from_rating())
    return ops.run_complete(ops.running_counts(rows, "product_category", "label"))


@query(
    "stream_day_counts",
    ctes("review_events")
    + """SELECT epoch_us(date_trunc('day', ts)) AS day_us, product_category, count(*) AS rows
FROM review_events GROUP BY ALL""",
)
def stream_day_counts(spark, sf_dir):
    day = F.window("ts", "1 day")["start"]
    counts = ops.running_counts(_events(spark, sf_dir), day.alias("day"), "product_category")
    return ops.run_complete(counts).select(
        F.unix_micros("day").alias("day_us"), "product_category", "rows"
    )


def _in_order(spark, rows, batch):
    """A stream whose micro-batches are the values of ``batch``, one after the other."""
    path, dealt = scratch_path(spark, "ordered"), scratch_path(spark, "dealt")
    numbered = rows.withColumn("__batch", batch.cast("int"))
    numbered.write.partitionBy("__batch").parquet(dealt)  # the table is read once, by many tasks
    numbered = spark.read.schema(numbered.schema).parquet(dealt)
    for number in range(BATCHES):
        part = numbered.filter(F.col("__batch") == number).drop("__batch").repartition(1)
        part.write.options(**_WRITING).mode("append").parquet(path)
    return file_stream(spark, path, rows.schema, max_files=1)


#: A row may come this many days late and still count.
DELAY_DAYS = 6
_LATE_BATCH = """CASE WHEN {id} % 97 = 5 THEN 5
 ELSE least(5, CAST(floor((day(ts) - 1) / 5) AS INT) + CASE WHEN {id} % 10 = 3 THEN 1 ELSE 0 END) END"""


@query(
    "stream_daily_counts",
    f"""WITH dealt AS (
  SELECT ts, event_type, {_LATE_BATCH.format(id="event_id")} AS batch,
         date_trunc('day', ts) + INTERVAL 1 DAY AS ends FROM events),
marks AS (
  SELECT b.batch, (SELECT max(d.ts) FROM dealt d WHERE d.batch <= b.batch - 2)
         - INTERVAL {DELAY_DAYS} DAY AS mark
  FROM (SELECT DISTINCT batch FROM dealt) b)
SELECT epoch_us(ends) - 86400000000 AS day_us, event_type AS product_category, count(*) AS rows
FROM dealt JOIN marks USING (batch)
WHERE (mark IS NULL OR ends > mark)
  AND ends <= (SELECT max(ts) FROM dealt) - INTERVAL {DELAY_DAYS} DAY
GROUP BY ALL""",
)
def stream_daily_counts(spark, sf_dir):
    """Days behind the watermark, each given out once; rows that come after their day are dropped.

    A batch drops by the watermark that the batch before it ran with, two batches back.
    """
    rows = views.events_as_reviews(table(spark, sf_dir, "events"))
    stream = _in_order(spark, rows, F.expr(_LATE_BATCH.format(id="seq")))
    days = run_append(ops.daily_counts(stream, "ts", f"{DELAY_DAYS} days", "product_category"))
    return days.select(F.unix_micros("day.start").alias("day_us"), "product_category", "rows")


_SCORED = ctes("reviews")[:-1] + ",\n" + sql_letter_scores("reviews")


def _scored(spark, sf_dir):
    rows = _documents(spark, sf_dir).withColumn("id", stable_id())
    return selection.candidate_rows(scoring.expression_scorer(views.letter_logits)(rows))


@query(
    "stream_score",
    _SCORED + "\nSELECT seq, pred_label, round(uncertainty, 6) AS uncertainty FROM letter_scored",
)
def stream_score(spark, sf_dir):
    rows = run_append(_scored(spark, sf_dir).select("seq", "pred_label", "uncertainty"))
    return rows.withColumn("uncertainty", F.round("uncertainty", 6))


@query(
    "stream_topk",
    _SCORED
    + """
SELECT seq, id, pred_label, round(uncertainty, 6) AS uncertainty FROM letter_scored
QUALIFY row_number() OVER (PARTITION BY pred_label ORDER BY uncertainty DESC, seq)
        <= [20, 30, 10][pred_label + 1]""",
)
def stream_topk(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("seq", "id", "pred_label", "uncertainty")
    picked = ops.run_top_k_per_class(rows, [20, 30, 10])
    return picked.withColumn("uncertainty", F.round("uncertainty", 6))


@query(
    "stream_topk_partial",
    _SCORED
    + """
SELECT seq, id, pred_label, round(uncertainty, 6) AS uncertainty FROM letter_scored
WHERE seq % 6 <= 2
QUALIFY row_number() OVER (PARTITION BY pred_label ORDER BY uncertainty DESC, seq)
        <= [20, 30, 10][pred_label + 1]""",
)
def stream_topk_partial(spark, sf_dir):
    """What a reader sees after the third of six batches; the stream goes on to its end."""
    rows = _in_order(spark, table(spark, sf_dir, "documents"), F.col("doc_id") % BATCHES)
    rows = views.documents_as_reviews(rows).withColumn("id", stable_id())
    scored = selection.candidate_rows(scoring.expression_scorer(views.letter_logits)(rows))
    scored = scored.select("seq", "id", "pred_label", "uncertainty")
    heaps = ops.HeapTable(spark)
    ops.run_top_k_per_class(scored, [20, 30, 10], table=heaps)
    kept = heaps.latest(ops.bounded_heaps(scored, [20, 30, 10]).schema, until=2)
    kept = ops.heap_rows(kept, scored.schema, "uncertainty")
    picked = selection.top_k_per_class(kept, "uncertainty", [20, 30, 10], "pred_label", "seq")
    return picked.withColumn("uncertainty", F.round("uncertainty", 6))


@query("stream_stop", ctes("reviews") + "SELECT seq, id FROM reviews")
def stream_stop(spark, sf_dir):
    """A stream stopped by its time limit goes on where it was, without loss or copies."""
    rows = _documents(spark, sf_dir).select("seq", stable_id().alias("id"))
    out, progress = scratch_path(spark, "table"), scratch_path(spark, "progress")
    run_append(rows, out, progress, seconds=1)
    return run_append(rows, out, progress)


@query(
    "stream_sample",
    ctes("reviews")[:-1]
    + f""",
labelled AS (SELECT seq, id, {_LABEL} AS label FROM reviews)
SELECT seq, id, label FROM labelled
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat(id, ':', seq, ':{SEED}')), id, seq)
        <= 50""",
)
def stream_sample(spark, sf_dir):
    rows = _documents(spark, sf_dir).select(
        "seq", stable_id().alias("id"), label_from_rating().alias("label")
    )
    return ops.run_sample_per_class(rows, 50, SEED)


@query("stream_seen", ctes("reviews") + "SELECT id FROM reviews")
def stream_seen(spark, sf_dir):
    return run_append(ops.seen_ids(_documents(spark, sf_dir)))


@query("stream_append_log", ctes("reviews") + "SELECT id FROM reviews")
def stream_append_log(spark, sf_dir):
    ids = ops.seen_ids(_documents(spark, sf_dir))
    log = AppendLog(spark, scratch_path(spark, "seen"))
    step = append_batches(log, "seen")

    def twice(batch, number):  # as after a failure between the append and the end of the batch
        step(batch, number)
        step(batch, number)

    run_batches(ids, twice)
    return log.read(ids.schema)


@query(
    "stream_categories",
    "SELECT event_id AS seq, event_type AS product_category,"
    " CAST(1 + event_id % 5 AS DOUBLE) AS rating FROM events",
)
def stream_categories(spark, sf_dir):
    out = scratch_path(spark, "categories")
    rows = views.events_as_reviews(table(spark, sf_dir, "events")).select(
        "seq", "text", "rating", F.col("product_category").alias("category")
    )
    rows.write.partitionBy("category").json(out)
    stream = category_stream(spark, out, "seq BIGINT, text STRING, rating DOUBLE", max_files=2)
    return run_append(stream.select("seq", "product_category", "rating"))
