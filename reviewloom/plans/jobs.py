"""Whole jobs: read, run operators, write. Arguments replace configuration files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import label_or_null, normalize_human_label, safe_float, safe_int
from ..functions.probs import normalize_probs
from ..functions.text import display_text, has_words
from ..operators import leakage, metrics, sampling, scoring, selection, validate
from ..operators.conform import ensure_label, gold_rows, with_id
from ..operators.dedup import dedup_keep_first, lookup_table
from ..operators.filters import drop_blocked, drop_labelled, min_words, union_id_sets
from ..runtime import cut_lineage, stored_table
from ..schema import GOLD_SCHEMA, REVIEW_COLUMNS
from ..sources import readers, writers
from ..sources.append_log import AppendLog

#: Lines that a shard can have; an arrival number is the shard's position times this, and the line.
LINES_PER_SHARD = 1 << 40


def snapshot(
    reviews: DataFrame, out: str, n_per_category: int, shard_size: int = 200_000, seq: str = "seq"
) -> DataFrame:
    """Write the first rows of every category as shards with a manifest."""
    return writers.write_snapshot(reviews, out, n_per_category, shard_size, seq)


def shard_reviews(spark: SparkSession, manifest: str, base_dir: str | None = None) -> DataFrame:
    """Reviews of a manifest's shards; ``seq`` orders them by the listed order, then by line.

    A shard listed twice counts where it is listed first. ``missing_shards`` tells which are not
    there.
    """
    found, _missing = readers.read_manifest(spark, manifest, base_dir)
    if not found:
        raise FileNotFoundError(f"no shard of {manifest} exists")
    found = list(dict.fromkeys(file for path in found for file in readers.shard_files(spark, path)))
    lines = writers.numbered_lines(spark, found)
    named = [(at, *writers.qualified_path(spark, path)) for at, path in enumerate(found)]
    order = stored_table(
        spark.createDataFrame(named, "position BIGINT, name STRING").dropDuplicates(["name"])
    )
    name = writers.plain_path(F.col("file"))
    placed = lines.join(order, name == F.col("name"))
    seq = F.col("position") * F.lit(LINES_PER_SHARD) + F.col("line")
    rows = readers.json_lines(placed.withColumn("seq", seq), readers.LINE_FIELDS)
    return rows.drop("file", "line", "position", "name")


def missing_shards(spark: SparkSession, manifest: str, base_dir: str | None = None) -> list[str]:
    """Shards that a manifest lists and that are not there."""
    return readers.read_manifest(spark, manifest, base_dir)[1]


def build_splits(
    spark: SparkSession,
    manifest: str,
    out: str,
    dev_k: int,
    eval_k: int,
    seed: int = 42,
    categories: Sequence[str] = (),
    blocked_paths: Sequence[str] = (),
    dedup: bool = True,
    base_dir: str | None = None,
) -> DataFrame:
    """Dev and eval files, their blocklist and the eval manifest; returns the diagnostics.

    Shards that the manifest lists but that are missing are named in ``MISSING_shards.json``.
    """
    reviews = shard_reviews(spark, manifest, base_dir)
    missing = missing_shards(spark, manifest, base_dir)
    writers.write_file_manifest(spark, f"{out}/MISSING_shards.json", missing)
    blocked = readers.read_id_set(spark, blocked_paths) if blocked_paths else None
    accepted = cut_lineage(sampling.split_candidates(reviews, categories, blocked, dedup))
    split = cut_lineage(
        sampling.split_dev_eval(
            reviews, dev_k, eval_k, seed, categories, dedup=dedup, candidates=accepted
        ).withColumn("rating", safe_float("rating"))
    )
    for part in ("dev", "eval"):
        rows = split.filter(F.col("split") == part).select(*REVIEW_COLUMNS)
        writers.write_jsonl(rows, f"{out}/{part}.jsonl")
        writers.write_parquet(rows, f"{out}/{part}.parquet")
    writers.write_blocklist(split, f"{out}/blocklist")
    writers.write_file_manifest(spark, f"{out}/MANIFEST_eval.json", [f"{out}/eval.jsonl"])

    return sampling.split_diagnostics(accepted, split, dev_k, eval_k)


def build_blocklist(
    spark: SparkSession, paths: Sequence[str], out: str, manifest: str | None = None
) -> DataFrame:
    """Distinct ids of all rows in the given line files (and in a manifest's files).

    A file that is not there is an error: a blocklist that is short without a sign would let
    rows of the eval side into training.
    """
    files = list(paths)
    if manifest:
        found, missing = readers.read_manifest(spark, manifest)
        files += [*found, *missing]
    gone = [f for f in files if not readers.path_exists(spark, f)]
    if gone:
        raise FileNotFoundError(f"no such files for the blocklist: {gone[:5]}")
    ids = cut_lineage(writers.blocklist_ids(readers.read_jsonl(spark, files)))
    writers.write_blocklist(ids, out)
    return ids


def prepare(
    train: DataFrame,
    dev: DataFrame,
    evaluation: DataFrame,
    out: str,
    per_class: int | None = None,
    blocked: DataFrame | None = None,
    words: int = 0,
    max_rows: dict[str, int] | None = None,
    seed: int = 42,
    seq: str = "seq",
) -> DataFrame:
    """Write train, dev and eval parquet; returns rows per split and label.

    The blocklist and the word limit apply to the train side only; the eval side is frozen.
    Ids on both the train and the eval side are an error.
    """
    limits = max_rows or {}
    train = min_words(train, words)
    if per_class:
        train = cut_lineage(
            sampling.balanced_train(train, per_class, seed, blocked, seq=seq)
        )
    elif blocked is not None:
        train = drop_blocked(with_id(train), blocked)
    counts = []
    sides: dict[str, DataFrame] = {}
    for name, rows in (("train", train), ("dev", dev), ("eval", evaluation)):
        labelled = with_id(ensure_label(rows))
        drawn = sampling.sample_stratified(
            labelled, limits.get(name, 0), seed, key=("id", seq), seq=seq
        )
        path = f"{out}/{name}.parquet"
        writers.write_parquet(drawn.select("id", seq, *REVIEW_COLUMNS, "label"), path)
        stored = train.sparkSession.read.parquet(path)
        sides[name] = stored
        counts.append(metrics.label_distribution(stored.withColumn("split", F.lit(name)),
                                                 "split", "label"))
    leakage.assert_no_leakage(sides["train"], sides["eval"])
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def make_pool(
    spark: SparkSession, snapshot_dir: str, out: str, limit_per_file: int | None = None
) -> DataFrame:
    """Unlabelled pool of a snapshot as CSV."""
    pool = writers.pool_rows(spark, snapshot_dir, limit_per_file)
    writers.write_csv(pool, out)
    return readers.read_pool(spark, out)


def train_and_evaluate(
    train: DataFrame,
    dev: DataFrame,
    evaluation: DataFrame,
    out: str | None = None,
    sample_weight: str | None = None,
    **options,
) -> tuple[PipelineModel, DataFrame]:
    """Validate, check for leakage, fit, and report metrics of dev and eval."""
    validate.assert_valid(train, rating_range=(0.0, 5.0))
    leakage.assert_no_leakage(train, evaluation)
    model = scoring.train_classifier(train, sample_weight, **options)
    scorer = scoring.model_scorer(model)
    report = None
    for name, rows in (("dev", dev), ("eval", evaluation)):
        row = scoring.evaluate_scorer(rows, scorer).withColumn("split", F.lit(name))
        report = row if report is None else report.unionByName(row)
    report = cut_lineage(report)
    if out:
        model.write().overwrite().save(f"{out}/model")
        writers.write_metrics(report, f"{out}/metrics")
    return model, report


def score_pool(
    pool: DataFrame,
    scorer: scoring.Scorer,
    out: str,
    blocked: DataFrame | None = None,
    seen_path: str | None = None,
) -> DataFrame:
    """Probabilities for every row of a pool that is not blocked; notes the scored ids."""
    rows = with_id(pool, "content_id")
    if blocked is not None:
        rows = drop_blocked(rows, blocked, "content_id")
    writers.write_parquet(scoring.score(rows, scorer), out)
    stored = pool.sparkSession.read.parquet(out)
    if seen_path:
        writers.append_ids(stored, seen_path, "content_id")
    return stored


def predict_csv(
    spark: SparkSession, path: str, out: str, scorer: scoring.Scorer, threshold: float = 0.0
) -> None:
    """Label, confidence and probabilities for every row of a CSV file, with its row number.

    The written files follow the order of the input; ``row`` counts from 0.
    """
    predicted = scoring.predict(readers.numbered_text_csv(spark, path), scorer, threshold)
    columns = ("row", "label", "confidence", "p_neg", "p_neu", "p_pos")
    writers.write_csv(predicted.select(*columns).orderBy("row"), out)


def select_for_labelling(
    pool: DataFrame,
    scorer: scoring.Scorer,
    out: str,
    seen_path: str | None = None,
    **options,
) -> DataFrame:
    """Pick uncertain rows, write them as JSON lines and parquet, and note their ids."""
    picked = selection.select_uncertain(pool, scorer, **options)
    writers.write_parquet(picked, f"{out}/to_label.parquet")
    stored = pool.sparkSession.read.parquet(f"{out}/to_label.parquet")
    writers.write_jsonl(stored, f"{out}/to_label.jsonl")
    if seen_path:
        writers.append_ids(stored, seen_path)
    return stored


def batch_for_labelling(
    scored: DataFrame, out: str, k: int, strategy: str = "entropy"
) -> None:
    """A CSV file of the least certain rows with an empty label column."""
    writers.write_csv(selection.prepare_batch(scored, k, strategy), out)


def gold_records(labelled: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Labelled candidates in the gold schema, with safe defaults for unreadable fields."""

    def have(name: str, default):
        return F.col(name) if name in labelled.columns else F.lit(default)

    strings = ("id", "text", "title", "asin", "product_category")
    kinds = dict(labelled.dtypes)
    if kinds.get("probs") == "array<double>":
        probs = F.coalesce("probs", F.array().cast("array<double>"))
    else:
        probs = normalize_probs(have("probs", None))
    columns = {
        **{name: F.coalesce(have(name, "").cast("string"), F.lit("")) for name in strings},
        "rating": safe_float(have("rating", 0.0), 0.0, textual=kinds.get("rating") == "string"),
        "pred_label": safe_int(
            have("pred_label", -1), -1, textual=kinds.get("pred_label") == "string"
        ),
        "probs": probs,
        "uncertainty": safe_float(
            have("uncertainty", 0.0), 0.0, textual=kinds.get("uncertainty") == "string"
        ),
        "label": normalize_human_label("label"),
    }
    return labelled.select(*[value.alias(name) for name, value in columns.items()], *keep)


def labelling_queue(candidates: DataFrame, gold: DataFrame, words: int = 0) -> DataFrame:
    """Candidates that still need a label, with display text and the default label."""
    queue = drop_labelled(candidates, gold)
    whole = F.concat_ws("  ", "title", "text")
    queue = queue.filter(has_words(whole, words)) if words > 0 else queue
    return queue.withColumns(
        {"display_text": display_text(), "default_label": label_or_null("rating")}
    )


def ingest_labels(
    labelled: DataFrame, gold_path: str, chunk_rows: int = 0, seq: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Append readable, not yet known labels to the gold table.

    An id labelled twice keeps its first label by ``seq``, or the lower class without one.
    Returns the gold table and the rows with unreadable labels.
    """
    spark = labelled.sparkSession
    order = seq or "label"
    records = gold_records(labelled, keep=(seq,) if seq else ())
    if readers.path_exists(spark, gold_path):
        known = spark.read.schema(GOLD_SCHEMA).parquet(gold_path).select("id")
        records = drop_labelled(records, cut_lineage(known))
    records = records.filter(F.col("id") != "")
    one = dedup_keep_first(records.filter(F.col("label").isNotNull()), "id", order)
    writers.append_gold(one.drop(*([seq] if seq else [])), gold_path, chunk_rows)
    gold = spark.read.schema(GOLD_SCHEMA).parquet(gold_path)
    return gold, selection.quarantine_labels(labelled)


def ingest_label_batch(
    labelled: DataFrame, log: AppendLog, batch: str, chunk_rows: int = 0, seq: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``ingest_labels`` into a table that grows by whole batches.

    A failed job leaves the table as it was, and a ``batch`` that runs again adds nothing.
    """
    records = gold_records(labelled, keep=(seq,) if seq else ())
    records = drop_labelled(records, log.read(GOLD_SCHEMA).select("id"))
    records = records.filter((F.col("id") != "") & F.col("label").isNotNull())
    one = dedup_keep_first(records, "id", seq or "label")
    log.append(one.drop(*([seq] if seq else [])), batch, chunk_rows)
    return log.read(GOLD_SCHEMA), selection.quarantine_labels(labelled)


def human_gold(labelled: DataFrame) -> DataFrame:
    """Text, asin and class of readable human labels."""
    clean = labelled.withColumn("label", normalize_human_label("label"))
    return gold_rows(clean.filter(F.col("label").isNotNull()))


def weight_rows(rows: DataFrame, scorer: scoring.Scorer, out: str) -> DataFrame:
    """Rows with their training weight, as CSV and as a table."""
    weighted = cut_lineage(scoring.weight_rows(rows, scorer).drop("probs"))
    writers.write_csv(weighted, out)
    return weighted


def merge_training_rows(
    train: DataFrame,
    gold: DataFrame,
    blocked: DataFrame | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Train rows and human-labelled rows as one table, one row per id.

    ``gold`` has ``id, text, asin, label`` and the other review columns where known. Its label
    wins over that of a train row with the same id, and its other ids become training rows. With
    a ``batch`` column the newest answer for an id wins, else the lower class. Unreadable labels
    are left out and blocked ids do not train. ``label_source`` says where a label is from.
    """
    base = with_id(ensure_label(train))
    if "seq" in train.columns:
        base = dedup_keep_first(base, "id", "seq")
    else:
        base = base.dropDuplicates(["id"])
    columns = ["id", *REVIEW_COLUMNS, "label"]
    label = normalize_human_label("label")
    human = with_id(gold).withColumn("__label", label).filter("__label IS NOT NULL")
    newest = [F.col(batch).desc()] if batch else []
    rank = F.row_number().over(Window.partitionBy("id").orderBy(*newest, "__label"))
    human = human.withColumn("__nth", rank).filter("__nth = 1")
    kinds = {"rating": "double"}
    human = human.select(
        "id",
        *[
            (F.col(c) if c in human.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c)
            for c in REVIEW_COLUMNS
        ],
        F.col("__label").cast("int").alias("label"),
        F.lit("human").alias("label_source"),
    )
    mine = base.select(*columns).withColumn("label", F.col("label").cast("int"))
    known = mine.join(lookup_table(human.select("id"), "id"), "id", "left_semi").select("id")
    relabelled = selection.merge_human_labels(mine, human.select("id", "label"))
    new = human.join(lookup_table(known, "id"), "id", "left_anti")
    merged = relabelled.withColumn(
        "label_source", F.when(F.col("label_source") == "pool", "train").otherwise("human")
    ).unionByName(new)
    return drop_blocked(merged, blocked) if blocked is not None else merged


def retrain(
    train: DataFrame,
    human: DataFrame,
    evaluation: DataFrame,
    scorer: scoring.Scorer,
    blocked: DataFrame | None = None,
    batch: str | None = None,
    **options,
) -> tuple[PipelineModel, DataFrame]:
    """Fit again on train and human rows together, weighted, and evaluate.

    Ids that are on the eval side too are an error; block them.
    """
    merged = cut_lineage(merge_training_rows(train, human, blocked, batch))
    leakage.assert_no_leakage(merged, evaluation)
    weighted = scoring.weight_rows(merged, scorer).drop("probs")
    model = scoring.train_classifier(weighted, "sample_weight", **options)
    return model, scoring.evaluate_scorer(evaluation, scoring.model_scorer(model))


def seen_and_blocked(spark: SparkSession, paths: Sequence[str], *tables: DataFrame) -> DataFrame:
    """All ids that must not be drawn again."""
    return union_id_sets(readers.read_id_set(spark, paths), *tables)
