"""Balanced and stratified samples and dev/eval splits.

The sampling operators decide on a narrow table (id, arrival number, class) and then fetch
the full rows by arrival number, so review texts are scanned but not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_empty
from ..runtime import stored_table
from .conform import label_column, with_id
from .dedup import fetch_rows, first_arrivals, require_columns
from .filters import cap_per_group, category_filter, drop_blocked, min_words, sample_rows
from .ranking import sample_hash, top_ranked


def sample_per_key(
    df: DataFrame,
    by: str,
    k: int,
    seed: int,
    key: Sequence[str] = ("id",),
    rank: str = "rank",
) -> DataFrame:
    """A uniform sample of at most ``k`` rows of each group.

    ``key`` must identify a row: the id after dedup, else the id and the arrival number.
    """
    require_columns(df, by, *key)
    hashed = df.withColumn("__hash", sample_hash(seed, *key))
    picked = top_ranked(hashed, [by], ["__hash", *key], k, rank=rank)
    return picked.drop("__hash")


def train_candidates(
    df: DataFrame,
    blocked: DataFrame | None = None,
    words: int = 0,
    dedup: bool = True,
    seq: str = "seq",
) -> DataFrame:
    """Narrow table of the rows that may train: id, arrival number and class."""
    require_columns(df, "text", "asin", seq)
    rows = min_words(df, words)
    narrow = with_id(rows).select("id", seq, label_column(rows).alias("label"))
    if dedup:  # before the anti join, so that copies are combined on the map side
        narrow = first_arrivals(narrow, "id", seq, ["label"])
    return drop_blocked(narrow, blocked) if blocked is not None else narrow


def balanced_train(
    df: DataFrame,
    per_class: int,
    seed: int = 42,
    blocked: DataFrame | None = None,
    words: int = 0,
    dedup: bool = True,
    seq: str = "seq",
) -> DataFrame:
    """At most ``per_class`` rows of each class, drawn uniformly from the whole table.

    Steps: word filter, first arrival of each id, blocklist, class from label or stars,
    seeded sample per class. Returns the rows with ``id`` and ``label``.
    """
    narrow = train_candidates(df, blocked, words, dedup, seq)
    narrow = stored_table(narrow)  # the ids are computed once, and ranking reads them twice
    key = ("id",) if dedup else ("id", seq)
    keep = sample_per_key(narrow, "label", per_class, seed, key, rank="__rank")
    return fetch_rows(df, keep.drop("__rank"), seq)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def split_candidates(
    df: DataFrame,
    categories: Sequence[str] = (),
    blocked: DataFrame | None = None,
    dedup: bool = True,
    seq: str = "seq",
) -> DataFrame:
    """Narrow table of the rows a split may draw: id, arrival number and category."""
    require_columns(df, "text", "asin", "product_category", seq)
    rows = category_filter(
        df.withColumn("product_category", or_empty("product_category")), categories
    )
    narrow = with_id(rows).select("id", seq, "product_category")
    if dedup:  # before the anti join, so that copies are combined on the map side
        narrow = first_arrivals(narrow, "id", seq, ["product_category"])
    return drop_blocked(narrow, blocked) if blocked is not None else narrow


def split_dev_eval(
    df: DataFrame,
    dev_k: int,
    eval_k: int,
    seed: int = 42,
    categories: Sequence[str] = (),
    blocked: DataFrame | None = None,
    dedup: bool = True,
    seq: str = "seq",
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Per category: ``dev_k`` sampled rows marked "dev", the next ``eval_k`` marked "eval".

    Both parts come from one draw over distinct ids, so they cannot share an id.
    ``candidates`` may pass in stored ``split_candidates``.
    """
    total = dev_k + eval_k
    narrow = candidates
    if narrow is None:
        narrow = split_candidates(df, categories, blocked, dedup, seq)
        narrow = stored_table(narrow)
    key = ("id",) if dedup else ("id", seq)
    drawn = sample_per_key(narrow, "product_category", total, seed, key)
    split = F.when(F.col("rank") <= dev_k, F.lit("dev")).otherwise(F.lit("eval"))
    keep = drawn.select("id", seq, "product_category", split.alias("split"))
    return fetch_rows(df, keep, seq)


def split_diagnostics(
    accepted: DataFrame, split: DataFrame, dev_k: int, eval_k: int
) -> DataFrame:
    """Per category: rows that could be drawn, rows drawn for each part, and a shortage flag."""
    seen = accepted.groupBy("product_category").agg(F.count(F.lit(1)).alias("seen"))
    drawn = split.groupBy("product_category").agg(
        F.count_if(F.col("split") == "dev").alias("dev_rows"),
        F.count_if(F.col("split") == "eval").alias("eval_rows"),
    )
    short = (F.col("dev_rows") < dev_k) | (F.col("eval_rows") < eval_k)
    return (
        seen.join(drawn, "product_category", "left")
        .na.fill(0, ["dev_rows", "eval_rows"])
        .withColumn("short", short)
    )


def allocate_quota(counts: DataFrame, n: int, by: str = "label", rows: str = "rows") -> DataFrame:
    """Seats per stratum by largest remainder; ties go to the smaller stratum value.

    ``counts`` has one row per stratum, plus possibly one with a NULL stratum that counts in
    the total and gets no seats. Asking for at least all rows gives every stratum its rows.
    """
    everyone = Window.partitionBy(F.lit(0))  # one row per stratum, a handful
    strata = counts.withColumn("total", F.sum(rows).over(everyone)).filter(
        F.col(by).isNotNull()
    )
    # Whole numbers throughout: share = rows * n / total without rounding.
    product = F.col(rows).cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)")
    base = F.expr(f"(CAST({rows} AS DECIMAL(19,0)) * CAST({int(n)} AS DECIMAL(19,0))) div total")
    seated = (
        strata.withColumn("base", F.when(F.col("total") <= n, F.col(rows)).otherwise(base))
        .withColumn("left_over", product - F.col("base") * F.col("total"))
    )
    extra = F.least(F.col("total"), F.lit(n)) - F.sum("base").over(everyone)
    place = F.row_number().over(everyone.orderBy(F.desc("left_over"), by))
    return seated.select(
        by,
        F.col(rows),
        (F.col("base") + F.when((place <= extra) & (F.col("total") > n), 1).otherwise(0))
        .cast("long")
        .alias("seats"),
        "total",
    )


def sample_stratified(
    df: DataFrame,
    n: int,
    seed: int = 42,
    by: str = "label",
    key: Sequence[str] = ("id",),
    seq: str = "seq",
) -> DataFrame:
    """``n`` rows in the proportions of ``by``; fewer rows than ``n`` are returned whole.

    Seats that the strata do not use (rows without a stratum count in the total) are filled
    from the rows that were not drawn. Without the column the sample is uniform.
    """
    if n <= 0:
        return df
    if by not in df.columns:
        return sample_rows(df, n, seed, key)
    require_columns(df, seq, *key)
    # Read several times below, so it is stored once: a few percent of the full rows.
    narrow = stored_table(df.select(*dict.fromkeys([*key, seq, by])))
    counts = narrow.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    seats = stored_table(allocate_quota(counts, n, by).select(by, "seats", "total"))
    total, seated = seats.agg(F.max("total"), F.sum("seats")).first()
    if total is None:  # no row has a stratum
        return sample_rows(df, n, seed, key)
    if total <= n:
        return df

    most = seats.agg(F.max("seats")).first()[0]
    hashed = narrow.withColumn("__hash", sample_hash(seed, *key))
    drawn = top_ranked(hashed, [by], ["__hash", *key], most, rank="__rank")
    drawn = drawn.join(seats, by).filter("__rank <= seats").select(seq)
    if seated == n:
        return fetch_rows(df, drawn, seq)
    # Rows without a seat among the first n of all hold the first ones of those without a seat.
    drawn = stored_table(drawn)
    first = top_ranked(hashed, [], ["__hash", *key], n, rank="__rank").drop("__rank")
    rest = first.join(drawn, seq, "left_anti")
    rest = top_ranked(rest, [], ["__hash", *key], n - seated, rank="__rank").select(seq)
    return fetch_rows(df, drawn.unionByName(rest), seq)


def first_n_per_category(
    df: DataFrame, n: int, by: str = "product_category", seq: str = "seq"
) -> DataFrame:
    """The first ``n`` arrivals of each category, with their rank."""
    return cap_per_group(df, n, by, seq, rank="rank")


def shuffle_rows(df: DataFrame, seed: int, key: Sequence[str] = ("id",)) -> DataFrame:
    """Stored order of a seeded shuffle (a distributed range sort)."""
    return df.orderBy(sample_hash(seed, *key), *key)
