"""Mixing sources to target weights, by subset sums over a histogram of lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, bucket_of, global_index, ranked, shuffle_partitions, stored
from .subset_sum import best_fill

#: Budget in words that the exact subset sum fills; what is above it is filled longest first.
EXACT_WORDS = 1 << 15
BUCKET_ROWS = 100_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``source, source_size, target`` for each source of ``source, size``.

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes by them. No target is above ``most`` times its source's size: what is above is shared
    among the others by weight, round by round, until none is above.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    numbered = global_index(totals, order, min(8, shuffle_partitions(spark)), "nth")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    sources = stored(
        numbered.select("source", "source_size", turn.cast("double").alias("weight")), "sources"
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full = most * F.col("source_size")
    level, capped = 0.0, -1
    while True:  # each round caps one source more, or is the last
        free = F.col("weight") * level < full
        row = sources.agg(
            F.sum(F.when(free, F.col("weight"))).alias("weight"),
            F.sum(F.when(~free, full)).alias("full"),
            F.sum((~free).cast("int")).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["weight"]:
            break
        capped = row["capped"]
        level = (total - (row["full"] or 0.0)) / row["weight"]
    target = F.least(F.col("weight") * level, full) if row["weight"] else full
    return sources.select("source", "source_size", target.alias("target"))


def copies(
    sizes: dict[int, int], source_size: int, target: float, most: int
) -> dict[int, tuple[int, int]]:
    """For each size: how often every document is taken, and how many are taken once more.

    Whole passes come first. Of the rest, each size gives its even share, rounded down; then
    one more document of each size, longest first, while more than ``EXACT_WORDS`` are missing;
    then the subset sum that comes closest to what is missing. If that cannot be met by taking
    documents once more, they may be taken again, up to ``most`` times in all.
    """
    positive = {n: count for n, count in sizes.items() if n}
    if not positive:
        return {n: (0, 0) for n in sizes}
    budget = round(target)
    whole = min(most, budget // source_size)
    missing = budget - whole * source_size if whole < most else 0
    extra = {n: count * missing // source_size for n, count in positive.items()}
    missing -= sum(n * k for n, k in extra.items())
    for passes in (1, most - whole):
        left = {n: count * passes - extra[n] for n, count in positive.items()}
        for n in sorted(left, reverse=True):
            k = max(0, min(left[n], (missing - EXACT_WORDS) // n))
            extra[n], left[n], missing = extra[n] + k, left[n] - k, missing - n * k
        room = min(missing, 2 * EXACT_WORDS)
        order = sorted((n for n in left if n <= room), reverse=True)
        for n, k in best_fill(order, left, room).items():
            extra[n], left[n], missing = extra[n] + k, left[n] - k, missing - n * k
        if not missing:
            break
    over = min((n for n in left if left[n] > 0), default=0)
    if over and over - missing < missing:  # one document too many is nearer than one too few
        extra[over] += 1
    each = {n: divmod(extra[n], count) for n, count in positive.items()}
    return {n: (whole + each[n][0], each[n][1]) if n else (0, 0) for n in sizes}


def _plan(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = dict(zip(rows["size"].tolist(), rows["n"].tolist()))
        found = copies(sizes, int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0]), most)
        return rows[["source", "size", "source_size", "target"]].assign(
            whole=[found[n][0] for n in sizes], extra=[found[n][1] for n in sizes]
        )

    return run


def mix(
    sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for rows ``doc_id, source, size``.

    ``copies`` says how often a document is taken, 0 to ``most`` times. Which documents of a
    size are taken once more is a seeded hash of doc_id, so reruns agree and partitioning does
    not matter; rows that share a doc_id and a size are alike and any of them may be taken.
    A null source is a source of its own, a source without words has target 0, an empty table
    gives no rows. The histogram (one row per source and length) is solved source by source.
    """
    spark = sizes.sparkSession
    sizes = stored(sizes.select("doc_id", "source", F.col("size").cast("bigint")), "sizes")
    histogram = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = source_targets(
        histogram.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most
    )
    same = F.col("h.source").eqNullSafe(F.col("t.source"))
    plan = (
        histogram.alias("h")
        .join(targets.alias("t"), same)
        .select("h.source", "size", "n", "source_size", "target")
        .groupBy("source")
        .applyInPandas(
            _plan(most),
            "source string, size bigint, source_size bigint, target double, whole int, extra bigint",
        )
    )
    rows = sizes.count()
    buckets = max(shuffle_partitions(spark), rows // BUCKET_ROWS + 1)
    dealt = sizes.withColumn("bucket", bucket_of(buckets, F.lit(seed), "doc_id"))
    order = [F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id"]
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))
    return (
        ranked(dealt, ["source", "size"], "bucket", order)
        .alias("d")
        .join(stored(plan, "plan").alias("p"), same)
        .select(
            "doc_id",
            "d.source",
            "d.size",
            "source_size",
            "target",
            (F.col("whole") + (F.col("rank") < F.col("extra")).cast("int")).alias("copies"),
        )
    )
