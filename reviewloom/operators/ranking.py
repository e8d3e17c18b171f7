"""Ranked selection that never brings a whole group into one task.

A selection first cuts: a sample of each large group gives a row that is surely behind the last
one wanted, and only rows up to it are ranked, ties included. The cut is a guess that is checked:
if fewer rows than wanted lie before it, the rest of the group is added. What is left of a group
is a few times its limit, and ranked by a window while that is a bounded number of rows.

Larger remainders, and ranks of whole tables, are dealt by range over group and order, with
borders that Spark samples from the rows, and sorted inside each range. A row's place among all
rows is its place in its range plus the rows of the ranges before; its rank is that place less
the first place of its group. A limit of millions, close scores or a few far ones are all spread
over as many tasks as the rows need, as long as the order ends in a unique column.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _col
from ..runtime import stored_table

#: Sampled rows of a group that gets a cut; smaller groups are ranked whole.
SAMPLE_ROWS = 1 << 15
#: Rows of one group that a single task may sort.
WINDOW_ROWS = 1 << 18


def sample_hash(seed: int, *keys: Column | str) -> Column:
    """Seeded pseudo-random key of a row; independent of partitioning and engine."""
    parts = [_col(k).cast("string") for k in keys] + [F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _sort_keys(order: Sequence[str]) -> list[tuple[str, bool]]:
    """Column and whether it falls, of names such as ``seq`` and ``score desc``."""
    return [(name.removesuffix(" desc"), name.endswith(" desc")) for name in order]


def _sorting(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() if falls else F.col(c).asc() for c, falls in _sort_keys(order)]


def _not_behind(order: Sequence[str], cut: Column) -> Column:
    """Whether a row is not behind the row ``cut``, a struct of its values, in the given order."""
    keys = _sort_keys(order)
    within = F.lit(True)
    for at in reversed(range(len(keys))):
        name, falls = keys[at]
        value, other = F.col(name), cut[f"v{at}"]
        # Nulls come first where the order rises and last where it falls.
        before = (value > other) if falls else (value < other)
        missing = (value.isNotNull() & other.isNull()) if falls else (value.isNull() & other.isNotNull())
        before = F.coalesce(before, F.lit(False)) | missing
        within = before | (value.eqNullSafe(other) & within)
    return within


def _same_group(by: Sequence[str], df: DataFrame, other: DataFrame) -> Column:
    """Join condition with a table whose columns are the group columns as g0, g1, ..."""
    same = F.lit(True)
    for i, name in enumerate(by):
        same = same & df[name].eqNullSafe(other[f"__g{i}"])
    return same


def _nth_of_sample(limit: Column, rows: Column) -> Column:
    """Place in a sample behind the last wanted row, but for less than one time in a million."""
    expected = limit * SAMPLE_ROWS / rows
    return F.ceil(expected + 5 * F.sqrt(expected) + 4)


def _worth_a_cut(limit: Column, rows: Column) -> Column:
    return rows > limit * 4 + 2 * SAMPLE_ROWS


def _values(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"v{i}") for i, (c, _) in enumerate(_sort_keys(order))])


def up_to_cut(
    df: DataFrame, by: Sequence[str], order: Sequence[str], limit: Column | int
) -> tuple[DataFrame, int]:
    """Rows of ``df`` that hold the first ``limit`` of each group, and the most rows of a group.

    Groups of more than four limits and two samples lose the rows behind their cut; ``df`` is then
    read three times, once to count, once to sample and once to cut.
    """
    if not by:
        return _up_to_one_cut(df, order, limit)
    names = [f"__g{i}" for i in range(len(by))]
    keys = [F.col(name).alias(key) for name, key in zip(by, names)]
    wanted = F.greatest(limit if isinstance(limit, Column) else F.lit(limit), F.lit(0)).cast("long")
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"))
    groups = stored_table(groups.select(*keys, "__rows", wanted.alias("__limit")))
    most = groups.agg(F.max("__rows")).first()[0] or 0
    limit_, rows_ = F.col("__limit"), F.col("__rows")
    if most <= 2 * SAMPLE_ROWS:
        return df, most
    # At most one group for each two samples of rows.
    large = stored_table(groups.filter(_worth_a_cut(limit_, rows_)))
    if large.isEmpty():
        return df, most
    drawn = df.join(large, _same_group(by, df, large)).filter(F.rand(11) < F.lit(SAMPLE_ROWS) / rows_)
    columns = [c for c, _ in _sort_keys(order)]
    drawn = stored_table(drawn.select(*names, *columns, "__limit", "__rows"))
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*_sorting(order)))
    cuts = drawn.withColumn("__place", place).filter(F.col("__place") == _nth_of_sample(limit_, rows_))
    cuts = stored_table(cuts.select(*names, "__limit", _values(order).alias("__cut")))
    marked = df.join(cuts, _same_group(by, df, cuts), "left")
    within = F.col("__cut").isNull() | _not_behind(order, F.col("__cut"))
    whole = [df[c] for c in df.columns]
    kept = stored_table(marked.filter(within).select(*whole, "__limit"))
    counts = kept.groupBy(*keys, "__limit").agg(F.count(F.lit(1)).alias("__kept"))
    counts = stored_table(counts)
    most = counts.agg(F.max("__kept")).first()[0] or 0
    kept = kept.drop("__limit")
    short = counts.filter("__kept < __limit")
    if not short.isEmpty():  # an unlucky sample: what lies behind these cuts is added
        behind = marked.filter(~within).select(*whole)
        behind = stored_table(behind.join(short, _same_group(by, behind, short), "left_semi"))
        kept, most = kept.unionByName(behind), most + behind.count()
    return kept, most


def _up_to_one_cut(df: DataFrame, order: Sequence[str], limit: int) -> tuple[DataFrame, int]:
    """``up_to_cut`` for a whole table; the cut is one row of the driver."""
    rows = df.count()
    if rows <= limit * 4 + 2 * SAMPLE_ROWS:
        return df, rows
    columns = [c for c, _ in _sort_keys(order)]
    drawn = df.select(*columns).filter(F.rand(11) < SAMPLE_ROWS / rows)
    expected = limit * SAMPLE_ROWS / rows
    nth = ceil(expected + 5 * expected**0.5 + 4)
    cut = drawn.orderBy(*_sorting(order)).offset(nth - 1).limit(1).first()
    if cut is None:
        return df, rows
    types = dict(df.dtypes)
    row = F.struct(*[F.lit(v).cast(types[c]).alias(f"v{i}") for i, (c, v) in enumerate(zip(columns, cut))])
    within = _not_behind(order, row)
    kept = stored_table(df.filter(within))
    count = kept.count()
    if count < limit:
        return df, rows
    return kept, count


def with_rank(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    limit: Column | int | None = None,
    rank: str = "rank",
) -> DataFrame:
    """Exact rank inside each group, from 1; with a ``limit`` (a number, or a column over
    ``by``) only the rows up to it.

    All columns of ``df`` are shuffled and stored, so pass narrow rows; they are read twice,
    once to sample the borders of the ranges. ``order`` should end in a unique column.
    """
    by = list(by)
    sort = [F.col(name).asc_nulls_first() for name in by] + list(order)
    dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # Spark numbers the rows of a partition from (partition number << 33) on.
    placed = stored_table(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base")
    )
    # One row per range, and there are no more ranges than shuffle partitions.
    placed = placed.withColumn("__part", part).join(F.broadcast(base), "__part")
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("__place", F.col("__base") + inside).drop("__part", "__base", "__at")
    if by:
        firsts = placed.groupBy(*[F.col(name).alias(f"__g{i}") for i, name in enumerate(by)])
        firsts = firsts.agg(F.min("__place").alias("__first"))
        placed = placed.join(firsts, _same_group(by, placed, firsts))
        placed = placed.drop(*[f"__g{i}" for i in range(len(by))])
    else:
        placed = placed.withColumn("__first", F.lit(0))
    ranked = placed.withColumn(rank, F.col("__place") - F.col("__first") + 1)
    ranked = ranked.drop("__place", "__first")
    return ranked if limit is None else ranked.filter(F.col(rank) <= limit)


def top_ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    limit: Column | int,
    rank: str = "rank",
) -> DataFrame:
    """The first ``limit`` rows of each group in the given order, with their ``rank``.

    ``order`` names columns, such as ``["score desc", "seq"]``, and should end in a unique one;
    ``limit`` is a number, or a column over ``by``. ``df`` is read several times: pass narrow
    rows, and stored ones if they cost something.
    """
    if isinstance(limit, int) and limit <= 0:
        return df.withColumn(rank, F.lit(0).cast("long")).filter(F.lit(False))
    few, most = up_to_cut(df, by, order, limit)
    if most > WINDOW_ROWS:
        return with_rank(few, by, _sorting(order), limit, rank)
    window = Window.partitionBy(*by).orderBy(*_sorting(order))
    numbered = few.withColumn(rank, F.row_number().over(window))
    return numbered.filter(F.col(rank) <= limit).withColumn(rank, F.col(rank).cast("long"))
