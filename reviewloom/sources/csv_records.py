"""CSV files whose fields may hold line breaks, each read by as many tasks as it has splits.

Spark reads such a file in one task when it looks for record ends itself. Here its text reader
deals the lines of every split; whether a split starts inside a quoted field is the parity of
all quotes before it, which is one small sum per split. A line then ends a record where the
parity is even. Records that cross splits are put together from their few fragments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import stored_table

#: Options under which a record is parsed; a quote inside a field is written twice.
OPTIONS = {"multiLine": "true", "escape": '"'}
_PLACED = "file string, block bigint, nth bigint, record string, kind string"
WHOLE, OPENS, GOES_ON = "whole", "opens", "goes on"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _starts_inside(lines: DataFrame) -> dict[str, set[int]]:
    """Splits that start inside a quoted field, by file: one number per such split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("before", F.sum("quotes").over(before)).filter("before % 2 = 1")
    found: dict[str, set[int]] = {}
    for row in inside.select("file", "block").collect():
        found.setdefault(row.file, set()).add(row.block)
    return found


class _Split:
    """The lines of one split, in order, as records and fragments."""

    def __init__(self, file: str, block: int, inside: bool):
        self.place, self.inside, self.goes_on = (file, block), inside, inside
        self.nth, self.open = 0, []

    def _row(self, kind: str) -> tuple:
        nth = -1 if kind == GOES_ON else self.nth
        self.nth += kind != GOES_ON
        record, self.open, self.goes_on = "\n".join(self.open), [], False
        return (*self.place, nth, record, kind)

    def add(self, values: list[str], inside: np.ndarray) -> Iterator[tuple]:
        """Rows that end in these lines; ``inside`` says if the parity after a line is odd."""
        for value, within in zip(values, inside.tolist()):
            if not self.open and not self.goes_on and not within and value in ("", "\r"):
                continue
            self.open.append(value)
            if not within:
                yield self._row(GOES_ON if self.goes_on else WHOLE)
        if len(inside):
            self.inside = bool(inside[-1])

    def end(self) -> Iterator[tuple]:
        if self.open:
            yield self._row(GOES_ON if self.goes_on else OPENS)


def _place(starts: dict[str, set[int]]):
    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["file", "block", "nth", "record", "kind"]
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            if not batch.num_rows:
                continue
            quotes = pc.count_substring(batch["value"], '"').to_numpy(zero_copy_only=False)
            values, files = batch["value"].to_pylist(), batch["file"].to_pylist()
            blocks = batch["block"].to_pylist()
            places = list(zip(files, blocks))
            new = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1])]
            rows: list[tuple] = []
            for start, stop in zip(new, [*new[1:], len(places)]):
                file, block = places[start]
                if split is None or split.place != (file, block):
                    rows += split.end() if split else ()
                    split = _Split(file, block, block in starts.get(file, ()))
                inside = (split.inside + np.cumsum(quotes[start:stop])) % 2 == 1
                rows += split.add(values[start:stop], inside)
            yield table(rows)
        if split:
            yield table(list(split.end()))

    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, nth, record``: the text of every record, header and all, and its place.

    ``nth`` counts the records that start in a split, without gaps; blank lines between records
    are none. Every file is read twice, the first time to count quotes. Lines end in line feeds,
    with or without a carriage return. A quote in a field must be written twice and the field be
    quoted, as CSV asks; a quote left open takes the rest of its file into one record. Memory: a
    batch of lines, and a record. The driver holds one number for each split that starts inside
    a field.
    """
    lines = _lines(spark, path)
    starts = _starts_inside(lines)
    placed = lines.mapInArrow(_place(starts), _PLACED)
    whole = placed.filter(F.col("kind") == WHOLE).drop("kind")
    if not starts:
        # No record crosses splits; only one left open at a file's end is not whole.
        rest = placed.filter(F.col("kind") != WHOLE).drop("kind")
    else:
        parts = stored_table(placed.filter(F.col("kind") != WHOLE))
        chain = F.count_if(F.col("kind") == OPENS).over(
            Window.partitionBy("file").orderBy("block", "nth")
        )
        # A split has two fragments at most; its continued one comes first (nth is -1).
        rest = (
            parts.withColumn("chain", chain)
            .groupBy("file", "chain")
            .agg(F.sort_array(F.collect_list(F.struct("block", "nth", "record"))).alias("parts"))
            .select(
                "file",
                F.col("parts")[0]["block"].alias("block"),
                F.col("parts")[0]["nth"].alias("nth"),
                F.concat_ws("\n", "parts.record").alias("record"),
            )
        )
    unended = F.expr("left(record, length(record) - 1)")
    record = F.when(F.endswith("record", F.lit("\r")), unended).otherwise(F.col("record"))
    return whole.unionByName(rest).withColumn("record", record)


def read_csv_records(
    spark: SparkSession, path: str, schema: str | None = None, places: bool = False
) -> DataFrame:
    """Rows of CSV files with a header, whose fields may hold line breaks.

    Without ``schema`` all columns are strings named by the header. With ``places`` the columns
    ``__file``, ``__block`` and ``__nth`` (from 0 in each split) say where a record started.
    """
    if schema is None:
        names = spark.read.options(**OPTIONS).csv(path, header=True).columns
        schema = ", ".join(f"`{name.replace('`', '``')}` STRING" for name in names)
        if not names:
            return spark.range(0).select()
    first = (F.col("block") == 0).cast("bigint")  # the header of the file
    rows = csv_records(spark, path).filter((F.col("block") > 0) | (F.col("nth") > 0))
    place = [
        F.col("file").alias("__file"),
        F.col("block").alias("__block"),
        (F.col("nth") - first).alias("__nth"),
    ]
    return rows.select(
        *(place if places else []), F.from_csv("record", schema, OPTIONS).alias("__row")
    ).select(*(["__file", "__block", "__nth"] if places else []), "__row.*")
