"""Streams of reviews from growing folders, and ways to run them to a finished table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.conform import fill_defaults
from ..runtime import scratch_path


def file_stream(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Stream over the files of a folder (or of a path pattern), ``max_files`` per batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def category_stream(
    spark: SparkSession, folder: str, schema: str, max_files: int | None = None
) -> DataFrame:
    """Stream over ``folder/category=X/`` JSON shards; every row gets the category of its folder."""
    rows = file_stream(spark, folder, f"{schema}, category STRING", "json", max_files)
    stamped = rows.withColumn("product_category", F.col("category")).drop("category")
    return fill_defaults(stamped)


def finish(query: StreamingQuery, seconds: float | None = None) -> bool:
    """Wait until a bounded query has read everything; stop it when the time is over.

    Returns whether it came to its own end.
    """
    if seconds is None:
        query.awaitTermination()
        return True
    done = query.awaitTermination(seconds)
    if not done:
        query.stop()
    return bool(done)


def run_append(
    stream: DataFrame,
    path: str | None = None,
    checkpoint: str | None = None,
    seconds: float | None = None,
) -> DataFrame:
    """Read everything that is there now, append it to parquet files, return that table."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "table")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "progress"))
        .trigger(availableNow=True)
        .start(path)
    )
    finish(query, seconds)
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(
    stream: DataFrame,
    step: Callable[[DataFrame, int], None],
    output_mode: str = "append",
    checkpoint: str | None = None,
    seconds: float | None = None,
    partitions: int | None = None,
) -> bool:
    """Hand every micro-batch of what is there now to ``step(batch, number)``.

    A new stream keeps its state in the session's number of shuffle partitions, or in
    ``partitions`` if that is less; each of them is a task of every batch.
    """
    spark, option = stream.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(option, None)
    if partitions:
        spark.conf.set(option, str(min(int(spark.conf.get(option)), partitions)))
    try:  # the stream takes the session's options with it when it starts
        query = (
            stream.writeStream.foreachBatch(step)
            .outputMode(output_mode)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "progress"))
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.unset(option) if before is None else spark.conf.set(option, before)
    return finish(query, seconds)
