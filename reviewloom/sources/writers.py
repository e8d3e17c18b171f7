"""Writers. Each one writes in parallel; files are named by Spark."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import or_empty, stable_id
from ..operators.conform import rating_to_int
from ..operators.sampling import first_n_per_category
from ..runtime import stored_table
from ..schema import REVIEW_COLUMNS


_SCHEME = r"^[^:/]+:/*"


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, UTF-8, with NULL fields written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    # Leading and trailing blanks are data here; Spark's CSV writer would trim them.
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)


def append_ids(df: DataFrame, path: str, key: str = "id") -> None:
    """Add ids to a seen set; readers take the distinct ids."""
    df.select(F.col(key).cast("string")).write.mode("append").text(path)


def write_blocklist(df: DataFrame, path: str, key: str = "id") -> None:
    """Distinct ids in order, one per line (range-partitioned, so files are in order too)."""
    ids = df.select(F.col(key).alias("id")).distinct().orderBy("id")
    ids.write.mode("overwrite").text(path)


def append_gold(df: DataFrame, path: str, chunk_rows: int = 0) -> None:
    """Add labelled rows as zstd parquet files, of at most ``chunk_rows`` rows if that is set."""
    writer = df.write.mode("append").option("compression", "zstd")
    writer.option("maxRecordsPerFile", chunk_rows).parquet(path)


def write_text_file(spark: SparkSession, path: str, content: str) -> None:
    """A small text file (a manifest) in whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(target, True)
    try:
        stream.write(bytearray(content, "utf-8"))
    finally:
        stream.close()


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One-row metrics as JSON."""
    write_jsonl(metrics, path)


def snapshot_rows(df: DataFrame, n_per_category: int, seq: str = "seq") -> DataFrame:
    """Rows of a snapshot: defaults filled, whole stars, the first n of each category.

    ``rank`` is the position of the row in its category.
    """
    numbered = df.select(
        seq, "rating", *[or_empty(c).alias(c) for c in REVIEW_COLUMNS if c != "rating"]
    )
    return first_n_per_category(rating_to_int(numbered), n_per_category, seq=seq)


def write_snapshot(
    df: DataFrame,
    path: str,
    n_per_category: int,
    shard_size: int = 200_000,
    seq: str = "seq",
) -> DataFrame:
    """Write gzipped JSON-line shards under ``category=.../`` and return the manifest.

    A shard is ``shard_size`` consecutive rows of a category, so a large category is written
    by many tasks.
    """
    spark = df.sparkSession
    rows = snapshot_rows(df, n_per_category, seq)
    shard = F.floor((F.col("rank") - 1) / shard_size)
    placed = (
        rows.withColumn("category", F.col("product_category"))
        .withColumn("__shard", shard)
        .repartition("category", "__shard")
        .sortWithinPartitions("category", "__shard", "rank")
        .select(*REVIEW_COLUMNS, "category")
    )
    (
        placed.write.mode("overwrite")
        .partitionBy("category")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", shard_size)
        .option("ignoreNullFields", "false")
        .json(f"{path}/shards")
    )
    manifest = snapshot_manifest(spark, f"{path}/shards").withColumn(
        "file", F.concat(F.lit("shards/"), "file")
    )
    write_manifest(manifest, f"{path}/MANIFEST.json", shard_size)
    return manifest


def snapshot_manifest(spark: SparkSession, shards: str) -> DataFrame:
    """Files and actual row counts of a snapshot, one row per shard."""
    lines = spark.read.option("recursiveFileLookup", True).text(shards)
    file = relative_path(spark, shards, F.col("_metadata.file_path"))
    counted = lines.select(file.alias("file")).groupBy("file").agg(
        F.count(F.lit(1)).alias("rows")
    )
    folder = _unescape(F.regexp_extract("file", r"category=([^/]*)/", 1))
    category = F.when(folder == "__HIVE_DEFAULT_PARTITION__", "").otherwise(folder)
    return counted.withColumn("product_category", category)


def _unescape(text: Column) -> Column:
    """Percent-decoding that leaves plus signs alone."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def plain_path(file_path: Column) -> Column:
    """The address that Spark reports for a file, without scheme and percent-encoding."""
    return F.regexp_replace(_unescape(file_path), _SCHEME, "/")


def qualified_path(spark: SparkSession, path: str) -> tuple[str]:
    """A path as ``plain_path`` gives it for the files that Spark reads from it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return (re.sub(_SCHEME, "/", system.makeQualified(hadoop_path).toString()).rstrip("/"),)


def relative_path(spark: SparkSession, folder: str, file_path: Column) -> Column:
    """Path of a file below ``folder``, from the address Spark reports for it."""
    (base,) = qualified_path(spark, folder)
    return F.substr(plain_path(file_path), F.lit(len(base) + 2))


def write_manifest(manifest: DataFrame, path: str, shard_size: int) -> None:
    """The manifest as one JSON file; it lists one entry per shard."""
    rows = manifest.orderBy("file").collect()
    content = {
        "categories": sorted({row.product_category for row in rows}),
        "total": sum(row.rows for row in rows),
        "files": [row.file for row in rows],
        "schema": REVIEW_COLUMNS,
        "shard_size": shard_size,
    }
    write_text_file(manifest.sparkSession, path, json.dumps(content, ensure_ascii=False, indent=2))


def write_file_manifest(spark: SparkSession, path: str, files: list[str]) -> None:
    """A manifest that only lists files."""
    write_text_file(spark, path, json.dumps({"files": files}, ensure_ascii=False, indent=2))


def numbered_lines(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """Lines of text files with file path and 0-based line number.

    Lines are numbered inside each file split and the splits' line counts are added up, so a
    large plain file is not sent to one task. (A gzipped file is one split in any case.)
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    lines = reader.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__at"),
    )
    # Lines of a block are numbered in a row: one row per block says where it begins.
    blocks = lines.groupBy("file", "__start").agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    before = Window.partitionBy("file").orderBy("__start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = F.coalesce(F.sum("__rows").over(before), F.lit(0))
    blocks = stored_table(blocks.select("file", "__start", (base - F.col("__first")).alias("__base")))
    line = F.col("__at") + F.col("__base")
    return lines.join(blocks, ["file", "__start"]).select("value", "file", line.alias("line"))


def pool_rows(
    spark: SparkSession, snapshot: str, limit_per_file: int | None = None
) -> DataFrame:
    """Unlabelled pool of a snapshot; the stars are dropped.

    ``id`` is the file's path below the snapshot folder and the line number.
    """
    from .readers import json_lines

    lines = numbered_lines(spark, snapshot, "*.json.gz")
    if limit_per_file is not None:
        lines = lines.filter(F.col("line") < limit_per_file)
    fields = {name: "string" for name in ("text", "title", "asin", "product_category")}
    rows = json_lines(lines, fields, strict=True)
    name = relative_path(spark, snapshot, F.col("file"))
    identity = F.concat_ws(":", name, F.col("line").cast("string"))
    return rows.select(identity.alias("id"), *[or_empty(name).alias(name) for name in fields])


def blocklist_ids(*tables: DataFrame) -> DataFrame:
    """Distinct content IDs of review tables."""
    from ..operators.filters import union_id_sets

    return union_id_sets(*[t.select(stable_id("text", "asin").alias("id")) for t in tables])
