"""Readers for review tables, line files, manifests, id sets and label files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import parse_number
from ..functions.text import or_empty, strip_ws
from ..operators.conform import conform_schema
from ..operators.filters import union_id_sets
from ..runtime import compute_once, stored_table
from ..schema import POOL_SCHEMA, TODO_SCHEMA
from .csv_records import read_csv_records

#: Fields taken from a JSON line unless the caller names others.
LINE_FIELDS = {
    "text": "string",
    "rating": "double",
    "title": "string",
    "asin": "string",
    "product_category": "string",
}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system its scheme names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names directly under a folder; none if there is no such folder."""
    if not path_exists(spark, folder):
        return []
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in system.listStatus(hadoop_path)]


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _require_paths(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        if not path:
            raise ValueError("the path is empty")
        if not path_exists(spark, path):
            raise FileNotFoundError(f"not found: {path}")


def read_reviews_parquet(
    spark: SparkSession, path: str, with_label: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Parquet reviews brought to the fixed columns; an absent path is an error."""
    _require_paths(spark, path)
    return conform_schema(spark.read.parquet(path), with_label, keep)


def read_reviews_glob(
    spark: SparkSession,
    folder: str,
    pattern: str,
    with_label: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """All parquet files and folders under ``folder`` that match ``pattern``; none is an error."""
    reader = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True)
    try:
        df = reader.parquet(f"{folder.rstrip('/')}/{pattern}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no files match {pattern!r} in {folder}") from error
        raise
    return conform_schema(df, with_label, keep)


def json_lines(
    lines: DataFrame, fields: dict[str, str], value: str = "value", strict: bool = False
) -> DataFrame:
    """One row per line that holds a JSON object; other lines are dropped.

    Fields are read one by one, so a number given as text does not spoil the line. The other
    columns of ``lines`` (file name, position) are passed through. With ``strict`` an
    unreadable line fails the job.
    """
    is_object = F.startswith(strip_ws(value), F.lit("{"))
    if strict:
        parsed = compute_once(lines, "__json", F.parse_json(strip_ws(value)))
        objects = parsed.filter(is_object)
    else:
        parsed = compute_once(
            lines.filter(is_object), "__json", F.try_parse_json(strip_ws(value))
        )
        objects = parsed.filter(F.col("__json").isNotNull())
    columns = []
    for name, kind in fields.items():
        if kind == "double":
            raw = F.try_variant_get("__json", f"$.{name}", "string")
            columns.append(parse_number(raw).alias(name))
        else:
            columns.append(F.try_variant_get("__json", f"$.{name}", kind).alias(name))
    rest = [c for c in lines.columns if c != value]
    return objects.select(*rest, *columns)


def read_jsonl(
    spark: SparkSession, paths: str | Sequence[str], fields: dict[str, str] | None = None
) -> DataFrame:
    """JSON lines, plain or gzipped; blank and unreadable lines are skipped."""
    return json_lines(spark.read.text(paths), fields or LINE_FIELDS)


def read_jsonl_strict(
    spark: SparkSession, paths: str | Sequence[str], schema: str
) -> DataFrame:
    """JSON lines where an unreadable line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def read_manifest(
    spark: SparkSession, manifest: str, base_dir: str | None = None
) -> tuple[list[str], list[str]]:
    """Shard paths a manifest names, split into those that exist and those that are missing."""
    _require_paths(spark, manifest)
    listed = spark.read.schema("files ARRAY<STRING>").json(manifest, multiLine=True)
    base = (base_dir or manifest.rsplit("/", 1)[0]).rstrip("/")
    files = [row.file for row in listed.select(F.explode("files").alias("file")).collect()]
    paths = [f if re.match(r"/|[A-Za-z][A-Za-z0-9+.-]*:", f) else f"{base}/{f}" for f in files]
    # One listing per folder, however many shards a folder has.
    names = {
        folder: set(list_names(spark, folder)) if path_exists(spark, folder) else set()
        for folder in {p.rsplit("/", 1)[0] for p in paths}
    }
    found = [p for p in paths if p.rsplit("/", 1)[1] in names[p.rsplit("/", 1)[0]]]
    return found, [p for p in paths if p not in set(found)]


def shard_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a shard: itself, or those of a folder in the order of their names."""
    names = sorted(name for name in list_names(spark, path) if name[0] not in "._")
    if names == [path.rsplit("/", 1)[1]]:
        return [path]
    return [f"{path}/{name}" for name in names]


def read_shards(
    spark: SparkSession, manifest: str, base_dir: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Reviews of all shards in a manifest, and a table of the shards that are missing."""
    found, missing = read_manifest(spark, manifest, base_dir)
    rows = [(path,) for path in missing]
    absent = spark.createDataFrame(rows, "path STRING")
    if not found:
        return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in LINE_FIELDS.items())), absent
    return read_jsonl(spark, found), absent


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and a ``text`` column; a NULL text becomes empty."""
    _require_paths(spark, path)
    return _text_csv(spark, path, places=False)


def _text_csv(spark: SparkSession, path: str, places: bool) -> DataFrame:
    df = read_csv_records(spark, path, places=places)
    if "text" not in df.columns:
        raise ValueError(f"{path} has no column named text")
    return df.withColumn("text", or_empty("text"))


def numbered_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """``row, text``: the texts of a CSV file, or of a folder's files by name, numbered from 0.

    A record's number is its number in its split plus the records of all splits before.
    """
    _require_paths(spark, path)
    place = ["__file", "__block"]
    rows = _text_csv(spark, path, places=True).select(*place, "__nth", "text")
    splits = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    base = F.coalesce(F.sum("__rows").over(before), F.lit(0))
    splits = stored_table(splits.select(*place, base.alias("__base")))
    return rows.join(splits, place).select((F.col("__nth") + F.col("__base")).alias("row"), "text")


def reviews_from_rows(
    spark: SparkSession, rows: Sequence[dict], with_label: bool = False
) -> DataFrame:
    """A small review table from inline rows, numbered in the given order."""
    fields = {**LINE_FIELDS, "rating": "string", "label": "string"}
    values = [
        (seq, *[None if row.get(f) is None else str(row[f]) for f in fields])
        for seq, row in enumerate(rows)
    ]
    schema = "seq BIGINT, " + ", ".join(f"{name} STRING" for name in fields)
    df = spark.createDataFrame(values, schema)
    return conform_schema(df, with_label, keep=("seq",))


def id_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct non-blank ids of a table of lines."""
    ids = lines.select(strip_ws(value).alias("id"))
    return ids.filter(F.col("id") != "").distinct()


def read_id_set(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Distinct ids of all the files; missing files are skipped."""
    found = [p for p in paths if p and path_exists(spark, p)]
    if not found:
        return spark.createDataFrame([], "id STRING")
    return id_lines(spark.read.text(found))


def load_blocklist(
    spark: SparkSession, paths: Sequence[str] = (), tables: Sequence[DataFrame] = ()
) -> DataFrame:
    """Union of id files and id tables."""
    return union_id_sets(read_id_set(spark, paths), *tables)


def read_category_tables(
    spark: SparkSession, folders: dict[str, str], schema: str
) -> DataFrame:
    """One JSON folder per category; every row gets the category of its folder."""
    parts = [
        spark.read.schema(schema).json(folder).withColumn("product_category", F.lit(category))
        for category, folder in folders.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored parquet with the three class probabilities."""
    _require_paths(spark, path)
    df = spark.read.parquet(path)
    return df.withColumn("probs", F.array("p_neg", "p_neu", "p_pos"))


def read_todo_csv(spark: SparkSession, path: str) -> DataFrame:
    """A finished label file."""
    _require_paths(spark, path)
    return spark.read.schema(TODO_SCHEMA).csv(path, header=True, multiLine=True, escape='"')


def mixed_texts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Non-blank texts of lines that are JSON objects with a ``text`` field or plain text.

    A line that is JSON but holds no text is dropped; the other columns are passed through.
    """
    parsed = compute_once(lines, "__json", F.try_parse_json(strip_ws(value)))
    field = F.try_variant_get("__json", "$.text", "string")
    text = F.when(F.col("__json").isNull(), strip_ws(value)).otherwise(field)
    rest = [c for c in lines.columns if c != value]
    return parsed.select(*rest, text.alias("text")).filter(F.col("text") != "")


def read_text_lines_mixed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Texts from lines that are JSON objects or plain text; blank ones are dropped."""
    return mixed_texts(spark.read.text(paths))


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Pool table written by this library."""
    _require_paths(spark, path)
    return read_csv_records(spark, path, POOL_SCHEMA)


def unnest_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """One row per text of request rows that hold ``text`` or a list ``texts``."""
    parsed = compute_once(requests, "__json", F.try_parse_json(F.col(body)))
    single = F.try_variant_get("__json", "$.text", "string")
    several = F.try_variant_get("__json", "$.texts", "array<string>")
    rest = [c for c in requests.columns if c != body]
    read = parsed.select(*rest, single.alias("__one"), several.alias("__many"))
    texts = F.when(F.col("__one").isNotNull(), F.array("__one")).otherwise(F.col("__many"))
    return read.select(*rest, F.posexplode(texts).alias("position", "text"))


__all__ = [name for name in dir() if name.startswith(("read_", "load_"))] + [
    "id_lines",
    "json_lines",
    "list_names",
    "mixed_texts",
    "path_exists",
    "reviews_from_rows",
    "unnest_requests",
]
