"""Session-level helpers: shared scratch space, lineage cuts and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: set[str] = set()

#: Rows and bytes of an Arrow batch, unless the session sets them: texts may be long, and several
#: batches of each Python worker are in memory at once.
BATCH_ROWS = 512
BATCH_BYTES = 1 << 22
_BATCH_OPTIONS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
    "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
}


def small_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python in small batches; sizes set by the user stay."""
    for option, size in _BATCH_OPTIONS.items():
        if spark.conf.get(option, None) is None:
            spark.conf.set(option, str(size))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of the machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="reviewloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses; ``release_scratch`` removes it."""
    folder = f"{shared_folder(spark).rstrip('/')}/reviewloom-{uuid.uuid4().hex}"
    _scratch.add(folder)
    return f"{folder}/{name}"


def release_scratch(spark: SparkSession) -> None:
    """Remove what jobs of this session wrote to the shared folder.

    Tables that were returned may read from there, so call it when their results are stored.
    """
    context = spark.sparkContext
    for folder in list(_scratch):
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _scratch.discard(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and continue from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and continue from it.

    Unlike a checkpoint, Spark knows the bytes of the table and decides by them, under the
    session's own limit, whether a join broadcasts it.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for a costly expression that later filters and joins refer to.

    The optimizer copies a plain column's expression into the filters it pushes below it. It
    does not do so with the output of a generator, here one over a one-element array.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
