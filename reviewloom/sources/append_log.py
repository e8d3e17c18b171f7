"""Tables that grow by whole batches: a reader sees all rows of an append or none of them.

Rows are written to a folder of their own under ``data``. They belong to the table from the moment
a small file in ``log`` names that folder; it gets there by one rename, which refuses to replace
an entry. A job that dies before leaves a folder that no entry names and no reader opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession

from .readers import list_names, path_exists, remove_path
from .writers import write_text_file

_ENTRY = "version BIGINT, batch STRING, folder STRING"


class AppendLog:
    """A parquet table with numbered versions; version ``n`` holds the first ``n`` appends.

    The driver holds one short row per append, never one per row. Where the file system renames in
    one step (as HDFS does), writers may append at the same time: each gets a version of its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, batch: str | None = None, chunk_rows: int = 0) -> int:
        """Add the rows and return the version that holds them.

        A ``batch`` is added once: if it is in the table already, nothing is written and its
        version returned, so a job or a micro-batch may run again after a failure. Without
        a name each call adds its rows. An empty table of rows makes a version too.
        """
        batch = batch if batch is not None else uuid.uuid4().hex
        known = self._version_of(batch)
        if known is not None:
            return known
        folder = uuid.uuid4().hex
        writer = rows.write.option("compression", "zstd").option("maxRecordsPerFile", chunk_rows)
        writer.parquet(self._data(folder))
        while True:
            version = self._last() + 1
            if self._enter({"version": version, "batch": batch, "folder": folder}):
                return version
            known = self._version_of(batch)
            if known is not None:  # another run of the batch was faster
                remove_path(self.spark, self._data(folder))
                return known

    def read(self, schema, until: int | None = None) -> DataFrame:
        """The rows of all appends, or of those up to a version."""
        entries = [e for e in self.entries() if until is None or e["version"] <= until]
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._data(e["folder"]) for e in entries])

    def entries(self) -> list[Row]:
        """``version, batch, folder`` of each append, in order."""
        if not self._last():
            return []
        log = self.spark.read.schema(_ENTRY).option("pathGlobFilter", "*.json")
        return sorted(log.json(f"{self.path}/log").collect())

    def remove_leftovers(self) -> int:
        """Remove folders that no entry names, and say how many; nobody may be appending."""
        named = {e["folder"] for e in self.entries()}
        left = [n for n in list_names(self.spark, f"{self.path}/data") if n not in named]
        for name in left:
            remove_path(self.spark, self._data(name))
        return len(left)

    def _data(self, folder: str) -> str:
        return f"{self.path}/data/{folder}"

    def _last(self) -> int:
        names = list_names(self.spark, f"{self.path}/log")
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def _version_of(self, batch: str) -> int | None:
        return next((e["version"] for e in self.entries() if e["batch"] == batch), None)

    def _enter(self, entry: dict) -> bool:
        """Put an entry into the log as a whole, unless its version is taken."""
        jvm, context = self.spark._jvm, self.spark.sparkContext
        # Names with an underscore are hidden from readers.
        draft = f"{self.path}/log/_{uuid.uuid4().hex}"
        write_text_file(self.spark, draft, json.dumps(entry))
        conf, path = self.spark._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path
        target = path(f"{self.path}/log/{entry['version']:020d}.json")
        whole = target.getFileSystem(conf).makeQualified(target)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf)
        keep = context._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(whole.getFileSystem(conf).makeQualified(path(draft)), whole, keep)
        except Py4JJavaError as error:
            if not path_exists(self.spark, str(whole)):
                raise error
            remove_path(self.spark, draft)
            return False
        return True


def append_batches(log: AppendLog, name: str) -> Callable[[DataFrame, int], None]:
    """A step for ``run_batches``: every micro-batch once, also if it runs again."""

    def step(batch: DataFrame, number: int) -> None:
        log.append(batch, f"{name}-{number}")

    return step
