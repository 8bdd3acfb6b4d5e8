"""An index as snapshot folders with a pointer: replaced whole, read whole, never half-written.

Every write makes a new snapshot beside the old ones and then moves the pointer, which is one small
file; readers that have resolved the pointer keep reading their snapshot. There is one writer.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import replaced, without_prefix


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def pointer(self) -> dict | None:
        text = self._read("CURRENT")
        return json.loads(text) if text else None

    def read(self) -> DataFrame | None:
        now = self.pointer()
        return None if now is None else self.spark.read.parquet(f"{self.root}/{now['snapshot']}")

    def write(self, rows: DataFrame, files: int | None = None, batch: int | None = None) -> str:
        """A new snapshot, sorted by path inside its files for row-group pruning, then the pointer."""
        name = f"snapshot-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        out = rows.repartition(files, "path") if files else rows
        out.sortWithinPartitions("path").write.parquet(f"{self.root}/{name}")
        tmp = self._path(f"{self.root}/CURRENT.{uuid.uuid4().hex[:8]}")
        stream = self._fs.create(tmp, True)
        stream.write(bytearray(json.dumps({"snapshot": name, "batch": batch}), "utf-8"))
        stream.close()
        self._move(tmp, self._path(f"{self.root}/CURRENT"))
        return name

    def _move(self, tmp, end) -> None:
        """Rename over what is there, in one step: a reader sees the old pointer or the new one."""
        hadoop, sc = self._jvm.org.apache.hadoop.fs, self.spark.sparkContext
        over = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(tmp, end, over)

    def replace_paths(self, fresh: DataFrame, gone: DataFrame | None = None, batch: int | None = None) -> str:
        """Insert the fresh rows in place of their paths' old ones; a batch that is already in does nothing."""
        now = self.pointer()
        if batch is not None and now and now.get("batch") is not None and now["batch"] >= batch:
            return now["snapshot"]
        old = self.read()
        return self.write(fresh if old is None else replaced(old, fresh, gone), batch=batch)

    def delete_prefix(self, prefix: str) -> str | None:
        old = self.read()
        return None if old is None else self.write(without_prefix(old, prefix))

    def compact(self, files: int) -> str | None:
        """The same rows in fewer files."""
        old = self.read()
        return None if old is None else self.write(old, files)

    def prune(self, keep: int = 2) -> int:
        """Delete snapshots but the newest ones and the current; how many went."""
        now = (self.pointer() or {}).get("snapshot")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("snapshot-"))
        old = [n for n in names[: max(0, len(names) - keep)] if n != now]
        for n in old:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return len(old)

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)


def append_log(rows: DataFrame, path: str) -> None:
    """Query log and report entries: JSON lines, appended."""
    rows.write.mode("append").json(path)
