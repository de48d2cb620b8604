"""Written tables that cut lineage between the rounds of iterative plans.

A table written to the shared checkpoint folder is computed once, survives the loss of any executor,
and gives the planner true sizes; ``checkpoint()`` computes its last stage twice.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[Scratch] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
#: Writes under way, and what the setting was before the first of them.
_WRITING: list = [0, None]


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """A table is written: nothing reads this run's shuffle files again. Writes of several threads share the setting."""
    with _LOCK:
        if not _WRITING[0]:
            _WRITING[1] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _WRITING[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITING[0] -= 1
            if not _WRITING[0]:
                spark.conf.set(_CLEANUP, _WRITING[1]) if _WRITING[1] is not None else spark.conf.unset(_CLEANUP)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A folder of intermediate tables. What a result still reads stays until the driver ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0
        _LIVE.append(self)

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the table read back."""
        self.n += 1
        path = f"{self.base}/{self.n}-{name}"
        with _cleaned(self.spark):
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        for t in tables:
            path = self.paths.pop(id(t), None)
            if path:
                self._remove(path)

    def _remove(self, path: str) -> None:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        """Remove everything."""
        self._remove(self.base)


@atexit.register
def _clean() -> None:
    for s in _LIVE:
        try:
            s.close()
        except Exception:  # noqa: BLE001 - the session may be gone
            pass
