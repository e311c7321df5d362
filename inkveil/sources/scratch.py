"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[int, tuple[int, str]] = {}
_scope = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this machine if Spark runs on it alone, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """The setting is the session's: the first of several writes at once sets it, the last one sets it back."""
    key = id(spark._jsparkSession)
    with _lock:
        depth, before = _writing.get(key, (0, ""))
        if not depth:
            before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writing[key] = (depth + 1, before)
    try:
        yield
    finally:
        with _lock:
            depth, before = _writing.pop(key)
            if depth > 1:
                _writing[key] = (depth - 1, before)
            else:
                spark.conf.set(_CLEANUP, before)


def materialised(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    It is computed once, whatever reads it, and a lost executor costs no recomputation. What was shuffled for it is not needed after that;
    Spark is told to delete it when the write ends, so the disks hold one step's shuffles.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{scratch_dir(spark)}/inkveil-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    getattr(_scope, "tables", []).append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``materialised`` returned and that nothing reads any more: what was made of them is written too."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released() -> Iterator[None]:
    """Tables that this thread materialises within are deleted at the end; what is made of them must be written by then."""
    outer = getattr(_scope, "tables", None)
    _scope.tables = []
    try:
        yield
    finally:
        tables = _scope.tables
        if outer is None:
            del _scope.tables
        else:
            _scope.tables = outer
        dropped(*tables)
