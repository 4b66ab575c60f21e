"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: Spark deletes the query's shuffle files when it ends, and Python workers hold few rows at a time.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one, as in tests, gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, lineage cut."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    with _settings(spark):
        # A plan made under the settings.
        df.select("*").write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out, lambda _, key=id(out): _PATHS.pop(key, None)), path)
    return out


#: Where the tables that are still held were written.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        _, path = _PATHS.pop(id(df), (None, None))
        if path:
            deleted(df.sparkSession, path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
