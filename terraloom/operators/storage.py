"""Intermediate tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_FOLDER_KEY = "spark.checkpoint.dir"

#: Paths written since each open scope began, the innermost last.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach.

    The cluster names it in `spark.checkpoint.dir`; where that is unset, the warehouse serves. A
    warehouse on a local disk is shared by the threads of a local master only, so elsewhere it is
    an error: executors would each write to their own disk.
    """
    folder = spark.conf.get(_FOLDER_KEY, None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    place, files = file_system(spark, warehouse)
    local_master = spark.sparkContext.master.split("[")[0] == "local"
    if files.getUri().getScheme() == "file" and not local_master:
        raise ValueError(f"set {_FOLDER_KEY}: the warehouse {place} is a local folder")
    return f"{warehouse}/intermediate"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write `frame` to the shared folder and read it back.

    Later joins then plan on the table's real size, and a lost executor re-reads files instead of
    recomputing the whole upstream plan. The table goes when the innermost `scope` around the call
    ends, or else when the application does.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/terraloom/{name}-{uuid4().hex}"
    place, files = file_system(spark, path)
    files.deleteOnExit(place)
    if _SCOPES:
        _SCOPES[-1].append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` makes inside are removed on leaving, also after a failure.

    For a step whose results have been stored elsewhere by then: a run of many steps needs disk for
    one step's tables at a time.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.pop()
        for path in paths:
            place, files = file_system(spark, path)
            files.delete(place, True)
            files.cancelDeleteOnExit(place)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())
