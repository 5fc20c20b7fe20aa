"""Data sets that a reader always finds whole: a folder per version, and a pointer replaced last.

The pointer is one small file with the names of the current version and of those before it that are
kept for readers which began on them. Whatever fails before it is replaced leaves the old version
current; whatever fails after it leaves folders that the next publication removes. One writer at a
time publishes under a path.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import SparkSession

from terraloom.operators.storage import file_system

POINTER = "CURRENT"
_PREFIX = "v-"


def publish(
    spark: SparkSession, path: str, write: Callable[[str], object], former_kept: int = 1
) -> str:
    """Let `write` fill a new folder, make it the current version, and return it."""
    before = history(spark, path)
    version = f"{_PREFIX}{time.time_ns():020d}-{uuid4().hex[:8]}"
    write(f"{path}/{version}")
    kept = [version, *before[:former_kept]]
    _point(spark, path, kept)
    for name in folders(spark, path):
        if name.startswith(_PREFIX) and name not in kept:
            remove(spark, f"{path}/{name}")
    return f"{path}/{version}"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version; None before the first publication."""
    versions = history(spark, path)
    return f"{path}/{versions[0]}" if versions else None


def history(spark: SparkSession, path: str) -> list[str]:
    """Names of the current version and of the former ones that are kept, latest first."""
    place, files = file_system(spark, f"{path}/{POINTER}")
    if not files.exists(place):
        return []
    stream = files.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return text.split()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below `path`."""
    place, files = file_system(spark, path)
    if not files.exists(place):
        return []
    return [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]


def remove(spark: SparkSession, path: str) -> None:
    place, files = file_system(spark, path)
    files.delete(place, True)


def _point(spark: SparkSession, path: str, versions: list[str]) -> None:
    """Replace the pointer in one step: a rename that overwrites, which file systems do atomically
    and object stores as one put.
    """
    fresh, files = file_system(spark, f"{path}/.{POINTER}-{uuid4().hex}")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray("\n".join(versions).encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(fresh, hadoop.Path(f"{path}/{POINTER}"), options)
