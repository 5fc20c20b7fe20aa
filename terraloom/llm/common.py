"""What several operators share: words, table access, batches, tokenizer files."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: White space as the pattern engines of the tokenizer libraries have it, by code points, to stand in
#: a character class; Python's \\s has four more. Fixed values.
_SPACE_RANGES = (
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
SPACE = "".join(f"{chr(a)}-{chr(b)}" for a, b in _SPACE_RANGES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(frame: DataFrame) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(frame["text"], F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what an operator on single texts needs; other columns never meet its own names."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))


def unused_name(docs: DataFrame, name: str) -> str:
    """`name`, made longer until no column has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(column: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, also where `body` loops over it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def arrow_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `size` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def give_back_memory() -> None:
    """Return freed memory to the system, so that a worker which goes on to another stage does not
    hold what its last one needed.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle that the session's setting sizes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
