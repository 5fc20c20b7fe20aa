"""Outputs: CSV export, partitioned resumable table, merged view and its checks."""

from __future__ import annotations

import time
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.functions.calendar import quarter_label
from terraloom.operators.observations import output_columns
from terraloom.operators.storage import scope, written
from terraloom.operators.worklist import PARTITION, pending
from terraloom.schemas import OUTPUT_SCHEMA, SCALES, columns
from terraloom.sources.publication import current, folders, publish, remove

#: Finished partitions: the run that wrote each, and when.
LEDGER = columns("station_id string, year int, quarter string, run string, written_at bigint")


def write_csv(table: DataFrame, path: str) -> None:
    """Publish the 83 columns with a header as the current version of the export at `path`.

    A reader (`read_csv`) sees the former export or the whole new one, whenever the writer fails.
    """
    spark = table.sparkSession
    rows = output_columns(table)
    publish(spark, path, lambda folder: rows.write.option("header", True).csv(folder))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The current version of an export; a folder that was never published is read as it is."""
    folder = current(spark, path) or path
    return spark.read.schema(OUTPUT_SCHEMA).option("header", True).csv(folder)


def with_partition(table: DataFrame) -> DataFrame:
    day = F.col("period_start").cast("date")
    return table.withColumns({"year": F.year(day), "quarter": quarter_label(day)})


def _write_rows(rows: DataFrame, root: str, run: str) -> None:
    """Rows as one run: a folder of its own with year and quarter below, clustered by station."""
    (
        rows.hint("rebalance", "year", "quarter")
        .sortWithinPartitions("year", "quarter", "station_id")
        .withColumn("run", F.lit(run))
        .write.mode("append")
        .partitionBy("run", "year", "quarter")
        .parquet(f"{root}/rows")
    )


def write_partitions(table: DataFrame, work: DataFrame, root: str) -> None:
    """Write the rows of `work`'s partitions as one run, then record the partitions as done.

    Rows outside `work` are left out. A reader takes each partition from the latest recorded run. So
    a repeated partition replaces its old rows, also if it now has none, and a run that dies in
    between is never read.
    """
    run, now = uuid4().hex, time.time_ns()
    wanted = work.select(*PARTITION).distinct()
    rows = with_partition(output_columns(table)).join(wanted, PARTITION, "left_semi")
    _write_rows(rows, root, run)
    recorded = wanted.withColumns({"run": F.lit(run), "written_at": F.lit(now)})
    recorded.write.mode("append").parquet(_ledger(table.sparkSession, root))


def _ledger(spark: SparkSession, root: str) -> str:
    """Where the ledger is: the version that the last compaction published, or the first one."""
    return current(spark, f"{root}/ledgers") or f"{root}/done"


def _stored(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def latest_runs(spark: SparkSession, root: str) -> DataFrame:
    """Per finished partition the run that holds its rows."""
    ledger = _stored(spark, LEDGER, _ledger(spark, root))
    return ledger.groupBy(*PARTITION).agg(
        F.max_by("run", F.struct("written_at", "run")).alias("run")
    )


def done_partitions(spark: SparkSession, root: str) -> DataFrame:
    """Partitions that an earlier run finished; none before the first run."""
    return latest_runs(spark, root).select(*PARTITION)


def pending_partitions(spark: SparkSession, work: DataFrame, root: str) -> DataFrame:
    return pending(work, done_partitions(spark, root))


def _live_rows(spark: SparkSession, root: str, latest: DataFrame) -> DataFrame:
    """Rows of the runs that hold their partitions, with the partition's columns."""
    keys = columns("run string, year int, quarter string")
    schema = T.StructType([*OUTPUT_SCHEMA.fields, *keys.fields])
    rows = _stored(spark, schema, f"{root}/rows")
    return rows.join(latest, [*PARTITION, "run"], "left_semi")


def read_partitions(spark: SparkSession, root: str) -> DataFrame:
    """All partitions as one table with the output columns; empty before the first run."""
    return output_columns(_live_rows(spark, root, latest_runs(spark, root)))


def compact(spark: SparkSession, root: str) -> int:
    """Rewrite all live rows as one run, switch the ledger to it, and remove what it names no more.

    Runs of single batches become files of a useful size, and replaced rows go. The switch is the
    publication of a ledger with one entry a partition: a failure before it leaves the old runs in
    use, one after it leaves folders that the next compaction removes. Not to be run beside a writer;
    readers that began earlier may lose their files. Returns the number of runs removed.
    """
    with scope(spark):
        latest = written(latest_runs(spark, root), "latest-runs")
        named = {r["run"] for r in latest.select("run").distinct().collect()}
        if not named:
            return 0
        keep = next(iter(named))
        if len(named) > 1 or _replaced(spark, root):
            keep = uuid4().hex
            _write_rows(_live_rows(spark, root, latest).drop("run"), root, keep)
            entries = latest.select(*PARTITION).withColumns(
                {"run": F.lit(keep), "written_at": F.lit(time.time_ns())}
            )
            publish(spark, f"{root}/ledgers", lambda folder: entries.write.parquet(folder), 0)
    stale = [f for f in folders(spark, f"{root}/rows") if f.startswith("run=") and f != f"run={keep}"]
    for folder in stale:
        remove(spark, f"{root}/rows/{folder}")
    if current(spark, f"{root}/ledgers"):
        remove(spark, f"{root}/done")
    return len(stale)


def _replaced(spark: SparkSession, root: str) -> bool:
    """Whether some ledger entry is no longer the latest of its partition."""
    ledger = _stored(spark, LEDGER, _ledger(spark, root))
    counts = ledger.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*PARTITION).alias("d")).head()
    return counts["n"] > counts["d"]


def output_summary(table: DataFrame) -> DataFrame:
    """Row counts in one row: total, per scale, and rows of any other scale."""
    scale = F.col("scale")
    return table.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(scale == name).alias(f"{name}_rows") for name in SCALES],
        F.count_if(~scale.isin(*SCALES) | scale.isNull()).alias("other_rows"),
    )


def check_output(table: DataFrame, strict: bool = True) -> dict[str, int]:
    """Raise for an empty table or an unknown scale and, if strict, for unequal scale counts."""
    counts = output_summary(table).head().asDict()
    if counts["total_rows"] == 0:
        raise ValueError("the output table is empty")
    if counts["other_rows"] > 0:
        raise ValueError(f"{counts['other_rows']} output rows have an unexpected scale")
    if strict and counts["footprint_rows"] != counts["local_60m_rows"]:
        raise ValueError(
            f"{counts['footprint_rows']} footprint rows but {counts['local_60m_rows']} local rows"
        )
    return counts
