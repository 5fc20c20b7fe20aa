"""A long run in batches: bounded parts of the work list, each computed and recorded by itself.

A batch is one quarter of a bounded group of neighbouring stations. Its rows are one run of the
partitioned output, and the ledger names them as soon as the batch ends. Whatever fails later, what
was recorded stays; the next run finds only the rest pending. Neighbours share pixel blocks and
weather cells, so a batch reads a compact part of every table.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.config import AnalysisConfig
from terraloom.operators.bounds import BLOCK, with_block
from terraloom.operators.stations import numbered
from terraloom.operators.storage import scope, written
from terraloom.operators.worklist import PARTITION
from terraloom.plans.availability import periods_of
from terraloom.plans.inputs import Inputs, Places
from terraloom.plans.training import build_training_tables
from terraloom.sources import sinks

_LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Batch:
    """Where a batch stands in the work list, and how many partitions it has."""

    year: int
    quarter: str
    station_group: int
    partitions: int

    def of(self, work: DataFrame) -> DataFrame:
        """Its partitions in a work list that `grouped` has marked."""
        own = (
            (F.col("year") == self.year)
            & (F.col("quarter") == self.quarter)
            & (F.col("station_group") == self.station_group)
        )
        return work.filter(own).select(*PARTITION)


@dataclass(frozen=True)
class Failure:
    batch: Batch
    error: Exception


class BatchesFailed(RuntimeError):
    """Some batches failed; all others that were tried are recorded."""

    def __init__(self, failures: list[Failure], done: int, left: int):
        first = failures[0]
        super().__init__(
            f"{len(failures)} batches failed, {done} are recorded, {left} were not tried; "
            f"first {first.batch}: {first.error}"
        )
        self.failures = failures


def grouped(work: DataFrame, sites: DataFrame, stations_per_batch: int) -> DataFrame:
    """The work list with `station_group`: at most so many stations, neighbours together.

    Stations are ordered by the block of ET cells that they lie in. Only stations with work count.
    """
    if stations_per_batch < 1:
        raise ValueError("a batch has at least one station")
    wanted = work.select("station_id").distinct()
    placed = with_block(sites.select("station_id", "cell_x", "cell_y").join(wanted, "station_id"))
    order = [*reversed(BLOCK), "station_id"]
    ordered = numbered(placed.select(*order), order, "place")
    group = F.floor((F.col("place") - 1) / stations_per_batch).cast("int")
    return work.join(ordered.select("station_id", group.alias("station_group")), "station_id")


def batches_of(work: DataFrame) -> list[Batch]:
    """The batches in order of time, then place: one row each reaches the driver."""
    keys = ["year", "quarter", "station_group"]
    counted = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("partitions")).orderBy(*keys)
    return [Batch(**row.asDict()) for row in counted.collect()]


def run_pending(
    inputs: Inputs,
    places: Places,
    config: AnalysisConfig,
    work: DataFrame,
    root: str,
    stations_per_batch: int,
    failures_allowed: int = 0,
    finished: Callable[[Batch, float], None] | None = None,
) -> int:
    """Compute and record `work` batch by batch; returns the number of batches.

    After `failures_allowed` failures the next one ends the run at once; with fewer, the rest is
    still done and recorded before `BatchesFailed` is raised. A batch's intermediate tables go when
    it ends. `finished` is called with each recorded batch and its seconds.
    """
    spark = work.sparkSession
    # Written: the ledger, and with it a pending list, changes while the run goes on.
    marked = written(grouped(work, places.sites, stations_per_batch), "batched-work")
    todo = batches_of(marked)
    periods = periods_of(inputs, config) if todo else None
    failures: list[Failure] = []
    for place, batch in enumerate(todo):
        began = time.monotonic()
        try:
            with scope(spark):
                part = batch.of(marked)
                rows = build_training_tables(inputs, places, config, part, periods)
                sinks.write_partitions(rows.final, part, root)
        except Exception as error:
            failures.append(Failure(batch, error))
            _LOG.warning("%s failed: %s", batch, error)
            if len(failures) > failures_allowed:
                done = place + 1 - len(failures)
                raise BatchesFailed(failures, done, len(todo) - place - 1) from error
            continue
        seconds = time.monotonic() - began
        _LOG.info("%s recorded after %.1f s, %d of %d", batch, seconds, place + 1, len(todo))
        if finished is not None:
            finished(batch, seconds)
    if failures:
        raise BatchesFailed(failures, len(todo) - len(failures), 0) from failures[0].error
    return len(todo)
