"""Exact top-k search by inner product: tiled matrix products and a merge tree.

Vectors become integers, so that scores are exact. Queries and candidates are cut into tiles of at
most TILE rows, and tiles are dealt in a grid: a block of at most HELD query tiles meets a block of
candidate tiles. A task holds the query tiles of a block, multiplies them with the candidate tiles
that stream past, selects k a tile, and keeps one running list a query, which leaves the task as one
row. So candidates travel once for each block of queries, and queries once for each block of
candidates. The lists of a query then meet in a tree: FAN lists at a time, level by level, so that no
task ever sees more of a query than FAN lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm import common
from terraloom.operators.storage import written

#: Rows of a tile, and lists that meet in a step of the tree.
TILE, FAN = 1024, 16
#: Query tiles that a task holds, and candidate tiles that stream past them.
HELD, PASSED = 8, 256
#: What scores stay below, so that products and the order of their keys are exact.
EXACT = 1 << 52
_NONE = np.iinfo("<i8").min // 2


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, q: floor(scale * x) of each component; rows with anything null or not finite go."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(
        "embedding",
        lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))),
    )
    usable = vectors.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    )
    return usable.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.floor(e * scale)).alias("q"),
    )


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one length packed together: ids, matrix, and the length."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {}

    def packed(size: int) -> pa.RecordBatch:
        nonlocal number
        rows = held.pop(size)
        ids = np.array([i for i, _ in rows], "<i8")
        order = np.argsort(ids, kind="stable")
        matrix = np.array([v for _, v in rows], "<i8").reshape(len(rows), size)
        if np.abs(matrix).max(initial=0) < 1 << 31:
            matrix = matrix.astype("<i4")
        number += 1
        return pa.record_batch(
            [
                pa.array([(part << 24) + number], pa.int64()),
                pa.array([size], pa.int32()),
                pa.array([ids[order].tobytes()], pa.binary()),
                pa.array([matrix[order].tobytes()], pa.binary()),
            ],
            ["tile", "size", "ids", "matrix"],
        )

    for batch in common.arrow_rows(batches, TILE):
        for vec_id, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(len(q), []).append((vec_id, q))
            if len(held[len(q)]) == TILE:
                yield packed(len(q))
    for size in list(held):
        yield packed(size)


_TILE = "tile long, size int, ids binary, matrix binary"


class _Tile:
    """Rows of a tile; of queries also the best scores and candidates so far."""

    def __init__(self, ids: pa.Scalar, matrix: pa.Scalar, size: int) -> None:
        self.ids = np.frombuffer(ids.as_buffer(), "<i8").copy()
        n = len(self.ids)
        held = matrix.as_buffer()
        width = held.size // (n * size) if size else 8
        self.matrix = np.frombuffer(held, f"<i{width}").reshape(n, size).astype("<f8")
        self.largest = float(np.abs(self.matrix).max(initial=0))
        self.scores = np.empty((n, 0), "<i8")
        self.found = np.empty((n, 0), "<i8")

    def meet(self, other: _Tile, k: int) -> None:
        """Products with a tile of candidates, the k best of them, and of those and the ones before."""
        if self.largest * other.largest * self.matrix.shape[1] >= EXACT:
            raise ValueError(f"components too large: scores may reach {EXACT}")
        n = len(other.ids)
        scores = (self.matrix @ other.matrix.T).astype("<i8")
        # Score, then smaller place, as one number; ids rise with places.
        keys = scores * n + (n - 1 - np.arange(n))
        own = self.ids[:, None] == other.ids[None, :]
        keys[own], scores[own] = _NONE, _NONE
        best = min(k, n)
        places = np.argpartition(keys, n - best, axis=1)[:, n - best :]
        scores = np.concatenate([self.scores, np.take_along_axis(scores, places, 1)], axis=1)
        found = np.concatenate([self.found, other.ids[places]], axis=1)
        order = np.lexsort((found, -scores), axis=-1)[:, :k]
        self.scores = np.take_along_axis(scores, order, 1)
        self.found = np.take_along_axis(found, order, 1)

    def lists(self, branch: int) -> pa.RecordBatch:
        real = self.scores > _NONE
        offsets = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype("<i4")
        pairs = pa.StructArray.from_arrays(
            [pa.array(-self.scores[real]), pa.array(self.found[real])], ["less", "vec_id"]
        )
        tops = pa.ListArray.from_arrays(pa.array(offsets), pairs)
        branches = pa.array(np.full(len(self.ids), branch, "<i8"))
        return pa.record_batch([pa.array(self.ids), branches, tops], ["query_id", "branch", "top"])


def _block_lists(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:4]]
            for row, (size, of, branch, passing) in enumerate(zip(*columns, strict=True)):
                if (size, of, branch) != now:
                    for query in queries:
                        yield query.lists(now[2])
                    now, queries = (size, of, branch), []
                if passing and not queries:
                    continue  # no query has this length
                tile = _Tile(batch.column(4)[row], batch.column(5)[row], size)
                if not passing:
                    queries.append(tile)
                    continue
                for query in queries:
                    query.meet(tile, k)
        for query in queries:
            yield query.lists(now[2])

    return run


def _best(k: int) -> Column:
    """The k best of lists that met: score falling, then vec_id rising."""
    ordered = F.array_sort(F.flatten(F.collect_list("top")))
    return F.slice(ordered, 1, k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query.

    Ties go to the smaller vec_id. Rows whose id or vector is null, or whose vector holds a null or
    non-finite component, take no part. Vectors of other lengths are no candidates of each other.
    Rows that repeat a vec_id are candidates each, but not of their own id; a repeated query is one.
    Components so large that scores may reach EXACT are an error.
    """
    spark = vectors.sparkSession
    whole = written(quantised(vectors, scale).mapInArrow(_tiles, _TILE), "tiles")
    asked = quantised(vectors.filter(is_query), scale).dropDuplicates(["vec_id"])
    queries = written(asked.mapInArrow(_tiles, _TILE), "query-tiles")
    parts = common.tasks(spark)
    tiles = max(1, whole.count())
    blocks = max(1, -(-queries.count() // HELD))
    # Some groups a task, so that they even out, and no longer ones than PASSED tiles.
    branches = max(-(-tiles // PASSED), min(tiles, -(-3 * parts // blocks)))
    group = ["size", "block", "branch"]
    held = _numbered(queries).select(
        "size",
        F.floor(F.col("number") / HELD).alias("block"),
        F.explode(_up_to(branches)).alias("branch"),
        F.lit(False).alias("passing"),
        "ids",
        "matrix",
        "tile",
    )
    passing = _numbered(whole).select(
        "size",
        F.explode(_up_to(blocks)).alias("block"),
        (F.col("number") % branches).alias("branch"),
        F.lit(True).alias("passing"),
        "ids",
        "matrix",
        "tile",
    )
    lists = (
        held.unionByName(passing)
        .repartition(parts, *group)
        .sortWithinPartitions(*group, "passing", "tile")
        .drop("tile")
        .mapInArrow(
            _block_lists(k),
            "query_id long, branch long, top array<struct<less: long, vec_id: long>>",
        )
    )
    while branches > FAN:
        lists = (
            lists.withColumn("branch", F.floor(F.col("branch") / FAN))
            .groupBy("query_id", "branch")
            .agg(_best(k).alias("top"))
        )
        branches = -(-branches // FAN)
    last = lists.groupBy("query_id").agg(_best(k).alias("top"))
    return last.select("query_id", F.posexplode("top").alias("place", "one")).select(
        "query_id",
        (F.col("place") + 1).alias("rank"),
        F.col("one.vec_id").alias("vec_id"),
        (-F.col("one.less")).alias("score"),
    )


def _up_to(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _numbered(tiles: DataFrame) -> DataFrame:
    """Written tiles counted from 0. The window and what is broadcast have one row for each partition
    that made tiles.
    """
    made = F.shiftright("tile", 24)
    counts = tiles.groupBy(made.alias("made")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("made")) - F.col("n")
    bases = counts.select("made", before.alias("base"))
    within = F.col("tile").bitwiseAND(F.lit((1 << 24) - 1)) - 1
    known = tiles.withColumn("made", made).join(F.broadcast(bases), "made")
    return known.withColumn("number", F.col("base") + within)
