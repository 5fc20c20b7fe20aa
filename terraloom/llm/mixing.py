"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target / source size. The
prefix sum of these along an order by size, plus one offset of the source, crosses an integer
boundary once per copy taken. Ordering by size makes each stretch of sizes contribute in
proportion, so that the words taken come near the target although sizes are very uneven.

The prefix sum never gathers a source in one task: documents are ranked within (source, size,
salt), salts within (source, size), and sizes within a source; only those small counts meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm import common
from terraloom.operators.storage import written

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most a source may be repeated.
SHARE, MOST = 1.5, 2
#: Parts of a (source, size) group.
SALTS = 64
SEED = "systematic"


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """`docs` with row numbers as column `row`, written: they hold for every later reading."""
    return written(docs.select("*", F.monotonically_increasing_id().alias(row)), "mix-rows")


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row_id, doc_id, source, size of every row; written once, as it is read several times. `row`
    names a column that tells equal rows apart, where there is one.
    """
    row = F.monotonically_increasing_id() if row is None else docs[row]
    found = docs.select(
        row.alias("row_id"),
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        F.regexp_count(common.text_of(docs), F.lit(common.WORD)).cast("long").alias("size"),
    )
    return written(found, "mix-sizes")


def targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """source, source_size, target, offset: one row per source.

    Sources by code point, null last, take the weights in turn. A target stops at `most` times its
    source's size; the excess is shared again by weight, which ends at one water level: the target
    is the smaller of the cap and weight x level.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    listed = per_source.withColumn("turn", turn)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") - 1) % len(weights) + 1)
    capped = listed.select(
        "*", weight.alias("weight"), (F.col("source_size") * most).alias("most_words")
    )
    # From the source whose cap is reached first on: what is left for whom.
    order = Window.orderBy(F.col("most_words") / F.col("weight"), "turn")
    before = F.coalesce(F.sum("most_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    levels = capped.withColumn("level", (total - before) / rest)
    holds = F.col("most_words") / F.col("weight") >= F.col("level")
    level = F.max(F.when(holds, F.col("level"))).over(Window.partitionBy())
    target = F.least(F.col("most_words").cast("double"), F.col("weight") * level)
    return levels.select(
        "source",
        "source_size",
        F.coalesce(target, F.col("most_words").cast("double")).alias("target"),
        _offset(F.col("source")).alias("offset"),
    )


def _offset(source: Column) -> Column:
    """A number in [0, 1) that depends on the source and the seed alone."""
    name = F.concat(F.lit(SEED + "|"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def ranks(sized: DataFrame) -> DataFrame:
    """row_id, doc_id, source, size and the row's rank in its source by size, salt and doc_id."""
    salted = sized.withColumn("salt", F.coalesce(F.pmod("doc_id", F.lit(SALTS)), F.lit(0)))
    cells = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_size.select(
        "source", "size", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("skip", F.coalesce(F.sum("n").over(within), F.lit(0)))
    same = placed["source"].eqNullSafe(starts["source"]) & (placed["size"] == starts["size"])
    placed = placed.join(starts, same).select(
        placed["source"], placed["size"], "salt", (F.col("skip") + F.col("start")).alias("base")
    )
    own = Window.partitionBy("source", "size", "salt").orderBy("doc_id", "row_id")
    counted = salted.withColumn("own", F.row_number().over(own))
    same = (
        counted["source"].eqNullSafe(placed["source"])
        & (counted["size"] == placed["size"])
        & (counted["salt"] == placed["salt"])
    )
    return counted.join(placed, same).select(
        "row_id", "doc_id", counted["source"], counted["size"], (F.col("base") + F.col("own")).alias("rank")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    row: str | None = None,
) -> DataFrame:
    """row_id, doc_id, source, size, source_size, target, copies of every row.

    Null texts have size 0; null sources form one source, the last. A row of size 0 may be drawn
    like any other and takes no words. Copies are 0 to `most`; equal rows may differ in copies.
    An empty table gives no rows. `row_id` tells equal rows apart within one result.
    """
    sized = sizes(docs, row)
    goals = targets(sized, weights, share, most)
    ranked = ranks(sized)
    # One row per source: as many as there are sources, not documents.
    drawn = ranked.join(goals, ranked["source"].eqNullSafe(goals["source"])).withColumn(
        "expected", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    )
    boundary = F.floor(F.col("rank") * F.col("expected") + F.col("offset"))
    previous = F.floor((F.col("rank") - 1) * F.col("expected") + F.col("offset"))
    return drawn.select(
        "row_id",
        "doc_id",
        ranked["source"],
        "size",
        "source_size",
        "target",
        (boundary - previous).cast("int").alias("copies"),
    )


def sample(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of `docs`, each row as often as it was drawn.

    Rows of null or empty text may be drawn like others; equal rows are drawn one by one; texts of
    any length stay whole; columns of any name stay as they are; an empty table gives no rows.
    """
    row = common.unused_name(docs, "__row_id")
    rows = numbered(docs, row)
    drawn = mix(rows, row=row).filter("copies > 0").select(F.col("row_id").alias(row), "copies")
    again = F.transform(F.sequence(F.lit(1), drawn["copies"]), lambda _: F.lit(True))
    chosen = drawn.select(row, F.explode(again))
    return rows.join(chosen.select(row), row).select(*[rows[c] for c in docs.columns])
