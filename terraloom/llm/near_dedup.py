"""Circulant MinHash near-duplicates.

Two permutations make the whole signature. A shingle's hash is placed on a ring of RING positions
by the first (the hash's own low bits, after mixing), and the second, one fixed table over the
ring, is read from that place on: coordinate k is the smallest table value `k` steps further, over
all shingles. A signature is thus the minimum of short windows of one table. Bands of coordinates
are hashed; documents that agree in a band are candidates, and candidates are verified by the exact
Jaccard similarity of their whole shingle sets.

Texts with equal sets form one class and are compared once. Buckets are not paired out: members are
first compared to centres of their buckets, and what is linked is joined. Then only pairs between
different components of a bucket matter. Where they are few they are all verified; in dense
buckets an exact prefix filter comes before: two sets of the required similarity share one of their
rarest shingles at a small enough place. So no link that would join two components is missed among
the candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm import common, components
from terraloom.operators.storage import written

#: Ring positions of the permutations, and the seed of the table.
RING, SEED = 1 << 20, 20_240_229
#: Rounds of comparing to centres before the remaining pairs are verified.
ROUNDS = 2
#: Pairs a member up to which a bucket is verified without the prefix filter.
SPARSE = 8
#: Shingles whose windows are held at once.
STEP = 512


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, least similarity in percent, and bands of the signature."""

    words: int = 5
    percent: int = 80
    bands: int = 32

    @property
    def rows(self) -> int:
        """Most coordinates of a band for which a pair at the limit is missed once in 100,000."""
        agree = (1e-5) ** (1 / self.bands)
        return max(1, math.floor(math.log(1 - agree) / math.log(self.percent / 100)))

    @property
    def width(self) -> int:
        return self.bands * self.rows


@lru_cache(maxsize=2)
def _table(width: int) -> np.ndarray:
    """Windows of the second permutation: row s is what a shingle at place s gives."""
    ring = np.random.default_rng(SEED).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[:width]]), width)


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; word hashes are kept between texts."""

    KEPT = 500_000

    def __init__(self, words: int) -> None:
        import xxhash

        self.words = words
        self.hash = xxhash.xxh3_64_intdigest
        self.kept: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space alone
        if not words:
            return np.empty(0, np.uint64)
        if len(self.kept) > self.KEPT:
            self.kept.clear()
        kept = self.kept
        for word in set(words).difference(kept):
            kept[word] = self.hash(word)
        hashes = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(words))
        made = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            made = _mix(made * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - n + 1 + k])
        return np.unique(made)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    table = _table(width)
    places = (_mix(shingles) & np.uint64(RING - 1)).astype(np.int64)
    lowest = np.full(width, RING, np.uint32)
    for start in range(0, len(places), STEP):
        np.minimum(lowest, table[places[start : start + STEP]].min(axis=0), out=lowest)
    return lowest


def _signed(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = _Shingler(rule.words)
        for batch in common.arrow_rows(batches, 1000):
            sizes, keys, bands = [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingler(text)
                sizes.append(len(shingles))
                if not len(shingles):
                    keys.append(None)
                    bands.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                rows = signature(shingles, rule.width).reshape(rule.bands, rule.rows)
                bands.append(
                    [
                        int.from_bytes(xxhash.xxh3_64_digest(row, k), "little", signed=True)
                        for k, row in enumerate(rows)
                    ]
                )
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return run


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = _Shingler(rule.words)
        for batch in common.arrow_rows(batches, 1000):
            sets = [shingler(t).tobytes() for t in batch.column(0).to_pylist()]
            keys = [xxhash.xxh3_128_digest(x) for x in sets]
            yield pa.record_batch(
                [pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["set_key", "held"]
            )

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.arrow_rows(batches, 2000):
            linked = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x = np.frombuffer(left.as_buffer(), np.uint64)
                y = np.frombuffer(right.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                ["a", "b", "linked"],
            )

    return run


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """a, b, linked of candidate pairs (a, b), by their whole sets. Written."""
    first = sets.select(F.col("node").alias("a"), F.col("held").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("held").alias("y"))
    held = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y")
    tested = held.mapInArrow(_verified(rule.percent), "a long, b long, linked boolean")
    return written(tested, "near-pairs")


def _crossing(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, n_shingles, component of buckets that hold several components. Written."""
    known = members.select("key", "node", "n_shingles").join(labels, "node")
    known = known.select("key", "node", "n_shingles", "component")
    several = (
        known.groupBy("key")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"))
        .filter("x <> y")
        .select("key")
    )
    return written(known.join(several, "key", "left_semi"), "near-crossing")


def _to_centres(crossing: DataFrame, number: int) -> DataFrame:
    """Members outside their bucket's largest component, with a member of it: a, b."""
    turn = F.xxhash64("node", F.lit(number))
    parts = crossing.groupBy("key", "component").agg(
        F.count("*").alias("n"), F.min_by(F.struct("node", "n_shingles"), turn).alias("one")
    )
    centres = parts.groupBy("key").agg(
        F.max_by(F.struct("component", "one"), F.struct("n", "component")).alias("top")
    )
    met = crossing.join(centres, "key").filter("component <> top.component")
    return _pairs(met, "node", "n_shingles", "top.one.node", "top.one.n_shingles")


def _sparse(crossing: DataFrame) -> DataFrame:
    """key, sparse: whether a bucket's pairs between components are few for its members."""
    parts = crossing.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = parts.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")
    )
    pairs = (F.col("n") * F.col("n") - F.col("own")) / 2
    return keys.select("key", (pairs <= SPARSE * F.col("n")).alias("sparse"))


def _all_crossing(crossing: DataFrame) -> DataFrame:
    """All pairs between different components of a bucket."""
    parts = crossing.select("key", "component").distinct()
    first = parts.withColumnRenamed("component", "x")
    second = parts.withColumnRenamed("component", "y")
    beside = first.join(second, "key").filter("x < y")
    left = crossing.toDF("key", "node_x", "size_x", "x")
    right = crossing.toDF("key", "node_y", "size_y", "y")
    met = beside.join(left, ["key", "x"]).join(right, ["key", "y"])
    return _pairs(met, "node_x", "size_x", "node_y", "size_y")


def _last_place(percent: int, size: Column, other: Column) -> Column:
    """Largest place (from 0) of the first shingle that a set can share with one of size `other`.

    Similar sets share at least percent / (100 + percent) of their sizes' sum.
    """
    shared = F.ceil((size + other) * percent / (100 + percent) - F.lit(1e-9))
    return size - shared


def _by_prefix(nodes: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different components that pass the prefix filter; `nodes`: node, component."""
    listed = sets.join(nodes.select("node").distinct(), "node", "left_semi").mapInArrow(
        _exploded, "node long, n_shingles long, shingle long"
    )
    # A shingle stands once in a set, so none holds more than its share of the rows.
    held = F.count("*").over(Window.partitionBy("shingle"))
    order = Window.partitionBy("node").orderBy("held", "shingle")
    least = F.ceil(F.col("n_shingles") * rule.percent / 100 - F.lit(1e-9))  # no partner is smaller
    placed = (
        listed.withColumn("held", held)
        .withColumn("place", F.row_number().over(order) - 1)
        .filter(F.col("place") <= F.col("n_shingles") - least)
        .join(nodes, "node")
        .select("node", "n_shingles", "shingle", "place", "component")
    )
    placed = written(placed, "near-prefixes")
    parts = placed.groupBy("shingle", "component").agg(
        F.min("place").alias("place"),
        F.min("n_shingles").alias("least"),
        F.max("n_shingles").alias("most"),
    )
    x, y = parts.alias("x"), parts.alias("y")
    beside = x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.component") < F.col("y.component"))
        & (F.col("x.place") <= _last_place(rule.percent, F.col("x.most"), F.col("y.least")))
        & (F.col("y.place") <= _last_place(rule.percent, F.col("y.most"), F.col("x.least"))),
    ).select(F.col("x.shingle").alias("shingle"), F.col("x.component").alias("x"), F.col("y.component").alias("y"))
    left = placed.select(
        "shingle", F.col("component").alias("x"), F.col("node").alias("node_x"),
        F.col("n_shingles").alias("size_x"), F.col("place").alias("place_x"),
    )
    right = placed.select(
        "shingle", F.col("component").alias("y"), F.col("node").alias("node_y"),
        F.col("n_shingles").alias("size_y"), F.col("place").alias("place_y"),
    )
    one = beside.join(left, ["shingle", "x"])
    same = (one["shingle"] == right["shingle"]) & (one["y"] == right["y"])
    near = (F.col("place_x") <= _last_place(rule.percent, F.col("size_x"), F.col("size_y"))) & (
        F.col("place_y") <= _last_place(rule.percent, F.col("size_y"), F.col("size_x"))
    )
    return _pairs(one.join(right, same & near), "node_x", "size_x", "node_y", "size_y")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.arrow_rows(batches, 200):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        sizes = np.array([len(x) for x in sets], np.int64)
        nodes = np.asarray(batch.column(0), np.int64)
        yield pa.record_batch(
            [
                pa.array(np.repeat(nodes, sizes)),
                pa.array(np.repeat(sizes, sizes)),
                pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)),
            ],
            ["node", "n_shingles", "shingle"],
        )


def _pairs(met: DataFrame, node: str, size: str, other: str, other_size: str) -> DataFrame:
    return met.select(
        F.least(node, other).alias("a"),
        F.greatest(node, other).alias("b"),
        F.least(size, other_size).alias("less"),
        F.greatest(size, other_size).alias("more"),
    )


def _candidates(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs whose sizes allow the similarity."""
    return pairs.filter(
        (F.col("a") < F.col("b")) & (100 * F.col("less") >= rule.percent * F.col("more"))
    ).select("a", "b").distinct()


def group(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    component_id is the smallest doc_id that links reach; `kept` marks that document. Texts without
    words, and null texts, have an empty set and link with nothing. A row without id links with
    nothing either: its component_id is null and it is kept. Rows that share a doc_id are each
    compared, and all show the smallest of their components.
    """
    rule = rule or Rule()
    narrow = common.id_and_text(docs)
    rows = written(
        narrow.mapInArrow(
            _signed(rule), "doc_id long, n_shingles long, set_key binary, bands array<long>"
        ),
        "near-rows",
    )
    usable = rows.filter("set_key is not null and doc_id is not null")
    classes = written(
        usable.groupBy("set_key").agg(
            F.min("doc_id").alias("least_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        )
        # A node is a class, also where classes share an id; the written number stays.
        .withColumn("node", F.monotonically_increasing_id()),
        "near-classes",
    )
    entries = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
    shared = (
        entries.groupBy("key")
        .agg(F.min("node").alias("x"), F.max("node").alias("y"))
        .filter("x <> y")
        .select("key", F.col("x").alias("centre"))
    )
    members = written(entries.join(shared, "key"), "near-members")
    nodes = members.select("node").distinct()
    wanted = classes.join(nodes, "node", "left_semi").select("node", "set_key", "least_id")
    texts = narrow.join(wanted, narrow["doc_id"] == wanted["least_id"], "left_semi").select("text")
    # One row a class, however often its id or its texts repeat.
    made = texts.mapInArrow(_sets(rule), "set_key binary, held binary").dropDuplicates(["set_key"])
    sets = written(made.join(wanted, "set_key").select("node", "held"), "near-sets")
    labels = written(nodes.select("node", F.col("node").alias("component")), "labels")
    # First each node meets the smallest centre of its buckets: one pair a node.
    nearest = members.groupBy("node").agg(F.min("centre").alias("centre"))
    pairs = nearest.filter("centre < node").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    tested = verify(pairs, sets, rule)
    labels = components.merged(labels, tested.filter("linked"))
    crossing = _crossing(members, labels)
    for number in range(ROUNDS):
        found = _candidates(_to_centres(crossing, number), rule)
        new = verify(found.join(tested, ["a", "b"], "left_anti"), sets, rule)
        labels = components.merged(labels, new.filter("linked"))
        tested = tested.unionByName(new)
        crossing = _crossing(crossing, labels)
    dealt = crossing.join(_sparse(crossing), "key")
    few = _all_crossing(dealt.filter("sparse").drop("sparse"))
    dense = dealt.filter("not sparse").select("node", "component").distinct()
    found = _candidates(few.unionByName(_by_prefix(dense, sets, rule)), rule)
    new = verify(found.join(tested, ["a", "b"], "left_anti"), sets, rule)
    labels = components.merged(labels, new.filter("linked"))
    placed = classes.select("set_key", "node", "least_id").join(labels, "node", "left").select(
        "set_key", "least_id", F.coalesce("component", "node").alias("component")
    )
    lowest = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_class = placed.join(lowest, "component").select("set_key", "component_id")
    grouped = usable.select("doc_id", "set_key").join(by_class, "set_key")
    return _labelled(rows, grouped)


def _labelled(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """The smallest component of each doc_id, put to its rows."""
    by_doc = grouped.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    found = rows.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def representatives(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The rows of `docs` that `group` keeps, with their columns as they are.

    Rows that share a doc_id stay or go together; rows without id stay.
    """
    gone = group(docs, rule).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    same = docs["doc_id"].cast("long") == gone["__gone"]
    return docs.join(gone, same, "left_anti")
