"""Toxicity scores of restored texts.

Texts are restored first (see `deobfuscation`), with a character model counted over all texts. Words
and beginnings of words are then features. Those that mark toxic documents are chosen on a bounded
sample of labelled documents: nearly all documents that hold the feature are toxic, in enough
different groups of documents. Copies share the smallest hash of their word pairs and count as one group,
so that words which merely stand beside an insult in many copies of one text are not chosen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm import common
from terraloom.llm.deobfuscation import LETTERS, Restorer, language_model, trigram_counts

#: Labelled documents that the list is chosen on, about: a sample by a hash of their ids.
FIT_ROWS = 20_000
#: A feature's least toxic groups of documents, and its least share of toxic groups.
LEAST_GROUPS, LEAST_PRECISION = 6, 0.9
#: The score of a text without any chosen feature.
UNEXPLAINED = 0.02
#: Lengths of word beginnings.
SHORTEST, LONGEST = 4, 8

_WORD = re.compile(f"[{LETTERS}]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features_of(word: str) -> list[str]:
    """The word itself, closed by a mark, and its beginnings."""
    return [word + "$", *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def _occurrences(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch in common.arrow_rows(batches, 200):
            groups, toxic, features = [], [], []
            for text, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _WORD.findall(restore(text.lower()))
                if not words:
                    continue
                pairs = {f"{x} {y}".encode() for x, y in zip(words, words[1:] + words[:1])}
                own = sorted({f for w in set(words) for f in features_of(w)})
                features += own
                groups += [min(map(zlib.crc32, pairs))] * len(own)
                toxic += [mark] * len(own)
            yield pa.record_batch(
                [
                    pa.array(features, pa.string()),
                    pa.array(groups, pa.int64()),
                    pa.array(toxic, pa.int32()),
                ],
                ["feature", "near", "toxic"],
            )

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, toxic of about `rows` labelled documents that are not held out."""
    usable = (
        labels.filter(~held_out(labels["doc_id"]) & labels["toxic"].isNotNull())
        .groupBy(labels["doc_id"].cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null")
    )
    share = min(1.0, rows / max(1, usable.count()))
    # The sample's size is bounded by `rows`, so that it is safe to broadcast.
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return common.id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def fit(
    docs: DataFrame, labels: DataFrame, model: np.ndarray, rows: int = FIT_ROWS
) -> dict[str, float]:
    """The chosen features with the chance that each is right; bounded by the sample."""
    sample = labelled_sample(docs, labels, rows).select("text", "toxic")
    found = sample.mapInArrow(_occurrences(model), "feature string, near long, toxic int")
    chosen = (
        found.groupBy("feature", "near")
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
        .filter((F.col("toxic") >= LEAST_GROUPS) & (F.col("toxic") >= LEAST_PRECISION * F.col("n")))
        .collect()
    )
    return {r.feature: (r.toxic + 0.5) / (r.n + 1) for r in chosen}


class Scorer:
    """Scores texts by their restored tokens; a token's features are remembered."""

    REMEMBERED = 300_000

    def __init__(self, fitted: dict[str, float], model: np.ndarray) -> None:
        self.fitted, self.restore = fitted, Restorer(model)
        self.known: dict[str, tuple[str, ...]] = {}

    def _features(self, restored: str) -> tuple[str, ...]:
        words = _WORD.findall(restored)
        return tuple(f for w in words for f in features_of(w) if f in self.fitted)

    def __call__(self, text: str) -> float:
        """One less the chance that no feature in the text is right."""
        raw = text.lower().split()
        distinct = set(raw)
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        known = self.known
        for token in distinct.difference(known):
            known[token] = self._features(self.restore.token(token))
        own = set().union(*filter(None, map(known.__getitem__, distinct)))
        for _, _, span in self.restore.spaced(raw):
            own.update(self._features(span))
        clean = 1 - UNEXPLAINED
        for feature in sorted(own):
            clean *= 1 - self.fitted[feature]
        return 1 - clean


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts score as texts without a feature, and so do all without usable labels.
    Equal texts score alike; repeated rows give one row each; an empty table gives none.
    """
    model = language_model(trigram_counts(docs))
    scored = common.id_and_text(docs).mapInArrow(
        _scored(fit(docs, labels, model, rows), model), "doc_id long, score double"
    )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _scored(fitted: dict[str, float], model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(fitted, model)
        for batch in common.arrow_rows(batches, 500):
            scores = [scorer(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with their columns as they are."""
    model = language_model(trigram_counts(docs))
    fitted = fit(docs, labels, model, rows)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(fitted, model)
        for batch in common.arrow_rows(batches, 500):
            texts = batch.column(columns.index("text")).to_pylist()
            yield batch.filter(pa.array([scorer(t or "") < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
