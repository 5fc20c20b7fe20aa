"""A corpus pipeline of five operators, each stage written as Parquet and read by the next.

1. toxicity: documents whose restored text is predicted toxic go.
2. near duplicates: one document of each group stays (five words, similarity 0.8 or more).
3. secrets: base secrets and linked credential parts are replaced by a mark; all documents stay.
4. mixing: sources are brought to their target weights; a document appears once per copy drawn.
5. byte-level BPE: the token ids of each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import byte_bpe, common, mixing, near_dedup, secrets, toxicity  # isort: split

# After the subpackage, which a checkout may lack: its absence is the one that the entry allows for.
import public_tokenizers

from terraloom.operators.storage import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; a null or empty text is scored like any other, equal rows alike.
    An empty table stays empty.
    """
    return toxicity.without_toxic(docs, common.read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Null and empty texts are linked with nothing and
    stay; rows of one id are compared one by one; an empty table stays empty.
    """
    return near_dedup.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of secrets; null and empty texts stay as they are, equal rows
    are treated alike, and an empty table stays empty.
    """
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target draws it: 0 to 2 times. Null sources are one
    source; null and empty texts have size 0; equal rows are drawn one by one; an empty table stays
    empty.
    """
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row; a null or empty text has no ids, a null doc_id stays null,
    and an empty table gives no rows.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.with_tokens(docs, ranks, public_tokenizers.PATTERN)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Restored text, exact similarity of candidate sets and BPE are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
