"""The registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import (
    byte_bpe,
    common,
    divergence,
    licences,
    line_frequency,
    mixing,
    near_dedup,
    periodic_runs,
    personal_data,
    secrets,
    token_counts,
    token_files,
    top_k,
    toxicity,
)

#: The end id of the token files and the limit of the token counts, from the contracts.
END_ID = 1
TOKEN_LIMIT = 512


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return toxicity.score(docs, common.read(spark, sf_dir, "labels"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.read(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(common.read(spark, sf_dir, "documents"))


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(common.read(spark, sf_dir, "documents"))
    spans = F.col("spans")
    counts = [
        F.size(secrets.of_kind(spans, kind)).cast("long").alias(f"n_{kind}") for kind in secrets.BASE
    ]
    base = secrets.joined(secrets.of_kind(spans, *secrets.BASE))
    return found.select(
        "doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.joined(spans).alias("spans")
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a source is a tree of folders of 1000 documents, where every other
    document stands in a folder of 100 below. Any document with a statement speaks for its folder.
    """
    docs = common.read(spark, sf_dir, "documents")
    thousand = F.floor(docs["doc_id"] / 1000).cast("string")
    hundred = F.when(docs["doc_id"] % 2 == 1, F.floor(docs["doc_id"] / 100).cast("string"))
    path = F.concat_ws("/", docs["source"], thousand, hundred, docs["doc_id"].cast("string"))
    found = licences.scan(docs, path, lambda _: F.lit(True))
    return found.withColumn("cosine", F.round("cosine", 6))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return near_dedup.group(docs, near_dedup.Rule(words=3, percent=85))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings")
    return top_k.search(vectors, F.col("vec_id") % 20 == 0)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = common.read(spark, sf_dir, "documents")
    return byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(
        docs, public_tokenizers.path("byte_bpe_50k.json"), ["<|endoftext|>"]
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.read(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(common.read(spark, sf_dir, "documents"))
    spans, base = F.col("spans"), F.filter("spans", lambda s: s["base"])

    def joined(listed: Column) -> Column:
        return F.array_join(
            F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, personal_data.KINDS)
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")
    )


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """One document in ten gets a periodic end, as the contract says; its place and period follow
    from the id. A row without an id or without words stays as it is.
    """
    drawn = F.floor(F.crc32(docs["doc_id"].cast("string")) / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        first = drawn % n
        period = 1 + F.call_function("div", n - first, 3 + drawn % 8)
        return F.transform(
            F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")),
            lambda i: F.get(words, F.when(i < first, i).otherwise(first + (i - first) % period).cast("int")),
        )

    words = common.let(
        F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)),
        lambda w: F.when(F.size(w) > 0, F.array_join(planted(w), " ")).otherwise(""),
    )
    chosen = F.crc32(docs["doc_id"].cast("string")) % 10 == 0
    return docs.select("doc_id", F.when(chosen, words).otherwise(docs["text"]).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_planted_runs(common.read(spark, sf_dir, "documents"))
    found = periodic_runs.collapse(docs)
    longest = F.element_at(
        F.sort_array(
            F.transform(
                "runs",
                lambda r: F.struct(
                    (-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period")
                ),
            )
        ),
        1,
    )
    top = F.when(F.size("runs") > 0, longest)
    lines = F.transform(
        "runs",
        lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")),
    )
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.minus")).alias("length"),
        F.col("top.period").alias("period"),
        F.call_function("div", -F.col("top.minus") * 1000, F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_source_mix,
        op3_line_frequency,
        op4_secret_links,
        op5_token_files,
        op6_licence_scan,
        op7_minhash_dedup,
        op8_top_k,
        op9_byte_bpe,
        op10_token_counts,
        op11_source_divergence,
        op12_personal_data,
        op13_periodic_runs,
    )
}
