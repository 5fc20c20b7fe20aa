"""The pipeline's stages on a small table, each held against its operator or brute force."""

import base64
import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from corpus_rows import ROWS

import __spark_entry__ as entry
from terraloom.llm import mixing, toxicity
from terraloom.operators.storage import written


@pytest.fixture(scope="module")
def tables(spark, docs, labels, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, tables):
    names = ["toxicity", "near_duplicates", "secrets", "mixing", "byte_bpe"]
    assert [name for name, _ in corpus_pipeline.STAGES] == names
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, tables), f"test-{name}")
        kept[name] = docs
        if name != "byte_bpe":
            assert docs.columns == before.columns
    assert kept["toxicity"].count() == len(ROWS)  # nothing toxic in these rows
    left = sorted((r.doc_id for r in kept["near_duplicates"].collect()), key=str)
    assert left == sorted([1, 4, 5, 6, 7, 9, 10, 11, 13, None, None], key=str)
    text = kept["secrets"].filter("doc_id = 10").first().text
    assert text == "[assign]' and [access] at [endpoint]"
    assert set(r.doc_id for r in kept["mixing"].collect()) <= set(left)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sorted((str(r.doc_id), coder.encode_ordinary(r.text or "")) for r in kept["mixing"].collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in docs.collect()) == expected


def test_run_chains_the_stages(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)


def test_toxic_documents_go(spark):
    draw = random.Random(4)

    def text(*extra):
        words = [f"{'abcdefghij'[draw.randrange(10)]}{draw.choice(['er', 'on', 'ti', 'no', 'sa', 'lu'])}{draw.choice(['ka', 'mo', 're', 'ba'])}" for _ in range(30)] + list(extra)
        draw.shuffle(words)
        return " ".join(words)

    insult = [(i, text("idiot"), "en", "a", 1) for i in range(40)]
    clean = [(100 + i, text(), "en", "a", 1) for i in range(40)]
    docs = spark.createDataFrame(insult + clean, "doc_id long, text string, lang string, source string, n_chars int")
    marks = [(r[0], 1, 1) for r in insult] + [(r[0], 1, 0) for r in clean]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in clean]


def test_registered():
    found = entry.queries()
    for n in range(1, 11):
        assert len([name for name in found if name.startswith(f"op{n}_")]) == 1
    assert found["pipeline"] is corpus_pipeline.run
    assert set(entry.oracle_sql()) <= set(found)
    assert mixing.WEIGHTS == (3, 1, 2)
