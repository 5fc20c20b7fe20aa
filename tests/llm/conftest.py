import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_rows import CLASHING, ROWS, SCHEMA  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or ""), *["clash"] * len(CLASHING)) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, None), (None, 0, 1), (4, 1, 1), (4, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
