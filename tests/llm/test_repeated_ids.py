"""Near-duplicates where ids repeat: rows many times over, and several texts under one id."""

import random

import pytest
from test_operators_brute_force import TEXTS, components_by_loops, near_rows

from terraloom.llm import near_dedup


def repeated_rows():
    draw = random.Random(8)
    rows = near_rows()
    for row in draw.sample([r for r in rows if r[0] is not None and r[0] >= 100], 24):
        rows += [row] * draw.randint(1, 5)
    # Other texts under ids of other groups, lower and higher than their own.
    for i in range(12):
        one, other = draw.sample([r for r in rows if r[0] is not None and r[0] >= 100], 2)
        rows.append((one[0] if i % 2 else 50 + i // 4, other[1], ""))
    return rows


@pytest.mark.parametrize("sparse", [0, near_dedup.SPARSE])
def test_repeated_ids_equal_loops(spark, monkeypatch, sparse):
    monkeypatch.setattr(near_dedup, "SPARSE", sparse)
    rows = repeated_rows()
    frame = spark.createDataFrame(rows, TEXTS)
    found = near_dedup.group(frame, near_dedup.Rule(3, 85)).collect()
    assert sorted(map(tuple, found), key=str) == components_by_loops(rows, 3, 85)


def test_prefixes_of_repeated_rows_are_whole(spark, monkeypatch):
    """Sets that reach the prefix filter stand once in it."""
    held = []
    whole = near_dedup._by_prefix
    monkeypatch.setattr(near_dedup, "SPARSE", 0)
    monkeypatch.setattr(near_dedup, "_by_prefix", lambda n, s, r: held.append(s) or whole(n, s, r))
    near_dedup.group(spark.createDataFrame(near_rows() * 3, TEXTS), near_dedup.Rule(3, 85)).collect()
    nodes = [r.node for r in held[0].select("node").collect()]
    assert nodes and len(nodes) == len(set(nodes))
