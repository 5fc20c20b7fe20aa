"""The plan of the search deals tiles by their numbers, never by their length alone."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import top_k


def test_no_shuffle_by_length_alone(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(100, [1.0]), (101, [2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = top_k.search(frame, F.col("vec_id") % 20 == 0, k=3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        joined = re.findall(r"SortMergeJoin \[size#\d+\], \[size#\d+\]", plan)
        assert not joined
        assert found.filter("query_id = 100").select("vec_id").collect() == [(101,)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("held, passed", [(1, 1), (2, 3), (8, 256)])
def test_any_grid_of_blocks_gives_the_same(spark, monkeypatch, held, passed):
    for name, value in (("TILE", 8), ("FAN", 3), ("HELD", held), ("PASSED", passed)):
        monkeypatch.setattr(top_k, name, value)
    draw = np.random.default_rng(7)
    matrix = draw.integers(-3, 4, (300, 6))
    frame = spark.createDataFrame([(i, (r / 64).tolist()) for i, r in enumerate(matrix)], "vec_id long, embedding array<double>")
    found = top_k.search(frame.repartition(5), F.col("vec_id") % 3 == 0, k=9).collect()
    expected = set()
    for q in range(0, 300, 3):
        ranked = sorted((-int(matrix[q] @ matrix[i]), i) for i in range(300) if i != q)[:9]
        expected |= {(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)}
    assert set(map(tuple, found)) == expected and len(found) == 900


def test_scores_beyond_exact_numbers_are_an_error(spark):
    large = [(0, [2.0**22, 2.0**22]), (20, [2.0**22, 1.0])]
    frame = spark.createDataFrame(large, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="components too large"):
        top_k.search(frame, F.col("vec_id") % 20 == 0).collect()
    near = spark.createDataFrame([(0, [2.0**18]), (20, [2.0**19])], "vec_id long, embedding array<double>")
    assert {r.score for r in top_k.search(near, F.col("vec_id") % 20 == 0).collect()} == {2**49}
