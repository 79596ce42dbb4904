import os

import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_equal_keys_of_a_segment_keep_the_first_row(spark, tmp_path):
    rows = [(1, 5, 1, "A"), (1, 5, 1, "N"), (2, 5, 2, "R"), (1, 4, 9, "R"), (2, 5, 2, "A"), (3, 1, 1, None), (1, 5, 1, "R"), (2, 9, 9, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = e.queries()["c10_label_segments"](spark, str(tmp_path)).collect()
    assert {q.segment: q.label for q in got} == {1: "A", 2: "R", 3: None}
