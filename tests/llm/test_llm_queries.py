"""Queries of the llm subpackage with a SQL twin against it on the smallest tables."""

from __future__ import annotations

import os

import pytest
from differential import difference, duck
from pyspark.sql import functions as F

from lodestream.llm import queries as llm

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, name):
    query, sql = llm.queries()[name], llm.oracle_sql().get(name)
    if sql is None:
        assert query(spark, BASE).count() > 0
    else:
        assert difference(query, sql, spark, BASE, duck(BASE)) == ""


def test_sample_stays_as_the_table_grows(spark, tmp_path):
    number, rows = "`職缺編號`", []
    for k in range(1200):  # weeks of 400 postings; the rate of later weeks is 100 / 400
        rows.append((k, str(k), f"2024-0{k // 400 + 2}-07 10:00:00"))
    more = [(5000 + k, str(5000 + k), "2024-01-03 10:00:00") for k in range(3000)]  # an earlier week
    more += [(9000 + k, str(k), "2024-01-03 10:00:00") for k in range(400, 1200)]  # earlier states of known postings
    more += [(20000 + k, str(20000 + k), "2024-02-07 11:00:00") for k in range(900)]  # a known week grows

    def sample(part):
        df = spark.createDataFrame(part, f"posting_row_id long, {number} string, loaded_at string").withColumn("loaded_at", F.to_timestamp_ntz("loaded_at"))
        df.write.mode("overwrite").parquet(f"{tmp_path}/job_posting.parquet")
        return {tuple(r) for r in llm.p7_sample(spark, str(tmp_path)).collect()}

    first = sample(rows)
    assert len(first) > 500 and sample(rows) == first
    grown = sample(rows + more)
    assert first < grown and {r[1:] for r in grown if int(r[1]) < 1200} == {r[1:] for r in first}
    assert sample(rows) == first
