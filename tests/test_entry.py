"""The driver's contract, and every query with a SQL twin against it on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from differential import difference, duck

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CORE = [m for m in entry.MODULES if "llm" not in m.__name__]
NAMES = [n for m in CORE for n in m.queries()]

needs_data = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")


def test_names():
    names = [n for m in entry.MODULES for n in m.queries()]
    assert len(names) == len(set(names)) and set(entry.oracle_sql()) <= set(names)


def test_core_stands_without_llm():
    code = "import sys; sys.modules['lodestream.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p3_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True)


@needs_data
def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["apply_id", "posting_row_id"] and rows.count() > 0


@pytest.fixture(scope="module")
def con():
    return duck(BASE)


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = {k: v for m in CORE for k, v in m.oracle_sql().items()}.get(name)
    query = entry.queries()[name]
    if sql is None:
        assert query(spark, BASE).count() > 0
    else:
        assert difference(query, sql, spark, BASE, con) == ""


@needs_data
def test_no_row_is_left_out(spark):
    searches, postings = (spark.read.parquet(f"{BASE}/{n}.parquet") for n in ("user_search_log", "job_posting"))
    codes = entry.queries()["closed_codes"](spark, BASE)
    assert codes.select("search_id").distinct().count() == searches.select("search_id").distinct().count()
    places = entry.queries()["place_and_duty"](spark, BASE)
    assert places.count() == postings.count()
    cityless = postings.filter("`工作城市` is null").select("posting_row_id")
    assert {r.place for r in places.join(cityless, "posting_row_id").collect()} == {-1.0}


@needs_data
def test_features_dont_know_their_own_day(spark, tmp_path):
    """Reactions of a day are taken away: that day's labels change, its features don't, those of later days do."""
    from lodestream.plans.ranking_queries import _behaviour

    names = ("user_search_log", "job_view", "job_apply", "job_posting")
    at = {"job_view": "dateIn", "job_apply": "datein"}
    for n in names:
        df = spark.read.parquet(f"{BASE}/{n}.parquet")
        df.filter(f"to_date({at[n]}) <> date'2026-04-12'" if n in at else "true").write.parquet(f"{tmp_path}/{n}.parquet")
    days = spark.read.parquet(f"{BASE}/user_search_log.parquet").selectExpr("search_id", "to_date(search_time) as day").distinct()
    told = []
    for base in (BASE, str(tmp_path)):
        rows = _behaviour(spark, base).join(days, "search_id").collect()
        told.append({(r.search_id, r.place, r.posting): (str(r.day), r.grade, tuple(v for k, v in r.asDict().items() if k not in ("search_id", "place", "posting", "grade", "day"))) for r in rows})
    whole, less = told
    assert whole.keys() == less.keys()
    same_day = [(whole[k], less[k]) for k in whole if whole[k][0] == "2026-04-12"]
    assert any(a[1] != b[1] for a, b in same_day) and all(a[2] == b[2] for a, b in same_day)
    assert all(whole[k][2] == less[k][2] for k in whole if whole[k][0] < "2026-04-12")
    assert any(whole[k][2] != less[k][2] for k in whole if whole[k][0] > "2026-04-13")
