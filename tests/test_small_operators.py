"""Operators that no query uses by itself, and whole pipelines on tiny tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestream.functions import fields, text
from lodestream.operators import aggs, graph, joins, retrieval, scoring, setops, windows
from lodestream.plans import build, pipeline_queries, search
from lodestream.sources import readers


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_small_columns(spark):
    df = spark.createDataFrame([("找java島課", ["java島"], ["b", " a ", "b", "x", ""]), ("java", [], []), ("java", None, ["a"])], "q string, blocked array<string>, v array<string>")
    got = df.select(text.suppressed(F.col("q"), F.col("blocked")).alias("s"), fields.closed_vocabulary(F.col("v"), ["a", "b"], 1).alias("c"), windows.first_seen(F.col("v"), 2).alias("f")).collect()
    assert [(r.s, r.c.known, r.c.other, r.f) for r in got] == [(True, ["b"], ["x"], ["b", " a "]), (False, [], [], []), (False, ["a"], [], ["a"])]
    named = spark.createDataFrame([([("abc", "n1"), ("ab", "n3"), ("xyz", "n2"), ("a", "n1")],)], "x array<struct<alias:string,id:string>>")
    assert named.select(windows.longest_first(F.col("x"), 2)).first()[0] == ["n2", "n1"]
    evidence = spark.createDataFrame([(0.0, ["s"], ["s"], 0.0, 1.0), (0.0, ["s"], ["t"], 0.0, 1.0), (1.0, [], [], 0.0, 0.0), (0.0, None, ["t"], 1.0, 1.0)], "l double, w array<string>, h array<string>, r double, s double")
    assert [r[0] for r in evidence.select(fields.has_evidence(F.col("l"), F.col("w"), F.col("h"), F.col("r"), F.col("s"))).collect()] == [True, False, False, True]
    assert spark.range(1).select(fields.split_list(F.lit("a, NULL,,b"))).first()[0] == ["a", "b"]


def test_candidates_in_order(spark):
    df = spark.createDataFrame([("c", "b", 0, 2), ("c", "a", 1, 3), ("c", "b", 2, 9), ("c", "z", 0, 1), ("d", "a", 0, 1)], "c string, item string, y int, t int")
    cut = {r.c: (r.candidates, r.grades) for r in aggs.case_candidates(df, case=["c"], item="item", grade="y", order=["t"], most=2).collect()}
    assert cut == {"c": (["z", "b"], {"z": 0, "b": 2}), "d": (["a"], {"a": 0})}
    every = aggs.grades_of_items(df, case=["c"], item="item", grade="y", order=["t"])
    assert {(r.c, r.item, r.y, r.place) for r in every.collect()} == {("c", "z", 0, 1), ("c", "b", 2, 2), ("c", "a", 1, 3), ("d", "a", 0, 1)}
    assert rows(aggs.group_sizes(df, "c"), "c", "rows") == [("c", 4), ("d", 1)]


def test_fields_fused(spark):
    one = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "query_id int, doc string, score double")
    two = spark.createDataFrame([(1, "a", 1.0), (1, "c", 4.0)], "query_id int, doc string, score double")
    assert rows(retrieval.best_fields([(one, 7.0), (two, 1.0)], tie_breaker=0.5), "doc", "score") == [("a", 14.5), ("b", 7.0), ("c", 4.0)]
    df, seen = retrieval.observed(one, "hits")
    df.collect()
    assert seen.get == {"rows": 2}
    assert [retrieval.clamp_limit(x) for x in (0, 7, 900)] == [1, 7, 500]


def test_edges_and_sets(spark):
    edges = spark.createDataFrame([("a", "b", 1)], "s string, t string, w int")
    assert rows(joins.both_directions(edges, "s", "t"), "s", "t", "w") == [("a", "b", 1), ("b", "a", 1)]
    a, b = spark.createDataFrame([("x",), ("y",), ("y",)], "k string"), spark.createDataFrame([("y",)], "k string")
    assert rows(setops.colliding_keys(a, b, "k"), "k") == [("y",)]
    assert rows(setops.missing(a, b), "k") == [("x",), ("y",)]
    assert graph.fingerprint(a) == graph.fingerprint(b) != graph.fingerprint(edges)
    assert graph.stage_fingerprint({"a": 1}, "x") != graph.stage_fingerprint({"a": 1}, "y") and graph.stage_fingerprint({"a": 1, "b": 2}) == graph.stage_fingerprint({"b": 2, "a": 1})
    assert [r.k for r in readers.window_of(a, "k", skip=1, limit=1).collect()] == ["y"]


def test_graph_scores_by_hand(spark):
    wanted = spark.createDataFrame([("q", "s1"), ("q", "s2"), ("z", "none")], "query_id string, skill string")
    held = spark.createDataFrame([("i", "s1", 1.0), ("i", "t", 1.0), ("j", "t", 1.0), ("k", "s1", 1.0), ("k", "s2", 0.9)], "item_id string, skill string, confidence double")
    relations = spark.createDataFrame([("t", "s2", 0.5), ("s1", "t", 0.9)], "source string, target string, weight double")
    got = {r.item_id: (r.direct_count, round(r.graph_raw, 4)) for r in scoring.graph_scores(wanted, held, relations).collect()}
    # i holds s1, so s1's relation doesn't count for it; two direct hits stop at the cap
    assert got == {"i": (1, 5.5 + 1.3), "j": (0, 2.34), "k": (2, 8.5)}
    assert {r.item_id for r in scoring.graph_scores(wanted, held, None).collect()} == {"i", "k"}
    assert {r.item_id for r in scoring.graph_scores(wanted, held, relations.limit(0)).collect()} == {"i", "k"}


POSTINGS = "doc string, title string, category string, body string, city string, changed long"


def test_search_by_hand(spark):
    postings = spark.createDataFrame([("1", "資料分析員", "資訊", "分析報表", "甲市", 5), ("2", "資料分析員", "資訊", "分析報表", "乙市", 5), ("3", "司機", "運輸", "送資料", "甲市", 9), ("4", None, None, None, None, None)], POSTINGS)
    asked = spark.createDataFrame([(1, "資料分析員", ["甲市"], []), (2, "護士", None, None), (3, "", [], [])], "query_id int, query string, places array<string>, duties array<string>")
    found = search.search(asked, postings, top_k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc, r["rank"]) for r in found] == [(1, "1", 1), (1, "2", 2), (1, "3", 3)] or [(r.query_id, r.doc) for r in found] == [(1, "1"), (1, "3"), (1, "2")]
    assert found[0].why.startswith("職稱／職務文字高度吻合；地區條件吻合")
    wide = spark.createDataFrame([(1, "ＧＲＩＤＮＯＴＥ 資料", ["甲市"], [])], "query_id int, query string, places array<string>, duties array<string>")
    full = postings.filter("doc in ('1', '2')").withColumn("title", F.lit("Gridnote 資料"))
    assert [(r.doc, r.lexical > 18) for r in search.search(wide, full).orderBy("rank").collect()] == [("1", True), ("2", True)]
    assert search.search(asked, postings.limit(0)).count() == 0 and search.search(asked.limit(0), postings).count() == 0


def test_graph_built_by_hand(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "Skill", "active", "Java", ["爪哇"]), ("n2", "Skill", "active", "報表", []), ("n3", "Skill", "candidate", "同名", ["報表工具"]), ("n4", "Skill", "active", "同名", None)], "id string, type string, status string, label string, aliases array<string>")
    postings = spark.createDataFrame([(f"j{i}", f"c{i % 3}", "ｊａｖａ,報表", "不需要 Java") for i in range(6)] + [(f"k{i}", "c", "同名", "爪哇工程師") for i in range(3)] + [(f"m{i}", "c", None, "") for i in range(9)], "job string, company string, skills string, title string")
    built = build.build(postings, nodes, item="job", owner="company", fields={"skills": (0.98, 0), "title": (0.95, 1)}, least_jobs=3, least_companies=2, least_lift=1.2)
    told = rows(built["mentions"].filter("item in ('j0', 'k0')"), "item", "node", "field", "evidence")
    assert told == [("j0", "n1", "skills", "ｊａｖａ"), ("j0", "n2", "skills", "報表"), ("k0", "n1", "title", "爪哇")]
    assert rows(built["relations"], "source_id", "target_id", "support_jobs", "support_companies") == [("n1", "n2", 6, 3)]
    assert {r.rule: r.violations for r in built["violations"].collect() if r.violations} == {"candidate_node": 1}
    first = build.export(built, str(tmp_path / "g"))
    assert first == build.export(built, str(tmp_path / "g")) and first["parts"]["edges"]["records"] == 15


def test_names_beside_signs(spark):
    names = ["gridnote", "kora", "d++", "d#", "hm/ui", ".nova", "kora script語言", "光", "資料分析"]
    texts = ["Gridnote/Excel", "kora-based", "D++/D#", "xkora", "hm/ui設計", "新.nova版", "akora script語言", "光學資料分析員", "kora#", "", None]
    got = pipeline_queries._named(spark.createDataFrame([(t,) for t in texts], "q string"), spark.createDataFrame([(n, n) for n in names], "alias string, node string"), "q").collect()
    bounded = lambda n, t: re.search("(?<![a-z0-9+#])" + re.escape(n) + "(?![a-z0-9+#])", t) if n.isascii() else n in t
    want = {(t, n) for t in texts if t for n in names if bounded(n, t.lower())}
    assert {(r.query, r.alias) for r in got} == want and len(got) == len(want)
    assert {("Gridnote/Excel", "gridnote"), ("kora-based", "kora"), ("akora script語言", "kora script語言")} <= want


def test_search_with_wishes(spark):
    rows = [("1", "司機", "運輸", "x", "", 5, False, 30000.0, 40000.0, "monthly"), ("2", "司機", "運輸", "x", "", 5, True, 45000.0, 50000.0, "monthly"), ("3", "司機", "運輸", "x", "", 5, False, 0.0, 0.0, "hourly")]
    postings = spark.createDataFrame(rows, POSTINGS + ", flag boolean, low double, high double, kind string")
    wish = "query_id int, query string, places array<string>, duties array<string>, wants_flag boolean, wanted double, wanted_kind string, exact boolean"
    asked = spark.createDataFrame([(1, "司機", [], [], True, None, None, False), (2, "司機", [], [], False, 35000.0, "monthly", True), (3, "司機", [], [], None, None, None, None)], wish)
    found = {(r.query_id, r.doc): (r["rank"], r.remote, r.salary) for r in search.search(asked, postings).collect()}
    assert [found[1, d][1] for d in "123"] == [-1.4, 2.4, -1.4] and found[1, "2"][0] == 1
    assert [found[2, d][2] for d in "123"] == [2.4, -1.4, 0.0] and found[2, "1"][0] == 1
    assert [found[3, d] for d in "123"] == [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]
