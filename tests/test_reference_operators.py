"""Small fixed cases for text, matching, field, graph, scoring, evaluation and model operators."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.functions import fields, text
from lodestream.operators import aggs, evaluation, graph, joins, ltr, matching, retrieval, scoring, setops, windows


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_normal_forms(spark):
    rows = {" 臺北  Next . js ": "台北 next.js", "ＲＥＡＣＴ　＃": "react#", "Straße": "strasse", None: ""}
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r.t: r.n for r in df.select("t", text.surface_normalize(F.col("t")).alias("n")).collect()} == rows
    ranked = {"React JS 工程師": "reactjs 工程師", "NodeJS": "node.js", "C Sharp／CPlusPlus": "c#/c++", " 臺中 ": "台中"}
    df = spark.createDataFrame([(k,) for k in ranked], "t string")
    assert {r.t: r.n for r in df.select("t", text.rank_normalize(F.col("t")).alias("n")).collect()} == ranked


def test_lexical_units(spark):
    df = spark.createDataFrame([("c++ 資料分 node.js",), ("",), ("!",)], "t string")
    got = [set(r[0]) for r in df.select(text.lexical_units(F.col("t"))).collect()]
    assert got == [{"c++", "node.js", "資料分", "資料", "料分"}, set(), set()]


@pytest.mark.parametrize(("query", "surface", "found"), [("learn java now", "java", True), ("javascript", "java", False), ("c++", "c", False), ("c", "c", True), ("javascript java", "java", True), ("學java課", "java", True), ("護理師", "護理", True), ("x", "", False), ("a.b", "a.b", True), ("axb", "a.b", False), ("用 react.js 開發", "react", False), ("react.", "react", False), (".net core", "net", False), ("react/vue", "react", True)])
def test_surface_in_text(spark, query, surface, found):
    df = spark.createDataFrame([(query, surface)], "q string, s string")
    assert df.select(text.surface_in_text(F.col("q"), F.col("s"))).first()[0] is found


def test_terms_and_rules(spark):
    assert one(spark, text.join_terms(F.array(F.lit("ab"), F.lit(" ab "), F.lit("cd"), F.lit("")), F.lit("zz"), 6)) == "ab cd"
    assert one(spark, text.join_terms(F.array(F.lit("abcdef")), F.lit("fallback"), 4)) == "fall"
    assert one(spark, text.recall_expansion(F.lit("q"), F.array().cast("array<string>"))) == ""
    assert one(spark, text.query_expansion(F.lit("找 會計"), F.lit(None).cast("string"), F.array(F.lit("會計"), F.lit("出納"), F.lit("ERP")))) == "找 會計 會計 ERP"
    assert one(spark, text.safe_cell(F.lit("@x"))) == "'@x"
    assert one(spark, text.explanation([(F.lit(False), "a"), (F.lit(True), "b")], "d")) == "b"
    assert one(spark, text.split_values(F.lit("a<br/>b、 c ／;"))) == ["a", "b", "c"]


def test_fields(spark):
    assert one(spark, fields.ordered_bounds(F.lit(9.0), F.lit(5.0))).asDict() == {"low": 5.0, "high": 9.0}
    cover = lambda lo, hi, t, exact=False, same=True: one(spark, fields.range_cover(F.lit(lo), F.lit(hi), F.lit(t), F.lit(exact), F.lit(same)))
    assert [cover(3.0, 5.0, 4.0), cover(3.0, 5.0, 6.0), cover(3.0, 0.0, 3.0), cover(3.0, 5.0, 2.0, True), cover(3.0, 5.0, 2.0), cover(0.0, 0.0, 1.0), cover(3.0, 5.0, 4.0, False, False)] == [1, -1, 1, -1, 1, 0, 0]
    assert one(spark, fields.mentions(F.lit("居家服務"), ["居家"], ["居家服務"])) is False
    assert one(spark, fields.confidence(F.lit("1.7"))) == 1.0 and one(spark, fields.confidence(F.lit("x"))) == 0.0
    place = one(spark, fields.resolve_place(F.lit("台北市中壢區"), {"中壢區": "桃園市"}, ["台北市"]))
    assert (place.city, place.district) == ("桃園市", "中壢區")
    m = F.array(F.struct(F.lit("x").alias("evidence"), F.lit("required").alias("level"), F.lit(0.5).alias("confidence"), F.lit(True).alias("negated")))
    assert one(spark, fields.evidence_errors(F.lit("abc"), m)) == ["0:ungrounded", "0:confidence", "0:negated_required"]
    assert one(spark, fields.activity_prior(F.lit(0), F.lit(0))) == 0 and one(spark, fields.activity_prior(F.lit(10**6), F.lit(0))) == 2.5


def test_overlaps_and_boundaries():
    names = ["java", "javascript", "script", "c", "c++", "資料", "資料分析"]
    words = lambda scan, t: [t[a:b] for a, b in scan(t)]
    both = matching.scan_automaton(names), matching.scan_consuming(names)
    assert [words(s, "javascript c++ 資料分析師") for s in both] == [["javascript", "c++", "資料分析"]] * 2
    # a rejected long name hides the short one only where it has used up its text
    assert [words(s, "xjavascript java") for s in both] == [["java"], ["java"]]
    few = ["a b", "b"]
    assert words(matching.scan_automaton(few), "xa b") == ["b"] and words(matching.scan_consuming(few), "xa b") == []
    assert words(matching.scan_consuming(["java"], {"java": ["java島"]}), "java島 java") == ["java"]
    assert matching.scan_windows({"護理": "n", "護理師": "m", "師": "x"})("護理師護理護理師") == ["m", "n"]
    for scan in (matching.scan_automaton(["react", "net", "c"]), matching.scan_consuming(["react", "net", "c"])):
        assert words(scan, "用 react.js 開發 .net c++ c# c") == ["c"] and words(scan, "react/net,c") == ["react", "net", "c"]
    blocked = matching.scan_consuming(["go", "java"], {"go": ["go shop", "to go", ""], "java": ["go java"]})
    assert words(blocked, "go shop to go go java, go") == ["go", "go"]
    assert matching.scan_automaton([])("a") == [] and matching.scan_consuming([])("a") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab臺Ｃ c.", min_size=1, max_size=4), max_size=6), st.text("ab臺Ｃ c.+", max_size=30))
def test_automaton_is_leftmost_longest(names, body):
    folded, places = matching.fold_with_places(body)
    assert len(folded) == len(places) and places == sorted(places)
    names = {matching.fold_with_places(n)[0] for n in names} - {""}
    want, at = [], 0
    while at < len(folded):
        fits = [n for n in names if folded.startswith(n, at) and matching.stands_alone(folded, at, at + len(n))]
        if fits:
            want.append((at, at + max(map(len, fits))))
        at += max(map(len, fits)) if fits else 1
    assert matching.scan_automaton(names)(folded) == want


@settings(max_examples=200, deadline=None)
@given(st.text("aＢ 臺ß\u3000\t.+#/-㍿", max_size=30))
def test_folding_keeps_places(body):
    import re
    import unicodedata

    one = lambda t: unicodedata.normalize("NFKC", t).casefold().replace("臺", "台")
    folded, places = matching.fold_with_places(body)
    whole = re.sub(r"\s+", " ", "".join(map(one, body))).strip()
    assert folded == re.sub(r"\s*([.+#/-])\s*", r"\1", whole)
    assert all(c == " " or c in one(body[p]) for c, p in zip(folded, places, strict=True))


def test_clauses():
    def said(body, name):
        at = body.index(name)
        clauses = matching.Clauses(body)
        return clauses.negated(at, at + len(name)), clauses.level(at, at + len(name))

    assert said("熟悉 java；不需 python", "java") == (False, "required")
    assert said("熟悉 java；不需 python", "python") == (True, "mentioned")
    assert said("java 非必要", "java") == (True, "mentioned") and said("會 java。非必要", "java") == (False, "mentioned")
    assert said("熟悉 java 尤佳", "java") == (False, "preferred") and said("not  required: java", "java") == (True, "mentioned")
    assert said("不需" + "一" * 30 + "java", "java") == (False, "mentioned")
    assert said("java", "java") == (False, "mentioned")


def test_matched_names_of_the_engine(spark):
    df = spark.createDataFrame([("用 react.js 與 c++、護理師 react",)], "t string")
    assert df.select(matching.matched_names(F.col("t"), ["react", "c", "c++", "護理", "護理師"])).first()[0] == ["c++", "護理師", "react"]


def test_mentions(spark):
    body = "必須熟悉 Ｊａｖａ；不需要 Python。具 C++ 者尤佳\n臺語"
    df = spark.createDataFrame([(body,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(matching.mentions(F.col("t"), ["java", "python", "c++", "台語"])).collect()]
    assert [(m.name, m.evidence, m.negated, m.level) for m in got[0]] == [("java", "Ｊａｖａ", "false", "required"), ("python", "Python", "true", "mentioned"), ("c++", "C++", "false", "preferred"), ("台語", "臺語", "false", "mentioned")]
    assert all(body[m.start : m.stop] == m.evidence for m in got[0]) and got[1:] == [[], []]


def test_relations_of_a_small_graph(spark):
    rows = [(f"j{i:02d}", f"c{i % 6}", ["a", "b", None], {"a": f"A-{i}", "b": f"B-{i}" if i else ""}) for i in range(20)] + [(f"n{i}", "c", [f"x{i}"], None) for i in range(80)]
    df = spark.createDataFrame(rows, "job string, company string, skills array<string>, said map<string,string>")
    found = graph.relation_candidates(df, basket="job", owner="company", items="skills", evidence="said").collect()
    assert [tuple(x) for x in found[0].evidence] == [(f"j{i:02d}", f"A-{i}", f"B-{i}") for i in (1, 2, 3)]
    long = spark.createDataFrame([("j", "x", [f"s{i}" for i in range(1200)]), ("j", "y", None), ("k", None, ["s1", "s2"])], "job string, company string, skills array<string>")
    pairs = graph.cooccurring_pairs(long, basket="job", owner="company", items="skills")
    sums = pairs.agg(F.count("*"), F.sum("support_jobs"), F.min("support_companies"), F.max("support_companies")).first()
    assert tuple(sums) == (1200 * 1199 // 2, 1200 * 1199 // 2 + 1, 2, 2)
    assert [(r.source_id, r.target_id, r.support_jobs, r.support_companies, r.lift, r.npmi) for r in found] == [("a", "b", 20, 6, 5.0, 1.0)]
    assert found[0].confidence == pytest.approx(0.6 + 0.3 * 3 / 8 + 0.02)
    assert graph.relation_candidates(df.limit(0), basket="job", owner="company", items="skills").count() == 0
    spokes = spark.createDataFrame([("hub", f"s{i:02d}", 1.0 - i / 100) for i in range(25)], "source_id string, target_id string, confidence double")
    accepted, rejected = graph.cap_degrees(spokes, 20, order=[F.desc("confidence")])
    assert (accepted.count(), {r.target_id for r in rejected.collect()}) == (20, {f"s{i}" for i in range(20, 25)})
    rng = random.Random(5)
    some = list({tuple(sorted(rng.sample(range(14), 2))) for _ in range(60)})
    weights = [(f"v{a:02d}", f"v{b:02d}", rng.choice([0.5, 0.7, rng.random()])) for a, b in some]
    degree, want = {}, set()
    for a, b, _ in sorted(weights, key=lambda e: (-e[2], e[0], e[1])):
        if max(degree.get(a, 0), degree.get(b, 0)) < 3:
            want.add((a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    accepted, rejected = graph.cap_degrees(spark.createDataFrame(weights, "source_id string, target_id string, confidence double"), 3, order=[F.desc("confidence")])
    assert {(r.source_id, r.target_id) for r in accepted.collect()} == want and rejected.count() == len(weights) - len(want)


def test_ids_and_resolution(spark):
    import hashlib

    want = hashlib.sha256("a\0T\0b".encode()).hexdigest()[:20]
    assert one(spark, graph.edge_id(F.lit("a"), F.lit("T"), F.lit("b"))) == f"edge:{want}"
    assert one(spark, graph.forbidden_merge(F.lit("javascript"), F.lit("java"))) is True
    nodes = spark.createDataFrame([("n1", "Java", ["jdk"]), ("n2", "Go", ["jdk", None])], "id string, label string, aliases array<string>")
    aliases = graph.aliases_of(nodes, node="id", label="label", aliases="aliases", fold=F.lower)
    rows = spark.createDataFrame([("java",), ("jdk",), ("rust",), (None,)], "s string")
    got = {r.s: (r.node, r.decision) for r in graph.resolve_exactly(rows, aliases, surface="s").collect()}
    assert got == {"java": ("n1", "EXACT"), "jdk": (None, "AMBIGUOUS"), "rust": (None, "UNKNOWN"), None: (None, "UNKNOWN")}


def test_joins(spark):
    x = spark.createDataFrame([(1, "u", 0), (2, "u", 100), (3, None, 0), (4, "v", 0), (1, "u", 0)], "exposure int, k string, start long")
    e = spark.createDataFrame([("u", 30, 1), ("u", 30, 2), ("u", 99, 5), ("u", 130, 1), ("v", -1, 2), ("v", 31, 2), (None, 3, 2)], "k string, at long, grade int")
    got = {r.exposure: r.grade for r in joins.interval_grades(x, e, keys=["k"], start="start", at="at", grade="grade", window=30).collect()}
    assert got == {1: 2, 2: 1, 3: 0, 4: 0}
    daily = spark.createDataFrame([("a", "d1", 3), ("a", "d3", 4), ("a", "d2", 5), ("b", "d1", 1)], "k string, day string, n int")
    assert {(r.k, r.day): r.n for r in joins.strictly_earlier(daily, keys=["k"], day="day", sums=["n"]).collect()} == {("a", "d1"): 0, ("a", "d2"): 3, ("a", "d3"): 8, ("b", "d1"): 0}
    old = spark.createDataFrame([(1, "t", "ok"), (2, "t", ""), (3, "old", "ok"), (4, None, "ok")], "k int, title string, verdict string")
    new = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t"), (4, None), (5, "t")], "k int, title string").withColumn("verdict", F.lit(None).cast("string"))
    kept = joins.carry_forward(new, old, key="k", locked=["title"], review=["verdict"], required=["verdict"])
    assert {r.k: r.verdict for r in kept.collect()} == {1: "ok", 2: None, 3: None, 4: "ok", 5: None}
    assert joins.score_against_queries(new, old.limit(0).select(F.col("k").alias("query_id")), F.lit(1.0)).count() == 0


def test_samples_dont_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    pick = lambda d: sorted(map(tuple, windows.bottom_k(d, 7, within=["g"], value=F.col("k"), seed="s").collect()))
    assert pick(df) == pick(df.orderBy(F.desc("k")).repartition(7)) and len(pick(df)) == 21
    share = windows.bucket_sample(df, F.col("k"), 0, 1000).count() / 500
    assert 0.05 < share < 0.16
    edges = spark.createDataFrame([("a", f"b{i}", float(i)) for i in range(5)] + [("b4", "c", 9.0)], "s string, t string, w double")
    assert {(r.s, r.t) for r in windows.mutual_neighbours(edges, 1, source="s", target="t", order=["w"]).collect()} == {("b4", "c")}


def test_metrics_by_hand(spark):
    rows = [("q", 0.9, 0, "a"), ("q", 0.8, 2, "b"), ("q", 0.8, 1, "c"), ("z", 0.1, 0, "a"), ("z", None, None, "b")]
    got = {r.g: r for r in evaluation.ranking_metrics(spark.createDataFrame(rows, "g string, s double, y int, t string"), group="g", score="s", grade="y", tie="t").collect()}
    dcg, ideal = 3 / math.log2(3) + 1 / math.log2(4), 3 / math.log2(2) + 1 / math.log2(3)
    assert (got["q"].ndcg, got["q"].mrr, got["q"].hit_1, got["q"].hit_k, got["q"].precision) == (pytest.approx(dcg / ideal, abs=1e-6), 0.5, 0.0, 1.0, 0.2)
    assert (got["z"].ndcg, got["z"].mrr, got["z"].hit_k) == (0.0, 0.0, 0.0)


def test_propensity(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(r, int(rng.random() < 1 / r)) for r in range(1, 12) for _ in range(50)], "rank int, clicked int")
    p = [r.propensity for r in evaluation.rank_propensity(df, rank="rank", clicked="clicked", max_rank=15).orderBy("rank").collect()]
    assert len(p) == 15 and p[0] == 1.0 and all(a >= b >= 0.02 for a, b in zip(p, p[1:], strict=False))
    assert one(spark, evaluation.inverse_weight(F.lit(0.01))) == 10.0


def test_bootstraps_agree(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(0.1, 1, 400))], "id long, d double")
    a, b = evaluation.paired_bootstrap(df, "d", repeats=600).first(), evaluation.exact_bootstrap(df, "d", repeats=600)
    assert a.mean == pytest.approx(b[0], abs=1e-6) and a.low == pytest.approx(b[1], abs=0.03) and a.high == pytest.approx(b[2], abs=0.03)
    assert evaluation.paired_bootstrap(df.repartition(5), "d", repeats=50).collect() == evaluation.paired_bootstrap(df, "d", repeats=50).collect()


def test_review_scores(spark):
    jobs = spark.createDataFrame([(2, 2, 1, 0), (2, 2, 1, 0)], "published int, valid int, missed int, incorrect_alias int")
    relations = spark.createDataFrame([(1,), (0,)], "is_valid int")
    got = {r.metric: (r.value, r.passed) for r in evaluation.review_scores(jobs, relations, {"published_relation_precision": 0.9}).collect()}
    assert got == {"mention_precision": (1.0, True), "mention_recall": (0.66666667, True), "exact_alias_precision": (1.0, True), "published_relation_precision": (0.5, False)}
    assert all(r.value is None and not r.passed for r in evaluation.review_scores(jobs.limit(0), relations.limit(0), {}).collect())
    assert evaluation.gates({"a": True, "b": None}) == (False, ["b"])


def test_portable_tree(spark):
    tree = {"nodeid": 0, "split": "f", "split_condition": 0.1, "yes": 1, "no": 2, "children": [{"nodeid": 1, "leaf": -0.2}, {"nodeid": 2, "leaf": 0.3}]}
    model = json.loads(json.dumps({"features": ["f", "g"], "base": 0.0, "trees": [tree]}))
    df = spark.createDataFrame([(0.1, 1.0), (0.0999, 1.0), (None, 1.0), (float(np.float32(0.1)), 0.0)], "f double, g double")
    score = lambda allowed=None: [round(r[0], 6) for r in df.select(ltr.predict_trees(df, model, allowed)).collect()]
    assert score() == [0.3, -0.2, -0.2, 0.3] and score(["g"]) == [-0.2] * 4


def test_ranking_model_learns(spark):
    rng = np.random.default_rng(4)
    rows = []
    for q in range(120):
        for i in range(8):
            a, b = rng.random(2)
            rows.append((f"q{q}", f"i{i}", float(a), float(b), int(a > 0.7) + int(a > 0.9)))
    df = spark.createDataFrame(rows, "q string, i string, a double, b double, y int").cache()
    model = ltr.fit_lambdamart(df, group="q", label="y", features=["b", "a"], trees=15)
    ranked = df.withColumn("s", ltr.predict_trees(df, model))
    ndcg = lambda s: evaluation.mean_metrics(evaluation.ranking_metrics(ranked, group="q", score=s, grade="y", tie="i")).first().ndcg
    assert ndcg("s") > 0.95 * ndcg("a") > ndcg("b")
    train = lambda o: ltr.fit_lambdamart(df, group="q", label="y", features=["b", "a"], trees=3, **o)
    options, _, trials = ltr.tune(train, lambda m: len(m["trees"]), {"depth": [1, 2], "rate": [0.1]})
    assert options == {"depth": 1, "rate": 0.1} and len(trials) == 2
    assert ltr.fit_lambdamart(df.limit(0), group="q", label="y", features=["a"])["trees"] == []


def test_fusion(spark):
    k = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc string, rank int")
    v = spark.createDataFrame([(1, "b", 1), (1, "z", 2), (1, "y", 3)], "query_id int, doc string, rank int")
    order = lambda df: [r.doc for r in df.orderBy("rank").collect()]
    assert order(retrieval.keyword_then_vector(k, v)) == ["a", "b", "c", "z", "y"]
    assert order(retrieval.keyword_then_vector(k, v, limit=3)) == ["a", "b", "c"]
    assert order(retrieval.keyword_then_vector(k, v, limit=3, reserve=1)) == ["a", "b", "z"]
    assert order(retrieval.keyword_then_vector(k, v.limit(0), limit=3, reserve=1)) == ["a", "b", "c"]
    assert order(retrieval.reciprocal_rank_fusion(k, v))[:2] == ["b", "a"]


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)] + [(100, [0.0] * 6), (101, None), (102, [1.0, 2.0])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    asked = df.filter("id < 5 or id in (100, 101)").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.nearest_vectors(df, asked, 4, vec="v", id="id").collect()}
    m = np.array([v for i, v in data if i < 60])
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    assert got == {(q, r + 1): int(i) for q in range(5) for r, i in enumerate(np.argsort(-(unit @ unit[q]), kind="stable")[:4])}
    assert got == {(r.query_id, r["rank"]): r.id for r in retrieval.nearest_vectors(df, asked, 4, vec="v", id="id", bound=2).collect()}
    assert retrieval.nearest_vectors(df, asked.limit(0), 4, vec="v", id="id").count() == 0


def test_aggregations_of_nothing(spark):
    none = spark.createDataFrame([], "k string, v double, t timestamp_ntz")
    assert aggs.frequency_head(none, "k", most=3).count() == 0
    assert aggs.digest(none, ["k"]).first().records == 0
    assert [r.share for r in aggs.field_coverage(none, ["k", "v"]).collect()] == [0.0, 0.0]
    assert setops.set_sizes(none, none, "k", ("a", "b", "c", "d")).filter("n <> 0").count() == 0
    ranges = spark.createDataFrame([(2400, 3400), (3400, 4400)], "a int, b int")
    assert setops.disjoint_ranges(ranges, "a", "b").first()[0] is True
    assert setops.disjoint_ranges(ranges.unionByName(ranges), "a", "b").first()[0] is False
    assert aggs.digest(ranges, ["a", "b"]).first() == aggs.digest(ranges.repartition(3), ["a", "b"]).first()


def test_gate_and_ablation(spark):
    df = spark.createDataFrame([("q", "a", 1.0, 0.5), ("q", "b", 0.0, 0.7), ("z", "c", 0.0, 0.9)], "g string, i string, on_ double, f double")
    out = {r.i: (r.f, r.gate_active) for r in scoring.gate(df, ["g"], ["f"], F.col("on_") > 0).collect()}
    assert out == {"a": (0.5, True), "b": (0.7, True), "c": (0.0, False)}
    stages = scoring.ablations(df, {"x": ["on_"], "y": ["f"]}, {"on_": 1.0, "f": 2.0}).filter("i = 'a'").select("stage", "score").collect()
    assert {r.stage: r.score for r in stages} == {"x": 1.0, "y": 2.0}
    same = spark.createDataFrame([(1.0, 11.0), (2.0, 12.0)], "a double, b double")
    assert scoring.largest_difference(same, "a", "b").first()[0] == 0.0
    ways = spark.createDataFrame([("q", "j", "s1", None, 1.0), ("q", "j", "s2", "r1", 0.5), ("q", "j", "s2", "r2", 0.9)], "q string, j string, s string, r string, w double")
    assert scoring.paths(ways, query="q", item="j", skill="s", related="r", weight="w").first().paths == ["q > s1 > j", "q > s2 > r2 > j"]
