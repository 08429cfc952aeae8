"""Operators of the llm subpackage against brute force, on small data with every kind of dirt."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import cooccur, leak, mix, quality
from lodestream.llm.cooccur import pair_supports
from lodestream.llm.leak import holds_stretch, leaked_items, letters
from lodestream.llm.nearest import nearest_in_time
from lodestream.llm.resolve import closest_entries, left_over, unmatched
from lodestream.llm.sample import extend_registry, first_seen, frozen_rates, stable_sample, uniform


@pytest.mark.parametrize("slot", [None, 7, 1000])
def test_nearest(spark, slot):
    rng = random.Random(slot or 1)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = [(key(), rng.choice([None, *range(300)]), i) for i in range(200)]
    right = [(key(), rng.choice([None, *range(300)]), rng.choice([None, *range(40)])) for _ in range(120)]
    ldf = spark.createDataFrame(left + left[:5], "k string, at long, rid long")
    for c in ("slot", "right", "last", "next", "choice", "id", "distance", "t", "k0"):
        ldf = ldf.withColumn(c, F.lit("clash"))
    rdf = spark.createDataFrame(right + right[:9], "k string, at long, id long").withColumn("rid", F.lit(1)).withColumn("slot", F.lit("clash"))
    got = sorted((r.rid, r.id, r.distance) for r in nearest_in_time(ldf, rdf, keys=["k"], tolerance=5, slot=slot).collect())
    want = []
    for k, at, i in left + left[:5]:
        near = [(abs(at - t), n) for kk, t, n in right if k is not None and kk == k and None not in (at, t, n) and abs(at - t) <= 5]
        if near:
            want.append((i, min(near)[1], min(near)[0]))
    assert got == sorted(want)
    assert nearest_in_time(ldf.limit(0), rdf, keys=["k"], tolerance=5).count() == 0
    assert nearest_in_time(ldf, rdf.limit(0), keys=["k"], tolerance=5).count() == 0


def baskets(seed: int) -> list:
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(25)]
    rows = [(None, "c", ["s1", "s2"]), ("empty", "c", []), ("none", None, None)]
    for j in range(150):
        own = rng.choice([None, "hot", "hot", "hot", "c1", "c2", "c3"])
        items = [names[min(24, int(rng.expovariate(0.15)))] for _ in range(rng.randint(0, 7))] + rng.choice([[], [None, "", " "]])
        rows.append((f"j{j}", own, items))
    rows.append(("long", "c9", names * 3))
    rows += rows[5:20] + [("j3", "c3", ["s1", "s24"])]
    return rows


@pytest.mark.parametrize(("heavy", "block_weight", "part", "least"), [(None, 32_768, 512, 1), (0, 16, 512, 1), (6, 30, 5, 1), (25, 10, 4, 5), (40, 100, 512, 1), (3, 10_000, 3, 2), (12, 200, 512, 3)])
def test_pair_supports(spark, heavy, block_weight, part, least):
    rows = baskets((heavy or 0) + least)
    df = spark.createDataFrame(rows, "job string, company string, skills array<string>").withColumn("owner", F.lit("clash")).withColumn("a", F.lit(1))
    out = pair_supports(df, basket="job", owner="company", items="skills", min_support=least, heavy=heavy, block_weight=block_weight, part=part)
    got = {(r.source_id, r.target_id): (r.support_jobs, r.support_companies, r.lift, r.npmi) for r in out.collect()}
    held, owners = defaultdict(set), defaultdict(set)
    for job, company, items in rows:
        if job is not None:
            held[job] |= {x for x in items or [] if x and x.strip()}
            owners[job] |= {company} - {None}
    n, single, jobs, companies = len(held), defaultdict(int), defaultdict(int), defaultdict(set)
    for job, items in held.items():
        for x in items:
            single[x] += 1
        for pair in itertools.combinations(sorted(items), 2):
            jobs[pair] += 1
            companies[pair] |= owners[job]
    assert got.keys() == {p for p, k in jobs.items() if k >= least}
    for (x, y), (k, c, lift, npmi) in got.items():
        true = n * jobs[x, y] / (single[x] * single[y])
        assert (k, c) == (jobs[x, y], len(companies[x, y]))
        assert (lift, npmi) == pytest.approx((true, math.log(true) / -math.log(jobs[x, y] / n)), abs=1e-6)


def test_pairs_of_a_very_long_basket(spark):
    long, other = [f"s{i}" for i in range(20_000)], [f"s{i}" for i in range(0, 20_000, 16)]
    df = spark.createDataFrame([("a", "x", long), ("b", "x", other), ("c", None, other[:3]), ("d", "y", [])], "job string, company string, skills array<string>")
    out = pair_supports(df, basket="job", owner="company", items="skills", min_support=2)
    supports = {(r.support_jobs, r.support_companies): r.n for r in out.groupBy("support_jobs", "support_companies").agg(F.count("*").alias("n")).collect()}
    assert supports == {(2, 1): 1250 * 1249 // 2 - 3, (3, 1): 3}


@pytest.mark.parametrize("sizes", [[1] * 300, [0] * 50 + [1, 2, 3, 4, 5, 33, 64, 65, 130, 200], [700], [2] * 90, []])
def test_matrix_and_hash_agree(sizes):
    import pyarrow as pa

    rng = random.Random(len(sizes))
    owners = [None if not n else f"o{i}" for i, n in enumerate(sizes) for _ in range(max(1, n))]
    named = [o is not None and int(o[1:]) % 5 == 4 for o in owners]
    items = [sorted({f"s{min(39, int(rng.expovariate(0.1)))}" for _ in range(6)}) for _ in owners]
    primary = [rng.random() < 0.9 for _ in owners]
    table = pa.table({"owner": pa.array(owners, pa.string()), "named": pa.array(named, pa.bool_()), "primary": pa.array(primary, pa.bool_()), "items": pa.array(items, pa.list_(pa.string())), "others": pa.array([None] * len(owners), pa.list_(pa.string()))})

    def counts(heavy):
        jobs, companies, names = defaultdict(int), defaultdict(int), defaultdict(set)
        for r in cooccur.count_block(table, pa.array([f"s{i}" for i in range(heavy)], pa.string())).to_pylist():
            assert r["a"] < r["b"]
            jobs[r["a"], r["b"]] += r["jobs"]
            companies[r["a"], r["b"]] += r["owners"]
            if r["owner"] is not None:
                names[r["a"], r["b"]].add(r["owner"])
        return {p: (jobs[p], companies[p] + len(names[p])) for p in jobs}

    want_jobs, want_owners = defaultdict(int), defaultdict(set)
    for o, p, own in zip(owners, primary, items, strict=True):
        for pair in itertools.combinations(own, 2):
            want_jobs[pair] += p
            want_owners[pair] |= {o} - {None}
    want = {k: (n, len(want_owners[k])) for k, n in want_jobs.items() if n or want_owners[k]}
    for heavy in (0, 3, 20, 40):
        assert counts(heavy) == want


def test_pair_supports_of_nothing(spark):
    df = spark.createDataFrame([("a", "b", None)], "job string, company string, skills array<string>")
    for x in (df, df.limit(0)):
        assert pair_supports(x, basket="job", owner="company", items="skills").count() == 0


NODES = [("n1", "HM/UI", []), ("n2", "前端介面開發", ["網頁切版"]), ("n3", "Node.kx", None), ("n4", "D++", []), ("n5", "D#", []), ("n6", "資安巡檢初階", []), ("n7", "Kora", []), ("n8", "KoraScript", ["Kora Script語言"]), ("n9", "X系統", ["共用名"]), ("n10", "Y系統", ["共用名"])]
#: Texts beside names that stand as they are, from which to learn what is written around names.
EVIDENCE = {"Kora 相關經驗": "n7", "D++相關經驗": "n4", "Kora(必備)": "n7", "HM/UI(必備)": "n1", "Kora 熟練": "n7", "D#熟練": "n5", "D++操作": "n4", "Kora操作": "n7", "D++能力": "n4", "D#能力": "n5", "Kora v1": "n7", "D# v2": "n5", "Kora(1)": "n7", "D++(2)": "n4", "D++經驗": "n4", "D# 經驗": "n5", "熟悉D#": "n5", "熟悉 Kora": "n7", "精通D#": "n5", "精通 Kora": "n7", "具Kora": "n7", "具 HM/UI": "n1"}
SURFACES = EVIDENCE | {
    "hm/ui (3.2)": "n1", "ＨＭ／ＵＩ相關經驗": "n1", "前端界面開發": "n2", "前介端面開發": "n2", "前端介面開": "n2", "前端介面面開發": "n2", "熟悉網頁切版(必備)": "n2", "前端・介面_開發": "n2",
    "node kx 熟練": "n3", "精通 nodekx": "n3", "d++操作": "n4", "d#": "n5", "具資安巡檢初階能力": "n6", "資安巡检初阶": "n6", "kora v9.4": "n7", "korascrpt": "n8", "kora script言": "n8",
    "Kora" + "經驗" * 12: "n7", "精通" * 11 + "熟悉kora(必備)操作": "n7", "資安巡檢初階經驗能力": "n6",
    "共用名": None, "皮革染色": None, "umbrevue經驗": None, "無": None, "": None, None: None, "?" * 5000: None, "經驗" * 20_000: None, "1" * 30_000: None,
}


def test_closest_entries(spark):
    nodes = spark.createDataFrame(NODES, "node_id string, label string, aliases array<string>")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*SURFACES, "hm/ui (3.2)"])], "id long, t string").withColumn("form", F.lit("clash")).withColumn("plain", F.lit("clash"))
    matched = closest_entries(rows, nodes, text="t", node_id="node_id", label="label", aliases="aliases")
    got = {r.text: r.node_id for r in matched.collect()}
    assert got == {k: v for k, v in SURFACES.items() if v}
    assert {r.t for r in unmatched(rows, matched, text="t").collect()} == {k for k, v in SURFACES.items() if not v}
    assert closest_entries(rows, nodes.limit(0), text="t", node_id="node_id", label="label", aliases="aliases").count() == 0
    assert closest_entries(rows.limit(0), nodes, text="t", node_id="node_id", label="label", aliases="aliases").count() == 0


def test_all_that_is_written_around_names(spark):
    nodes = spark.createDataFrame([(f"n{i}", name, None) for i, name in enumerate(["Kora", "HM/UI", "前端介面開發"])], "node_id string, label string, aliases array<string>")
    long = "需有五年以上獨立作業並且能夠帶領團隊之實務經驗"
    parts = {"after": ["熟練", "操作", "第0版", long], "before": ["精", "精通", "通", "通過"]}
    typed = {name + t.replace("0", str(i + 9)): f"n{i}" for i, name in enumerate(["Kora", "HM/UI"]) for t in parts["after"]}
    typed |= {t + name: f"n{i}" for i, name in enumerate(["Kora", "HM/UI"]) for t in parts["before"]}
    # 精通過 is 精 and 通過: neither the longest nor the shortest text at every step
    typed |= {"前端介面開發" + long: "n2", "前端介面開發熟練第123版" + long + "操作": "n2", "精通過前端介面開發": "n2", "精" * 200 + "前端介面開發" + "第7版熟練" * 100: "n2"}
    rows = spark.createDataFrame([(t,) for t in [*typed, "皮革染色", "熟練", "...", "操作" * 3000]], "t string")
    for most, longest in ((5_000, 16), (5_000, 40), (1, 16), (1, 40), (0, 0)):
        found = closest_entries(rows, nodes, text="t", node_id="node_id", label="label", aliases="aliases", most_affixes=most, longest_affix=longest).collect()
        assert {r.text: (r.node_id, r.distance) for r in found} == {t: (n, 0) for t, n in typed.items()}


@pytest.mark.parametrize("most", [100, 0])
def test_left_over_equals_brute_force(spark, most):
    rng = random.Random(6)
    around = {"before": ["a", "ab", "b0", "0", "bca", "😀"], "after": ["c", "bc", "0a", "a0b", "cc", "ab" * 40]}
    typed = {"".join(rng.choice("aabbcc127😀") for _ in range(rng.randint(1, 9))) for _ in range(300)} | {"a" * 150 + "cab" + "0a7b" * 50, "ba" + "ab" * 80, "..."}

    def reached(text: str, texts: list[str]) -> set[int]:
        found, todo = set(), [0]
        while todo:
            found.add(at := todo.pop())
            ends = [m.end() for t in texts if (m := re.compile(t.replace("0", r"\d+(?!\d)")).match(text, at))]
            todo += [e for e in ends if e not in found]
        return found

    want = set()
    for t in typed:
        heads, tails = reached(t, around["before"]), reached(t[::-1], [x[::-1] for x in around["after"]])
        want |= {(t, t[h : len(t) - x]) for h in heads for x in tails if 1 <= len(t) - x - h <= 6}
    rows = spark.createDataFrame([(t, t) for t in typed], "text string, plain string")
    got = left_over(rows, spark.createDataFrame([(s, t) for s, texts in around.items() for t in texts], "side string, rest string"), 6, most=most, longest_affix=80)
    assert sorted((r.text, r.form) for r in got.collect()) == sorted(want) and len(want) > 500


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_entries_equal_brute_force(spark):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    names = sorted({some(rng.choice([1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 12])) for _ in range(60)})
    typed = set()
    for _ in range(300):
        t = list(rng.choice(names))
        for _ in range(rng.randint(0, 2)):
            at, what = rng.randrange(len(t) + 1), rng.randint(0, 3)
            if what == 3 and at + 1 < len(t):
                t[at], t[at + 1] = t[at + 1], t[at]
            else:
                t[at : at + (what > 0)] = [rng.choice("abcd")] if what < 2 else []
        typed.add("".join(t))
    typed -= {""}

    def distance(t: str, n: str) -> int | None:
        d = edits(t, n)
        swapped = d == 2 and any(t[:i] + t[i + 1] + t[i] + t[i + 2 :] == n for i in range(len(t) - 1))
        if d and len(n) < 3 or d > 2 or (d == 2 and not swapped and len(n) < 8):
            return None
        return 1 if swapped else d

    want = {}
    for t in typed:
        near = sorted((d, -len(n), n) for n in names if (d := distance(t, n)) is not None)
        best = [n for d, k, n in near if (d, k) == near[0][:2]]
        if len(best) == 1:
            want[t] = (best[0], near[0][0])
    nodes = spark.createDataFrame([(n, n, None) for n in names], "node_id string, label string, aliases array<string>")
    found = closest_entries(spark.createDataFrame([(t,) for t in typed], "t string"), nodes, text="t", node_id="node_id", label="label", aliases="aliases", least_names=10**6)
    assert {r.text: (r.node_id, r.distance) for r in found.collect()} == want and len(want) > 100


def postings(spark, n: int, late: int = 0):
    rows = [(i, f"p{i % (n // 2 + 1)}" if i % 17 else None, f"w{i * 10 // 2000}") for i in range(n)] + [(9000 + i, f"new{i}", "w9") for i in range(late)]
    return spark.createDataFrame(rows, "row long, posting string, week string")


def test_names_in_simplified_characters(spark):
    pairs = {"賣場擺設": "卖场摆设", "無塵室設備保全": "无尘室设备保全", "幼兒團體帶領": "幼儿团体带领", "保全巡邏監看": "保全巡逻监看", "訪談參優歸檔": "访谈参优归档"}
    nodes = spark.createDataFrame([(n, n, None) for n in pairs], "node_id string, label string, aliases array<string>")
    got = closest_entries(spark.createDataFrame([(t,) for t in pairs.values()], "text string"), nodes, text="text", node_id="node_id", label="label", aliases="aliases").collect()
    assert {(r.node_id, r.text, r.distance) for r in got} == {(n, t, 0) for n, t in pairs.items()}


def test_sample_is_stable(spark):
    options = {"identifier": F.col("posting"), "epoch": F.col("week"), "target_per_epoch": 30, "floor": 0.05}
    chosen = lambda df, reg: {(r.row, r.id) for r in stable_sample(df, reg, identifier=F.col("posting"), seed="s").collect()}
    first = postings(spark, 1000)
    registry = extend_registry(None, first, **options)
    once = chosen(first, registry)
    assert once and once == chosen(first.repartition(7).orderBy(F.desc("row")), extend_registry(None, first.repartition(3), **options))
    rows_of = defaultdict(set)
    for r in first.collect():
        rows_of[r.posting].add(r.row)
    for posting in {p for _, p in once}:
        assert rows_of[posting] == {r for r, p in once if p == posting}
    more = postings(spark, 1000, late=300)
    grown = extend_registry(registry, more, **options)
    assert once <= chosen(more, grown)
    assert {tuple(r) for r in registry.collect()} <= {tuple(r) for r in grown.collect()}
    assert {tuple(r) for r in extend_registry(grown, more, **options).collect()} == {tuple(r) for r in grown.collect()}
    clash = first.withColumn("id", F.lit("x")).withColumn("epoch", F.lit("x")).withColumn("rate", F.lit("x"))
    assert chosen(clash, registry) == once
    assert chosen(first.limit(0), registry) == set()
    assert extend_registry(None, first.limit(0), **options).count() == 0


def test_sampling_numbers(spark):
    u = [r[0] for r in spark.range(4000).select(uniform(F.col("id").cast("string"), "s", F.lit("w1"))).collect()]
    other = [r[0] for r in spark.range(4000).select(uniform(F.col("id").cast("string"), "s", F.lit("w2"))).collect()]
    assert abs(np.corrcoef(u, other)[0, 1]) < 0.06
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02
    seen = first_seen(postings(spark, 1000), identifier=F.col("posting"), epoch=F.col("week"))
    rates = {r.epoch: r.rate for r in frozen_rates(seen, target_per_epoch=30, floor=0.05).collect()}
    sizes = dict(sorted((r.epoch, r["count"]) for r in seen.groupBy("epoch").count().collect()))
    epochs = list(sizes)
    assert rates[epochs[0]] == 1.0
    for k, e in enumerate(epochs[1:], 1):
        assert rates[e] == pytest.approx(min(1, max(0.05, 30 * k / sum(sizes[x] for x in epochs[:k]))))


def planted(seed: int) -> tuple[list, list, set]:
    """Documents, items and the pairs that brute force over all diagonals finds."""
    rng = random.Random(seed)
    text = lambda n: "".join(chr(rng.randint(0x4E00, 0x4E00 + 600)) for _ in range(n))
    items = [(i, "同一段開頭的說明文字，" + text(rng.randint(60, 150)), 50) for i in range(8)] + [(90, "短", 50), (91, None, 50)]
    docs = []
    for d in range(60):
        body = text(rng.randint(0, 300))
        if d % 2:
            passage = rng.choice(items[:8])[1]
            size = rng.randint(40, 70)
            start = rng.randint(0, max(0, len(passage) - size))
            part = list(passage[start : start + size])
            for p in rng.sample(range(len(part)), rng.randint(0, 6)):
                part[p] = "換"
            body = body[:100] + rng.choice(["", "<b>", "\n"]).join(part) + body[100:]
        docs.append((d, body if d % 13 else None))
    docs += [(100, text(9000) + items[3][1][5:70] + text(5000)), (101, " "), (102, items[0][1])]
    docs.append(docs[1])
    found = set()
    for d, body in docs:
        a = leak.code_points(letters(body))
        for i, t, least in items:
            b = leak.code_points(letters(t))
            if len(b) < least:
                continue
            for off in range(-len(b) + least, len(a) - least + 1):
                lo, hi = max(0, off), min(len(a), len(b) + off)
                if hi - lo >= least and holds_stretch(a[lo:hi], b[lo - off : hi - off], least, 12):
                    found.add((d, i))
                    break
    return docs, items, found


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"index_bound": 3}), (3, {"piece": 300}), (4, {"piece": 300, "index_bound": 200})])
def test_leaks_equal_brute_force(spark, seed, options):
    docs, items, want = planted(seed)
    d = spark.createDataFrame(docs, "doc long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item long, text string, least int").withColumn("doc", F.lit("clash"))
    find = lambda a, b: {tuple(r) for r in leaked_items(a, b, doc_id="doc", text="text", item_id="item", item_text="text", least=F.col("least"), **options).collect()}
    assert find(d, i) == want and len(want) > 10
    assert find(d.limit(0), i) == set() and find(d, i.limit(0)) == set()


def searched(item: str, least: int, miss: float = 1e-3):
    """found(document) for one item, by the sketch."""
    import pyarrow as pa

    codes, q = leak.code_points(item), leak.shingle_size(least, 12, 18)
    hashes = leak.shingles(codes, [q])[q]
    n = len(hashes)
    table = pa.table({"q": np.full(n, q), "hash": hashes.view(np.int64), "item": np.full(n, 7), "place": np.arange(n), "always": leak.repetitive(hashes, 2 * least)})
    index, share = leak.Index(table, {7: (1, least, q, codes)}), leak.sampling_share(leak.surviving(least, 12, q), miss)

    def found(document: str) -> list[int]:
        several = [p for _, p in leak.pieces(leak.code_points(document), 4096, 2 * least + q)]
        return sorted({1 for no, _, d in index.candidates(several, share) if leak.verified(several[no], codes, d, least, 12, q)})

    return found


def test_sketch_sizes():
    assert [leak.shingle_size(n, 12, 18) for n in (50, 100)] == [6, 9] and [leak.surviving(50, 12, 6), leak.surviving(100, 12, 9)] == [21, 19]
    assert 0.45 < leak.sampling_share(19, 1e-3) < 0.55 and leak.sampling_share(3, 0.5) > leak.sampling_share(30, 0.5)
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 61, 400, 4000):
        hashes = rng.integers(0, 1 << 63, n).astype(np.uint64)
        kept = leak.sketches(np.concatenate([hashes, hashes, hashes[:1]]), np.repeat([3, 5, 8], [n, n, 1]), 0.4)
        assert (kept[:n] == kept[n : 2 * n]).all() and kept[-1]
        assert 0.4 * n <= kept[:n].sum() <= 0.4 * n * leak.CLASS + 2 and hashes[kept[:n]].max() <= np.sort(hashes)[kept[:n].sum() - 1]


def test_shingles_of_two_sizes():
    codes = leak.code_points("the quick brown fox 狐狸")
    both = leak.shingles(codes, [6, 9])
    for q in (6, 9):
        one = leak.shingles(codes, [q])[q]
        assert len(one) == len(codes) - q + 1 and (both[q] == one).all() and len(set(one.tolist())) == len(one)
    assert [len(x) for x in leak.shingles(codes[:7], [6, 9]).values()] == [2, 0] and not len(leak.shingles(codes[:0], [6])[6])


@pytest.mark.parametrize(("least", "alphabet"), [(50, "".join(map(chr, range(0x4E00, 0x5200)))), (100, "abcdefghijklmnopqrstuvwxyz")])
def test_leaks_with_most_replacements(least, alphabet):
    rng = random.Random(least)
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    tried = []
    for n in (least, least + 10, least + 20, least + 32, 2 * least - 1) * 40:
        replaced = n // 12
        for places in ([int((k + 0.5) * n / replaced) for k in range(replaced)], [n // 2 - 3 * replaced + 6 * k for k in range(replaced)], rng.sample(range(n), replaced)):
            item, start = some(400), rng.randint(0, 400 - n)
            passage = list(item[start : start + n])
            for p in places:
                passage[p] = "ж"
            tried.append(searched(item, least)(some(200) + "".join(passage) + some(200)) == [1])
    assert len(tried) == 600 and sum(tried) >= 0.99 * len(tried)
    again = searched("好" * 70, least=50)
    assert again("天" * 9 + "好" * 60) == [1] and again("好" * 49) == []
    twice = some(30) * 6
    assert searched(twice, least)(some(99) + twice[7 : 7 + least] + some(99)) == [1]


def test_leaks_across_pieces():
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    item = some(400)
    find, hits = searched(item, least=100), []
    for n in (100, 112, 199):
        passage = list(item[50 : 50 + n])
        for k in range(n // 12):
            passage[12 * k + 6] = "ж"
        for start in range(3780, 4100, 4):
            hits.append(find(some(start) + "".join(passage) + some(500)) == [1])
    assert sum(hits) >= 0.99 * len(hits)


def test_markup_of_any_length():
    assert letters("ab<p style='" + "x" * 5000 + "'>c</p>d &lt;3 < 5 > 4") == "abcd3" + "54"
    assert letters("<!-- " + "y" * 9000 + "-->z") == "z" and letters("<" * 50_000) == ""


def test_stretch_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = rng.integers(0, 2, n), np.zeros(n, int)
        a[rng.random(n) < 0.8] = 0
        want = any(12 * (a[i:j] != b[i:j]).sum() <= j - i for i in range(n) for j in range(i + 10, n + 1))
        assert holds_stretch(a, b, 10, 12) == want


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, "word " * rng.randint(1, 60), rng.choice(["a", "A ", "a", "a", "b", "c", None, "other"])) for i in range(900)]
    docs += [(2000, None, "a"), (2001, "", "b"), (2002, "x", "B"), *docs[:30], (docs[3][0], docs[3][1], "b")]
    df = spark.createDataFrame(docs, "id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("missing", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = mix.mix_sources(df, targets, doc_id="id", text="text", source="source").collect()
    assert len({r.doc_id for r in mixed}) == len(mixed)
    assert all(r.copies <= {"a": 1, "b": 2, "c": 4}[r.source] for r in mixed)
    spent = defaultdict(int)
    for r in mixed:
        spent[r.source] += r.tokens * r.copies
    total = sum(spent.values())
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(spent[s] / total - share / 0.9) < 0.01
    report = {r.source: r for r in mix.share_report(spark.createDataFrame(mixed), targets).collect()}
    assert report["missing"].tokens == 0 and report["a"].tokens == spent["a"]
    assert mix.mix_sources(df.limit(0), targets, doc_id="id", text="text", source="source").count() == 0
    assert mix.mix_sources(df, targets.limit(0), doc_id="id", text="text", source="source").count() == 0


def test_flight_keeps_both_totals():
    rng = random.Random(3)
    for n in (1, 2, 3, 50, 2000):
        sizes = [rng.choice([5, 5, rng.randint(1, 400)]) for _ in range(n)]
        flight, picked = mix.Flight(7), []
        for k, t in enumerate(sizes):
            picked += flight.add((k, t), t, 0.37)
        assert len(flight.pool) <= 2
        picked += flight.land()
        assert sorted(u[0] for u, _ in picked) == list(range(n))
        tokens, count = sum(u[1] * b for u, b in picked), sum(b for _, b in picked)
        assert abs(tokens - 0.37 * sum(sizes)) <= 2 * max(sizes) and abs(count - 0.37 * n) <= 2.0001


def test_flight_has_no_bias():
    hits = np.zeros(9)
    for seed in range(3000):
        flight, picked = mix.Flight(seed), []
        for k in range(9):
            picked += flight.add((k,), 10 + k * k, 0.4)
        picked += flight.land()
        for u, b in picked:
            hits[u[0]] += b
    assert np.abs(hits / 3000 - 0.4).max() < 0.12


def test_mixing_plan():
    total, uses = mix.plan([("a", 0.5, 1), ("b", 0.5, 3)], {"a": 100, "b": 10})
    assert total == pytest.approx(60) and uses == {"a": pytest.approx(0.3), "b": pytest.approx(3)}
    assert mix.plan([("a", 0.5, 1), ("b", 0.5, 3)], {"a": 100, "b": 10}, 200)[1] == {"a": 1.0, "b": 3.0}
    assert mix.plan([("a", 1.0, 1)], {}) == (0.0, {})


def test_tails_are_exact(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0, 1]), rng.choice(["zh", "en"]), rng.choice([0.0, 0.0, round(rng.random(), 1)])) for _ in range(400)]
    counted = spark.createDataFrame([(*k, n) for k, n in Counter(rows).items()], "statistic int, language string, value double, n long")
    got = {(r.statistic, r.language, r.value): (r.left, r.right) for r in quality.tail_probabilities(counted).collect()}
    assert got.keys() == set(rows)
    for (s, lang, v), (left, right) in got.items():
        values = [x[2] for x in rows if x[:2] == (s, lang)]
        assert left == pytest.approx(-math.log(sum(x <= v for x in values) / len(values)))
        assert right == pytest.approx(-math.log(sum(x >= v for x in values) / len(values)))


def test_statistics_by_definition():
    import re

    han, kana = "㐀-䶿一-鿿\uf900-\ufaff", "ぁ-ヺ"
    common = quality.CommonWords([("zh", "的"), ("zh", "我們"), ("en", "The"), ("en", "is")])
    texts = ["我們的 abc1 12\n的，好", "The cat is here. Is it? 3.5 this\n\n- x", "<p style='" + "z" * 4000 + "'>第一行<br/>第二行。</p>", "かな カナー123", "�a?b│|", "", " \n", "<<<", "ａ" * 3000, "\ud800x", "İ the"]
    langs, values = quality.measure(texts, common)
    rows = [dict(zip(quality.STATISTICS, v, strict=True)) for v in values.tolist()]
    assert langs[:4] == ["zh", "en", "zh", "ja"] and langs[5:8] == ["und"] * 3
    for t, lang, r in zip(texts, langs, rows, strict=True):
        words = re.findall(rf"[{han}]|[{kana}ー]+|[^\W\d_{han}{kana}ー]+|\d+", t)
        assert r["words"] == len(words) and r["mean_word"] == pytest.approx(sum(map(len, words)) / max(1, len(words)))
        visible = max(1, len("".join(t.split())))
        assert r["symbols"] == pytest.approx(sum(not c.isspace() and not c.isalpha() and not c.isdigit() for c in t) / visible)
        lines = [x.strip() for x in re.split(r"[\r\n]+|<br/>", t) if x.strip()]
        assert r["line_ends"] == pytest.approx(sum(x[-1] in quality.ENDS for x in lines) / max(1, len(lines))) and r["mean_line"] == pytest.approx(sum(map(len, lines)) / max(1, len(lines)))
        assert r["distinct"] == pytest.approx(len(set(zip(t, t[1:], strict=False))) / max(1, len(t) - 1))
        bare = quality.TAG.sub("", t)
        assert r["markup"] == pytest.approx((len(t) - len(bare)) / max(1, len(t)))
        pieces = [x.strip() for x in re.split(rf"[{quality.SEPARATORS}]", bare) if x.strip()]
        assert r["piece"] == pytest.approx(sum(map(len, pieces)) / max(1, len(pieces)))
        long = 9 if lang in ("zh", "ja") else 30
        assert r["long_pieces"] == pytest.approx(sum(len(x) for x in pieces if len(x) >= long) / max(1, sum(map(len, pieces))))
    assert rows[0]["common"] == pytest.approx(4 / 8) and rows[0]["common_pieces"] == pytest.approx(2 / 3)
    assert rows[1]["common"] == pytest.approx(3 / 10) and rows[1]["sentences"] == pytest.approx(2 / 10)
    assert rows[4]["broken"] == pytest.approx(2 / 6) and rows[4]["drawn"] == pytest.approx(2 / 6) and rows[2]["markup"] > 0.99
    one_by_one = np.concatenate([quality.measure([t], common)[1] for t in texts])
    assert (one_by_one == values).all() and quality.measure([], common)[0] == []


PROSE = "我們在市場旁的辦公室工作，每天都會和同事一起檢查訂單。如果客人有問題，我們會請他先坐下，然後再慢慢說明。"


def test_outlier_scores(spark):
    docs = [(i, PROSE[: 30 + i] + "因為這樣，大家都可以準時下班。" * (i % 3 + 1), "x") for i in range(40)]
    docs += [(100 + i, "\n".join(["團體保險", "夜班加給", "水電技工"] * (i + 2)), "x") for i in range(4)] + [(200, "%$#@ ~~ ++ ==" * 9, "x"), (300, None, "x"), (301, "  \n", "x"), (302, "字" * 200_000, "x")]
    df = spark.createDataFrame(docs + docs[:1], "doc_id long, text string, value string").withColumn("row", F.lit("clash"))
    words = spark.createDataFrame([("zh", w) for w in "的 在 和 會 我們 如果 因為 可以 都".split()] + [("en", "the"), (None, "x")], "lang string, word string")
    labels = spark.createDataFrame([(i, "prose") for i in range(12)] + [(100, "list"), (101, "list"), (200, "junk"), (999, "list"), (5, None)], "doc_id long, label string")
    run = lambda d, lab: quality.outlier_scores(d, words, lab, doc_id="doc_id", text="text", label="label").collect()
    scores = {r.doc_id: r.score for r in run(df, labels)}
    assert {k for k, v in scores.items() if v > 0} - {302} == {100, 101, 102, 103, 200}
    assert scores.keys() == {d for d, t, _ in docs if t and t.strip()}
    assert len(run(df, labels.limit(0))) == len(scores) + 1
    assert run(df.limit(0), labels) == []
