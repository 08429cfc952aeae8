"""Attributes as of event time, packed fields and orphan references against brute force."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.functions.scalars import local_timestamp, micros, whole_number
from lodestream.operators import orphans
from lodestream.operators.asof import attributes_as_of, current_state_versions
from lodestream.operators.orphans import orphan_references
from lodestream.operators.packed import Segmenter, known_values, split_packed
from lodestream.session import TooLarge, bounded_rows

T0 = dt.datetime(2026, 4, 6)
STATES = "row long, job string, changed timestamp_ntz, loaded timestamp_ntz, status string, state string, slice string"


def moment(hours: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=hours)


def in_force(states: list, job: str | None, at: dt.datetime | None):
    held = [s for s in states if job is not None and at is not None and s[1] == job and s[2] and s[3] and s[2] <= at and s[3] <= at]
    return min(held, key=lambda s: (-s[2].timestamp(), s[0]), default=None)


def example(seed: int, jobs: int = 5, n: int = 120) -> tuple[list, list]:
    rng = random.Random(seed)
    clock = lambda: None if rng.random() < 0.05 else moment(rng.randint(0, 24 * 9) / 2)
    job = lambda: None if rng.random() < 0.05 else "hot" if rng.random() < 0.4 else f"j{rng.randint(0, jobs)}"
    states = [(i, job(), clock(), clock(), rng.choice(["open", "open", "removed"]), "x", "y") for i in range(n)]
    states += [(i + 1000, *s[1:]) for i, s in enumerate(rng.sample(states, 15))]
    events = [(i, job(), clock()) for i in range(n)]
    return states, events + events[:10]


def as_of(spark, states: list, events: list, **options):
    s = spark.createDataFrame(states, STATES)
    e = spark.createDataFrame(events, "event long, job string, at timestamp_ntz").withColumn("key", F.lit("clash")).withColumn("state", F.lit("clash"))
    return attributes_as_of(
        e, s, event_key=F.col("job"), event_time=F.col("at"), event_columns=["event"], state_key=F.col("job"), effective=F.col("changed"), available=F.col("loaded"), tie=F.col("row"),
        payload={"row": F.col("row"), "status": F.col("status")}, **options,
    )


@pytest.mark.parametrize("options", [{}, {"max_group": 3}, {"slice_seconds": 3600, "max_group": 5}])
def test_as_of_equals_brute_force(spark, options):
    states, events = example(1)
    got = sorted((r.event, r.row, r.status) for r in as_of(spark, states, events, **options).na.fill({"row": -1, "status": ""}).collect())
    want = sorted((e, s[0] if s else -1, s[4] if s else "") for e, job, at in events for s in [in_force(states, job, at)])
    assert got == want


def test_as_of_of_empty_tables(spark):
    states, events = example(2)
    assert all(r.row is None for r in as_of(spark, [], events).collect())
    assert as_of(spark, states, []).collect() == []


def test_payload_that_clashes_is_an_error(spark):
    with pytest.raises(ValueError, match="repeat"):
        df = spark.createDataFrame([(1, "a", T0)], "event long, job string, at timestamp_ntz")
        attributes_as_of(
            df, df, event_key=F.col("job"), event_time=F.col("at"), event_columns=["event"], state_key=F.col("job"), effective=F.col("at"), available=F.col("at"), tie=F.col("event"),
            payload={"event": F.col("event")},
        )


@pytest.mark.parametrize("seed", [3, 4])
def test_orphans_equal_brute_force(spark, seed):
    states, events = example(seed)
    s = spark.createDataFrame(states, STATES)
    versions = current_state_versions(s, key=F.col("job"), effective=F.col("changed"), available=F.col("loaded"), tie=F.col("row"), payload={"status": F.col("status")})
    refs = spark.createDataFrame(events, "record long, job string, t timestamp_ntz").select(F.col("job").alias("key"), micros(F.col("t")).alias("at"), "record", F.lit("clash").alias("day"), F.lit("clash").alias("state"), F.lit("clash").alias("sure"))
    got = sorted(r.record for r in orphan_references(refs, versions, exists="state.status <> 'removed'").collect())
    want = sorted(e for e, job, at in events if job is not None and at is not None and ((x := in_force(states, job, at)) is None or x[4] == "removed"))
    assert got == want


def test_orphans_without_parents_or_references(spark):
    states, events = example(5)
    none = spark.createDataFrame([], STATES)
    make = lambda df: current_state_versions(df, key=F.col("job"), effective=F.col("changed"), available=F.col("loaded"), tie=F.col("row"), payload={"status": F.col("status")})
    refs = spark.createDataFrame(events, "record long, job string, t timestamp_ntz").select(F.col("job").alias("key"), micros(F.col("t")).alias("at"), "record")
    whole = [e for e in events if e[1] is not None and e[2] is not None]
    assert orphan_references(refs, make(none), exists="state.status <> 'removed'").count() == len(whole)
    assert orphan_references(refs.limit(0), make(spark.createDataFrame(states, STATES)), exists="state.status <> 'removed'").count() == 0


KNOWN = ["HM/UI", "Rivet I/O", "D++", "D#", ".NOVA", "Cashvero POS", "咖啡萃取調校"]
FIELDS = [
    (None, []),
    ("", []),
    (" 無 ", []),
    ("N/A", []),
    ("D++、D#，.NOVA", ["D++", "D#", ".NOVA"]),
    ("HM/UI / Rivet I/O/D#", ["HM/UI", "Rivet I/O", "D#"]),
    ("hm/ui,ＨＭ／ＵＩ", ["hm/ui", "ＨＭ／ＵＩ"]),
    ("a/b", ["a", "b"]),
    ("1. .NOVA\n2. D#", [".NOVA", "D#"]),
    ("(1) a\n(2) b\n(3) a", ["a", "b", "a"]),
    ("- a\r\n- b\r\n", ["a", "b"]),
    ("※a\n※Cashvero POS", ["a", "Cashvero POS"]),
    ("a<br/>b<BR />c<br>", ["a", "b", "c"]),
    ('"a, b",c', ["a, b", "c"]),
    ('"俗稱""快手""的裝箱"、c', ['俗稱"快手"的裝箱', "c"]),
    ('["x, y", "a \\"b\\"", "x, y"]', ["x, y", 'a "b"', "x, y"]),
    ("「剪紙|摺紙」|“裁切；封邊”", ["剪紙|摺紙", "裁切；封邊"]),
    ('half "open, b', ['half "open', "b"]),
    ("a,,b, ,", ["a", "b"]),
    (" a\tb ", ["a", "b"]),
    ("2.5D製圖,3D", ["2.5D製圖", "3D"]),
]


@pytest.mark.parametrize(("field", "values"), FIELDS)
def test_segmenter(field, values):
    assert Segmenter(KNOWN).values(field) == values


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*KNOWN, "甲", "乙 丙", 'x, "y"|z']), min_size=1, max_size=12), st.sampled_from([",", "、", " / ", "\n", "<br>", "；", "|", "\t"]), st.booleans())
def test_segmenter_round_trip(values, between, quoted):
    written = ['"' + v.replace('"', '""') + '"' if quoted or any(c in v for c in ',"|') and v not in KNOWN else v for v in values]
    assert Segmenter(KNOWN).values(between.join(written)) == values


def test_segmenter_of_long_fields():
    for field, n in ((",".join(["甲"] * 50_000), 50_000), ("“a," * 50_000, 50_000), ("HM/UI、" * 20_000, 20_000), ("x" * 300_000, 1), ('"a,' * 50_000, 50_000)):
        assert len(Segmenter(KNOWN).values(field)) == n


def test_split_packed_rows(spark):
    rows = [(1, "a,b", None, "clash", "z"), (2, None, None, "p", "z"), (3, "", "無", "p", "z"), (1, "a,b", None, "clash", "z"), (4, "x" * 100_000 + ",y", "q", "p", "z")]
    df = spark.createDataFrame(rows, "id long, one string, two string, item string, pos string")
    out = split_packed(df, ["one", "two"], [], row_id="id")
    got = sorted((r.id, r.field_name, r.pos, len(r.item)) for r in out.collect())
    assert got == [(1, "one", 1, 1), (1, "one", 1, 1), (1, "one", 2, 1), (1, "one", 2, 1), (4, "one", 1, 100_000), (4, "one", 2, 1), (4, "two", 1, 1)]
    assert split_packed(df.limit(0), ["one", "two"], KNOWN, row_id="id").count() == 0


def test_known_values_are_bounded(spark):
    nodes = spark.createDataFrame([("a", ["b", " ", None]), ("c", None)], "label string, aliases array<string>")
    assert known_values(nodes, "label", "aliases") == ["a", "b", "c"]
    with pytest.raises(TooLarge):
        bounded_rows(nodes, 1, "nodes")


def test_numbers_and_times(spark):
    texts = [" 007", "7.0", "７", "abc", "", None, "1.5", "-1", "1" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(whole_number(F.col("t"))).collect()] == ["7", "7", "7", None, None, None, None, "-1", "1" * 30]
    times = ["2026-02-04 12:04:24.123", "2026/2/5 上午 12:01:17", "2026/4/9 下午 12:19:11", "115/02/04 23:36:06", "20260204123151", "2026-02-04T19:25:02", "2026-13-01 00:00:00", "無", None]
    want = [dt.datetime(2026, 2, 4, 12, 4, 24, 123000), dt.datetime(2026, 2, 5, 0, 1, 17), dt.datetime(2026, 4, 9, 12, 19, 11), dt.datetime(2026, 2, 4, 23, 36, 6)]
    want += [dt.datetime(2026, 2, 4, 12, 31, 51), dt.datetime(2026, 2, 4, 19, 25, 2), None, None, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(local_timestamp(F.col("t"))).collect()] == want
    got = [r[0] for r in df.select(micros(local_timestamp(F.col("t")))).collect()]
    assert got == [w and round((w - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for w in want]


def test_bitmaps():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.choice(orphans.RANGE, n, replace=False)) for n in (0, 1, 50, 4096, 4097, 9000, 65536)]
    for a in sets:
        for b in sets:
            x, y = orphans.Bitmap(a), orphans.Bitmap(b)
            assert x.values.nbytes <= 8192
            for got, want in ((x.and_not(y), np.setdiff1d(a, b)), (x.either(y), np.union1d(a, b)), (x.one_of(y), np.setxor1d(a, b))):
                assert (got.numbers() == want).all() and len(got.numbers()) == len(want)
                assert (got.values.dtype == np.uint16) == (len(want) <= orphans.SPARSE)


def test_ranges_of_keys():
    rng = random.Random(3)
    rows, want = [], set()
    for k in range(150_000):
        if rng.random() < 0.3:
            continue
        key, exists = f"{k:07d}", False
        days = {rng.randint(-70, 70): [rng.random() < 0.7, rng.choice([0, 0, 0, 1, 2])] for _ in range(rng.randint(1, 3))}
        for day in sorted(days):
            asked, n = days[day]
            if asked and not (exists and not n):
                want.add((key, day, not exists and not n))
            exists ^= n % 2 == 1
        blocks = {}
        for day, (asked, n) in days.items():
            x = blocks.setdefault(day // 64, [0, 0, 0])
            for i, flag in enumerate((asked, n > 0, n % 2 == 1)):
                x[i] |= flag << day % 64
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rows += [(key, b, *map(signed, x)) for b, x in sorted(blocks.items())]
    table = pa.table({n: pa.array(c, t) for n, c, t in zip(("key", "block", "asked", "moved", "odd"), zip(*rows, strict=True), (pa.string(), pa.int32(), *[pa.int64()] * 3), strict=True)})
    for size in (999, 70_000, len(rows)):
        got = pa.Table.from_batches(list(orphans.unaccounted(iter([*table.to_batches(size), *table.slice(0, 0).to_batches()]))))
        assert {tuple(r.values()) for r in got.to_pylist()} == want and got.num_rows == len(want)
    assert list(orphans.unaccounted(iter([]))) == []
