"""Files, sinks and the streaming forms."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestream import schemas
from lodestream.sources import readers, sinks
from lodestream.streaming import jobs

PAIRS = "query_id string, job_id string, label int, exposure_rank int"


def test_csv_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("\ufeffCodeNo,CodeNameA,CodeNameB,CodeNameC\n" + "".join(f'{i},"a ""{i}"", c",,z\n' for i in range(40_000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = readers.read_csv(spark, str(path), schemas.DUTY_CODES)
        assert rows.rdd.getNumPartitions() > 3 and rows.distinct().count() == 40_000
        assert tuple(rows.filter("CodeNo = '777'").first()) == ("777", 'a "777", c', "", "z")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('\ufeffCodeNo,CodeNameA,CodeNameB,CodeNameC\n1,"a ""b"", c","x\ny",\n2,NULL,無,z\n', encoding="utf-8")
    rows = readers.read_csv(spark, str(path), schemas.DUTY_CODES, multiline=True).orderBy("CodeNo").collect()
    assert [tuple(r) for r in rows] == [("1", 'a "b", c', "x\ny", ""), ("2", "NULL", "無", "z")]
    lookup = {r.code: r.names for r in readers.code_lookup(spark.createDataFrame(rows, schemas.DUTY_CODES), "CodeNo", ["CodeNameA", "CodeNameB", "CodeNameC"]).collect()}
    assert lookup["2"] == ["NULL", "z", "無"]


def test_jsonl(spark, tmp_path):
    lines = [{"query_id": "q", "job_id": "b", "label": 1, "exposure_rank": 2}, {"query_id": "p", "job_id": "c", "label": 0, "exposure_rank": 1}, {"query_id": "q", "job_id": "a", "label": 0, "exposure_rank": 1}]
    (tmp_path / "part-0.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n\n")
    schema = spark.createDataFrame([], PAIRS).schema
    assert readers.read_jsonl(spark, str(tmp_path), schema).count() == 3
    groups = {r.query_id: [x.job_id for x in r.rows] for r in readers.read_groups(spark, str(tmp_path), schema, group="query_id", order="exposure_rank").collect()}
    assert groups == {"q": ["a", "b"], "p": ["c"]}
    (tmp_path / "part-1.jsonl").write_text('{"query_id": "r"}\n{broken\n')
    good, broken = readers.read_jsonl_checked(spark, str(tmp_path), schema)
    assert good.count() == 4 and [r.line for r in broken.collect()] == ["{broken"]
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_jsonl(spark, str(tmp_path), schema).collect()


def test_quarantine_loses_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (-1, None)], "n int, t string")
    good, bad = readers.accepted_and_quarantined(df, {"positive": F.col("n") > 0, "text": F.col("t").isNotNull()})
    assert [r.n for r in good.collect()] == [1]
    assert {r.n: r.reasons for r in bad.collect()} == {2: ["text"], -1: ["positive", "text"]}


def test_immutable_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "n int, t string")
    path = str(tmp_path / "parts")
    first = sinks.write_immutable(df, path, rows_per_file=1)
    assert sinks.write_immutable(df.repartition(3), path) == first and first["records"] == 3
    with pytest.raises(sinks.Different):
        sinks.write_immutable(df.limit(1), path)
    assert sinks.manifest({"a": first}, run="x") == sinks.manifest({"a": first}, run="x")
    assert sinks.manifest({"a": first}, run="y")["manifest_hash"] != sinks.manifest({"a": first}, run="x")["manifest_hash"]


def test_csv_and_graph_files(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "a,b"), ("ok", 'q"')], "x string, y string")
    sinks.write_csv(df, str(tmp_path / "c"), safe=True)
    assert {tuple(r) for r in readers.read_csv(spark, str(tmp_path / "c"), df.schema).collect()} == {("'=1+1", "a,b"), ("ok", 'q"')}
    nodes = spark.createDataFrame([("n", "Skill", "active", "l", ["b", "a", "b"]), ("m", "Skill", "active", "k", None)], schemas.NODE)
    assert {r["aliases:String[]"] for r in sinks.graph_nodes(nodes).collect()} == {"a;b", ""}
    edges = spark.createDataFrame([("e", "n", "m", "T", None, "p")], schemas.EDGE)
    assert sinks.graph_edges(edges, ["provenance"]).first()["properties:String"] == '{"provenance":"p"}'


def test_updates(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "k int, v string, day string")
    new = spark.createDataFrame([(2, "c", "d2"), (3, "d", "d2")], "k int, v string, day string")
    assert sorted(map(tuple, sinks.upsert(old, new, "k").collect())) == [(1, "a", "d1"), (2, "c", "d2"), (3, "d", "d2")]
    assert sorted(map(tuple, sinks.update_column(old, new, "k", "v").collect())) == [(1, "a", "d1"), (2, "c", "d2")]
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(old, path, ["day"])
    sinks.overwrite_partitions(new, path, ["day"])
    assert sorted((r.k, r.day) for r in spark.read.parquet(path).collect()) == [(1, "d1"), (2, "d2"), (3, "d2")]


def test_send_tries_again(spark, tmp_path):
    folder = str(tmp_path)

    def deliver(rows: list[dict]) -> None:
        import os

        mark = f"{folder}/{rows[0]['k']}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        with open(mark, "a") as f:
            f.write(",".join(str(r["k"]) for r in rows))

    sinks.send(spark.range(5).withColumnRenamed("id", "k").coalesce(1), deliver, batch=2)
    assert (tmp_path / "0").read_text() == "0,1" and (tmp_path / "4").read_text() == "4"


@pytest.fixture
def logs(spark, tmp_path):
    t = dt.datetime(2026, 4, 6, tzinfo=dt.UTC)
    shown = [(i, f"u{i % 3}", t + dt.timedelta(minutes=20 * i)) for i in range(30)]
    done = [(i, f"u{i % 3}", t + dt.timedelta(minutes=13 * i), "view" if i % 2 else "apply") for i in range(45)]
    s = spark.createDataFrame(shown, "exposure long, user string, start timestamp")
    e = spark.createDataFrame(done + done[:4], "event_id long, user string, at timestamp, kind string")
    s.write.parquet(str(tmp_path / "s"))
    e.write.parquet(str(tmp_path / "e"))
    return s, e, tmp_path


def test_streamed_interval_join_equals_batch(spark, logs):
    s, e, tmp = logs
    stream = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp / name))
    out = jobs.interval_matches(stream("s", s), stream("e", e).dropDuplicates(["event_id", "at"]), keys=["user"], start="start", at="at", lateness="100 days")
    jobs.run_to_table(out.select("exposure", "event_id"), str(tmp / "o"), str(tmp / "c"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp / "o")).collect()))
    batch = s.join(e.distinct(), "user").filter("at between start and start + interval 30 minutes").select("exposure", "event_id")
    assert got == sorted(map(tuple, batch.collect())) and got


def test_streamed_counts_equal_batch(spark, logs):
    _, e, tmp = logs
    out = jobs.running_counts(spark.readStream.schema(e.schema).parquet(str(tmp / "e")), item="user", kind="kind", kinds={"view": "views", "apply": "applies"}, at="at", lateness="100 days")
    jobs.run_to_table(out, str(tmp / "o"), str(tmp / "c"), mode="complete")
    batch = e.distinct().groupBy("user").agg(F.count_if(F.col("kind") == "view").alias("views"), F.count_if(F.col("kind") == "apply").alias("applies"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp / "o")).collect())) == sorted(map(tuple, batch.collect()))
