"""Joins, aggregations, windows and set operations over the logs, with SQL twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import fields
from lodestream.functions.scalars import micros, whole_number
from lodestream.operators import aggs, joins, windows
from lodestream.plans.core_problems import number_sql
from lodestream.plans.registry import Registry
from lodestream.session import load

registry = Registry()
queries, oracle_sql, query = registry.queries, registry.oracle_sql, registry.query
CUTOFF = dt.datetime(2026, 4, 12, 23, 59, 59)
HALF_HOUR = 1_800_000_000

EVENTS = f"""events as (
    select distinct 'job_view' as kind, view_id as event_id, {number_sql('"talentNo"')} as talent, {number_sql('"employeeNo"')} as posting, "dateIn" as moment, 1 as grade from job_view
    union all select distinct 'job_apply', apply_id, {number_sql('"talentNo"')}, {number_sql('"empNo"')}, datein, 2 from job_apply
)"""
EXPOSURES = f"""named as (
    select distinct on (search_id) search_id, {number_sql('"talentNo"')} as talent, ks, c0, d0, search_time, "empStr" from user_search_log order by search_id, loaded_at
),
listed as (
    select search_id, talent, ks, c0, d0, search_time, unnest(l) as entry, generate_subscripts(l, 1) as place from (select *, regexp_split_to_array("empStr", '[,，;；]') as l from named)
),
exposures as (select search_id, talent, coalesce(ks, '') as ks, coalesce(c0, '') as c0, coalesce(d0, '') as d0, search_time, place, {number_sql("entry")} as posting from listed where {number_sql("entry")} is not null)"""
GRADED = """graded as (
    select x.search_id, x.place, x.posting, x.talent, x.ks, x.c0, x.d0, x.search_time, coalesce(max(e.grade), 0) as grade
    from exposures x left join events e on e.talent = x.talent and e.posting = x.posting and epoch_us(e.moment) - epoch_us(x.search_time) between 0 and 1800000000
    where try_cast(x.talent as hugeint) > 0 group by all
)"""
WITH_GRADED = f"with {EVENTS}, {EXPOSURES}, {GRADED}"


def event_log(spark: SparkSession, base: str) -> DataFrame:
    """Views and applications as one log; a redelivered record once (SET-1)."""

    def one(name: str, record: str, posting: str, time: str, grade: int) -> DataFrame:
        rows = load(spark, base, name)
        columns = (F.lit(name).alias("kind"), F.col(record).alias("event_id"), whole_number(F.col("talentNo")).alias("talent"), whole_number(F.col(posting)).alias("posting"), F.col(time).alias("moment"), F.lit(grade).alias("grade"))
        return rows.select(*columns)

    return one("job_view", "view_id", "employeeNo", "dateIn", 1).unionByName(one("job_apply", "apply_id", "empNo", "datein", 2)).distinct()


def exposures(spark: SparkSession, base: str) -> DataFrame:
    """Every posting that a search listed, with its place; the first delivery of a search counts."""
    columns = ("talentNo", "ks", "c0", "d0", "search_time", "empStr")
    first = load(spark, base, "user_search_log").groupBy("search_id").agg(F.min(F.struct("loaded_at", *columns)).alias("s")).select("search_id", "s.*")
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("ks", "c0", "d0")]
    listed = first.select("search_id", whole_number(F.col("talentNo")).alias("talent"), *filled, "search_time", F.posexplode(F.split("empStr", "[,，;；]")).alias("place", "entry"))
    return listed.select("search_id", "talent", "ks", "c0", "d0", "search_time", (F.col("place") + 1).alias("place"), whole_number(F.col("entry")).alias("posting")).filter("posting is not null")


def graded(spark: SparkSession, base: str) -> DataFrame:
    """Exposures to known users with the best reaction within half an hour."""
    shown = exposures(spark, base).filter("talent <> '0' and talent not like '-%'").withColumn("start", micros(F.col("search_time"))).withColumn("exposure", F.struct("search_id", "place"))
    events = event_log(spark, base).withColumn("at", micros(F.col("moment")))
    return joins.interval_grades(shown, events, keys=["talent", "posting"], start="start", at="at", grade="grade", window=HALF_HOUR).drop("exposure", "start")


@query(f"{WITH_GRADED} select search_id, place, posting, grade from graded")
def interval_grades(spark: SparkSession, base: str) -> DataFrame:
    return graded(spark, base).select("search_id", "place", "posting", "grade")


@query(f"with {EVENTS} select posting, count(*) filter (kind = 'job_view') as views, count(*) filter (kind = 'job_apply') as applies from events where posting is not null and moment <= '2026-04-12 23:59:59' group by posting")
def activity_counts(spark: SparkSession, base: str) -> DataFrame:
    """Views and applications per posting up to a cutoff."""
    return aggs.activity_counts(event_log(spark, base), item="posting", kind="kind", kinds={"job_view": "views", "job_apply": "applies"}, cutoff=CUTOFF, time="moment")


@query(f"with {EVENTS} select count(distinct posting) as postings, count(*) filter (kind = 'job_view') as views, count(*) filter (kind = 'job_apply') as applies, count(*) filter (posting is null) as skipped from events")
def activity_totals(spark: SparkSession, base: str) -> DataFrame:
    kinds = (F.count_if(F.col("kind") == "job_view").alias("views"), F.count_if(F.col("kind") == "job_apply").alias("applies"))
    return event_log(spark, base).agg(F.countDistinct("posting").alias("postings"), *kinds, F.count_if(F.col("posting").isNull()).alias("skipped"))


SMOOTHED = f"""with {EVENTS},
g as (select posting, count(*) as n, sum(case when grade = 2 then 1 else 0 end) as positives, sum(grade) as grade_sum, count(*) filter (grade = 1) as views from events where posting is not null group by posting),
t as (select sum(n) as n, sum(positives) as positives from g),
s as (select posting, g.n as events, cast(g.positives as bigint) as applies, round((g.positives + 5.0::double * t.positives / t.n) / (g.n + 5.0::double), 6) as rate, round(least(2.5::double, 0.65::double * ln(1 + g.positives) + 0.12::double * ln(1 + g.views)), 4) as prior from g, t)
select posting, events, applies, rate, prior, row_number() over (order by rate desc, posting) as rank from s qualify rank <= 20"""


@query(SMOOTHED)
def smoothed_engagement(spark: SparkSession, base: str) -> DataFrame:
    """The postings with the best smoothed rate of applications, and their activity prior."""
    from lodestream.operators.scoring import smoothed_rate

    per = event_log(spark, base).filter("posting is not null").groupBy("posting").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("grade") == 2).alias("applies"), F.count_if(F.col("grade") == 1).alias("views"))
    total = per.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("n"), F.coalesce(F.sum("applies"), F.lit(0)).alias("p")).first()
    rate = F.round(smoothed_rate(F.col("applies"), F.col("events"), total.p / max(1, total.n), 5.0), 6)
    rows = per.select("posting", "events", "applies", rate.alias("rate"), F.round(fields.activity_prior(F.col("applies"), F.col("views")), 4).alias("prior"))
    return windows.top_k(rows, 20, "rate", "posting")


@query(f"""with {EVENTS}, {EXPOSURES}, sampled as (select distinct talent from exposures where cast(concat('0x', substr(sha256(concat('1111:', talent)), 1, 12)) as bigint) % 10000 < 1000)
select kind, count(*) as events, count(distinct talent) as talents from events where talent in (select talent from sampled) and posting in (select posting from exposures) group by kind""")
def restricted_events(spark: SparkSession, base: str) -> DataFrame:
    """Events of sampled users on postings that some search listed."""
    shown = exposures(spark, base)
    users = windows.bucket_sample(shown.select("talent").distinct(), F.col("talent"), 0, 1000)
    kept = joins.restricted(event_log(spark, base), (users, "talent"), (shown, "posting"))
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("talent").alias("talents"))


@query(f"{WITH_GRADED}, good as (select search_id from graded group by search_id having count(*) >= 2 and max(grade) > 0) select search_id, place, posting, grade from graded where search_id in (select search_id from good)")
def judged_searches(spark: SparkSession, base: str) -> DataFrame:
    """Searches with at least two results and one reaction."""
    return joins.judged_groups(graded(spark, base), group=["search_id"], grade="grade").select("search_id", "place", "posting", "grade")


@query(f"{WITH_GRADED}, cases as (select cast(cast(search_time as date) as varchar) as day, ks, c0, d0, posting, max(grade) as grade from graded group by all) select day, ks, c0, d0, count(*) as candidates, cast(sum(grade) as bigint) as grade_sum, max(grade) as best from cases group by all")
def label_cases(spark: SparkSession, base: str) -> DataFrame:
    """Candidates and grades per day, query and codes."""
    case = ["day", "ks", "c0", "d0"]
    rows = graded(spark, base).withColumn("day", F.to_date("search_time").cast("string"))
    return rows.groupBy(*case, "posting").agg(F.max("grade").alias("grade")).groupBy(*case).agg(F.count(F.lit(1)).alias("candidates"), F.sum("grade").alias("grade_sum"), F.max("grade").alias("best"))


@query(f"""{WITH_GRADED}, u as (select *, case when grade > 0 then 1 else 0 end as pos from graded)
select 'query_posting' as grain, concat_ws(chr(31), ks, posting) as key, count(*) as n, cast(sum(pos) as bigint) as positives, cast(sum(grade) as bigint) as grade_sum from u group by all
union all select 'posting', posting, count(*), cast(sum(pos) as bigint), cast(sum(grade) as bigint) from u group by all
union all select 'query', ks, count(*), cast(sum(pos) as bigint), cast(sum(grade) as bigint) from u group by all
union all select 'all', '', count(*), cast(sum(pos) as bigint), cast(sum(grade) as bigint) from u""")
def grain_triples(spark: SparkSession, base: str) -> DataFrame:
    """Exposures, positives and grades at four grains."""
    rows = graded(spark, base).select("ks", "posting", F.lit(1).alias("one"), (F.col("grade") > 0).cast("int").alias("pos"), "grade")
    return aggs.grain_triples(rows, grains={"query_posting": ["ks", "posting"], "posting": ["posting"], "query": ["ks"], "all": []}, n="one", positive="pos", grade="grade")


@query(f"""{WITH_GRADED}, daily as (select posting, cast(cast(search_time as date) as varchar) as day, count(*) as n, sum(grade) as grade_sum from graded group by all)
select posting, day, cast(coalesce(sum(n) over w, 0) as bigint) as n, cast(coalesce(sum(grade_sum) over w, 0) as bigint) as grade_sum from daily window w as (partition by posting order by day rows between unbounded preceding and 1 preceding)""")
def rolling_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """What was known of each posting before each day."""
    daily = graded(spark, base).groupBy("posting", F.to_date("search_time").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("grade").alias("grade_sum"))
    return joins.strictly_earlier(daily, keys=["posting"], day="day", sums=["n", "grade_sum"])


@query(f"""select posting, title from (select {number_sql('"empNo"')} as posting, "empName" as title, row_number() over (partition by {number_sql('"empNo"')} order by datein desc, apply_id, "empName" desc nulls last) as n from job_apply where datein <= '2026-04-12 23:59:59') where n = 1 and posting is not null""")
def latest_titles(spark: SparkSession, base: str) -> DataFrame:
    """The title of each posting at its latest application up to a cutoff."""
    rows = load(spark, base, "job_apply").select(whole_number(F.col("empNo")).alias("posting"), F.col("empName").alias("title"), F.col("datein").alias("moment"), "apply_id")
    return joins.latest_before(rows, key="posting", time="moment", value="title", cutoff=F.lit(CUTOFF), tie="apply_id").select("posting", "title")


BUCKET = "cast(concat('0x', substr(sha256(concat('1111:', cast({} as varchar))), 1, 12)) as bigint) % 10000"


@query(f"select distinct search_id, {BUCKET.format('search_id')} as bucket from user_search_log where {BUCKET.format('search_id')} between 2400 and 3399")
def bucket_sample(spark: SparkSession, base: str) -> DataFrame:
    """Searches whose hash bucket lies in a range."""
    ids = load(spark, base, "user_search_log").select("search_id").distinct()
    key = F.col("search_id").cast("string")
    return windows.bucket_sample(ids, key, 2400, 3400).withColumn("bucket", windows.stable_bucket(key))


@query("select search_id, day from (select search_id, cast(cast(search_time as date) as varchar) as day, row_number() over (partition by cast(search_time as date) order by sha256(concat('s:', cast(search_id as varchar))), cast(search_id as varchar)) as n from (select distinct search_id, search_time from user_search_log)) where n <= 10")
def bottom_k_per_day(spark: SparkSession, base: str) -> DataFrame:
    """Ten searches of each day by least hash."""
    rows = load(spark, base, "user_search_log").select("search_id", "search_time").distinct().select("search_id", F.to_date("search_time").cast("string").alias("day"))
    return windows.bottom_k(rows, 10, within=["day"], value=F.col("search_id").cast("string"), seed="s")


@query("select doc_id, label from (select doc_id, label, row_number() over (partition by label order by sha256(concat('r:', label, ':', cast(doc_id as varchar))), concat(label, ':', cast(doc_id as varchar))) as n from doc_label) where n <= 5")
def stratified_bottom_k(spark: SparkSession, base: str) -> DataFrame:
    """Five documents of each label by least hash."""
    return windows.bottom_k(load(spark, base, "doc_label"), 5, within=["label"], value=F.concat_ws(":", "label", F.col("doc_id").cast("string")), seed="r")


@query("select ks, n, rank, share from (select ks, count(*) as n, row_number() over (order by count(*) desc, ks nulls first) as rank, round(count(*) / (select count(*) from user_search_log)::double, 6) as share from user_search_log group by ks having count(*) >= 2) where rank <= 50")
def query_head(spark: SparkSession, base: str) -> DataFrame:
    """The fifty most frequent search texts and their share."""
    return aggs.frequency_head(load(spark, base, "user_search_log"), "ks", least=2, most=50)


@query(f"with {EXPOSURES} select search_id, posting, place as exposure_rank, round(1.0::double / place, 6) as reciprocal, round(ln(1.0::double + place), 6) as log_rank, cast(place <= 1 as int) as within_1, cast(place <= 3 as int) as within_3, cast(place <= 10 as int) as within_10 from exposures")
def exposure_features(spark: SparkSession, base: str) -> DataFrame:
    return exposures(spark, base).select("search_id", "posting", *windows.exposure_features(F.col("place")))


@query(f"with {EXPOSURES} select search_id, posting, min(place) as place from exposures group by all")
def first_places(spark: SparkSession, base: str) -> DataFrame:
    """The first place of each posting in a search that lists it repeatedly."""
    return exposures(spark, base).groupBy("search_id", "posting").agg(F.min("place").alias("place"))


@query("""select posting_row_id, city, minor from (select posting_row_id, "工作城市" as city, "職務小類" as minor, row_number() over (partition by "工作城市" order by loaded_at desc, posting_row_id) as a, row_number() over (partition by "職務小類" order by loaded_at desc, posting_row_id) as b from job_posting) where a <= 5 or b <= 5""")
def top_per_group_union(spark: SparkSession, base: str) -> DataFrame:
    """The latest five rows of each city and of each duty, united."""
    rows = load(spark, base, "job_posting").select("posting_row_id", F.col("`工作城市`").alias("city"), F.col("`職務小類`").alias("minor"), "loaded_at")
    return windows.top_n_per_group(rows, 5, ["city", "minor"], [F.desc("loaded_at"), F.asc("posting_row_id")]).drop("loaded_at")


@query(f"""with {EVENTS}, c as (select posting, count(*) as n from events where posting is not null group by posting), p as (select posting, n from c order by n desc, posting limit 30),
d as (select posting, n from c where posting not in (select posting from p) order by sha256(concat('v:', posting)), posting limit 20)
select posting, n, 'popular' as chosen_as from p union all select posting, n, 'diverse' from d""")
def popular_and_diverse(spark: SparkSession, base: str) -> DataFrame:
    """Fifty postings: the most active, and some at random."""
    counts = event_log(spark, base).filter("posting is not null").groupBy("posting").agg(F.count(F.lit(1)).alias("n"))
    return windows.popular_and_diverse(counts, 50, key="posting", score="n", seed="v")


@query(f"""{WITH_GRADED}, r as (select place as rank, count(*) as n, sum(case when grade > 0 then 1 else 0 end) as c from graded where place <= 20 group by place),
raw as (select g.rank, (coalesce(c, 0) + 2.0::double) / (coalesce(n, 0) + 22.0::double) as p from (select unnest(generate_series(1, 20)) as rank) g left join r using (rank)),
scaled as (select rank, least(1.0::double, greatest(0.02::double, p / (select p from raw where rank = 1))) as p from raw),
final as (select rank, min(p) over (order by rank) as p from scaled)
select rank, round(p, 6) as propensity, round(least(10.0::double, 1.0::double / greatest(p, 0.02::double)), 6) as weight from final""")
def click_propensity(spark: SparkSession, base: str) -> DataFrame:
    """How likely a place is seen, and the weight that makes up for it."""
    from lodestream.operators.evaluation import inverse_weight, rank_propensity

    seen = graded(spark, base).select(F.col("place").alias("rank"), (F.col("grade") > 0).cast("int").alias("clicked"))
    p = rank_propensity(seen, rank="rank", clicked="clicked", max_rank=20)
    return p.select("rank", F.round("propensity", 6).alias("propensity"), F.round(inverse_weight(F.col("propensity")), 6).alias("weight"))


@query(f"with {EVENTS}, c as (select posting, count(*) as n from events group by posting) select k.posting, coalesce(c.n, 0) as n from (select distinct {number_sql(chr(34) + '職缺編號' + chr(34))} as posting from job_posting) k left join c on c.posting = k.posting")
def counts_with_defaults(spark: SparkSession, base: str) -> DataFrame:
    """Events of every posting, 0 where there are none."""
    keys = load(spark, base, "job_posting").select(whole_number(F.col("`職缺編號`")).alias("posting")).distinct()
    counts = event_log(spark, base).groupBy("posting").agg(F.count(F.lit(1)).alias("n"))
    return joins.with_defaults(keys, counts, ["posting"], {"n": 0})


DUTIES = """select search_id, array_to_string(list_sort(list_distinct(list_filter(flatten(list(names)), lambda x: x is not null))), '|') as names from (
select s.search_id, case when d.CodeNo is null then [] else list_filter([d.CodeNameA, d.CodeNameB, d.CodeNameC], lambda x: x is not null and x <> '') end as names
from (select search_id, unnest(case when coalesce(d0, '') = '' then [''] else regexp_split_to_array(d0, ',') end) as code from (select distinct search_id, d0 from user_search_log)) s left join duty_code d on d.CodeNo = s.code) group by search_id"""


@query(DUTIES)
def duty_names(spark: SparkSession, base: str) -> DataFrame:
    """The names that the duty codes of a search stand for."""
    rows = load(spark, base, "user_search_log").select("search_id", F.split(F.coalesce("d0", F.lit("")), ",").alias("codes")).distinct()
    table = load(spark, base, "duty_code")
    named = joins.names_of_codes(rows, "codes", row=["search_id"], table=table, code="CodeNo", names=["CodeNameA", "CodeNameB", "CodeNameC"])
    return named.withColumn("names", F.array_join("names", "|"))


@query("""with q(query_id, words) as (values (1, '護理'), (2, '工程師'), (3, '司機')) select query_id, posting_row_id, 10.0::double * cast(contains("職務名稱", words) as int) + 2.0::double * cast(contains(coalesce("職務內容", ''), words) as int) as score from job_posting, q where "職務名稱" is not null and (contains("職務名稱", words) or contains(coalesce("職務內容", ''), words))""")
def scored_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Every posting row against a stated set of queries."""
    rows = load(spark, base, "job_posting").select("posting_row_id", F.col("`職務名稱`").alias("title"), F.coalesce(F.col("`職務內容`"), F.lit("")).alias("body")).filter("title is not null")
    asked = spark.createDataFrame([(1, "護理"), (2, "工程師"), (3, "司機")], "query_id int, words string")
    score = 10.0 * F.col("title").contains(F.col("words")).cast("int") + 2.0 * F.col("body").contains(F.col("words")).cast("int")
    return joins.score_against_queries(rows, asked, score).select("query_id", "posting_row_id", "score")


STATE_ORDER = """first as (select * from (select *, row_number() over (partition by key order by loaded_at, posting_row_id) as n from (select *, NUMBER as key from job_posting) where key is not null) where n = 1),
last as (select * from (select *, row_number() over (partition by key order by loaded_at desc, posting_row_id) as n from (select *, NUMBER as key from job_posting) where key is not null) where n = 1)""".replace("NUMBER", number_sql('"職缺編號"'))


def _state(spark: SparkSession, base: str, last: bool) -> DataFrame:
    rows = load(spark, base, "job_posting").select(whole_number(F.col("`職缺編號`")).alias("key"), "posting_row_id", F.col("`職務名稱`").alias("title"), F.col("`工作城市`").alias("city"), F.col("`廠商編號`").alias("company"), "loaded_at")
    order = [F.desc("loaded_at") if last else F.asc("loaded_at"), F.asc("posting_row_id")]
    return windows.rank_within(rows.filter("key is not null"), ["key"], order, "n").filter("n = 1").drop("n", "loaded_at")


@query(f"""with {STATE_ORDER} select l.key, l."職務名稱" as title, l."工作城市" as city, case when l."職務名稱" is not distinct from f."職務名稱" and l."工作城市" is not distinct from f."工作城市" and coalesce(f."廠商編號", '') <> '' then f."廠商編號" end as company from last l join first f using (key)""")
def carried_reviews(spark: SparkSession, base: str) -> DataFrame:
    """The first state's company, where title and city are still the same in the last."""
    out = joins.carry_forward(_state(spark, base, True), _state(spark, base, False), key="key", locked=["title", "city"], review=["company"], required=["company"])
    return out.select("key", "title", "city", "company")


@query(f"""with {STATE_ORDER} select key, posting_row_id from (select f.key, coalesce(case when l.posting_row_id <> f.posting_row_id then l.posting_row_id end, f.posting_row_id) as posting_row_id from first f join last l using (key))""")
def replaced_states(spark: SparkSession, base: str) -> DataFrame:
    """First states, replaced by the last where there is another."""
    first, last = (_state(spark, base, x).select("key", "posting_row_id") for x in (False, True))
    changed = last.join(first, ["key", "posting_row_id"], "left_anti")
    return joins.replace_merge(first, changed, "key")


@query("select name, count(*) as times from (select label as name from skill_node union all select unnest(aliases) from skill_node union all select CodeNameA from duty_code) group by name having count(*) > 1")
def colliding_names(spark: SparkSession, base: str) -> DataFrame:
    """Names that occur more than once in two lists taken together."""
    nodes = load(spark, base, "skill_node")
    names = nodes.select(F.col("label").alias("name")).unionByName(nodes.select(F.explode("aliases").alias("name")))
    return joins.merge_unique(names, load(spark, base, "duty_code").select(F.col("CodeNameA").alias("name")), "name")[1]


@query("select alias, node_id from (select a as alias, min(node_id) as node_id, count(distinct node_id) as n from (select node_id, unnest(list_append(coalesce(aliases, []), label)) as a from skill_node) group by a) where n = 1")
def unambiguous_aliases(spark: SparkSession, base: str) -> DataFrame:
    """Names that exactly one node owns."""
    nodes = load(spark, base, "skill_node")
    names = nodes.select("node_id", F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("label"))).alias("alias"))
    return aggs.owned_once(names, "alias", "node_id")


@query("select normalized_surface as surface, count(distinct job_id) as records, count(distinct company_id) as owners, array_to_string(list_sort(list(distinct evidence_field)), '|') as fields from resolution where node_id is null and coalesce(normalized_surface, '') <> '' group by 1 having count(distinct job_id) >= 3 and count(distinct company_id) >= 2")
def unknown_surfaces(spark: SparkSession, base: str) -> DataFrame:
    """Unresolved surfaces that enough postings of enough companies use."""
    rows = load(spark, base, "resolution").filter("node_id is null").withColumnRenamed("surface", "typed").withColumnRenamed("normalized_surface", "surface")
    return aggs.frequent_surfaces(rows, surface="surface", record="job_id", owner="company_id", field="evidence_field").withColumn("fields", F.array_join("fields", "|"))


COVERED = ("職務名稱", "職務內容", "工作城市", "電腦技能資料", "工作技能", "專業證照", "廠商編號")


@query(" union all ".join(f"select '{c}' as field, count(*) filter (\"{c}\" is not null and trim(\"{c}\") <> '') as filled, round(count(*) filter (\"{c}\" is not null and trim(\"{c}\") <> '') / count(*)::double, 6) as share from job_posting" for c in COVERED))
def field_coverage(spark: SparkSession, base: str) -> DataFrame:
    return aggs.field_coverage(load(spark, base, "job_posting"), list(COVERED))


@query("select count(*) as records, count(*) filter (loaded_at <= '2026-04-12 23:59:59') as eligible, count(*) filter (loaded_at > '2026-04-12 23:59:59') as later, count(*) filter (loaded_at is null) as without_time from job_posting")
def corpus_inventory(spark: SparkSession, base: str) -> DataFrame:
    return aggs.inventory(load(spark, base, "job_posting"), time="loaded_at", cutoff=CUTOFF)


SUMS = ", ".join(f"cast(coalesce(sum(cast(cast(concat('0x', substr(h, {15 * i + 1}, 15)) as bigint) as hugeint)), 0) as varchar) as s{i}" for i in range(4))


@query(f"""with h as (select sha256(concat_ws(chr(31), {", ".join(f"coalesce(cast({c} as varchar), chr(0))" for c in ("doc_id", "text", "lang", "source", "n_chars", "organ_no", "job_no", "epoch_us(created_at)"))})) as h from documents),
s as (select {SUMS}, count(*) as records from h) select sha256(concat_ws(':', s0, s1, s2, s3, cast(records as varchar))) as digest, records from s""")
def content_digest(spark: SparkSession, base: str) -> DataFrame:
    """A hash of the documents' content, whatever their order."""
    columns = ["doc_id", "text", "lang", "source", "n_chars", "organ_no", "job_no", "created_at"]
    return aggs.digest(load(spark, base, "documents").withColumn("created_at", micros(F.col("created_at"))), columns)


@query("select count(value) as n, percentile_disc(0.5) within group (order by value) as p50, percentile_disc(0.95) within group (order by value) as p95, percentile_disc(0.99) within group (order by value) as p99 from events")
def value_percentiles(spark: SparkSession, base: str) -> DataFrame:
    return aggs.nearest_rank_percentiles(load(spark, base, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("select event_type, count(*) as events, round(count(*) * 1000.0, 0)::double as expected from events group by event_type")
def expected_at_scale(spark: SparkSession, base: str) -> DataFrame:
    """Counts translated to a thousand times the traffic."""
    counts = load(spark, base, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
    return aggs.scale_translation(counts, 1000, "events")


@query("select decision, status, count(*) as n, row_number() over (order by count(*) desc, decision, status) as rank from resolution group by decision, status")
def decision_histogram(spark: SparkSession, base: str) -> DataFrame:
    counts = load(spark, base, "resolution").groupBy("decision", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "decision", "status")))


@query("""select 'both' as part, count(*) as n from (select distinct c_nationkey from customer intersect select distinct s_nationkey from supplier)
union all select 'customers_only', count(*) from (select distinct c_nationkey from customer except select distinct s_nationkey from supplier)
union all select 'suppliers_only', count(*) from (select distinct s_nationkey from supplier except select distinct c_nationkey from customer)
union all select 'either', count(*) from (select c_nationkey from customer union select s_nationkey from supplier)""")
def set_operations(spark: SparkSession, base: str) -> DataFrame:
    """Sizes of the intersection, the differences and the union of two key sets."""
    from lodestream.operators.setops import set_sizes

    a, b = load(spark, base, "customer").select(F.col("c_nationkey").alias("key")), load(spark, base, "supplier").select(F.col("s_nationkey").alias("key"))
    return set_sizes(a, b, "key", names=("both", "customers_only", "suppliers_only", "either"))


@query("""with p as (select posting_row_id, "職務名稱" as title from job_posting), first as (select posting_row_id, title, 1 as pass from p where contains(title, '護理')), second as (select posting_row_id, title, 2 as pass from p where contains(title, '員'))
select * from first union all select * from second where posting_row_id not in (select posting_row_id from first)""")
def rescue_union(spark: SparkSession, base: str) -> DataFrame:
    """First-pass rows, then second-pass rows that the first pass didn't have."""
    from lodestream.operators.setops import union_first_wins

    rows = load(spark, base, "job_posting").select("posting_row_id", F.col("`職務名稱`").alias("title"))
    first, second = (rows.filter(F.col("title").contains(w)).withColumn("pass", F.lit(k)) for w, k in (("護理", 1), ("員", 2)))
    return union_first_wins(first, second, "posting_row_id")
