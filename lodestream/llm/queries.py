"""Queries of the corpus and signal problems over the project's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.scalars import micros, whole_number
from lodestream.llm.cooccur import pair_supports
from lodestream.llm.leak import leaked_items
from lodestream.llm.mix import mix_sources, share_report
from lodestream.llm.nearest import nearest_in_time
from lodestream.llm.quality import document_statistics, outlier_scores
from lodestream.llm.resolve import closest_entries, unmatched
from lodestream.llm.sample import kept_registry, stable_sample
from lodestream.session import cut_lineage, load

MINUTE = 60_000_000
SEED = "posting-sample-1"


def _surfaces(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "resolution").filter("decision = 'UNKNOWN_SURFACE'").select("surface_id", F.coalesce("normalized_surface", "surface").alias("text"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Each unresolved surface with the entry it means, or - if it means none."""
    surfaces = _surfaces(spark, base)
    matched = cut_lineage(closest_entries(surfaces, load(spark, base, "skill_node"), text="text", node_id="node_id", label="label", aliases="aliases"), "entries")
    found = surfaces.join(matched, "text").select("surface_id", "node_id")
    return found.unionByName(unmatched(surfaces, matched, text="text").select("surface_id", F.lit("-").alias("node_id"))).distinct()


def _pairs(spark: SparkSession, base: str, min_support: int) -> DataFrame:
    return pair_supports(load(spark, base, "skill_basket"), basket="job_id", owner="company_id", items="skills", min_support=min_support)


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Skill pairs that clearly exceed chance."""
    return _pairs(spark, base, 20).filter("support_jobs >= 20 and support_companies >= 5 and lift >= 2 and npmi >= 0.15").select("source_id", "target_id")


def p4_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Every pair of skills that occurs, with its supports and scores."""
    return _pairs(spark, base, 1)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Views and applications with the nearest search of the same user that listed the posting."""
    somebody = "talent is not null and talent <> '0' and talent not like '-%' and posting is not null"

    def actions(name: str, posting: str, time: str, record: str) -> DataFrame:
        rows = load(spark, base, name)
        return rows.select(whole_number(F.col("talentNo")).alias("talent"), whole_number(F.col(posting)).alias("posting"), micros(F.col(time)).alias("at"), F.lit(name).alias("table_name"), F.col(record).alias("record_id"))

    left = actions("job_view", "employeeNo", "dateIn", "view_id").unionByName(actions("job_apply", "empNo", "datein", "apply_id")).filter(somebody)
    searches = load(spark, base, "user_search_log").select(whole_number(F.col("talentNo")).alias("talent"), micros(F.col("search_time")).alias("at"), F.col("search_id").alias("id"), "empStr")
    searches = searches.filter("talent is not null and talent <> '0' and talent not like '-%'")
    right = searches.select("talent", F.explode(F.split("empStr", "[,，;；、|]")).alias("posting"), "at", "id").withColumn("posting", whole_number(F.col("posting"))).filter(somebody)
    near = nearest_in_time(left, right, keys=["talent", "posting"], tolerance=30 * MINUTE)
    return near.select("table_name", "record_id", F.col("id").alias("search_id")).distinct()


def p7_sample(spark: SparkSession, base: str) -> DataFrame:
    """All rows of the sampled postings, with the week they were first seen in and its rate.

    Both are kept in the shared folder, for each folder of tables; the SQL is what the first run gives.
    """
    postings = load(spark, base, "job_posting").select("posting_row_id", "`職缺編號`", "loaded_at")
    number = whole_number(F.col("`職缺編號`"))
    week = F.date_trunc("week", "loaded_at").cast("date").cast("string")
    registry = kept_registry(f"{SEED} {base.rstrip('/')}", postings, identifier=number, epoch=week, target_per_epoch=100, floor=0.01)
    chosen = stable_sample(postings, registry, identifier=number, seed=SEED)
    return chosen.select("posting_row_id", F.col("id").alias("job_no"), "epoch", F.round("rate", 9).alias("rate"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that contain passages of test items, with the items."""
    items = load(spark, base, "eval_item").withColumn("least", F.when(F.lower("lang").startswith("en"), 100).otherwise(50))
    return leaked_items(load(spark, base, "documents"), items, doc_id="doc_id", text="text", item_id="item_id", item_text="text", least=F.col("least"))


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mix_sources(load(spark, base, "documents"), load(spark, base, "mix_target"), doc_id="doc_id", text="text", source="source")


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    """The shares of total tokens that the mixture's sources actually reach."""
    return share_report(p9_mix(spark, base), load(spark, base, "mix_target"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents whose text as a whole is no running prose."""
    scores = outlier_scores(load(spark, base, "documents"), load(spark, base, "common_word"), load(spark, base, "doc_label"), doc_id="doc_id", text="text", label="label")
    return scores.filter("score > 0").select("doc_id").distinct()


def p10_statistics(spark: SparkSession, base: str) -> DataFrame:
    """The figures on each document's text."""
    return document_statistics(load(spark, base, "documents"), load(spark, base, "common_word"), doc_id="doc_id", text="text")


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p4_found, p4_pairs, p5_found, p7_sample, p8_found, p9_mix, p9_shares, p10_found, p10_statistics)}


def _number(column: str) -> str:
    narrow = f"trim(translate({column}, '０１２３４５６７８９．　', '0123456789. '))"
    return f"cast(try_cast(case when regexp_full_match({narrow}, '-?[0-9]+([.]0*)?') then regexp_replace({narrow}, '[.]0*$', '') end as hugeint) as varchar)"


BASKETS = """with rows as (select job_id, company_id, list_distinct(list_filter(coalesce(skills, []), lambda x: trim(x) <> '')) as skills from skill_basket where job_id is not null),
incidence as (select distinct job_id, unnest(skills) as skill from rows),
owners as (select distinct job_id, company_id from rows where company_id is not null),
total as (select count(distinct job_id) as n from rows),
single as (select skill, count(*) as n from incidence group by skill),
pairs as (
    select a.skill as x, b.skill as y, count(distinct a.job_id) as jobs, count(distinct o.company_id) as companies
    from incidence a join incidence b on a.job_id = b.job_id and a.skill < b.skill left join owners o on o.job_id = a.job_id group by all
),
scored as (
    select x as source_id, y as target_id, jobs as support_jobs, companies as support_companies,
        round(t.n * jobs / (sx.n * sy.n::double), 6) as lift,
        round(case when jobs = t.n then 1.0 else ln(t.n * jobs / (sx.n * sy.n::double)) / -ln(jobs / t.n::double) end, 6) as npmi
    from pairs join single sx on sx.skill = x join single sy on sy.skill = y cross join total t
)
"""


def oracle_sql() -> dict[str, str]:
    named = f"""searches as (
    select distinct search_id, talent, search_time, {_number("named")} as posting from (
        select search_id, {_number('"talentNo"')} as talent, search_time, unnest(regexp_split_to_array("empStr", '[,，;；、|]')) as named from user_search_log)
),
actions as (
    select 'job_view' as table_name, view_id as record_id, {_number('"talentNo"')} as talent, {_number('"employeeNo"')} as posting, "dateIn" as moment from job_view
    union select 'job_apply', apply_id, {_number('"talentNo"')}, {_number('"empNo"')}, datein from job_apply
),
near as (
    select table_name, record_id, search_id, row_number() over (partition by table_name, record_id order by abs(epoch_us(moment) - epoch_us(search_time)), search_id) as n
    from actions a join searches s on a.talent = s.talent and a.posting = s.posting and abs(epoch_us(moment) - epoch_us(search_time)) <= 1800000000
    where try_cast(a.talent as hugeint) > 0
)"""
    sample = f"""with rows as (select posting_row_id, {_number('"職缺編號"')} as job_no, cast(cast(date_trunc('week', loaded_at) as date) as varchar) as epoch from job_posting),
seen as (select job_no, min(epoch) as epoch from rows where job_no is not null group by job_no),
sizes as (select epoch, count(*) as n from seen group by epoch),
rates as (
    select epoch, case when count(*) over w = 0 then 1.0::double else least(greatest(100.0::double * count(*) over w / sum(n) over w, 0.01::double), 1.0::double) end as rate
    from sizes window w as (order by epoch rows between unbounded preceding and 1 preceding)
)
select posting_row_id, job_no, s.epoch, round(rate, 9) as rate from rows join seen s using (job_no) join rates r on r.epoch = s.epoch
where cast(concat('0x', substr(sha256(concat('{SEED}', ':', s.epoch, ':', job_no)), 1, 13)) as bigint) / 4503599627370496.0::double < rate"""
    return {
        "p4_found": BASKETS + "select source_id, target_id from scored where support_jobs >= 20 and support_companies >= 5 and lift >= 2 and npmi >= 0.15",
        "p4_pairs": BASKETS + "select * from scored",
        "p5_found": f"with {named} select table_name, record_id, search_id from near where n = 1",
        "p7_sample": sample,
    }
