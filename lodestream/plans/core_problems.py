"""Queries of the general problems over the project's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.scalars import local_timestamp, micros, whole_number
from lodestream.operators.asof import attributes_as_of, current_state_versions
from lodestream.operators.orphans import DAY, orphan_references
from lodestream.operators.packed import known_values, split_packed
from lodestream.session import load

FIELDS = ("電腦技能資料", "工作技能", "專業證照")


def posting_states(postings: DataFrame) -> dict:
    """How job_posting's columns name the states of a posting."""
    return {
        "effective": local_timestamp(F.col("`職缺最後修改時間`")),
        "available": F.col("loaded_at"),
        "tie": F.col("posting_row_id"),
        "payload": {"posting_row_id": F.col("posting_row_id"), "row_status": F.col("row_status")},
    }


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Applications whose posting has an open state in force, with that state's row."""
    postings = load(spark, base, "job_posting")
    known = attributes_as_of(
        load(spark, base, "job_apply"),
        postings,
        event_key=whole_number(F.col("empNo")),
        event_time=F.col("datein"),
        event_columns=["apply_id"],
        state_key=whole_number(F.col("`職缺編號`")),
        **posting_states(postings),
    )
    return known.filter("row_status = 'open'").select("apply_id", "posting_row_id").distinct()


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Every value in the three packed fields of every posting row."""
    known = known_values(load(spark, base, "skill_node"), "label", "aliases")
    return split_packed(load(spark, base, "job_posting"), FIELDS, known, row_id="posting_row_id")


def posting_references(spark: SparkSession, base: str) -> DataFrame:
    """Every posting number that a log record names: (key, at, table_name, record_id)."""
    searches = load(spark, base, "user_search_log").select(
        F.explode(F.split("empStr", "[,，;；、|]")).alias("named"), F.col("search_time").alias("time"), F.lit("user_search_log").alias("table_name"), F.col("search_id").alias("record_id")
    )
    views = load(spark, base, "job_view").select(F.col("employeeNo").alias("named"), F.col("dateIn").alias("time"), F.lit("job_view").alias("table_name"), F.col("view_id").alias("record_id"))
    applies = load(spark, base, "job_apply").select(F.col("empNo").alias("named"), F.col("datein").alias("time"), F.lit("job_apply").alias("table_name"), F.col("apply_id").alias("record_id"))
    return searches.unionByName(views).unionByName(applies).select(whole_number(F.col("named")).alias("key"), micros(F.col("time")).alias("at"), "table_name", "record_id")


def _orphans(spark: SparkSession, base: str) -> DataFrame:
    postings = load(spark, base, "job_posting")
    versions = current_state_versions(postings, key=whole_number(F.col("`職缺編號`")), **posting_states(postings))
    return orphan_references(posting_references(spark, base), versions, exists="coalesce(state.row_status, '') <> 'removed'").distinct()


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Log records and posting numbers they name for which no posting exists at that moment."""
    return _orphans(spark, base).select("table_name", "record_id", F.col("key").alias("job_no"))


def p6_orphans_per_day(spark: SparkSession, base: str) -> DataFrame:
    """Orphan references counted per table and day."""
    day = F.date_from_unix_date(F.floor(F.col("at") / DAY).cast("int"))
    counted = _orphans(spark, base).groupBy("table_name", day.cast("string").alias("day"))
    return counted.agg(F.count(F.lit(1)).alias("orphan_references"), F.countDistinct("key").alias("orphan_keys"))


def p1_states(spark: SparkSession, base: str) -> DataFrame:
    """Every application with its posting's state, if any, whatever its status."""
    postings = load(spark, base, "job_posting")
    states = posting_states(postings)
    states["payload"] = states["payload"] | {"title": F.col("`職務名稱`"), "city": F.col("`工作城市`")}
    known = attributes_as_of(
        load(spark, base, "job_apply").select("apply_id", "empNo", "datein").distinct(),
        postings,
        event_key=whole_number(F.col("empNo")),
        event_time=F.col("datein"),
        event_columns=["apply_id"],
        state_key=whole_number(F.col("`職缺編號`")),
        **states,
    )
    return known.groupBy("apply_id").agg(F.max(F.struct("posting_row_id", "row_status", "title", "city")).alias("s")).select("apply_id", "s.*")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_states, p2_found, p6_found, p6_orphans_per_day)}


def number_sql(column: str) -> str:
    narrow = f"translate({column}, '０１２３４５６７８９．　', '0123456789. ')"
    return f"cast(try_cast(case when regexp_full_match(trim({narrow}), '-?[0-9]+([.]0*)?') then regexp_replace(trim({narrow}), '[.]0*$', '') end as hugeint) as varchar)"


def time_sql(column: str) -> str:
    """The same notations, read by patterns."""
    at = lambda shape: f"try_strptime({column}, '{shape}')"
    local = f"case when regexp_matches({column}, '^[0-9]{{2,3}}/') then concat(cast(cast(split_part({column}, '/', 1) as int) + 1911 as varchar), substr({column}, strpos({column}, '/'))) else {column} end"
    half = f"replace(replace({column}, '上午', 'AM'), '下午', 'PM')"
    shapes = ", ".join(at(x) for x in ("%Y-%m-%d %H:%M:%S.%g", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y%m%d%H%M%S"))
    return f"coalesce({shapes}, try_strptime({local}, '%Y/%m/%d %H:%M:%S'), try_strptime({half}, '%Y/%m/%d %p %I:%M:%S'))"


STATES = f"""
states as (
    select {number_sql('"職缺編號"')} as key, posting_row_id, row_status, "職務名稱" as title, "工作城市" as city, {time_sql('"職缺最後修改時間"')} as changed, loaded_at
    from job_posting
)"""
IN_FORCE = """select {keep}, s.posting_row_id, s.row_status, s.title, s.city,
        row_number() over (partition by {keep} order by s.changed desc nulls last, s.posting_row_id) as n
    from {of} e left join states s on s.key = e.key and s.changed <= e.moment and s.loaded_at <= e.moment"""

REFERENCES = f"""
named as (
    select 'user_search_log' as table_name, search_id as record_id, search_time as moment, unnest(regexp_split_to_array("empStr", '[,，;；、|]')) as text from user_search_log
    union all select 'job_view', view_id, "dateIn", "employeeNo" from job_view
    union all select 'job_apply', apply_id, datein, "empNo" from job_apply
),
refs as (select distinct table_name, record_id, moment, {number_sql("text")} as key from named where {number_sql("text")} is not null)"""

ORPHANS = f"""with {STATES}, {REFERENCES},
ranked as ({IN_FORCE.format(keep="e.table_name, e.record_id, e.moment, e.key", of="refs")}),
orphans as (select table_name, record_id, moment, key from ranked where n = 1 and (posting_row_id is null or row_status = 'removed'))
"""


def oracle_sql() -> dict[str, str]:
    applied = f"""with {STATES}, asked as (select distinct apply_id, datein as moment, {number_sql('"empNo"')} as key from job_apply),
ranked as ({IN_FORCE.format(keep="e.apply_id", of="asked")})
"""
    return {
        "p1_found": applied + "select apply_id, posting_row_id from ranked where n = 1 and row_status = 'open'",
        "p1_states": applied + "select apply_id, posting_row_id, row_status, title, city from ranked where n = 1",
        "p6_found": ORPHANS + "select distinct table_name, record_id, key as job_no from orphans",
        "p6_orphans_per_day": ORPHANS + "select table_name, cast(cast(moment as date) as varchar) as day, count(*) as orphan_references, count(distinct key) as orphan_keys from orphans group by all",
    }
