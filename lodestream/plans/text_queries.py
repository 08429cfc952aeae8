"""Text and field operators over the posting, search and code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import fields, text
from lodestream.functions.scalars import micros
from lodestream.plans import sqltext
from lodestream.plans.registry import Registry
from lodestream.session import load

registry = Registry()
queries, oracle_sql, query = registry.queries, registry.oracle_sql, registry.query

# What marks a search as spam or as an address.
SPAM = r"(?i)百度|霸屏|快排|谷歌技术|谷歌技術|QQ：|QQ:|www\.tgbot|老船长|圣淘沙客服|关键词.*优化|關鍵詞.*優化"
ADDRESS = r"(?i)^https?://|^www\."
REMOTE = ("遠端工作", "遠端上班", "遠端客服", "全遠端", "遠端", "在家工作", "在家上班", "在家兼職", "居家辦公", "居家工作", "wfh", "work from home", "remote work", "remote job", "remote")
HOME_CARE = ("居家照顧", "居家照服", "居家服務", "居家護理", "居家督導", "居家清潔", "居家托育")

JOIN_SPELLINGS = "replace(replace(replace(replace(replace(replace({}, 'react.js', 'reactjs'), 'react js', 'reactjs'), 'node js', 'node.js'), 'nodejs', 'node.js'), 'c sharp', 'c#'), 'cplusplus', 'c++')"
COLLAPSE = sqltext.collapsed("{}")
PAD = "regexp_replace({}, '^[\\s\u3000\u00a0]+|[\\s\u3000\u00a0]+$', '', 'g')"


def _ranked(column: str) -> str:
    return COLLAPSE.format(JOIN_SPELLINGS.format("replace(" + PAD.format(f"lower({sqltext.plain_width(column)})") + ", '臺', '台')"))


@query(f"select distinct ks, {sqltext.indexed('ks')} as indexed, {_ranked('ks')} as ranked, {sqltext.surface('ks')} as surface from user_search_log")
def normalized_queries(spark: SparkSession, base: str) -> DataFrame:
    """The normal forms of every search text."""
    ks = F.col("ks")
    forms = (text.index_normalize(ks).alias("indexed"), text.rank_normalize(ks).alias("ranked"), text.surface_normalize(ks).alias("surface"))
    return load(spark, base, "user_search_log").select("ks").distinct().select("ks", *forms)


@query(f"""select distinct "職務名稱" as title, {_ranked('"職務名稱"')} as ranked, {sqltext.surface('"職務名稱"')} as surface, {sqltext.collapsed(sqltext.plain_width('"職務名稱"'))} as plain from job_posting""")
def folded_titles(spark: SparkSession, base: str) -> DataFrame:
    """Titles in the folded normal forms, width and case included."""
    title = F.col("`職務名稱`")
    rows = load(spark, base, "job_posting").select(title.alias("title")).distinct()
    return rows.select("title", text.rank_normalize(F.col("title")).alias("ranked"), text.surface_normalize(F.col("title")).alias("surface"), text.plain_query(F.col("title")).alias("plain"))


UNITS = """with t as (select distinct "職務名稱" as title from job_posting where "職務名稱" is not null),
low as (select title, lower(title) as l from t),
runs as (select title, unnest(regexp_extract_all(l, '[\u4e00-\u9fff]+')) as r from low),
units as (
    select title, unnest(regexp_extract_all(l, '[a-z0-9][a-z0-9.+#/-]*')) as u from low
    union select title, r from runs
    union select title, substr(r, i, n) from (select title, r, n, unnest(generate_series(1, length(r) - n + 1)) as i from runs, (values (2), (3)) v(n))
)
"""


@query(UNITS + "select title, count(distinct u) as n_units, min(u) as first_unit, max(u) as last_unit from units group by title")
def title_units(spark: SparkSession, base: str) -> DataFrame:
    """How many lexical units each title has, and the first and last of them."""
    rows = load(spark, base, "job_posting").select(F.col("`職務名稱`").alias("title")).filter("title is not null").distinct()
    units = rows.withColumn("units", text.lexical_units(F.lower("title"))).filter(F.size("units") > 0)
    return units.select("title", F.size("units").alias("n_units"), F.array_min("units").alias("first_unit"), F.array_max("units").alias("last_unit"))


@query(UNITS + """, wanted as (select unnest(['資料', '料分', '分析', '析員', '資料分', '料分析', '分析員', '資料分析員']) as w)
select title, round(count(distinct u) / 8.0, 6) as overlap from units join wanted on u = w group by title""")
def title_overlap(spark: SparkSession, base: str) -> DataFrame:
    """The share of a query's units that a title has, where it has any."""
    rows = load(spark, base, "job_posting").select(F.col("`職務名稱`").alias("title")).distinct()
    share = text.overlap(text.lexical_units(F.lit("資料分析員")), text.lexical_units(F.lower("title")))
    return rows.select("title", F.round(share, 6).alias("overlap")).filter("overlap > 0")


@query(f"select search_id, case when regexp_matches(ks, '{SPAM}') then 'spam_keyword' when regexp_matches(ks, '{ADDRESS}') then 'url_as_keyword' when talentNo = '0' and starts_with(c0, '111') and trim(coalesce(empStr, '')) = '' then 'region_without_result' else '' end as reason from user_search_log")
def spam_searches(spark: SparkSession, base: str) -> DataFrame:
    """The first rule by which a search is spam, if any."""
    ks = F.col("ks")
    rules = [
        ("spam_keyword", ks.rlike(SPAM)),
        ("url_as_keyword", ks.rlike(ADDRESS)),
        ("region_without_result", (F.col("talentNo") == "0") & F.col("c0").startswith("111") & (F.trim(F.coalesce("empStr", F.lit(""))) == "")),
    ]
    return load(spark, base, "user_search_log").select("search_id", text.first_rule(rules).alias("reason"))


@query(f"""with r as (select search_id, case when regexp_matches(ks, '{SPAM}') then 'spam_keyword' when regexp_matches(ks, '{ADDRESS}') then 'url_as_keyword' when ks is null or trim(ks) = '' then 'empty' else 'kept' end as reason from user_search_log)
select reason, count(*) as searches, round(count(*) / (select count(*) from user_search_log)::double, 6) as share from r group by reason""")
def cleaning_report(spark: SparkSession, base: str) -> DataFrame:
    """Searches per reason of removal, and their share."""
    from lodestream.operators.aggs import reason_shares

    ks = F.col("ks")
    rules = [("spam_keyword", ks.rlike(SPAM)), ("url_as_keyword", ks.rlike(ADDRESS)), ("empty", ks.isNull() | (F.trim(ks) == "")), ("kept", F.lit(True))]
    return reason_shares(load(spark, base, "user_search_log").select(text.first_rule(rules).alias("reason")), "reason", count="searches")


@query("""select search_id, len(c) as n_cities, len(d) as n_duties, list_min(c) as first_city from (
select search_id, list_filter(list_transform(regexp_split_to_array(coalesce(c0, ''), '[,，]'), lambda x: trim(x)), lambda x: x <> '') as c, list_filter(list_transform(regexp_split_to_array(coalesce(d0, ''), '[,，]'), lambda x: trim(x)), lambda x: x <> '') as d from user_search_log)""")
def search_codes(spark: SparkSession, base: str) -> DataFrame:
    """City and duty codes of each search as lists."""
    rows = load(spark, base, "user_search_log").select("search_id", text.codes(F.col("c0")).alias("c"), text.codes(F.col("d0")).alias("d"))
    return rows.select("search_id", F.size("c").alias("n_cities"), F.size("d").alias("n_duties"), F.array_min("c").alias("first_city"))


SPLIT = "list_filter(list_transform(regexp_split_to_array(coalesce(\"工作技能\", ''), '(?i)(?:<br\\s*/?>|[\\r\\n,，、;；|｜/／]+)'), lambda x: regexp_replace(x, '^[\\s\u3000]+|[\\s\u3000]+$', '', 'g')), lambda x: x <> '')"


@query(f"select value, count(*) as times, count(distinct posting_row_id) as postings from (select posting_row_id, unnest({SPLIT}) as value from job_posting) group by value")
def split_skill_values(spark: SparkSession, base: str) -> DataFrame:
    """Pieces of the skill field by plain separators, with how often they occur."""
    rows = load(spark, base, "job_posting").select("posting_row_id", F.explode(text.split_values(F.col("`工作技能`"))).alias("value"))
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("times"), F.countDistinct("posting_row_id").alias("postings"))


@query("select doc_id, length(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '[\\s\u3000\u00a0\u0085\u2028\u2029]+', ' ', 'g'), '^ | $', '', 'g')) as n_chars_plain, case when regexp_matches(text, '^[=+\\-@]') then concat('''', substr(text, 1, 1)) else substr(text, 1, 1) end as cell from documents")
def plain_documents(spark: SparkSession, base: str) -> DataFrame:
    """Lengths of the documents without markup; the first sign as a safe cell."""
    rows = load(spark, base, "documents")
    cell = text.safe_cell(F.col("text"))
    return rows.select("doc_id", F.length(text.strip_tags(F.col("text"))).alias("n_chars_plain"), F.substring(cell, 1, F.when(cell.startswith("'") & ~F.col("text").startswith("'"), 2).otherwise(1)).alias("cell"))


@query("""select node_id, coalesce(label, '') || case when len(a) > 0 then ' ' || array_to_string(a, ' ') else '' end as joined, len(a) as n_aliases
from (select node_id, label, list_filter(coalesce(aliases, []), lambda x: length(x) between 2 and 60) as a from skill_node)""")
def joined_aliases(spark: SparkSession, base: str) -> DataFrame:
    """Label and admissible aliases of each node as one text."""
    rows = load(spark, base, "skill_node").withColumn("a", text.bounded_aliases(F.coalesce("aliases", F.array().cast("array<string>"))))
    return rows.select("node_id", text.join_terms(F.concat(F.array("label"), "a"), F.col("label")).alias("joined"), F.size("a").alias("n_aliases"))


@query("""select posting_row_id, array_to_string(list_filter([coalesce("職務名稱", ''), coalesce("職務大類", ''), coalesce("職務中類", ''), coalesce("職務小類", ''), substr(coalesce("職務內容", ''), 1, 200)], lambda x: x <> '' and x <> 'NULL'), ' ') as embedded from job_posting""")
def embedding_texts(spark: SparkSession, base: str) -> DataFrame:
    """What each posting row is embedded by."""
    levels = fields.present_levels(F.col("`職務大類`"), F.col("`職務中類`"), F.col("`職務小類`"))
    return load(spark, base, "job_posting").select("posting_row_id", text.embedding_text(F.col("`職務名稱`"), levels, F.col("`職務內容`")).alias("embedded"))


@query("""with q as (select distinct ks, coalesce(trim(ks), '') as q from user_search_log),
e as (select ks, q, list_filter([q, 'Acme', 'Boardtrace', case when contains(lower(q), '焊接') then '焊接' end], lambda x: x is not null and x <> '') as a, list_filter(['維修', q], lambda x: x <> '') as b from q),
u as (select ks, q, list_filter(a, lambda x, i: list_position(a, x) = i) as a, list_filter(b, lambda x, i: list_position(b, x) = i) as b from e),
f as (select ks, q, list_filter(a, lambda x, i: list_sum(list_transform(a[1:i], lambda y: length(y) + 1)) <= 480) as a, list_filter(b, lambda x, i: list_sum(list_transform(b[1:i], lambda y: length(y) + 1)) <= 480) as b from u)
select ks, case when len(a) > 0 then array_to_string(a, ' ') else substr(q, 1, 480) end as expansion, case when len(b) > 0 then array_to_string(b, ' ') else substr(q, 1, 480) end as recall from f""")
def query_expansions(spark: SparkSession, base: str) -> DataFrame:
    """Search texts with the company and the terms they may be widened by."""
    rows = load(spark, base, "user_search_log").select("ks").distinct()
    q = F.coalesce(F.trim("ks"), F.lit(""))
    kept = F.array(F.lit("Boardtrace"), F.lit("焊接"))
    return rows.select("ks", text.query_expansion(q, F.lit("Acme"), kept).alias("expansion"), text.recall_expansion(q, F.array(F.lit("維修"))).alias("recall"))


PAY = """select posting_row_id, case when lo <> 0 and hi <> 0 and hi < lo then hi else lo end as low, case when lo <> 0 and hi <> 0 and hi < lo then lo else hi end as high, kind from (
select posting_row_id, coalesce(try_cast("薪資下限" as double), 0) as lo, coalesce(try_cast("薪資上限" as double), 0) as hi,
case when starts_with("薪資", '月薪') then 'monthly' when starts_with("薪資", '日薪') then 'daily' when starts_with("薪資", '時薪') then 'hourly' when starts_with("薪資", '年薪') then 'yearly' when starts_with("薪資", '面議') then 'negotiable' else 'unknown' end as kind from job_posting)"""
CLASSES = (("月薪", "monthly"), ("日薪", "daily"), ("時薪", "hourly"), ("年薪", "yearly"), ("面議", "negotiable"))


def _bounds(spark: SparkSession, base: str) -> DataFrame:
    low, high = (fields.number_or_zero(F.col(f"`{c}`")) for c in ("薪資下限", "薪資上限"))
    rows = load(spark, base, "job_posting").select("posting_row_id", fields.ordered_bounds(low, high).alias("b"), fields.prefix_class(F.col("`薪資`"), CLASSES).alias("kind"))
    return rows.select("posting_row_id", "b.low", "b.high", "kind")


@query(PAY)
def number_ranges(spark: SparkSession, base: str) -> DataFrame:
    """Two text bounds as numbers, the right way round, with the class of their text."""
    return _bounds(spark, base)


@query(f"""with b as ({PAY}) select posting_row_id,
case when kind <> 'monthly' or (low <= 0 and high <= 0) then 0.0::double when case when high > 0 then high else low end >= 40000 then 1.0 else -1.0 end as at_least,
case when kind <> 'monthly' or (low <= 0 and high <= 0) then 0.0::double when low <= 40000 and 40000 <= case when high > 0 then high else low end then 1.0 else -1.0 end as exactly from b""")
def range_matches(spark: SparkSession, base: str) -> DataFrame:
    """Whether a posting's range answers a wanted number."""
    same = F.col("kind") == "monthly"
    cover = lambda exact: fields.range_cover(F.col("low"), F.col("high"), F.lit(40000.0), F.lit(exact), same)
    return _bounds(spark, base).select("posting_row_id", cover(False).alias("at_least"), cover(True).alias("exactly"))


@query("""select posting_row_id, regexp_matches(regexp_replace(concat(coalesce("職務名稱", ''), ' ', coalesce("職務內容", '')), '(?i)居家照顧|居家照服|居家服務|居家護理|居家督導|居家清潔|居家托育', '', 'g'), '(?i)遠端|在家工作|在家上班|在家兼職|居家辦公|居家工作|wfh|work from home|remote') as mentioned from job_posting""")
def keyword_flags(spark: SparkSession, base: str) -> DataFrame:
    """Whether a posting mentions one of some phrases, others that look like them left out."""
    whole = F.concat_ws(" ", F.coalesce(F.col("`職務名稱`"), F.lit("")), F.coalesce(F.col("`職務內容`"), F.lit("")))
    return load(spark, base, "job_posting").select("posting_row_id", fields.mentions(whole, REMOTE, HOME_CARE).alias("mentioned"))


@query("""with b as (select min(epoch_us(loaded_at)) as lo, max(epoch_us(loaded_at)) as hi from job_posting)
select posting_row_id, round(greatest(0, least(1, (epoch_us(loaded_at) - lo) / (hi - lo)::double)), 4) as freshness from job_posting, b""")
def posting_freshness(spark: SparkSession, base: str) -> DataFrame:
    """Where each row's time lies between the first and the last."""
    rows = load(spark, base, "job_posting").select("posting_row_id", micros(F.col("loaded_at")).alias("at"))
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    return rows.select("posting_row_id", fields.freshness(F.col("at"), F.lit(low), F.lit(high)).alias("freshness"))


@query("""select posting_row_id, case when contains("工作城市", '市') then 1.0::double else -1.0 end as place, case when contains(coalesce("職務小類", ''), '護理') or contains(coalesce("職務名稱", ''), '護理') then 2.4::double else -10.0 end as duty,
len(list_filter(["職務大類", "職務中類", "職務小類"], lambda x: x is not null and x <> '' and x <> 'NULL')) as levels from job_posting""")
def place_and_duty(spark: SparkSession, base: str) -> DataFrame:
    """Signed matches of place and duty names, and the filled levels; without a city the wanted place is missed."""
    rows = load(spark, base, "job_posting")
    names = F.array(F.lit("護理"))
    duty = fields.any_contains(names, F.coalesce(F.col("`職務小類`"), F.lit(""))) | fields.any_contains(names, F.coalesce(F.col("`職務名稱`"), F.lit("")))
    place = fields.signed_match(F.array(F.lit("市")), fields.any_contains(F.array(F.lit("市")), F.col("`工作城市`")))
    levels = F.size(fields.present_levels(F.col("`職務大類`"), F.col("`職務中類`"), F.col("`職務小類`")))
    return rows.select("posting_row_id", place.alias("place"), fields.reward_or_penalty(fields.signed_match(names, duty, -0.7), 2.4, -10.0).alias("duty"), levels.alias("levels"))


@query("select surface_id, coalesce(least(greatest(try_cast(cast(confidence as varchar) as double), 0), 1), 0) as confidence from resolution")
def clamped_confidence(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "resolution").select("surface_id", fields.confidence(F.col("confidence").cast("string")).alias("confidence"))


@query("""select search_id, case when contains(ks, '技師') then '技師' end as grounded, case when contains(ks, '雲橋') then '雲橋市' when contains(ks, '東籬') then '東籬市' end as city from user_search_log""")
def grounded_searches(spark: SparkSession, base: str) -> DataFrame:
    """A claimed class that the text bears out, and the city of a named district."""
    ks = F.col("ks")
    place = fields.resolve_place(ks, {"雲橋": "雲橋市"}, ["東籬市", "東籬"])
    city = F.when(place["city"] == "東籬", "東籬市").otherwise(place["city"])
    return load(spark, base, "user_search_log").select("search_id", fields.grounded(F.lit("技師"), {"技師": ["技師"]}, ks).alias("grounded"), city.alias("city"))


@query("""select surface_id, array_to_string(list_filter([case when surface is null or surface = '' or not contains(coalesce(normalized_surface, ''), surface) then '0:ungrounded' end, case when not confidence >= 0.75 or confidence is null then '0:confidence' end], lambda x: x is not null), '|') as errors from resolution""")
def evidence_checks(spark: SparkSession, base: str) -> DataFrame:
    """What is wrong with each resolution taken as extracted evidence."""
    one = F.array(F.struct(F.col("surface").alias("evidence"), F.lit("mentioned").alias("level"), F.col("confidence"), F.lit(False).alias("negated")))
    return load(spark, base, "resolution").select("surface_id", F.array_join(fields.evidence_errors(F.coalesce("normalized_surface", F.lit("")), one), "|").alias("errors"))


@query("""select posting_row_id, case when "職務名稱" like '%員%' and "工作城市" is not null then '職稱吻合；地區吻合' when "職務名稱" like '%員%' then '職稱吻合' when "工作城市" is not null then '地區吻合' else '綜合' end as why from job_posting""")
def explanations(spark: SparkSession, base: str) -> DataFrame:
    """Why a posting was found, in up to three phrases."""
    phrases = [(F.col("`職務名稱`").contains("員"), "職稱吻合"), (F.col("`工作城市`").isNotNull(), "地區吻合")]
    return load(spark, base, "job_posting").select("posting_row_id", text.explanation(phrases, "綜合").alias("why"))
