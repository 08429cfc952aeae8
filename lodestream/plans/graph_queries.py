"""Names, relations and graph checks over skills, baskets, resolutions and codes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.functions.scalars import whole_number
from lodestream.operators import graph, joins, matching
from lodestream.plans import sqltext
from lodestream.plans.core_problems import number_sql
from lodestream.plans.registry import Registry
from lodestream.session import load

registry = Registry()
queries, oracle_sql, query = registry.queries, registry.oracle_sql, registry.query
CUTOFF = dt.datetime(2026, 4, 12, 23, 59, 59)


fold = text.surface_normalize
ALIASES = f"aliases as (select distinct {sqltext.surface('a')} as alias, node_id as node from (select node_id, unnest(list_append(coalesce(aliases, []), label)) as a from skill_node) where {sqltext.surface('a')} <> '')"


def alias_map(spark: SparkSession, base: str) -> DataFrame:
    return graph.aliases_of(load(spark, base, "skill_node"), node="node_id", label="label", aliases="aliases", fold=fold)


@query(f"with {ALIASES}, o as (select alias, count(distinct node) as n, min(node) as node from aliases group by 1), m as (select distinct surface_id, {sqltext.surface('normalized_surface')} as surface from resolution) select surface_id, case when n = 1 then node end as node, case when n = 1 then 'EXACT' when n > 1 then 'AMBIGUOUS' else 'UNKNOWN' end as decision from m left join o on alias = surface")
def entity_resolution(spark: SparkSession, base: str) -> DataFrame:
    """Typed names resolved by exact names of the list."""
    rows = load(spark, base, "resolution").select("surface_id", fold(F.col("normalized_surface")).alias("surface")).distinct()
    return graph.resolve_exactly(rows, alias_map(spark, base), surface="surface").select("surface_id", "node", "decision")


@query(f"""with {ALIASES}, o as (select alias, count(distinct node) as n, min(node) as node from aliases group by 1), m as (select distinct surface_id, first, {sqltext.surface('surface')} as surface from resolution join (select job_id, min(node_id) as first from resolution group by 1) using (job_id))
select surface_id, first as claimed, case when n = 1 then node end as node from m left join o on alias = surface where first is not null and first is distinct from case when n = 1 then node end""")
def mismatched_claims(spark: SparkSession, base: str) -> DataFrame:
    """Typed names that don't mean the first node that their posting claims."""
    rows = load(spark, base, "resolution").select("surface_id", "job_id", "node_id", fold(F.col("surface")).alias("surface"))
    first = rows.groupBy("job_id").agg(F.min("node_id").alias("claimed"))
    claims = rows.join(first, "job_id").select("surface_id", "claimed", "surface").distinct()
    resolved = graph.resolve_exactly(claims, alias_map(spark, base), surface="surface")
    return graph.mismatched_claims(resolved, claimed="claimed", node="node").select("surface_id", "claimed", "node")


@query(f"with {ALIASES}, codes as (select distinct {sqltext.surface('CodeNameA')} as alias, 'duty.' || CodeNo as node from duty_code) select alias, node from aliases union all select alias, node from codes where alias not in (select alias from aliases)")
def merged_vocabulary(spark: SparkSession, base: str) -> DataFrame:
    """Names of skills and duties; a skill keeps a name that both have."""
    codes = load(spark, base, "duty_code").select(fold(F.col("CodeNameA")).alias("alias"), F.concat(F.lit("duty."), "CodeNo").alias("node")).distinct()
    return graph.merge_vocabularies(alias_map(spark, base), codes)


@query("select node_id, concat(lower(node_type), ':', substr(sha256(concat(node_type, chr(0), lower(label))), 1, 16)) as stable_id from skill_node")
def stable_node_ids(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "skill_node").select("node_id", graph.node_id(F.col("node_type"), F.lower("label")).alias("stable_id"))


EDGES = """edges as (select concat('edge:', substr(sha256(concat(job_id, chr(0), 'REQUIRES', chr(0), node_id)), 1, 20)) as id, job_id as source_id, node_id as target_id, 'REQUIRES' as type, max(surface_id) as surface_id, arg_max(evidence_field, surface_id) as provenance from resolution where node_id is not null group by job_id, node_id)"""


def job_edges(spark: SparkSession, base: str) -> DataFrame:
    rows = load(spark, base, "resolution").filter("node_id is not null").select("job_id", "node_id", "surface_id", F.col("evidence_field").alias("provenance"))
    return graph.edges_of(rows, source="job_id", target="node_id", kind="REQUIRES", order=F.col("surface_id"))


@query(f"with {EDGES} select * from edges")
def edge_ids(spark: SparkSession, base: str) -> DataFrame:
    """One edge per posting and skill, with its last mention."""
    return job_edges(spark, base)


@query("select node_type as type, count(*) as nodes from skill_node group by 1")
def node_counts(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "skill_node").groupBy(F.col("node_type").alias("type")).agg(F.count(F.lit(1)).alias("nodes"))


GRAPH = f"""{EDGES}, nodes as (select node_id as id, node_type as type, status from skill_node union all select job_id, 'Job', status from (select job_id, max(status) as status from resolution group by 1)), e as (select id, source_id, target_id, type, provenance from edges union all select id, source_id, 'skill:none', 'PARENT_OF', '' from edges where target_id = 'skill:5b70c3593e38daff')"""


@query(f"""with {GRAPH} select 'candidate_node' as rule, count(*) as violations from nodes where status = 'candidate' union all select 'repeated_node', count(*) from (select id from nodes group by 1 having count(*) > 1)
union all select 'repeated_edge', count(*) from (select id from e group by 1 having count(*) > 1) union all select 'missing_source', count(*) from e where source_id not in (select id from nodes)
union all select 'missing_target', count(*) from e where target_id not in (select id from nodes) union all select 'without_provenance', count(*) from e where coalesce(provenance, '') = ''
union all select 'forbidden_type', count(*) from e where type = 'PARENT_OF'""")
def graph_violations(spark: SparkSession, base: str) -> DataFrame:
    """What the checks find in a graph with some edges made wrong."""
    jobs = load(spark, base, "resolution").groupBy(F.col("job_id").alias("id")).agg(F.max("status").alias("status")).select("id", F.lit("Job").alias("type"), "status")
    nodes = load(spark, base, "skill_node").select(F.col("node_id").alias("id"), F.col("node_type").alias("type"), "status").unionByName(jobs)
    good = job_edges(spark, base).select("id", "source_id", "target_id", "type", "provenance")
    bad = good.filter("target_id = 'skill:5b70c3593e38daff'").select("id", "source_id", F.lit("skill:none").alias("target_id"), F.lit("PARENT_OF").alias("type"), F.lit("").alias("provenance"))
    return graph.violations(nodes, good.unionByName(bad).withColumn("modified_at", F.lit(None).cast("timestamp_ntz")))


@query("select 'source_id' as \"end\", job_id as id, count(distinct node_id) as edges from resolution where node_id is not null and job_id not in (select job_id from skill_basket) group by 2 union all select 'target_id', node_id, count(distinct job_id) from resolution where node_id is not null and node_id not in (select node_id from skill_node where node_type <> 'Certificate') group by 2")
def missing_endpoints(spark: SparkSession, base: str) -> DataFrame:
    """Ends of edges that are in no table of postings and skills, certificates left aside."""
    nodes = load(spark, base, "skill_basket").select(F.col("job_id").alias("id")).unionByName(load(spark, base, "skill_node").filter("node_type <> 'Certificate'").select(F.col("node_id").alias("id")))
    return joins.missing_endpoints(job_edges(spark, base), nodes, ends=["source_id", "target_id"], node="id")


PAIRS = """own as (select job_id, skill, min(nullif(evidence, '')) as evidence from (select job_id, skill, list_extract(map_extract(skill_evidence, skill), 1) as evidence from (select job_id, skill_evidence, unnest(skills) as skill from skill_basket where job_id is not null)) where skill is not null and trim(skill) <> '' group by all),
comp as (select distinct job_id, company_id as company from skill_basket), total as (select count(distinct job_id)::double as n from skill_basket where job_id is not null), single as (select skill, count(*) as n from own group by 1),
pairs as (select a.skill as source_id, b.skill as target_id, count(distinct a.job_id) as support_jobs, count(distinct c.company) as support_companies from own a join own b on a.job_id = b.job_id and a.skill < b.skill join comp c on c.job_id = a.job_id group by all),
scored as (select source_id, target_id, support_jobs, support_companies, t.n * support_jobs / (x.n * y.n::double) as lift, case when support_jobs >= t.n then 1 else ln(t.n * support_jobs / (x.n * y.n::double)) / -ln(support_jobs / t.n) end as npmi from pairs join single x on x.skill = source_id join single y on y.skill = target_id cross join total t where support_jobs >= {least}),
rel as (select source_id, target_id, support_jobs, support_companies, round(lift, 8) as lift, round(npmi, 8) as npmi, round(0.6::double * greatest(0, least(1, (npmi - 0.15) / (1 - 0.15::double))) + 0.3::double * greatest(0, least(1, (lift - {lift}) / 8.0::double)) + 0.1::double * least(support_jobs / 100.0::double, 1), 6) as confidence from scored where support_companies >= {companies} and lift >= {lift} and npmi >= 0.15),
ends as (select *, unnest([source_id, target_id]) as e from rel), ranked as (select *, row_number() over (partition by e order by confidence desc, npmi desc, lift desc, support_jobs desc, source_id, target_id) as k from ends),
mutual as (select source_id, target_id from ranked where k <= 3 group by all having count(*) = 2)"""
FEW = PAIRS.replace("{least}", "5").replace("{companies}", "2").replace("{lift}", "1.5::double")


def _relations(spark: SparkSession, base: str, evidence: str | None = None) -> DataFrame:
    return graph.relation_candidates(load(spark, base, "skill_basket"), basket="job_id", owner="company_id", items="skills", evidence=evidence, least_jobs=5, least_companies=2, least_lift=1.5, neighbours=3)


@query(f"""with {FEW}, r as (select rel.* from rel join mutual using (source_id, target_id)),
e as (select source_id, target_id, a.job_id, a.evidence as x, b.evidence as y, row_number() over (partition by source_id, target_id order by a.job_id) as n from r join own a on a.skill = source_id join own b on b.skill = target_id and b.job_id = a.job_id where a.evidence is not null and b.evidence is not null),
t as (select source_id, target_id, string_agg(concat(job_id, '=', x, '+', y), '|' order by n) as evidence from e where n <= 3 group by all)
select r.*, coalesce(evidence, '') as evidence from r left join t using (source_id, target_id)""")
def relation_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of skills that exceed chance and are among each other's nearest, with the postings that bear them out."""
    told = F.transform(F.coalesce("evidence", F.array().cast("array<struct<basket:string,source_evidence:string,target_evidence:string>>")), lambda x: F.concat(x["basket"], F.lit("="), x["source_evidence"], F.lit("+"), x["target_evidence"]))
    return _relations(spark, base, "skill_evidence").withColumn("evidence", F.array_join(told, "|"))


@query(f"with {PAIRS.split('scored as')[0].rstrip().rstrip(',')} select * from pairs")
def cooccurring_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of skills with their supports."""
    return graph.cooccurring_pairs(load(spark, base, "skill_basket"), basket="job_id", owner="company_id", items="skills")


@query(f"""with {FEW}, r as (select rel.* from rel join mutual using (source_id, target_id)), ways as (select source_id as seed, target_id as neighbour, confidence as weight from r union all select target_id, source_id, confidence from r),
seeds as (select node_id as seed from skill_node where node_type = 'Certificate' order by 1 limit 8) select seed, neighbour, weight from ways join seeds using (seed) order by seed, weight desc, neighbour limit 160""")
def relation_expansion(spark: SparkSession, base: str) -> DataFrame:
    """Neighbours of some seeds, either way."""
    seeds = load(spark, base, "skill_node").filter("node_type = 'Certificate'").select(F.col("node_id").alias("seed"))
    return graph.expand(seeds, _relations(spark, base), weight="confidence")


@query(f"with {FEW}, r as (select rel.* from rel join mutual using (source_id, target_id)) select source_id, target_id, a.label as source_label, b.label as target_label, support_jobs, row_number() over (partition by source_id order by support_jobs desc, target_id) as review_rank from r join skill_node a on a.node_id = source_id join skill_node b on b.node_id = target_id")
def review_packet(spark: SparkSession, base: str) -> DataFrame:
    """Relations with labels, in the order of review."""
    labels = load(spark, base, "skill_node").select(F.col("node_id").alias("id"), "label")
    return graph.review_packet(_relations(spark, base), labels).select("source_id", "target_id", "source_label", "target_label", "support_jobs", "review_rank")


@query(f"with {ALIASES}, a as (select alias from aliases) select x.alias as a, y.alias as b from (select distinct alias from a) x, (select distinct alias from a) y where x.alias < y.alias and (x.alias, y.alias) in (('d#', 'd++'), ('kora', 'korascript'))")
def forbidden_merges(spark: SparkSession, base: str) -> DataFrame:
    """Pairs that must not be merged, of which the list has both names."""
    names = alias_map(spark, base).select("alias").distinct()
    pairs = spark.createDataFrame([("d#", "d++"), ("kora", "korascript"), ("c", "c++")], "a string, b string")
    both = pairs.join(names.select(F.col("alias").alias("a")), "a", "left_semi").join(names.select(F.col("alias").alias("b")), "b", "left_semi")
    return both.filter(graph.forbidden_merge(F.col("a"), F.col("b"), [("d#", "d++"), ("kora", "korascript"), ("c", "c++")])).select("a", "b")


TAXONOMY = f"""n as (select posting_row_id, '職務大類' as level, {sqltext.surface('"職務大類"')} as name from job_posting union all select posting_row_id, '職務中類', {sqltext.surface('"職務中類"')} from job_posting union all select posting_row_id, '職務小類', {sqltext.surface('"職務小類"')} from job_posting),
l as (select '職務大類' as level, {sqltext.surface('CodeNameC')} as name, min(CodeNo) as code from duty_code where CodeNameA = CodeNameB and CodeNameB = CodeNameC group by all union all select '職務中類', {sqltext.surface('CodeNameB')}, min(CodeNo) from duty_code where CodeNameA = CodeNameB group by all union all select '職務小類', {sqltext.surface('CodeNameA')}, min(CodeNo) from duty_code group by all)"""


@query(f"with {TAXONOMY} select distinct posting_row_id as item, code, coalesce(nullif(CodeNameA, ''), nullif(CodeNameB, ''), nullif(CodeNameC, ''), CodeNo) as label from n join l using (level, name) join duty_code on CodeNo = code where name <> ''")
def taxonomy_match(spark: SparkSession, base: str) -> DataFrame:
    """Duties that postings name on any level."""
    levels = {"職務大類": "CodeNameC", "職務中類": "CodeNameB", "職務小類": "CodeNameA"}
    return graph.taxonomy_match(load(spark, base, "job_posting"), load(spark, base, "duty_code"), item="posting_row_id", levels=levels, fold=fold)


@query(f"""with p as (select {number_sql('"職缺編號"')} as item, loaded_at from job_posting), i as (select distinct item from p where item is not null), ok as (select distinct item from p where loaded_at <= '2026-04-12 23:59:59'),
e as (select job_id as item, node_id as skill, max(confidence) as c from resolution where node_id is not null and job_id in (select item from ok) group by all), s as (select item, list_sort(list(skill)) as skills, round(max(c), 6) as confidence from e group by 1)
select item, array_to_string(coalesce(skills, []), '|') as skills, coalesce(confidence, 0) as confidence from i left join s using (item)""")
def ranking_overlay(spark: SparkSession, base: str) -> DataFrame:
    """Postings with the skills that were known of them by a cutoff."""
    postings = load(spark, base, "job_posting").select(whole_number(F.col("`職缺編號`")).alias("item"), F.col("loaded_at").alias("modified_at")).filter("item is not null")
    edges = load(spark, base, "resolution").filter("node_id is not null").select(F.col("job_id").alias("item"), F.col("node_id").alias("skill"), "confidence")
    return graph.overlay(postings, postings, edges, cutoff=CUTOFF).withColumn("skills", F.array_join("skills", "|"))


@query(f"with {ALIASES}, o as (select alias, count(distinct node) as n, min(node) as node from aliases group by 1), m as (select {sqltext.surface('normalized_surface')} as s, confidence from resolution where coalesce(normalized_surface, '') <> ''), r as (select coalesce(case when n = 1 then node end, 'skill:' || substr(sha256(concat('Skill', chr(0), s)), 1, 16)) as node, s, confidence, n is null as fresh from m left join o on alias = s where n is null or n = 1) select node, count(distinct s) as surfaces, max(confidence) as confidence, bool_and(fresh) as new from r group by node")
def published_nodes(spark: SparkSession, base: str) -> DataFrame:
    """Typed names as new nodes, or merged with the node that has the name."""
    rows = load(spark, base, "resolution").filter("normalized_surface <> ''").select(fold(F.col("normalized_surface")).alias("surface"), "confidence")
    return graph.publish(rows, alias_map(spark, base), surface="surface", confidence="confidence")


@query(f"with {ALIASES} select 'blank' as \"check\", count(*) as violations from aliases where trim(alias) = '' union all select 'unknown_node', count(*) from aliases where node not in (select node_id from skill_node) union all select 'without_name', count(*) from skill_node where node_id not in (select node from aliases) union all select 'repeated', count(*) from (select 1 from aliases group by alias, node having count(*) > 1)")
def alias_index_checks(spark: SparkSession, base: str) -> DataFrame:
    return graph.alias_index_checks(alias_map(spark, base), load(spark, base, "skill_node"), "node_id")


@query(f"select {number_sql(chr(34) + 'employeeNo' + chr(34))} as posting, count(distinct view_id) as views from job_view where {number_sql(chr(34) + 'employeeNo' + chr(34))} in (select job_id from skill_basket) group by 1")
def indexed_behaviour(spark: SparkSession, base: str) -> DataFrame:
    """Views of postings that the basket table knows."""
    views = load(spark, base, "job_view").select(whole_number(F.col("employeeNo")).alias("posting"), "view_id")
    return graph.limited_to(views, posting=load(spark, base, "skill_basket").select("job_id")).groupBy("posting").agg(F.countDistinct("view_id").alias("views"))


BODY = f"""{ALIASES}, t as (select posting_row_id, {sqltext.surface("concat_ws('。', \"職務名稱\", \"職務內容\")")} as body from job_posting)"""


def _mentions(spark: SparkSession, base: str, way: str) -> DataFrame:
    names = [n for (n,) in matching.bounded_vocabulary(alias_map(spark, base), ["alias"])]
    found = matching.mentions(F.concat_ws("。", "`職務名稱`", "`職務內容`"), names, way=way)
    return load(spark, base, "job_posting").select("posting_row_id", F.inline(found))


@query(f"""with {BODY}, m as (select posting_row_id, unnest(regexp_extract_all({sqltext.marked("body")}, {sqltext.alternation("aliases", "alias", True)})) as m from t)
select posting_row_id, replace(m, chr(1), '') as name, count(*) as times from m group by all""")
def alias_extract(spark: SparkSession, base: str) -> DataFrame:
    """Names of the list in posting texts, by an automaton, with how often they occur."""
    return _mentions(spark, base, "automaton").groupBy("posting_row_id", "name").agg(F.count(F.lit(1)).alias("times"))


@query(f"""with {BODY}, m as (select posting_row_id, unnest(regexp_extract_all({sqltext.marked("body")}, {sqltext.alternation("aliases", "alias", False)})) as m from t)
select posting_row_id, replace(m, chr(1), '') as name, count(*) as times from m where not {sqltext.ascii_only("m")} or (starts_with(m, chr(1)) and ends_with(m, chr(1))) group by all""")
def consuming_extract(spark: SparkSession, base: str) -> DataFrame:
    """The same by an alternation in which a rejected name has used up its text."""
    return _mentions(spark, base, "consuming").groupBy("posting_row_id", "name").agg(F.count(F.lit(1)).alias("times"))


@query()
def mention_levels(spark: SparkSession, base: str) -> DataFrame:
    """Names that postings mention and don't negate, with evidence, place and level."""
    return _mentions(spark, base, "consuming").filter("negated = 'false'").drop("negated")


@query("""with d as (select "CodeNameA" as n, max("CodeNo") as code from duty_code where "CodeNameA" is not null group by 1), q as (select distinct ks from user_search_log where ks is not null),
found as (select ks, regexp_extract_all(ks, (select string_agg(regexp_escape(n), '|' order by length(n) desc, n) from d where length(n) > 1)) as names from q),
each as (select ks, unnest(names) as n, generate_subscripts(names, 1) as k from found),
first as (select ks, code, min(k) as k from each join d using (n) group by all)
select ks, string_agg(code, '|' order by k) as codes from first group by ks""")
def vocab_scan(spark: SparkSession, base: str) -> DataFrame:
    """Duties that search texts name, by windows."""
    table = dict(matching.bounded_vocabulary(load(spark, base, "duty_code").filter("CodeNameA is not null"), ["CodeNameA", "CodeNo"]))
    rows = load(spark, base, "user_search_log").select("ks").distinct()
    return rows.select("ks", F.array_join(matching.resolved_windows(F.col("ks"), table), "|").alias("codes")).filter("codes <> ''")


@query(f"""with v as (select distinct {sqltext.indexed('label')} as n from skill_node where {sqltext.indexed('label')} <> ''), q as (select ks, {sqltext.indexed('ks')} as t from (select distinct ks from user_search_log)),
m as (select ks, unnest(regexp_extract_all({sqltext.marked("t")}, {sqltext.alternation("v", "n", True)})) as m from q)
select ks, string_agg(distinct replace(m, chr(1), ''), '|' order by replace(m, chr(1), '')) as names from m group by ks""")
def matched_names(spark: SparkSession, base: str) -> DataFrame:
    """All labels in search texts, by one expression inside the engine; of labels that overlap, the first and longest."""
    labels = [n for (n,) in matching.bounded_vocabulary(load(spark, base, "skill_node").select(text.index_normalize(F.col("label")).alias("n")).filter("n <> ''"), ["n"])]
    rows = load(spark, base, "user_search_log").select("ks").distinct()
    found = matching.matched_names(text.index_normalize(F.col("ks")), labels)
    return rows.select("ks", F.array_join(F.sort_array(F.array_distinct(found)), "|").alias("names")).filter("names <> ''")
