"""Building the skill graph in stages: extract, resolve, relate, check, export. Each is a table in, a table out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.operators import graph, matching
from lodestream.operators.windows import best_per_group
from lodestream.session import cut_lineage
from lodestream.sources import sinks


def extract(postings: DataFrame, aliases: DataFrame, *, item: str, owner: str, fields: dict[str, tuple[float, int]]) -> DataFrame:
    """(item, owner, field, node, surface, evidence, level, confidence): names that postings mention and don't negate.

    fields: column -> (confidence, priority); a node is taken from the field of the least
    priority number, then the longest name. Names that several nodes own are left out.
    """
    owned = aliases.groupBy("alias").agg(F.countDistinct("node").alias("n"), F.min("node").alias("node")).filter("n = 1").select("alias", "node")
    names = [a for a, _ in matching.bounded_vocabulary(owned, ["alias", "node"])]
    told = None
    for column, (confidence, priority) in fields.items():
        found = matching.mentions(F.col(f"`{column}`"), names, way="consuming")
        one = postings.select(F.col(item).alias("item"), F.col(owner).alias("owner"), F.inline(found)).filter("negated = 'false'")
        one = one.select("item", "owner", F.lit(column).alias("field"), F.col("name").alias("alias"), "evidence", "level", "start", F.lit(confidence).alias("confidence"), F.lit(priority).alias("priority"))
        told = one if told is None else told.unionByName(one)
    resolved = told.join(owned, "alias")
    order = [F.asc("priority"), F.desc(F.length("alias")), F.asc("field"), F.asc("start"), F.asc("alias"), F.asc("owner"), F.asc("evidence"), F.asc("level")]
    return best_per_group(resolved, ["item", "node"], order).select("item", "owner", "field", "node", F.col("alias").alias("surface"), "evidence", "level", "confidence")


def build(postings: DataFrame, nodes: DataFrame, *, item: str, owner: str, fields: dict[str, tuple[float, int]], least_jobs: int = 20, least_companies: int = 5, least_lift: float = 2.0, least_npmi: float = 0.15, neighbours: int = 20) -> dict[str, DataFrame]:
    """mentions, edges, relations, nodes and violations of the graph of these postings."""
    fold = lambda c: text.surface_normalize(c)
    aliases = cut_lineage(graph.aliases_of(nodes, node="id", label="label", aliases="aliases", fold=fold), "aliases")
    mentions = cut_lineage(extract(postings, aliases, item=item, owner=owner, fields=fields), "mentions")
    edges = graph.edges_of(mentions.select("item", "node", "field", "level", "confidence"), source="item", target="node", kind="REQUIRES", order=F.col("confidence"))
    held = mentions.groupBy("item").agg(F.collect_set("node").alias("skills"))
    # postings without a skill count, too: they are what chance is measured against
    baskets = postings.groupBy(F.col(item).alias("item")).agg(F.max(owner).alias("owner")).filter("item is not null").join(held, "item", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    relations = graph.relation_candidates(baskets, basket="item", owner="owner", items="skills", least_jobs=least_jobs, least_companies=least_companies, least_lift=least_lift, least_npmi=least_npmi, neighbours=neighbours)
    jobs = postings.select(F.col(item).cast("string").alias("id")).filter("id is not null").distinct().select("id", F.lit("Job").alias("type"), F.lit("active").alias("status"), F.lit("").alias("label"), F.array().cast("array<string>").alias("aliases"))
    every = nodes.select("id", "type", "status", "label", "aliases").unionByName(jobs)
    checked = edges.select("id", F.col("source_id").cast("string").alias("source_id"), "target_id", "type", F.col("field").alias("provenance"), F.lit(None).cast("timestamp_ntz").alias("modified_at"))
    return {"mentions": mentions, "edges": edges, "relations": relations, "nodes": every, "violations": graph.violations(every, checked)}


def export(built: dict[str, DataFrame], path: str) -> dict:
    """Writes the graph for a bulk loader and returns its manifest."""
    parts = {
        "nodes": sinks.write_immutable(sinks.graph_nodes(built["nodes"]), f"{path}/nodes", format="json"),
        "edges": sinks.write_immutable(sinks.graph_edges(built["edges"], ["field", "level", "confidence"]), f"{path}/edges", format="json"),
        "relations": sinks.write_immutable(built["relations"], f"{path}/relations", format="json"),
    }
    return sinks.manifest(parts, stage="export")
