"""Building and checking a graph of items, skills and relations, as tables of nodes and edges."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.windows import mutual_neighbours
from lodestream.session import broadcast_if_small, cut_lineage

# Pairs of names that must never be taken for one.
NEVER_MERGED = (("java", "javascript"), ("c", "c++"), ("c", "c#"), ("next.js", "react"))


def aliases_of(nodes: DataFrame, *, node: str, label: str, aliases: str, fold) -> DataFrame:
    """(alias, node): every folded name of every node once."""
    names = F.concat(F.array(label), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    return nodes.select(F.col(node).alias("node"), F.explode(names).alias("name")).select(fold(F.col("name")).alias("alias"), "node").filter("alias <> ''").distinct()


def merge_vocabularies(seed: DataFrame, reviewed: DataFrame, alias: str = "alias") -> DataFrame:
    """Aliases of both lists; where both have one, the seed's owner keeps it."""
    return seed.unionByName(reviewed.join(seed.select(alias), alias, "left_anti"))


def resolve_exactly(mentions: DataFrame, alias_map: DataFrame, *, surface: str) -> DataFrame:
    """Mentions with node and decision: EXACT, AMBIGUOUS (several nodes own the name) or UNKNOWN."""
    owners = alias_map.groupBy("alias").agg(F.countDistinct("node").alias("__owners"), F.min("node").alias("__node"))
    joined = mentions.join(owners, F.col(surface) == F.col("alias"), "left")
    decision = F.when(F.col("__owners") == 1, "EXACT").when(F.col("__owners") > 1, "AMBIGUOUS").otherwise("UNKNOWN")
    return joined.select(*mentions.columns, F.when(F.col("__owners") == 1, F.col("__node")).alias("node"), decision.alias("decision"))


def mismatched_claims(resolved: DataFrame, *, claimed: str, node: str) -> DataFrame:
    """Rows whose claimed node isn't the one their name resolves to."""
    return resolved.filter(F.col(claimed).isNotNull() & ~F.col(claimed).eqNullSafe(F.col(node)))


def node_id(kind: Column, label: Column, digits: int = 16) -> Column:
    """An id that depends on kind and folded label alone."""
    return F.concat(F.lower(kind), F.lit(":"), F.substring(F.sha2(F.concat_ws("\x00", kind, label), 256), 1, digits))


def edge_id(source: Column, kind: Column, target: Column, digits: int = 20) -> Column:
    return F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("\x00", source, kind, target), 256), 1, digits))


def edges_of(mentions: DataFrame, *, source: str, target: str, kind: str, order: Column) -> DataFrame:
    """One edge per source and target, with the last mention's columns by order."""
    rest = [c for c in mentions.columns if c not in (source, target)]
    last = mentions.groupBy(source, target).agg(F.max_by(F.struct(*rest), order).alias("m"))
    return last.select(edge_id(F.col(source).cast("string"), F.lit(kind), F.col(target).cast("string")).alias("id"), F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(kind).alias("type"), "m.*")


def forbidden_merge(a: Column, b: Column, pairs: Iterable[tuple[str, str]] = NEVER_MERGED) -> Column:
    """Whether two folded names are one of the pairs that must not be merged."""
    pair = F.concat_ws("\x00", F.least(a, b), F.greatest(a, b))
    return pair.isin(*["\x00".join(sorted(p)) for p in pairs])


def item_rows(baskets: DataFrame, *, basket: str, items: str, evidence: str | None = None) -> DataFrame:
    """(b, i, e): each basket's items once, with the least text that bears an item out, if evidence names a map of them."""
    said = F.try_element_at(F.col(evidence), F.col("i")) if evidence else F.lit(None).cast("string")
    rows = baskets.filter(F.col(basket).isNotNull()).select(F.col(basket).alias("b"), F.explode(items).alias("i"), *([evidence] if evidence else [])).filter("i is not null and trim(i) <> ''")
    return rows.select("b", "i", F.nullif(said, F.lit("")).alias("e")).groupBy("b", "i").agg(F.min("e").alias("e"))


def pair_rows(own: DataFrame, *, part: int = 512) -> DataFrame:
    """(b, source_id, target_id, source_evidence, target_evidence): pairs of items within a basket, from rows (b, i, e).

    A basket of more than `part` items is split into pairs of parts, which go to tasks of
    their own before their pairs are formed.
    """
    sets = own.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("i", "e"))).alias("s")).filter(F.size("s") > 1)
    parts = F.ceil(F.size("s") / part).cast("int")
    cut = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.transform(F.sequence(p, parts - 1), lambda q: F.struct(p.alias("p"), q.alias("q"))))))
    long = sets.filter(F.size("s") > part).select("b", "s", cut.alias("c")).select("b", F.slice("s", F.col("c.p") * part + 1, F.lit(part)).alias("x"), F.slice("s", F.col("c.q") * part + 1, F.lit(part)).alias("y"), "c")
    long = long.repartition("b", "c").drop("c")
    each = sets.filter(F.size("s") <= part).select("b", F.col("s").alias("x"), F.col("s").alias("y")).unionByName(long)
    each = each.select("b", F.explode("x").alias("a"), "y").select("b", "a", F.explode(F.filter("y", lambda z: z["i"] > F.col("a.i"))).alias("z"))
    return each.select("b", F.col("a.i").alias("source_id"), F.col("z.i").alias("target_id"), F.col("a.e").alias("source_evidence"), F.col("z.e").alias("target_evidence"))


def cooccurring_pairs(baskets: DataFrame, *, basket: str, owner: str, items: str, least: int = 1) -> DataFrame:
    """(source_id, target_id, support_jobs, support_companies): pairs of items in baskets.

    An item counts once per basket, an owner once per pair, however many baskets and owners of
    a basket there are. Items held by fewer than `least` baskets are taken out first, which
    changes no result; pairs are summed before they are shuffled.
    """
    own = item_rows(baskets, basket=basket, items=items)
    if least > 1:
        own = own.join(own.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "i", "left_semi")
    owners = baskets.filter(F.col(basket).isNotNull()).groupBy(F.col(basket).alias("b")).agg(F.sort_array(F.collect_set(owner)).alias("o"))
    told = pair_rows(own).select("b", "source_id", "target_id").join(owners, "b").select("source_id", "target_id", F.posexplode_outer("o").alias("k", "o"))
    # in two steps, so that no pair's owners are gathered
    each = told.groupBy("source_id", "target_id", "o").agg(F.count_if(F.coalesce("k", F.lit(0)) == 0).alias("jobs"))
    counted = each.groupBy("source_id", "target_id").agg(F.sum("jobs").alias("support_jobs"), F.count("o").alias("support_companies"))
    return counted.filter(F.col("support_jobs") >= least)


def pair_evidence(baskets: DataFrame, pairs: DataFrame, *, basket: str, items: str, evidence: str, most: int = 3) -> DataFrame:
    """(source_id, target_id, evidence): for some pairs, the first baskets by id that bear out both items, with both texts."""
    wanted = pairs.select("source_id", "target_id").distinct()
    needed = wanted.select(F.explode(F.array("source_id", "target_id")).alias("i")).distinct()
    own = item_rows(baskets, basket=basket, items=items, evidence=evidence).filter("e is not null").join(needed, "i", "left_semi")
    met = pair_rows(own).join(wanted, ["source_id", "target_id"], "left_semi")
    first = met.withColumn("n", F.row_number().over(Window.partitionBy("source_id", "target_id").orderBy("b"))).filter(F.col("n") <= most)
    entry = F.struct(F.col("b").cast("string").alias("basket"), "source_evidence", "target_evidence")
    return first.groupBy("source_id", "target_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", entry.alias("x")))), lambda r: r["x"]).alias("evidence"))


def association(pairs: DataFrame, *, jobs: Column, n: Column, n_source: Column, n_target: Column) -> DataFrame:
    """Pairs with p, lift, pmi and npmi."""
    p = jobs / n
    lift = n * jobs / (n_source * n_target)
    npmi = F.when(p >= 1, 1.0).otherwise(F.ln(lift) / -F.ln(p))
    return pairs.select("*", p.alias("p"), lift.alias("lift"), F.ln(lift).alias("pmi"), npmi.alias("npmi"))


def association_confidence(npmi: Column, lift: Column, jobs: Column, least_npmi: float = 0.15, least_lift: float = 2.0) -> Column:
    """How sure a relation is, from its strength and its support."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.round(0.6 * clip((npmi - least_npmi) / (1 - least_npmi)) + 0.3 * clip((lift - least_lift) / 8.0) + 0.1 * F.least(jobs / 100.0, F.lit(1.0)), 6)


def relation_candidates(
    baskets: DataFrame, *, basket: str, owner: str, items: str, evidence: str | None = None, least_jobs: int = 20, least_companies: int = 5, least_lift: float = 2.0, least_npmi: float = 0.15, neighbours: int = 20
) -> DataFrame:
    """Pairs that clearly exceed chance and are among each other's nearest; lift and npmi to 8 decimals, judged before they are rounded.

    evidence: a map column item -> text; then each pair comes with the first three baskets that
    bear it out.
    """
    total = baskets.select(basket).filter(F.col(basket).isNotNull()).distinct().count()
    counts = cut_lineage(item_rows(baskets, basket=basket, items=items).groupBy("i").agg(F.count(F.lit(1)).alias("n")), "counts")
    pairs = cooccurring_pairs(baskets, basket=basket, owner=owner, items=items, least=least_jobs)
    both = pairs.join(counts.select(F.col("i").alias("source_id"), F.col("n").alias("n_source")), "source_id").join(counts.select(F.col("i").alias("target_id"), F.col("n").alias("n_target")), "target_id")
    scored = association(both, jobs=F.col("support_jobs").cast("double"), n=F.lit(float(total)), n_source=F.col("n_source"), n_target=F.col("n_target"))
    strong = scored.filter((F.col("support_companies") >= least_companies) & (F.col("lift") >= least_lift) & (F.col("npmi") >= least_npmi))
    sure = strong.withColumn("confidence", association_confidence(F.col("npmi"), F.col("lift"), F.col("support_jobs"), least_npmi, least_lift))
    sure = cut_lineage(sure.select("source_id", "target_id", "support_jobs", "support_companies", F.round("lift", 8).alias("lift"), F.round("npmi", 8).alias("npmi"), "confidence"), "relations")
    near = mutual_neighbours(sure, neighbours, source="source_id", target="target_id", order=["confidence", "npmi", "lift", "support_jobs"])
    if evidence is None:
        return near
    near = cut_lineage(near, "neighbours")
    return near.join(pair_evidence(baskets, near, basket=basket, items=items, evidence=evidence), ["source_id", "target_id"], "left")


def cap_degrees(edges: DataFrame, cap: int, *, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) edges, taken in order until an end has `cap` edges.

    The rule is sequential, but an edge doesn't have to wait for all before it: it is taken as
    soon as it stands, among the undecided edges of either end, within what that end may still
    take, and rejected as soon as an end may take none. So each round decides many edges, and
    the first in order at the least; after mutual neighbours of at most `cap` one round does.
    """
    columns = edges.columns
    undecided = cut_lineage(edges, "undecided")
    accepted = rejected = undecided.limit(0)
    while not undecided.isEmpty():
        used = accepted.select(F.explode(F.array("source_id", "target_id")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("used"))
        ends = undecided.withColumn("v", F.explode(F.array("source_id", "target_id")))
        ends = ends.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy(*order, "source_id", "target_id"))).join(used, "v", "left").withColumn("room", F.lit(cap) - F.coalesce("used", F.lit(0)))
        judged = ends.groupBy("source_id", "target_id").agg(F.bool_and(F.col("place") <= F.col("room")).alias("fits"), F.bool_or(F.col("room") <= 0).alias("full"))
        judged = cut_lineage(undecided.join(judged, ["source_id", "target_id"]).select(*columns, "fits", "full"), "judged")
        accepted = cut_lineage(accepted.unionByName(judged.filter("fits").select(*columns)), "accepted")
        rejected = rejected.unionByName(judged.filter("full").select(*columns))
        undecided = judged.filter("not fits and not full").select(*columns)
    return accepted, rejected


def expand(seeds: DataFrame, relations: DataFrame, *, weight: str, limit: int = 160, most_seeds: int = 8) -> DataFrame:
    """(seed, neighbour, weight): one step from each of the first seeds, either way, the strongest first."""
    first = seeds.select("seed").distinct().orderBy("seed").limit(most_seeds)
    ways = relations.select(F.col("source_id").alias("seed"), F.col("target_id").alias("neighbour"), F.col(weight).alias("weight"))
    ways = ways.unionByName(relations.select(F.col("target_id").alias("seed"), F.col("source_id").alias("neighbour"), F.col(weight).alias("weight")))
    return ways.join(F.broadcast(first), "seed").orderBy("seed", F.desc("weight"), "neighbour").limit(limit)


def violations(nodes: DataFrame, edges: DataFrame, *, cutoff: object = None, directed: Sequence[str] = ("REQUIRES_SKILL_OF", "PARENT_OF")) -> DataFrame:
    """(rule, violations): what is wrong with a graph.

    nodes: id, type, status; edges: id, source_id, target_id, type, modified_at, provenance.
    """
    ids = nodes.select(F.col("id").alias("node")).distinct()

    def count(rule: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    repeated = lambda df: df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    loose = lambda end: edges.join(ids, F.col(end) == F.col("node"), "left_anti")
    rules = [
        count("candidate_node", nodes.filter("status = 'candidate'")),
        count("repeated_node", repeated(nodes)),
        count("repeated_edge", repeated(edges)),
        count("missing_source", loose("source_id")),
        count("missing_target", loose("target_id")),
        count("without_provenance", edges.filter("provenance is null or provenance = ''")),
        count("forbidden_type", edges.filter(F.col("type").isin(*directed))),
    ]
    if cutoff is not None:
        rules.append(count("future_edge", edges.filter(F.col("modified_at") > F.lit(cutoff))))
    return reduce(DataFrame.unionByName, rules)


def taxonomy_match(items: DataFrame, taxonomy: DataFrame, *, item: str, levels: dict[str, str], fold, code: str = "CodeNo", names: tuple[str, str, str] = ("CodeNameA", "CodeNameB", "CodeNameC"), codes: Column | None = None) -> DataFrame:
    """(item, code, label): entries of a three-level code table that items name exactly.

    levels: item column -> table column (one of names, finest first). A name of the coarsest
    level counts only for the entry whose names are all equal, of the middle one where the
    finer two are; of several the lowest code.
    """
    fine, middle, coarse = names
    structure = {coarse: (F.col(fine) == F.col(middle)) & (F.col(middle) == F.col(coarse)), middle: F.col(fine) == F.col(middle), fine: F.lit(True)}
    table = []
    for column, of in levels.items():
        rows = taxonomy.filter(structure[of]).select(fold(F.col(of)).alias("name"), F.col(code).alias("code")).filter("name <> ''")
        table.append(rows.groupBy("name").agg(F.min("code").alias("code")).withColumn("level", F.lit(column)))
    lookup = reduce(DataFrame.unionByName, table)
    wanted = items.select(F.col(item).alias("item"), F.explode(F.array(*[F.struct(F.lit(c).alias("level"), fold(F.col(f"`{c}`")).alias("name")) for c in levels])).alias("x")).select("item", "x.*")
    found = wanted.join(lookup, ["level", "name"]).select("item", "code")
    if codes is not None:
        direct = items.select(F.col(item).alias("item"), F.explode(codes).alias("code"))
        found = found.unionByName(direct.join(taxonomy.select(F.col(code).alias("code")), "code", "left_semi").select("item", "code"))
    labels = taxonomy.select(F.col(code).alias("code"), F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names], F.col(code)).alias("label"))
    return found.distinct().join(labels, "code").select("item", "code", "label")


def overlay(items: DataFrame, resolved: DataFrame, edges: DataFrame, *, cutoff: object) -> DataFrame:
    """(item, skills, confidence): items with the skills of edges known up to a cutoff; those without start anew (empty).

    items: item; resolved: item, modified_at; edges: item, skill, confidence.
    """
    eligible = resolved.filter(F.col("modified_at") <= F.lit(cutoff)).select("item").distinct()
    held = edges.join(eligible, "item", "left_semi").groupBy("item", "skill").agg(F.max("confidence").alias("confidence"))
    per = held.groupBy("item").agg(F.sort_array(F.collect_list("skill")).alias("skills"), F.round(F.max("confidence"), 6).alias("confidence"))
    return items.select("item").distinct().join(per, "item", "left").select("item", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def publish(validated: DataFrame, alias_map: DataFrame, *, surface: str, confidence: str) -> DataFrame:
    """(node, surfaces, confidence, new): validated names as nodes, merged with the node that owns them, the highest confidence kept."""
    resolved = resolve_exactly(validated, alias_map, surface=surface)
    target = F.coalesce("node", node_id(F.lit("Skill"), F.col(surface)))
    rows = resolved.filter("decision <> 'AMBIGUOUS'").select(target.alias("node"), F.col(surface).alias("s"), F.col(confidence).alias("c"), F.col("node").isNull().alias("fresh"))
    return rows.groupBy("node").agg(F.countDistinct("s").alias("surfaces"), F.max("c").alias("confidence"), F.bool_and("fresh").alias("new"))


def alias_index_checks(alias_map: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """(check, violations) of an index of names: no blank name, no unknown node, no node without name, no repeated pair."""
    ids = nodes.select(F.col(node).alias("node")).distinct()
    parts = {
        "blank": alias_map.filter("trim(alias) = ''"),
        "unknown_node": alias_map.join(ids, "node", "left_anti"),
        "without_name": ids.join(alias_map.select("node"), "node", "left_anti"),
        "repeated": alias_map.groupBy("alias", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("check"), "violations") for n, df in parts.items()])


def review_packet(relations: DataFrame, labels: DataFrame) -> DataFrame:
    """Relations with their labels, to be reviewed: best supported first within each source."""
    named = relations.join(labels.select(F.col("id").alias("source_id"), F.col("label").alias("source_label")), "source_id").join(labels.select(F.col("id").alias("target_id"), F.col("label").alias("target_label")), "target_id")
    order = Window.partitionBy("source_id").orderBy(F.desc("support_jobs"), "target_id")
    return named.withColumn("review_rank", F.row_number().over(order))


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's column names and types."""
    import hashlib

    return hashlib.sha256(df.schema.json().encode()).hexdigest()


def stage_fingerprint(options: dict, before: str = "") -> str:
    """A hash of a stage's options and of the stage before: the stage has to run again when it changes."""
    import hashlib
    import json

    return hashlib.sha256((before + json.dumps(options, sort_keys=True, ensure_ascii=False)).encode()).hexdigest()


def limited_to(df: DataFrame, **allowed: DataFrame) -> DataFrame:
    """Rows whose value in each named column occurs in the first column of the table given for it."""
    for column, table in allowed.items():
        df = df.join(table.select(F.col(table.columns[0]).alias(column)), column, "left_semi")
    return df


def unknown_values(items: DataFrame, alias_map: DataFrame, *, item: str, owner: str, fields: Sequence[str], split, fold, nothing) -> DataFrame:
    """(item, owner, surface, field): pieces of packed fields that no name of the list is, each once per item.

    split, fold and nothing are column functions: text -> array, text -> folded, text -> boolean.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), split(F.col(f"`{f}`")).alias("values")) for f in fields]))
    pieces = items.select(F.col(item).alias("item"), F.col(owner).alias("owner"), each.alias("x")).select("item", "owner", "x.field", F.explode("x.values").alias("value"))
    named = pieces.filter(~nothing(F.col("value"))).select("item", "owner", "field", fold(F.col("value")).alias("surface")).filter("surface <> ''")
    return named.join(alias_map.select(F.col("alias").alias("surface")).distinct(), "surface", "left_anti").groupBy("item", "owner", "surface").agg(F.min("field").alias("field"))


def lookup_aliases(queries: DataFrame, alias_map: DataFrame, *, query: str, units, named, unit=None, bound: int = 200_000) -> DataFrame:
    """(query, alias, node): names that occur in a query.

    Queries and names meet by equality on a unit of the name, then `named` verifies; all
    are column functions. `unit` gives the one unit of a name that all queries have that
    `named` accepts, by default its least. A small list is broadcast, if it is counted to be small.
    """
    one = unit or (lambda c: F.array_min(units(c)))
    keys = alias_map.select("alias", "node", one(F.col("alias")).alias("unit")).filter("unit is not null")
    asked = queries.select(F.col(query).alias("query")).distinct().select("query", F.explode(units(F.col("query"))).alias("unit"))
    return asked.join(broadcast_if_small(keys, bound), "unit").filter(named(F.col("query"), F.col("alias"))).select("query", "alias", "node")
