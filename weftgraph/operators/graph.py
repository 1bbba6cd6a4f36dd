"""Lookups, filters, joins and statistics over the pair (entities, relationships)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import valid_types
from ..schemas import ENTITY_TYPES, RELATIONSHIP_TYPES
from ..staging import stage
from .automaton import find_terms
from .joins import join_by_id
from .stars import meet, star_components


def entity_faults(df: DataFrame) -> DataFrame:
    """Rows with a column ``fault``: why the entity is invalid, or null."""
    return df.withColumn(
        "fault", F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "blank name").when(~valid_types("entity_type", ENTITY_TYPES), "unknown type"),
    )


def relationship_faults(df: DataFrame) -> DataFrame:
    """Rows with a column ``fault``: why the relationship is invalid, or null."""
    s, t = (F.coalesce(c, F.lit("")) for c in ("source_entity_id", "target_entity_id"))
    fault = (
        F.when((s == "") | (t == ""), "missing endpoint")
        .when(s == t, "self edge")
        .when(~valid_types("relationship_type", RELATIONSHIP_TYPES), "unknown type")
    )
    return df.withColumn("fault", fault.when(F.col("strength").isNull() | (F.col("strength") < 0) | (F.col("strength") > 1), "strength out of range"))


def chunk_faults(df: DataFrame) -> DataFrame:
    """Chunks with counts filled in and a column ``fault``."""
    filled = df.withColumn("character_count", F.coalesce(F.when(F.col("character_count") > 0, F.col("character_count")), F.length("content"))).withColumn("end_position", F.coalesce(F.when(F.col("end_position") > 0, F.col("end_position")), F.col("start_position") + F.length("content")))
    return filled.withColumn(
        "fault",
        (
            F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty content")
            .when(F.col("document_id").isNull(), "missing document")
            .when(F.col("chunk_index") < 0, "negative index")
        ),
    )


def document_faults(df: DataFrame) -> DataFrame:
    fault = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "blank title").when(F.coalesce("source_url", "file_path").isNull(), "no url or path")
    return df.withColumn(
        "fault",
        fault.when(F.col("content_length") < 0, "negative length").when(
            F.col("processed_chunks") > F.col("total_chunks"), "more processed than total",
        ),
    )


def coerce_entities(df: DataFrame) -> DataFrame:
    """Trim names, drop blank ones, give unknown types the type Concept and set trust and status of extracted rows."""
    kept = df.withColumn("name", F.trim("name")).where("name <> ''")
    kind = F.when(valid_types("entity_type", ENTITY_TYPES), F.col("entity_type")).otherwise("Concept")
    return kept.withColumn("entity_type", kind).withColumn("source_trust", F.lit("extracted")).withColumn("verification_status", F.lit("unverified"))


def coerce_relationships(df: DataFrame) -> DataFrame:
    kind = F.when(valid_types("relationship_type", RELATIONSHIP_TYPES), F.col("relationship_type")).otherwise("RELATED_TO")
    return df.withColumn("relationship_type", kind).withColumn("strength", F.coalesce(F.col("confidence"), F.lit(1.0)))


def strict_filter(nodes: DataFrame, edges: DataFrame, node_types: list[str], edge_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of allowed types (case ignored); an empty list allows all."""

    def allowed(c: str, kinds: list[str]) -> Column:
        return F.lower(c).isin(*[k.lower() for k in kinds]) if kinds else F.lit(True)

    ends = allowed("source_type", node_types) & allowed("target_type", node_types)
    return nodes.where(allowed("type", node_types)), edges.where(ends & allowed("type", edge_types))


def check_endpoints(edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose two ends exist, and the dangling ones."""
    ids = entities.select("entity_id").distinct()
    found = edges
    for end in ("source", "target"):
        found = found.join(ids.select(F.col("entity_id").alias(f"{end}_entity_id"), F.lit(True).alias(f"has_{end}")), f"{end}_entity_id", "left")
    both = F.col("has_source").isNotNull() & F.col("has_target").isNotNull()
    inside = edges
    for end in ("source", "target"):
        inside = join_by_id(inside, ids.select(F.col("entity_id").alias(f"{end}_entity_id")), f"{end}_entity_id", "left_semi")
    return inside, found.where(~both).select(*edges.columns)


def filter_graph(entities: DataFrame, edges: DataFrame, entity_types: list[str] | None = None, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The induced subgraph of some entity types, then edges of some types."""
    kept = entities.where(F.col("entity_type").isin(entity_types)) if entity_types else entities
    inside = check_endpoints(edges, kept)[0]
    return kept, inside.where(F.col("relationship_type").isin(edge_types)) if edge_types else inside


def drop_rejected(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("rejected"), F.lit(False)))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page in a fixed order, with the total on each row."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def with_place(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in an order of the whole table, which no task sorts alone.

    Range partitions hold neighbouring rows; their totals, one row each, give the place at which each partition starts.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    spread = stage(spread, "places").withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return spread.join(F.broadcast(starts), "_part").select(*df.columns, place.alias(name))


def list_entities(entities: DataFrame, entity_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(entities.where(F.col("entity_type") == entity_type) if entity_type else entities, ["entity_id"], limit, offset)


def list_relationships(edges: DataFrame, kind: str | None = None, source: str | None = None, target: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    for c, v in (("relationship_type", kind), ("source_entity_id", source), ("target_entity_id", target)):
        edges = edges.where(F.col(c) == v) if v else edges
    return page(edges, ["relationship_id"], limit, offset)


def lookup(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the wanted ids, and the ids that are missing."""
    wanted = ids.select(id_col).distinct()
    return df.join(wanted, id_col, "left_semi"), wanted.join(df, id_col, "left_anti")


def valid_at(edges: DataFrame, moment: Column) -> DataFrame:
    """Edges valid at a moment: ends are inclusive, an absent end or interval is open."""
    a, z = F.col("temporal_validity.start_date"), F.col("temporal_validity.end_date")
    return edges.where((a.isNull() | (a <= moment)) & (z.isNull() | (z >= moment)))


def match_rules(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """(chunk_id, rule_id) where a pattern or keyword of a rule is a substring of the content.

    Terms that ignore case are looked for in lower case; each kind takes one pass over the chunks by an automaton. A null
    ``case_sensitive`` counts as false.
    """
    none = F.array().cast("array<string>")
    terms = rules.select(
        "rule_id", F.coalesce("case_sensitive", F.lit(False)).alias("exact"),
        F.explode(F.array_union(F.coalesce("patterns", none), F.coalesce("keywords", none))).alias("term"),
    )
    terms = terms.withColumn("term", F.when(F.col("exact"), F.col("term")).otherwise(F.lower("term"))).distinct()
    found = None
    for exact in (False, True):
        some = terms.where(F.col("exact") == exact).select("rule_id", "term")
        text = F.col("content") if exact else F.lower("content")
        hits = find_terms(chunks.select("chunk_id", text.alias("text")), some, ["chunk_id"]).join(some, "term").select("chunk_id", "rule_id")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def facet_graph(entities: DataFrame, edges: DataFrame, text: str, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities whose name holds the text, of some types (case ignored), and the edges among them."""
    seen = entities.where(F.lower("name").contains(text.lower()))
    seen = seen.where(F.upper("entity_type").isin(*[t.upper() for t in types])) if types else seen
    return seen, check_endpoints(edges, seen)[0]


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among the ids, once each; two equi-joins instead of one on a disjunction."""
    a = edges.join(ids.select(F.col("entity_id").alias("source_entity_id")), "source_entity_id", "left_semi")
    b = edges.join(ids.select(F.col("entity_id").alias("target_entity_id")), "target_entity_id", "left_semi")
    return a.unionByName(b).dropDuplicates(["relationship_id"])


def neighbours(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities joined to any of the ids by an edge of either direction."""
    ways = F.array(
        F.struct(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b")),
        F.struct(F.col("target_entity_id").alias("a"), F.col("source_entity_id").alias("b")),
    )
    both = edges.select(F.explode(ways).alias("way")).select("way.*")
    near = both.join(ids.select(F.col("entity_id").alias("a")), "a", "left_semi").select(F.col("b").alias("entity_id")).distinct()
    return entities.join(near, "entity_id", "left_semi")


def unconnected_page(entities: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """The first unconnected entities by id, with the number of all of them on each row."""
    return page(unconnected(entities, edges), ["entity_id"], limit)


def unconnected(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities without an edge to another entity."""
    real = edges.where("source_entity_id <> target_entity_id")
    # both ends of an edge come from one reading of it
    ends = real.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).distinct()
    return entities.join(ends, "entity_id", "left_anti")


def delete_entities(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids and the edges that touch them."""
    kept = entities.join(ids.select("entity_id"), "entity_id", "left_anti")
    for c in ("source_entity_id", "target_entity_id"):
        edges = edges.join(ids.select(F.col("entity_id").alias(c)), c, "left_anti")
    return kept, edges


def enrich_endpoints(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names and types of their ends; null where an end is missing."""
    for end in ("source", "target"):
        side = entities.select(
            F.col("entity_id").alias(f"{end}_entity_id"), F.col("name").alias(f"{end}_name"), F.col("entity_type").alias(f"{end}_type"),
        )
        edges = join_by_id(edges, side, f"{end}_entity_id", "left")
    return edges


def graph_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, average degree 2R/E and density R/(E(E-1)/2)."""
    e, r = entities.agg(F.count("*").alias("n_entities")), edges.agg(F.count("*").alias("n_relationships"))
    n, m = F.col("n_entities"), F.col("n_relationships")
    return e.crossJoin(F.broadcast(r)).select(
        "n_entities", "n_relationships", F.when(n > 0, 2.0 * m / n).otherwise(0.0).alias("average_degree"),
        F.when(n > 1, m / (n.cast("double") * (n - 1) / 2)).otherwise(0.0).alias("density"),
    )


def type_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def type_breakdown(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The k most frequent types with their rounded percentage of what is shown."""
    top = type_counts(df, column).orderBy(F.desc("n"), column).limit(k)
    return top.withColumn("percent", F.bround(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0)))).cast("long"))


def components(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, component): the smallest id that edges between the entities reach, however long the way.

    Rounds go over 64-bit hashes of the ids; should two ids have the same hash, they go over the ids.
    """
    ids = stage(entities.select("entity_id").distinct().withColumn("node", F.xxhash64("entity_id")), "ids")
    inside = edges.select("source_entity_id", "target_entity_id")
    for end in ("source", "target"):
        inside = join_by_id(inside, ids.select(F.col("entity_id").alias(f"{end}_entity_id")), f"{end}_entity_id", "left_semi")
    if ids.where("entity_id is not null").groupBy("node").agg(F.count("*").alias("n")).where("n > 1").take(1):
        ids, hashed = ids.withColumn("node", F.col("entity_id")), F.col
    else:
        hashed = F.xxhash64
    roots = star_components(inside.select(hashed("source_entity_id").alias("a"), hashed("target_entity_id").alias("b")))
    held = ids.where("entity_id is not null").join(roots, "node")
    least = held.groupBy("root").agg(F.min("entity_id").alias("component"), F.count("*").alias("n"))
    named = meet(held.select("node", "root"), least, "root").select("node", "component")
    rows = entities.select("entity_id", hashed("entity_id").alias("node")).join(named, "node", "left")
    return rows.select("entity_id", F.coalesce("component", "entity_id").alias("component"))


def structure_report(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, connected components, average degree."""
    parts = components(entities, edges).agg(F.countDistinct("component").alias("n_components"))
    return graph_stats(entities, edges).crossJoin(F.broadcast(parts)).select("n_entities", "n_relationships", "n_components", "average_degree")
