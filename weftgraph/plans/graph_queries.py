"""Registered queries over the fixture graph: lookups, filters, joins, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import names as M
from .fixture import GRAPH_SQL, entities, relationships
from .registry import query


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return entities(spark, d), relationships(spark, d)


@query("graph_entities", GRAPH_SQL + "SELECT * FROM e")
def graph_entities(spark, d):
    return entities(spark, d)


@query("graph_relationships", GRAPH_SQL + "SELECT * FROM r")
def graph_relationships(spark, d):
    return relationships(spark, d)


@query("graph_stats", GRAPH_SQL + """SELECT n_entities, n_relationships, 2.0::DOUBLE * n_relationships / n_entities AS average_degree,
  n_relationships / (n_entities::DOUBLE * (n_entities - 1) / 2) AS density
  FROM (SELECT count(*) AS n_entities FROM e), (SELECT count(*) AS n_relationships FROM r)""")
def graph_stats(spark, d):
    return G.graph_stats(*both(spark, d))


@query("entity_type_counts", GRAPH_SQL + "SELECT entity_type, count(*) AS n FROM e GROUP BY 1")
def entity_type_counts(spark, d):
    return G.type_counts(entities(spark, d), "entity_type")


@query("relationship_type_counts", GRAPH_SQL + "SELECT relationship_type, count(*) AS n FROM r GROUP BY 1")
def relationship_type_counts(spark, d):
    return G.type_counts(relationships(spark, d), "relationship_type")


@query("type_breakdown", GRAPH_SQL + """, t AS (SELECT entity_type, count(*) AS n FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
  SELECT entity_type, n, CAST(round_even(n * 100.0 / sum(n) OVER (), 0) AS BIGINT) AS percent FROM t""")
def type_breakdown(spark, d):
    return G.type_breakdown(entities(spark, d), "entity_type")


@query("subgraph_by_type", GRAPH_SQL + """SELECT r.relationship_id, r.strength FROM r
  WHERE source_entity_id IN (SELECT entity_id FROM e WHERE entity_type IN ('Organization', 'Location'))
  AND target_entity_id IN (SELECT entity_id FROM e WHERE entity_type IN ('Organization', 'Location')) AND relationship_type = 'LOCATED_IN'""")
def subgraph_by_type(spark, d):
    return G.filter_graph(*both(spark, d), ["Organization", "Location"], ["LOCATED_IN"])[1].select("relationship_id", "strength")


@query("drop_rejected", GRAPH_SQL + "SELECT entity_id, status FROM e WHERE NOT rejected")
def drop_rejected(spark, d):
    return G.drop_rejected(entities(spark, d)).select("entity_id", "status")


@query("list_entities", GRAPH_SQL + """SELECT entity_id, name, (SELECT count(*) FROM e WHERE entity_type = 'Product') AS total
  FROM e WHERE entity_type = 'Product' ORDER BY entity_id LIMIT 50 OFFSET 100""")
def list_entities(spark, d):
    return G.list_entities(entities(spark, d), "Product", 50, 100).select("entity_id", "name", "total")


@query("list_relationships", GRAPH_SQL + """, x AS (SELECT * FROM r WHERE relationship_type = 'MANUFACTURES' AND source_entity_id = 'supplier:7')
  SELECT relationship_id, strength, (SELECT count(*) FROM x) AS total FROM x ORDER BY relationship_id LIMIT 20""")
def list_relationships(spark, d):
    return G.list_relationships(relationships(spark, d), "MANUFACTURES", "supplier:7", limit=20).select("relationship_id", "strength", "total")


@query("entities_by_type_ordered", GRAPH_SQL + "SELECT name, entity_id, row_number() OVER (ORDER BY name, entity_id) AS place FROM e WHERE entity_type = 'Organization'")
def entities_by_type_ordered(spark, d):
    return G.with_place(entities(spark, d).where("entity_type = 'Organization'").select("name", "entity_id"), ["name", "entity_id"])


@query("lookup_with_missing", GRAPH_SQL + """, w AS (SELECT DISTINCT 'customer:' || user_id AS entity_id FROM events)
  SELECT entity_id, 'found' AS outcome FROM e SEMI JOIN w USING (entity_id) UNION ALL SELECT entity_id, 'missing' FROM w ANTI JOIN e USING (entity_id)""")
def lookup_with_missing(spark, d):
    ids = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("entity_id"))
    found, missing = G.lookup(entities(spark, d), "entity_id", ids)
    return found.select("entity_id", F.lit("found").alias("outcome")).unionByName(missing.select("entity_id", F.lit("missing").alias("outcome")))


@query("facet_graph", GRAPH_SQL + """, s AS (SELECT * FROM e WHERE lower(name) LIKE '%n%' AND upper(entity_type) IN ('ORGANIZATION', 'LOCATION'))
  SELECT relationship_id FROM r WHERE source_entity_id IN (SELECT entity_id FROM s) AND target_entity_id IN (SELECT entity_id FROM s)""")
def facet_graph(spark, d):
    return G.facet_graph(*both(spark, d), "n", ["organization", "location"])[1].select("relationship_id")


_LOCATED_SQL = ", q AS (SELECT entity_id FROM e WHERE entity_type = 'Location')"


def _locations(spark, d):
    return entities(spark, d).where("entity_type = 'Location'").select("entity_id")


@query("entity_relationships", GRAPH_SQL + _LOCATED_SQL + "SELECT relationship_id FROM r WHERE source_entity_id IN (SELECT * FROM q) OR target_entity_id IN (SELECT * FROM q)")
def entity_relationships(spark, d):
    return G.touching(relationships(spark, d), _locations(spark, d)).select("relationship_id")


@query("neighbours", GRAPH_SQL + _LOCATED_SQL + """SELECT entity_id, name FROM e WHERE entity_id IN (SELECT target_entity_id FROM r WHERE source_entity_id IN (SELECT * FROM q)
  UNION SELECT source_entity_id FROM r WHERE target_entity_id IN (SELECT * FROM q))""")
def neighbours(spark, d):
    return G.neighbours(*both(spark, d), _locations(spark, d)).select("entity_id", "name")


@query("unconnected", GRAPH_SQL + """, m AS (SELECT * FROM r WHERE relationship_type = 'MANUFACTURES')
  SELECT entity_id FROM e WHERE entity_id NOT IN (SELECT source_entity_id FROM m UNION SELECT target_entity_id FROM m)""")
def unconnected(spark, d):
    e, r = both(spark, d)
    return G.unconnected(e, r.where("relationship_type = 'MANUFACTURES'")).select("entity_id")


@query("delete_entities", GRAPH_SQL + "SELECT relationship_id FROM r WHERE source_entity_id NOT IN (SELECT entity_id FROM e WHERE rejected) AND target_entity_id NOT IN (SELECT entity_id FROM e WHERE rejected)")
def delete_entities(spark, d):
    e, r = both(spark, d)
    return G.delete_entities(e, r, e.where("rejected"))[1].select("relationship_id")


@query("enrich_endpoints", GRAPH_SQL + """SELECT relationship_id, a.name AS source_name, a.entity_type AS source_type, b.name AS target_name, b.entity_type AS target_type
  FROM r LEFT JOIN e a ON a.entity_id = source_entity_id LEFT JOIN e b ON b.entity_id = target_entity_id""")
def enrich_endpoints(spark, d):
    e, r = both(spark, d)
    return G.enrich_endpoints(r, e).select("relationship_id", "source_name", "source_type", "target_name", "target_type")


@query("dangling_edges", GRAPH_SQL + """SELECT relationship_id FROM r WHERE source_entity_id NOT IN (SELECT entity_id FROM e WHERE status <> 'flagged')
  OR target_entity_id NOT IN (SELECT entity_id FROM e WHERE status <> 'flagged')""")
def dangling_edges(spark, d):
    e, r = both(spark, d)
    return G.check_endpoints(r, e.where("status <> 'flagged'"))[1].select("relationship_id")


@query("similar_by_chars", GRAPH_SQL + """, x AS (SELECT entity_id, lower(name) AS n, entity_type, k FROM e),
  p AS (SELECT a.entity_id AS a_id, b.entity_id AS b_id, CASE WHEN a.n = b.n THEN 1.0 WHEN contains(a.n, b.n) OR contains(b.n, a.n) THEN 0.8
    ELSE len(list_intersect(list_distinct(string_split(a.n, '')), list_distinct(string_split(b.n, '')))) / len(list_distinct(list_concat(string_split(a.n, ''), string_split(b.n, ''))))::DOUBLE END AS s
    FROM x a JOIN x b USING (entity_type) WHERE a.entity_id <> b.entity_id)
  SELECT a_id, b_id, round(s, 6)::DOUBLE AS score FROM p WHERE round(s, 6) >= 0.8""")
def similar_by_chars(spark, d):
    e = entities(spark, d)
    return M.similar_by_chars(e, e)


@query("similar_by_prefix", GRAPH_SQL + """, x AS (SELECT entity_id, lower(name) AS n, entity_type, k FROM e),
  p AS (SELECT a.entity_id AS a_id, b.entity_id AS b_id, CASE WHEN a.n = b.n THEN 1.0 WHEN contains(a.n, b.n) OR contains(b.n, a.n) THEN 0.8
    WHEN contains(b.n, substring(a.n, 1, length(a.n) // 2)) THEN 0.6 ELSE 0.0 END::DOUBLE AS score FROM x a JOIN x b USING (entity_type) WHERE a.entity_id <> b.entity_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rank FROM p WHERE score >= 0.6)
  SELECT a_id, b_id, score, rank FROM k WHERE rank <= 10""")
def similar_by_prefix(spark, d):
    e = entities(spark, d)
    found = M.similar_by_prefix(e, e, 0.6)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("entity_faults", GRAPH_SQL + """SELECT entity_id, CASE WHEN trim(coalesce(name, '')) = '' THEN 'blank name' WHEN entity_type = 'Location' THEN 'unknown type' END AS fault
  FROM (SELECT entity_id, CASE WHEN k % 11 = 0 THEN ' ' ELSE name END AS name, entity_type FROM e)""")
def entity_faults(spark, d):
    rows = entities(spark, d).withColumn("name", F.when(F.col("k") % 11 == 0, " ").otherwise(F.col("name")))
    return G.entity_faults(rows.withColumn("entity_type", F.when(F.col("entity_type") == "Location", "Place").otherwise(F.col("entity_type")))).select("entity_id", "fault")


@query("relationship_faults", GRAPH_SQL + """SELECT relationship_id, CASE WHEN k % 13 = 0 THEN 'self edge' WHEN relationship_type = 'PART_OF' THEN 'unknown type' WHEN k % 17 = 0 THEN 'strength out of range' END AS fault FROM r""")
def relationship_faults(spark, d):
    rows = relationships(spark, d).withColumn(
        "target_entity_id", F.when(F.col("k") % 13 == 0, F.col("source_entity_id")).otherwise(F.col("target_entity_id")),
    )
    rows = rows.withColumn("relationship_type", F.when(F.col("relationship_type") == "PART_OF", "part of").otherwise(F.col("relationship_type")))
    return G.relationship_faults(rows.withColumn("strength", F.when(F.col("k") % 17 == 0, 1.5).otherwise(F.col("strength")))).select(
        "relationship_id", "fault",
    )


@query("coerce_types", GRAPH_SQL + """SELECT entity_id, trim(name) AS name, CASE WHEN entity_type = 'Location' THEN 'Concept' ELSE entity_type END AS entity_type, 'extracted' AS source_trust, 'unverified' AS verification_status
  FROM e WHERE trim(name) <> ''""")
def coerce_types(spark, d):
    rows = (
        entities(spark, d)
        .withColumn("entity_type", F.when(F.col("entity_type") == "Location", "LOCATION").otherwise(F.col("entity_type")))
        .withColumn("name", F.concat(F.lit(" "), "name"))
    )
    return G.coerce_entities(rows).select("entity_id", "name", "entity_type", "source_trust", "verification_status")


#: All edges hold together what the least id reaches; whatever it doesn't reach has no edge in these tables.
REACH_SQL = GRAPH_SQL.replace("WITH e0", "WITH RECURSIVE e0") + """, w AS MATERIALIZED (SELECT source_entity_id AS a, target_entity_id AS b FROM r UNION SELECT target_entity_id, source_entity_id FROM r),
  g AS (SELECT min(entity_id) AS id FROM e UNION SELECT w.b FROM g JOIN w ON w.a = g.id),
  c AS (SELECT entity_id, CASE WHEN entity_id IN (SELECT id FROM g) THEN (SELECT min(entity_id) FROM e) ELSE entity_id END AS component FROM e)"""


@query("components", REACH_SQL + " SELECT * FROM c")
def components(spark, d):
    return G.components(*both(spark, d))


@query("order_chains", "SELECT 'order:' || o_orderkey AS entity_id, min('order:' || o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders")
def order_chains(spark, d):
    """Orders joined to the same customer's next order: chains as long as customers have orders."""
    from pyspark.sql import Window

    node = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(
        node.alias("entity_id"), F.lead(node).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("next"),
    )
    edges = o.where("next is not null").select(
        F.concat_ws(">", "entity_id", "next").alias("relationship_id"), F.col("entity_id").alias("source_entity_id"),
        F.col("next").alias("target_entity_id"),
    )
    return G.components(o.select("entity_id"), edges)


@query("unconnected_page", GRAPH_SQL + """, m AS (SELECT * FROM r WHERE relationship_type = 'MANUFACTURES'),
  u AS (SELECT entity_id FROM e WHERE entity_id NOT IN (SELECT source_entity_id FROM m UNION SELECT target_entity_id FROM m))
  SELECT entity_id, (SELECT count(*) FROM u) AS total FROM u ORDER BY entity_id LIMIT 100""")
def unconnected_page(spark, d):
    e, r = both(spark, d)
    return G.unconnected_page(e, r.where("relationship_type = 'MANUFACTURES'")).select("entity_id", "total")


@query("structure_report", REACH_SQL + """ SELECT (SELECT count(*) FROM e) AS n_entities, (SELECT count(*) FROM r) AS n_relationships, (SELECT count(DISTINCT component) FROM c) AS n_components,
  2.0::DOUBLE * (SELECT count(*) FROM r) / (SELECT count(*) FROM e) AS average_degree""")
def structure_report(spark, d):
    return G.structure_report(*both(spark, d))
