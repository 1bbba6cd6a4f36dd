"""Registered queries: model replies, review actions, filters and small column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core as N
from ..operators import curate as Q
from ..operators import graph as G
from ..operators import replies as E
from ..operators import resolve as J
from .fixture import GRAPH_SQL, entities, relationships
from .registry import query, table


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("k", F.col("p_partkey"))


def replies(rows: DataFrame, body: Column, every: int = 7) -> DataFrame:
    """Replies (request_id, reply): every ``every``-th is no JSON, the next one stands in a fence."""
    k = F.col("k")
    fenced = F.concat(F.lit("```json\n"), F.to_json(body), F.lit("\n```"))
    return rows.select(k.alias("request_id"), F.when(k % every == 0, "sorry").when(k % every == 1, fenced).otherwise(F.to_json(body)).alias("reply"))


@query("parse_classifications", """SELECT p_partkey AS request_id, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS primary_category, CASE WHEN p_partkey % 7 > 0 THEN c END AS category, CASE WHEN p_partkey % 7 > 0 THEN x END AS confidence
  FROM (SELECT *, p_brand AS c, 0.75::DOUBLE AS x FROM part UNION ALL SELECT *, p_type, 0.25 FROM part WHERE p_partkey % 7 > 0)""")
def parse_classifications(spark, d):
    one = lambda c, x: F.struct(F.col(c).alias("category"), F.lit(x).alias("confidence"))
    rows = replies(parts(spark, d), F.struct(F.array(one("p_brand", 0.75), one("p_type", 0.25)).alias("classifications"), F.col("p_brand").alias("primary_category")))
    return E.parse_classifications(rows)


@query("parse_summaries", """SELECT p_partkey AS request_id, CASE WHEN g THEN p_name END AS summary, CASE WHEN g THEN p_brand || '/' || p_type END AS points, CASE WHEN g THEN '' END AS themes FROM (SELECT *, p_partkey % 7 > 0 AS g FROM part)""")
def parse_summaries(spark, d):
    body = F.struct(F.col("p_name").alias("summary"), F.array("p_brand", "p_type").alias("key_points"), F.array().cast("array<string>").alias("themes"))
    found = E.parse_summaries(replies(parts(spark, d), body))
    return found.select("request_id", "summary", F.array_join("key_points", "/").alias("points"), F.array_join("themes", "/").alias("themes"))


@query("parse_entity_matches", "SELECT p_partkey AS request_id, 0 AS pos, p_name AS new_name, p_brand AS existing_name, 0.5::DOUBLE AS confidence FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 1, p_type, p_brand, 0.9 FROM part WHERE p_partkey % 7 > 0")
def parse_entity_matches(spark, d):
    one = lambda new, x: F.struct(new.alias("new_name"), F.col("p_brand").alias("existing_name"), F.lit(x).alias("confidence"))
    first = F.when(F.col("k") % 3 > 0, F.col("p_name")).otherwise("")
    return E.parse_entity_matches(replies(parts(spark, d), F.struct(F.array(one(first, 0.5), one(F.col("p_type"), 0.9)).alias("matches"))))


def graph_replies(spark: SparkSession, d: str) -> DataFrame:
    """Node and edge lists, in a box where the key is even; one node without an id, one edge without a type."""
    k, none = F.col("k"), F.lit(None).cast("string")
    nodes = F.array(F.struct(F.lower("p_brand").alias("id"), F.lit("BRAND").alias("type")), F.struct(F.col("p_name").alias("id"), none.alias("type")), F.struct(none.alias("id"), F.lit("x").alias("type")))

    def edge(kind: Column) -> Column:
        return F.struct(F.lower("p_brand").alias("source_node_id"), none.alias("source_node_type"), F.col("p_name").alias("target_node_id"), F.lit("THING").alias("target_node_type"), kind.alias("type"))

    flat = F.to_json(F.struct(nodes.alias("nodes"), F.array(edge(F.lit("made of")), edge(none)).alias("relationships")))
    boxed = F.to_json(F.struct(F.struct(nodes.alias("Items")).alias("nodes"), F.struct(F.array(edge(F.lit("made of")), edge(none)).alias("Items")).alias("relationships")))
    return parts(spark, d).select(k.alias("request_id"), F.when(k % 2 == 0, boxed).otherwise(flat).alias("reply"))


@query("graph_reply_nodes", """SELECT p_partkey AS request_id, 0 AS pos, p_brand AS id, 'Brand' AS type FROM part
  UNION ALL SELECT p_partkey, 1, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), 'Node' FROM part""")
def graph_reply_nodes(spark, d):
    return E.parse_graph_replies(graph_replies(spark, d))[0]


@query("graph_reply_edges", """SELECT p_partkey AS request_id, p_brand AS source, 'Brand' AS source_type, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS target, 'Thing' AS target_type, 'MADE_OF' AS type FROM part""")
def graph_reply_edges(spark, d):
    return E.parse_graph_replies(graph_replies(spark, d))[1].drop("pos")


@query("parse_schema_replies", "SELECT 'label' AS kind, p_brand AS value FROM part WHERE p_partkey % 7 > 0 GROUP BY 2 UNION ALL SELECT 'relationship', p_type FROM part WHERE p_partkey % 7 > 0 GROUP BY 2")
def parse_schema_replies(spark, d):
    return E.parse_schema_replies(replies(parts(spark, d), F.struct(F.array("p_brand").alias("labels"), F.array("p_type").alias("relationshipTypes"))))


@query("to_graph_rows", "SELECT p_partkey AS id, lower(string_split(p_name, ' ')[1]) || upper(string_split(p_name, ' ')[2][1]) || lower(string_split(p_name, ' ')[2][2:]) || '=' || p_size AS props FROM part")
def to_graph_rows(spark, d):
    rows = parts(spark, d).select(F.col("k").alias("id"), F.create_map(F.col("p_name"), F.col("p_size").cast("string")).alias("props"))
    found = E.to_graph_rows(rows, "props")
    return found.select("id", F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("props"))


@query("resolve_action", """SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'view' ELSE CASE event_type WHEN 'signup' THEN 'approve' WHEN 'purchase' THEN 'correct' ELSE 'reject' END || CASE WHEN event_id % 3 = 0 THEN '_relationship' ELSE '_entity' END END AS action, CASE WHEN event_id % 3 = 0 THEN 'r' ELSE 'e' END || user_id AS target_id FROM events""")
def resolve_action(spark, d):
    k, t, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    short = F.when(t == "signup", "approve").when(t == "purchase", "correct").when(t == "error", "reject").when(t == "click", "flag").otherwise(t)
    rows = table(spark, d, "events").select(
        k.alias("seq"), short.alias("action"), F.when(k % 3 > 0, F.concat(F.lit("e"), user)).alias("entity_id"), F.when(k % 3 == 0, F.concat(F.lit("r"), user)).alias("relationship_id"),
    )
    return Q.resolve_action(rows).select("seq", "action", "target_id")


STRICT_SQL = GRAPH_SQL + ", n AS (SELECT entity_id, entity_type FROM e), x AS (SELECT relationship_id, a.entity_type AS st, b.entity_type AS tt, relationship_type FROM r JOIN n a ON a.entity_id = source_entity_id JOIN n b ON b.entity_id = target_entity_id)"


@query("strict_filter", STRICT_SQL + " SELECT entity_id AS id FROM n WHERE entity_type IN ('Location', 'Organization') UNION ALL SELECT relationship_id FROM x WHERE st IN ('Location', 'Organization') AND tt IN ('Location', 'Organization') AND relationship_type = 'LOCATED_IN'")
def strict_filter(spark, d):
    nodes = entities(spark, d).select("entity_id", F.col("entity_type").alias("type"))
    edges = relationships(spark, d).select("relationship_id", "source_entity_id", "target_entity_id", F.col("relationship_type").alias("type"))
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("type").alias(f"{end}_type")), f"{end}_entity_id")
    found = G.strict_filter(nodes, edges, ["LOCATION", "organization"], ["located_in"])
    return found[0].select(F.col("entity_id").alias("id")).unionByName(found[1].select(F.col("relationship_id").alias("id")))


@query("valid_at", """SELECT o_orderkey AS relationship_id FROM orders WHERE (o_orderkey % 5 = 0 OR o_orderdate <= TIMESTAMP '1996-06-01') AND (o_orderkey % 7 = 0 OR o_orderdate + INTERVAL 400 DAY >= TIMESTAMP '1996-06-01')""")
def valid_at(spark, d):
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    span = F.struct(F.when(k % 5 > 0, at).alias("start_date"), F.when(k % 7 > 0, at + F.expr("interval 400 days")).alias("end_date"))
    rows = table(spark, d, "orders").select(k.alias("relationship_id"), span.alias("temporal_validity"))
    return G.valid_at(rows, F.lit("1996-06-01").cast("timestamp")).select("relationship_id")


@query("resolve_fallback", """SELECT s_suppkey AS seq, 'supplier:' || s_suppkey AS source_entity_id, 'nation:' || s_nationkey AS target_entity_id FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 10 >= 7""")
def resolve_fallback(spark, d):
    """Two thirds of the suppliers are named otherwise; decisions of 0.7 and more say who they are."""
    k, one = F.col("s_suppkey"), F.lit(1).alias("document_id")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    other = F.concat(F.lit("the "), F.col("s_name"))
    edges = s.select(one, k.alias("seq"), F.when(k % 3 == 0, F.col("s_name")).otherwise(other).alias("source_name"), F.upper("n_name").alias("target_name"))
    ids = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("entity_id")
    known = s.select(one, F.col("s_name").alias("name"), ids("supplier:", "s_suppkey"), k.alias("seq"))
    known = known.unionByName(table(spark, d, "nation").select(one, F.col("n_name").alias("name"), ids("nation:", "n_nationkey"), F.col("n_nationkey").cast("long").alias("seq")))
    decisions = s.select(one, other.alias("new_name"), ids("supplier:", "s_suppkey").alias("existing_id"), (k % 10 / 10).alias("confidence"))
    return J.resolve_fallback(edges, known, decisions).select("seq", "source_entity_id", "target_entity_id")


@query("column_functions", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN TIMESTAMP '1970-01-01' ELSE date_trunc('second', ts) END AS at, CASE event_id % 2 WHEN 0 THEN 'a=1,status=' ELSE 'a=1,b=2,status=' END || event_type AS notes FROM events""")
def column_functions(spark, d):
    """Times read from text, and annotations set over older ones."""
    k = F.col("event_id")
    text = F.when(k % 3 == 0, "soon").when(k % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    old = F.when(k % 2 == 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("status"), F.lit("old"))).otherwise(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))
    notes = F.array_sort(F.map_entries(N.annotate(old, status=F.col("event_type"))))
    joined = F.array_join(F.transform(notes, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, d, "events").select("event_id", N.parse_ts(text).cast("timestamp_ntz").alias("at"), joined.alias("notes"))
