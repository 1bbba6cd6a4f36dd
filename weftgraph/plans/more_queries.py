"""Registered queries: validity and coercion, provenance, decisions, retrieval with the graph, progress, stores, reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as N
from ..operators import chunking as C
from ..operators import graph as G
from ..operators import pages as P
from ..operators import resolve as J
from ..operators import retrieve as A
from ..operators import sinks as K
from ..operators import verify as W
from .fixture import GRAPH_SQL, entities, relationships
from .kg_queries import CASCADE_SQL, CONFLICT_SQL, cascaded, conflicts
from .registry import query, table


@query("strip_bad_chars", "SELECT doc_id, replace(replace(replace(text, chr(10), ' '), chr(34), ''), chr(39), '') AS stripped FROM documents")
def strip_bad_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", N.strip_bad_chars(F.col("text")).alias("stripped"))


@query("chunk_faults", """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE text END AS content, CASE WHEN doc_id % 11 <> 0 THEN source END AS document_id, doc_id % 5 - 1 AS chunk_index, CASE WHEN doc_id % 3 = 0 THEN 7 ELSE 0 END AS character_count, CASE WHEN doc_id % 2 = 0 THEN 9 END AS end_position FROM documents)
  SELECT doc_id, CASE WHEN character_count > 0 THEN character_count ELSE length(content) END AS character_count, CASE WHEN end_position > 0 THEN end_position ELSE 3 + length(content) END AS end_position,
  CASE WHEN trim(coalesce(content, '')) = '' THEN 'empty content' WHEN document_id IS NULL THEN 'missing document' WHEN chunk_index < 0 THEN 'negative index' END AS fault FROM c""")
def chunk_faults(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(k % 7 == 0, " ").otherwise(F.col("text")).alias("content"), F.when(k % 11 != 0, F.col("source")).alias("document_id"), (k % 5 - 1).alias("chunk_index"),
        F.when(k % 3 == 0, 7).otherwise(0).alias("character_count"), F.when(k % 2 == 0, 9).alias("end_position"), F.lit(3).alias("start_position"),
    )
    return G.chunk_faults(rows).select("doc_id", F.col("character_count").cast("long"), F.col("end_position").cast("long"), "fault")


@query("document_faults", """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'blank title' WHEN page_id % 5 = 0 THEN 'no url or path' WHEN page_id % 11 = 0 THEN 'negative length' WHEN page_id % 13 = 0 THEN 'more processed than total' END AS fault FROM pages""")
def document_faults(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(
        "page_id", F.when(k % 7 == 0, " ").otherwise("t").alias("title"), F.when(k % 5 != 0, F.col("url")).alias("source_url"), F.lit(None).cast("string").alias("file_path"),
        F.when(k % 11 == 0, -1).otherwise(F.length("html")).alias("content_length"), F.when(k % 13 == 0, 5).otherwise(2).alias("processed_chunks"), F.lit(3).alias("total_chunks"),
    )
    return G.document_faults(rows).select("page_id", "fault")


@query("coerce_relationships", GRAPH_SQL + "SELECT relationship_id, CASE WHEN relationship_type IN ('PART_OF') OR relationship_type = 'LOCATED_IN' AND k % 2 = 0 THEN 'RELATED_TO' ELSE relationship_type END AS relationship_type, CASE WHEN k % 3 = 0 THEN 1.0 ELSE strength END::DOUBLE AS strength FROM r")
def coerce_relationships(spark, d):
    t = F.col("relationship_type")
    rows = (
        relationships(spark, d)
        .withColumn(
            "relationship_type", F.when(t == "PART_OF", "part of").when((t == "LOCATED_IN") & (F.col("k") % 2 == 0), "located_in").otherwise(t),
        )
        .withColumn("confidence", F.when(F.col("k") % 3 != 0, F.col("strength")))
    )
    return G.coerce_relationships(rows).select("relationship_id", "relationship_type", "strength")


@query("page_acceptable", "SELECT page_id, page_id % 3 < 2 AND octet_length(encode(html)) <= 4000 AS ok FROM pages")
def page_acceptable(spark, d):
    kind = (
        F.when(F.col("page_id") % 3 == 0, "Text/HTML; charset=utf-8")
        .when(F.col("page_id") % 3 == 1, "application/xhtml+xml")
        .otherwise("image/png")
    )
    return table(spark, d, "pages").select("page_id", P.page_acceptable(kind, F.octet_length("html"), ["html", "text/plain"], 4000).alias("ok"))


@query("allowed_by_list", "SELECT page_id, regexp_matches(url, '^https?://(www\\.)?([^/]+\\.)?example\\.com([/?#:]|$)') AS ok FROM pages")
def allowed_by_list(spark, d):
    return table(spark, d, "pages").select("page_id", P.domain_allowed(F.col("url"), ["example.com"], ["elsewhere.org"]).alias("ok"))


@query("has_entity_edges", "SELECT DISTINCT 'c' || l_orderkey AS src_id, 'part:' || l_partkey AS dst_id, 'HAS_ENTITY' AS edge_type FROM lineitem")
def has_entity_edges(spark, d):
    li = table(spark, d, "lineitem").select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("entity_id"),
        F.array(F.concat(F.lit("c"), F.col("l_orderkey").cast("string"))).alias("source_chunk_ids"),
    )
    return C.has_entity_edges(li)


@query("provenance_edges", "SELECT 'customer:' || o_custkey AS src_id, 'c' || o_orderkey AS dst_id, 'EXTRACTED_FROM' AS edge_type FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def provenance_edges(spark, d):
    chunk = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("entity_id"), F.array(chunk).alias("source_chunk_ids"),
        F.when(F.col("o_orderstatus") == "F", F.array(chunk)).alias("old_chunk_ids"),
    )
    chunks = table(spark, d, "lineitem").where("l_linenumber = 2").select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("chunk_id"))
    return C.provenance_edges(rows, "entity_id", "EXTRACTED_FROM", chunks)


@query("apply_rel_decisions", """WITH s AS (SELECT l_suppkey AS a, l_partkey AS b, list('r' || l_orderkey || '-' || l_linenumber ORDER BY 'r' || l_orderkey || '-' || l_linenumber) AS c FROM lineitem GROUP BY 1, 2)
  SELECT 'n' || a || '-' || b AS relationship_id, CASE WHEN (a + b) % 4 < len(c) AND a % 3 > 0 THEN c[(a + b) % 4 + 1] END AS duplicate_id FROM s""")
def apply_rel_decisions(spark, d):
    pair = F.concat(F.lit("n"), F.concat_ws("-", "l_suppkey", "l_partkey")).alias("relationship_id")
    li = table(spark, d, "lineitem").select(
        pair, "l_suppkey", "l_partkey", F.concat(F.lit("r"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("old"),
    )
    candidates = li.groupBy("relationship_id", "l_suppkey", "l_partkey").agg(F.array_sort(F.collect_set("old")).alias("candidates"))
    decisions = candidates.select(
        "relationship_id", ((F.col("l_suppkey") + F.col("l_partkey")) % 4).cast("int").alias("duplicate_of"),
        F.when(F.col("l_suppkey") % 3 > 0, 0.7).otherwise(0.69).alias("confidence"),
    )
    return J.apply_rel_decisions(candidates.select("relationship_id"), candidates, decisions)


@query("upsert_stored_relationships", """WITH x AS (SELECT 'customer:' || o_custkey AS s, 'nation:' || c_nationkey AS d, o_orderkey AS seq, o_orderkey % 3 = 0 AS old, least(1.0, o_totalprice / 1000000) AS p, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS description FROM orders JOIN customer ON c_custkey = o_custkey),
  o AS (SELECT *, CASE WHEN old THEN seq - 1000000000 ELSE seq END AS o FROM x), t AS (SELECT s, d, 't' || (seq % 5) AS tag, min(o) AS o FROM o GROUP BY 1, 2, 3), g AS (SELECT s, d, string_agg(tag, ',' ORDER BY o) AS tags FROM t GROUP BY 1, 2)
  SELECT o.s AS source_entity_id, o.d AS target_entity_id, 'o' || arg_min(seq, o) AS relationship_id, arg_max(p, o)::DOUBLE AS strength, arg_max(description, o) FILTER (WHERE description IS NOT NULL) AS description, max(tags) AS tags,
  arg_max('q' || seq, o) AS note, CAST(max(CASE WHEN old THEN 4 ELSE 0 END) + count(*) FILTER (WHERE NOT old) AS BIGINT) AS version FROM o JOIN g ON g.s = o.s AND g.d = o.d GROUP BY 1, 2""")
def upsert_stored_relationships(spark, d):
    """Stored and new edges of one pair, with descriptions, tags and a map."""
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("source_entity_id"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("target_entity_id"), F.lit("LOCATED_IN").alias("relationship_type"),
        F.concat(F.lit("o"), k.cast("string")).alias("relationship_id"), k.alias("seq"), (k % 3 == 0).alias("old"), F.least(F.lit(1.0), F.col("o_totalprice") / 1000000).alias("strength"),
        F.when(k % 4 != 0, F.col("o_orderpriority")).alias("description"), F.array(F.concat(F.lit("t"), (k % 5).cast("string"))).alias("tags"), F.create_map(F.lit("note"), F.concat(F.lit("q"), k.cast("string"))).alias("properties"), F.lit(4).alias("version"),
    )
    u = J.upsert_relationships(
        x.where("old").withColumn("seq", F.col("seq") - 1000000000).drop("old"), x.where("not old").drop("old"), entities(spark, d),
    )
    return u.select(
        "source_entity_id", "target_entity_id", "relationship_id", "strength", "description", F.array_join("tags", ",").alias("tags"),
        F.col("properties")["note"].alias("note"), F.col("version").cast("long").alias("version"),
    )


@query("merge_pairs", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS entity_id, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(da, db) ELSE coalesce(db, da) END AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'vb' ELSE 'va' END AS v,
  CASE WHEN o_orderstatus < o_orderpriority THEN o_orderstatus || ',' || o_orderpriority ELSE o_orderpriority || ',' || o_orderstatus END AS aliases
  FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'da' END AS da, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'db' END AS db FROM orders)""")
def merge_pairs(spark, d):
    k = F.col("o_orderkey")

    def side(name, confidence, n, alias):
        return F.struct(
            F.lit(name).alias("entity_id"), F.lit(name.upper()).alias("name"), F.lit("Concept").alias("entity_type"), F.when(k % n != 0, "d" + name).alias("description"), confidence.alias("confidence"),
            F.array(alias).alias("aliases"), F.array(F.lit("c" + name)).alias("source_chunk_ids"), F.create_map(F.lit("v"), F.lit("v" + name)).alias("properties"),
        ).alias(name)

    rows = table(spark, d, "orders").select(
        "o_orderkey", side("a", F.lit(0.5), 3, "o_orderstatus"), side("b", F.when(k % 2 == 0, 0.5).otherwise(0.6), 5, "o_orderpriority"),
    )
    merged = J.merge_pairs(
        rows.select("a", "b", "o_orderkey").withColumn("a", F.struct("a.*", "o_orderkey")).withColumn("b", F.struct("b.*", "o_orderkey")),
    )
    return merged.select("o_orderkey", "entity_id", "description", F.col("properties")["v"].alias("v"), F.array_join("aliases", ",").alias("aliases"))


@query("retrieve_with_graph", GRAPH_SQL + """, h AS (SELECT DISTINCT l_orderkey AS c, 'part:' || l_partkey AS entity_id FROM lineitem WHERE l_orderkey % 100 = 0),
  t AS (SELECT entity_id, name, entity_type FROM e JOIN (SELECT entity_id, count(*) AS n FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25) USING (entity_id))
  SELECT 'entities' AS section, entity_type || ':' || name AS line FROM t UNION SELECT 'relationships', a.name || ' ' || relationship_type || ' ' || b.name FROM r JOIN e a ON a.entity_id = source_entity_id JOIN e b ON b.entity_id = target_entity_id
  WHERE source_entity_id IN (SELECT entity_id FROM t) OR target_entity_id IN (SELECT entity_id FROM t)""")
def retrieve_with_graph(spark, d):
    li = table(spark, d, "lineitem")
    mentions = li.select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("entity_id"))
    hits = table(spark, d, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("chunk_id"))
    return A.retrieve_with_graph(hits, mentions, relationships(spark, d), entities(spark, d), 25)


@query("run_counts", "SELECT (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type FROM part)) AS n_nodes, (SELECT count(*) FROM lineitem) AS n_relationships")
def run_counts(spark, d):
    return A.run_counts(table(spark, d, "part").select(F.col("p_brand").alias("id"), F.col("p_type").alias("type")), table(spark, d, "lineitem"))


@query("progress_pct", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN (user_id % 5) / (event_id % 7)::DOUBLE * 100 ELSE 0.0 END AS pct FROM events")
def progress_pct(spark, d):
    return table(spark, d, "events").select("event_id", N.progress_pct(F.col("user_id") % 5, F.col("event_id") % 7).alias("pct"))


@query("delete_documents", "SELECT doc_id AS document_id, 'document' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT conv_id, 'chunk' FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(spark, d):
    docs, chunks = table(spark, d, "documents").select(F.col("doc_id").alias("document_id")), table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"))
    kept = K.delete_documents(docs, chunks, table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id")))
    return kept[0].withColumn("kind", F.lit("document")).unionByName(kept[1].withColumn("kind", F.lit("chunk")))


@query("rel_texts", GRAPH_SQL + "SELECT relationship_id, concat_ws(' ', a.name, relationship_type, b.name, CASE WHEN r.description <> '' THEN r.description END) AS text FROM r JOIN e a ON a.entity_id = source_entity_id JOIN e b ON b.entity_id = target_entity_id")
def rel_texts(spark, d):
    rows = G.enrich_endpoints(relationships(spark, d), entities(spark, d))
    return rows.select(
        "relationship_id", N.rel_text(F.col("source_name"), F.col("relationship_type"), F.col("target_name"), F.col("description")).alias("text"),
    )


@query("list_reviews", CONFLICT_SQL + """, q AS (SELECT sha1(concat_ws(':', new_relationship_id, old_relationship_id)) AS review_id, md5(old_relationship_id) AS created FROM c WHERE conflict_type IS NOT NULL),
  z AS (SELECT *, CASE WHEN review_id < '4' THEN 'approved' WHEN review_id < '8' THEN 'rejected' ELSE 'pending' END AS review_status FROM q) SELECT review_id, review_status FROM z WHERE review_status = 'rejected' ORDER BY created DESC, review_id LIMIT 50 OFFSET 10""")
def list_reviews(spark, d):
    q = W.enqueue_reviews(conflicts(spark, d)).withColumn("created", F.md5("old_relationship_id"))
    decided = q.where("review_id < '8'").select(
        "review_id", F.when(F.col("review_id") < "4", "approve").otherwise("reject").alias("decision"), F.lit("seen").alias("notes"),
    )
    return W.list_reviews(W.decide_reviews(q, decided), "rejected", 50, 10).select("review_id", "review_status")


@query("report_rows", CASCADE_SQL + " SELECT y.doc_id AS relationship_id, y.status, y.confidence, concat_ws(',', 'text_match', CASE WHEN es IS NOT NULL THEN 'embedding' END, CASE WHEN ls IS NOT NULL THEN 'llm' END) AS stages FROM y JOIN w USING (doc_id)")
def report_rows(spark, d):
    rows = K.report_rows(cascaded(spark, d).withColumn("relationship_id", F.col("doc_id")))
    return rows.select("relationship_id", "status", "confidence", F.array_join("stages.stage", ",").alias("stages"))


@query("reembed")
def reembed(spark, d):
    """Vectors of all entities by the default column function."""
    from ..operators.vectors import hashed_embedding
    from ..operators.vectors import reembed as again

    rows = entities(spark, d).select("entity_id", N.entity_text(F.col("name"), F.col("description")).alias("text"))
    return again(rows, F.col("text"), hashed_embedding)

