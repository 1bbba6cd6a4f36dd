"""Retrieval: chunk hits gathered by document, with the graph around them; statistics over documents, calls and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import touching


def retrieve_documents(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits (chunk_id, score) by document: texts joined by a rule, best first, the mean score, and the source."""
    rows = hits.join(chunks.select("chunk_id", "document_id", "content"), "chunk_id").join(
        docs.select("document_id", "source_url", "file_name"), "document_id",
    )
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", "content")))
    source = F.when(F.col("source_url").isNull() | F.col("source_url").contains("None"), F.col("file_name")).otherwise(F.col("source_url"))
    return (
        rows.groupBy("document_id", source.alias("source"))
        .agg(F.avg("score").alias("score"), best.alias("held"))
        .select(
            "document_id", "source", "score", F.array_join("held.content", "\n----\n").alias("text"),
            F.array_join("held.chunk_id", ",").alias("chunk_ids"),
        )
    )


def retrieve_with_graph(hits: DataFrame, mentions: DataFrame, edges: DataFrame, entities: DataFrame, k: int = 25) -> DataFrame:
    """Sections of text around hits: the k entities in most hit chunks, and their edges (0 or 1 hops), sorted."""
    seen = hits.join(mentions, "chunk_id").groupBy("entity_id").agg(F.count_distinct("chunk_id").alias("n"))
    top = seen.orderBy(F.desc("n"), "entity_id").limit(k).join(entities, "entity_id").select("entity_id", "name", "entity_type")
    near = touching(edges, F.broadcast(top.select("entity_id"))).select("source_entity_id", "relationship_type", "target_entity_id").distinct()  # top has k rows
    names = entities.select("entity_id", "name")
    near = near.join(names.withColumnsRenamed({"entity_id": "source_entity_id", "name": "s"}), "source_entity_id").join(
        names.withColumnsRenamed({"entity_id": "target_entity_id", "name": "t"}), "target_entity_id",
    )
    a = top.select(F.lit("entities").alias("section"), F.concat_ws(":", "entity_type", "name").alias("line"))
    return a.unionByName(near.select(F.lit("relationships").alias("section"), F.concat_ws(" ", "s", "relationship_type", "t").alias("line"))).distinct()


def processing_stats(docs: DataFrame) -> DataFrame:
    """By status: documents, mean length, summed counters; and the mean over all, weighted by documents."""
    by = docs.groupBy("processing_status").agg(
        F.count("*").alias("n"), F.avg("content_length").alias("avg_length"), F.sum("total_chunks").alias("chunks"),
    )
    every = Window.partitionBy(F.lit(0))
    return by.withColumn("overall_avg", F.sum(F.col("avg_length") * F.col("n")).over(every) / F.sum("n").over(every))


def usage_metrics(calls: DataFrame) -> DataFrame:
    """By call type: calls, tokens, hit rate, and the mean latency of calls that no cache answered."""
    return calls.groupBy("call_type").agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.avg(F.when(~F.col("cached"), F.col("latency"))).alias("avg_latency"),
        (F.count_if("cached") / F.count("*")).alias("hit_rate"),
    )


def batch_summary(docs: DataFrame) -> DataFrame:
    done, failed = F.count_if(F.col("processing_status") == "completed"), F.count_if(F.col("processing_status") == "failed")
    return docs.agg(
        F.count("*").alias("total"), done.alias("processed"), failed.alias("failed"),
        F.when(F.count("*") > 0, done * 100.0 / F.count("*")).otherwise(0.0).alias("success_rate"),
    )


def run_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count_distinct("id", "type").alias("n_nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_relationships"))))  # one row


def cache_stats(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("entries"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


def run_summary(chunks: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for a run: chunks, entities and relationships, and how many of each have which status."""
    def counts(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(
            F.count("*").alias(kind),
            *(F.count_if(F.col("status") == s).alias(f"{kind}_{s}") for s in ("verified", "flagged", "rejected", "unverified")),
        )

    one = chunks.agg(F.count("*").alias("chunks"))
    for kind, df in (("entities", entities), ("relationships", edges)):
        one = one.crossJoin(F.broadcast(counts(df, kind)))  # one row
    return one
