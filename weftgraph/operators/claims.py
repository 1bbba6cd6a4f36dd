"""Claims against the graph: candidates by terms, verification, conflicts; evidence by vectors; small lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import entity_text, rel_credit, search_terms
from .automaton import find_terms
from .graph import check_endpoints, enrich_endpoints
from .verify import classify_entities, classify_relationships, detect_conflicts, verify_cascade, verify_text

def claim_entities(claims: DataFrame, entities: DataFrame, most: int | None = 50) -> DataFrame:
    """(claim_id, entity_id): entities whose name holds a term of the claim; the first ``most`` by id (None: all).

    All terms are found in one pass over the names by an automaton; claims join by the terms that were found.
    """
    terms = (
        claims.select("claim_id", F.explode(search_terms(F.col("text"))).alias("term"))
        .select("claim_id", F.lower("term").alias("term"))
        .distinct()
    )
    hits = find_terms(entities.select("entity_id", F.lower("name").alias("text")), terms, ["entity_id"])
    found = hits.join(terms, "term").select("claim_id", "entity_id")
    found = found.distinct()
    if most is None:
        return found
    nth = F.row_number().over(Window.partitionBy("claim_id").orderBy("entity_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def claim_candidates(claims: DataFrame, entities: DataFrame, edges: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Edges (claim_id, …) that touch an entity of the claim, and the entities at their ends or named by it."""
    named = claim_entities(claims, entities, most)
    by_end = [edges.join(named.select("claim_id", F.col("entity_id").alias(c)), c) for c in ("source_entity_id", "target_entity_id")]
    touched = by_end[0].unionByName(by_end[1]).dropDuplicates(["claim_id", "relationship_id"])
    ends = touched.select("claim_id", F.col("source_entity_id").alias("entity_id")).unionByName(
        touched.select("claim_id", F.col("target_entity_id").alias("entity_id")),
    )
    return touched, named.unionByName(ends).distinct()


def verify_claims(claims: DataFrame, entities: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """Candidate edges of each claim through the text stage and the cascade, with the claim as context: the best ``most``."""
    touched, _ = claim_candidates(claims, entities, edges)
    rows = enrich_endpoints(touched, entities).join(claims.select("claim_id", F.col("text").alias("context")), "claim_id")
    rows = verify_text(rows.withColumn("extra_terms", F.array().cast("array<string>")))
    none = F.lit(None)
    for p in ("embedding", "llm"):
        rows = rows.withColumn(f"{p}_status", none.cast("string")).withColumn(f"{p}_confidence", none.cast("double"))
    rows = verify_cascade(rows.drop("status"))
    nth = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("confidence"), "relationship_id"))
    return rows.withColumn("rank", nth).where(F.col("rank") <= most).select("claim_id", "relationship_id", "confidence", "status", "rank")


def claim_pairs(claims: DataFrame, entities: DataFrame, most: int | None = None) -> DataFrame:
    """(claim_id, a, b): all unordered pairs of the entities that a claim names, or of the first ``most`` of them."""
    n = claim_entities(claims, entities, most)
    return n.select("claim_id", F.col("entity_id").alias("a")).join(n.select("claim_id", F.col("entity_id").alias("b")), "claim_id").where("a < b")


def claim_conflicts(claims: DataFrame, entities: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Conflicts of what claims say of their pairs (as RELATED_TO, with the claim as description) with stored edges."""
    n = claim_entities(claims, entities, most)
    # only pairs that a stored edge joins can conflict, either way round
    ends = (
        edges.select(F.least("source_entity_id", "target_entity_id").alias("a"), F.greatest("source_entity_id", "target_entity_id").alias("b"))
        .where("a < b")
        .distinct()
    )
    named = ends.join(n.select("claim_id", F.col("entity_id").alias("a")), "a").join(
        n.select("claim_id", F.col("entity_id").alias("b")), ["claim_id", "b"],
    )
    pairs = named.join(claims, "claim_id")
    new = pairs.select(
        F.concat_ws("|", F.lit("claim"), "claim_id", "a", "b").alias("relationship_id"), F.col("a").alias("source_entity_id"),
        F.col("b").alias("target_entity_id"), F.lit("RELATED_TO").alias("relationship_type"), F.col("text").alias("description"),
        F.lit("user").alias("trust"),
    )
    return detect_conflicts(new, edges)


def verify_relationships(edges: DataFrame, entities: DataFrame, contexts: DataFrame) -> DataFrame:
    """A verification run over stored edges: the context is the map's entry, else the description, else empty."""
    rows = enrich_endpoints(edges, entities).join(contexts.select("relationship_id", F.col("context").alias("given")), "relationship_id", "left")
    rows = rows.withColumn("context", F.coalesce("given", "description", F.lit(""))).withColumn("extra_terms", F.array().cast("array<string>"))
    rows = verify_text(rows)
    for p in ("embedding", "llm"):
        rows = rows.withColumn(f"{p}_status", F.lit(None).cast("string")).withColumn(f"{p}_confidence", F.lit(None).cast("double"))
    return verify_cascade(rows.drop("status")).select(
        "relationship_id", "confidence", "status",
        F.when(F.col("status") == "passed", "verification_passed").otherwise("verification_failed").alias("flag"),
    )


def verify_embedding(rows: DataFrame, similarity: Column, hits: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """The embedding stage of edges (relationship_id, relationship_type, …): embedding_status and embedding_confidence.

    ``similarity`` is the cosine of query and context (null without a context). ``hits`` (relationship_id, role, entity_id, score)
    are the entities near either end; stored edges from a source hit to a target hit are evidence, by type or by
    ``text_similarity`` where the edge table has it. The confidence is the best of all; without context and hits it fails.
    """
    s = hits.where("role = 'source'").select("relationship_id", F.col("entity_id").alias("source_entity_id"))
    t = hits.where("role = 'target'").select("relationship_id", F.col("entity_id").alias("target_entity_id"))
    like = F.col("text_similarity") if "text_similarity" in edges.columns else F.lit(None).cast("double")
    stored = edges.select("source_entity_id", "target_entity_id", F.col("relationship_type").alias("old_type"), like.alias("like"))
    # an edge's own hits meet first: a few pairs each, however many edges an entity has
    ends = s.join(t, "relationship_id").join(rows.select("relationship_id", "relationship_type"), "relationship_id")
    met = ends.join(stored, ["source_entity_id", "target_entity_id"])
    credit = met.groupBy("relationship_id").agg(
        F.max(F.round(rel_credit(F.col("like"), F.col("old_type") == F.col("relationship_type")), 4)).alias("edge_credit"),
    )
    near = hits.groupBy("relationship_id").agg(F.max("score").alias("hit_score"))
    rows = rows.withColumn("similarity", similarity).join(near, "relationship_id", "left").join(credit, "relationship_id", "left")
    best = F.greatest(F.col("similarity"), F.col("hit_score"), F.col("edge_credit"))  # nulls are skipped
    return rows.withColumn("embedding_confidence", F.round(F.coalesce(best, F.lit(0.0)), 4)).withColumn(
        "embedding_status", F.when(F.col("embedding_confidence") >= least, "passed").otherwise("failed"),
    )


def verification_targets(df: DataFrame, document_id: Column) -> DataFrame:
    """Rows whose provenance holds the document and that nobody has judged yet."""
    fresh = F.trim(F.coalesce("status", F.lit(""))).isin("", "unverified")
    return df.where(F.array_contains("source_document_ids", document_id) & fresh)


def verify_stage(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statuses of judged entities and edges (confidence, source_trust; edges also conflict), confidences to 3 places."""
    return tuple(
        f(df).withColumn("verification_confidence", F.round("confidence", 3)) for f, df in ((classify_entities, entities), (classify_relationships, edges))
    )


def subset_graph(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of the ids and the entities at their ends."""
    some = check_endpoints(edges.join(ids.select("relationship_id").distinct(), "relationship_id", "left_semi"), entities)[0]
    ends = some.select(F.col("source_entity_id").alias("entity_id")).unionByName(some.select(F.col("target_entity_id").alias("entity_id"))).distinct()
    return entities.join(ends, "entity_id", "left_semi"), some


def neighbour_preview(edges: DataFrame, entity_id: str, n: int = 8) -> DataFrame:
    """The first edges that touch an entity."""
    return edges.where((F.col("source_entity_id") == entity_id) | (F.col("target_entity_id") == entity_id)).orderBy("relationship_id").limit(n)


def documents_by_url(docs: DataFrame, part: str) -> DataFrame:
    """Documents whose url holds a text, newest first."""
    return docs.where(F.col("source_url").contains(part)).orderBy(F.desc("created"), "document_id")


def documents_by_status(docs: DataFrame, status: str) -> DataFrame:
    return docs.where(F.col("processing_status") == status).orderBy(F.desc("created"), "document_id")


def document_chunks(chunks: DataFrame, document_id) -> DataFrame:
    """The chunks of a document in order."""
    return chunks.where(F.col("document_id") == document_id).orderBy("chunk_index")


def parse_wiki_url(url: Column) -> tuple[Column, Column]:
    """(page id, language) of an encyclopaedia url; null where it is none."""
    pattern = r"^https?://([a-z]+)\.wikipedia\.org/wiki/([^?#]+)"
    page, lang = F.regexp_extract(url, pattern, 2), F.regexp_extract(url, pattern, 1)
    return F.when(page != "", page), F.when(lang != "", lang)


def crawl_summary(pages: DataFrame) -> DataFrame:
    """Of each job (job_id, status, length): pages, those fetched and failed, characters."""
    return pages.groupBy("job_id").agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("status") == "completed").alias("fetched"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.sum("length").alias("characters"),
    )


def entity_embedding_text(entities: DataFrame) -> DataFrame:
    return entities.select("entity_id", entity_text(F.col("name"), F.col("description")).alias("text"))
