"""Evidence gathered within verification: source texts up to a cap, and nearest neighbours by vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import annotate, cosine, rel_credit
from ..staging import stage
from .chunking import CONTEXT_CAPS
from .graph import enrich_endpoints
from .vectors import vector_topk, vector_topk_cells
from .verify import Stage, classify_entities, classify_relationships, run_cascade, verify_entities, verify_text

#: Distinct query vectors beyond which an index of cells is searched instead of all pairs, which take a pass over the items for each block of queries.
MANY_QUERIES = 1_000_000


def bounded_context(rows: DataFrame, chunks: DataFrame, id_col: str, most: int, between: str = "\n\n") -> DataFrame:
    """(id, context): texts of each row's ``source_chunk_ids`` in order, joined and cut after ``most`` characters.

    Lengths come first: a chunk's text is fetched only if it, or what stands between it and the one before, begins before the cut, so no row gathers more than that, however many
    chunks it names. Ids without a chunk, and nulls, have no text; a row without any text has no context row.
    """
    places = rows.select(id_col, F.posexplode("source_chunk_ids").alias("pos", "chunk_id"))
    sized = places.join(chunks.select("chunk_id", F.length("content").alias("n")).where("n is not null"), "chunk_id")
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum(F.col("n") + len(between)).over(before), F.lit(0))
    kept = sized.withColumn("begins", begins).where(F.col("begins") < most + len(between)).select(id_col, "pos", "chunk_id")
    held = kept.join(chunks.select("chunk_id", F.substring("content", 1, most).alias("content")), "chunk_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    return held.groupBy(id_col).agg(F.substring(F.array_join(parts, between), 1, most).alias("context"))


def neighbours_of(queries: DataFrame, items: DataFrame, k: int, least: float, skip_self: bool = False) -> DataFrame:
    """The k nearest items of each query of at least that cosine: all pairs for few queries, cells for many; the same result."""
    search = vector_topk if queries.limit(MANY_QUERIES + 1).count() <= MANY_QUERIES else vector_topk_cells
    return search(queries, items, k, least, skip_self)


def verify_by_vectors(
    rows: DataFrame, name_vectors: DataFrame, entity_vectors: DataFrame, edges: DataFrame, k: int = 5, min_score: float = 0.5, least: float = 0.5
) -> DataFrame:
    """The embedding stage of edges, with its searches: adds embedding_confidence and embedding_status.

    ``rows``: relationship_id, relationship_type, source_name, target_name, query_vector (of what the edge says), context_vector (null without a
    context). ``name_vectors``: name, vector. ``entity_vectors``: item_id, vector. ``edges``: source_entity_id, target_entity_id,
    relationship_type and ``vector`` of what the stored edge says. The stage looks up the ``k`` entities nearest to either name, of cosine
    ``min_score`` or more; stored edges from a hit of the source to one of the target are evidence, by type or by how like their vectors are.
    The confidence (4 places) is the best of the cosine of query and context, the hits' scores and the edges' credits; nothing at all gives 0.
    Null names are not looked up; ids are distinct.
    """
    asked = rows.select("relationship_id", F.explode(F.map_from_arrays(F.array(F.lit("source"), F.lit("target")), F.array("source_name", "target_name"))).alias("role", "name")).where("name is not null")
    names = asked.select("name").distinct().join(name_vectors.where("vector is not null"), "name").dropDuplicates(["name"])
    near = neighbours_of(names.select(F.col("name").alias("query_id"), "vector"), entity_vectors, k, min_score)
    hits = asked.join(near.select(F.col("query_id").alias("name"), F.col("item_id").alias("entity_id"), F.round("score", 4).alias("score")), "name")
    best_hit = hits.groupBy("relationship_id").agg(F.max("score").alias("hit_score"))
    source, target = (hits.where(F.col("role") == r).select("relationship_id", F.col("entity_id").alias(f"{r}_entity_id")) for r in ("source", "target"))
    stored = edges.select("source_entity_id", "target_entity_id", F.col("relationship_type").alias("old_type"), F.col("vector").alias("old_vector"))
    # an edge's own hits meet first: k times k pairs at most, however many edges an entity has
    met = source.join(target, "relationship_id").join(stored, ["source_entity_id", "target_entity_id"])
    met = met.join(rows.select("relationship_id", "relationship_type", "query_vector"), "relationship_id")
    credit = rel_credit(cosine(F.col("query_vector"), F.col("old_vector")), F.col("relationship_type") == F.col("old_type"))
    credits = met.groupBy("relationship_id").agg(F.max(F.round(credit, 4)).alias("edge_credit"))
    similarity = F.when(F.col("query_vector").isNotNull() & F.col("context_vector").isNotNull(), cosine(F.col("query_vector"), F.col("context_vector")))
    out = rows.withColumn("similarity", similarity).join(best_hit, "relationship_id", "left").join(credits, "relationship_id", "left")
    best = F.greatest("similarity", "hit_score", "edge_credit")  # nulls are skipped
    out = out.withColumn("embedding_confidence", F.round(F.coalesce(best, F.lit(0.0)), 4)).drop("similarity", "hit_score", "edge_credit")
    return out.withColumn("embedding_status", F.when(F.col("embedding_confidence") >= least, "passed").otherwise("failed"))


def verify_entities_in_graph(entities: DataFrame, chunks: DataFrame, entity_vectors: DataFrame, k: int = 5, min_score: float = 0.55) -> DataFrame:
    """Entities (entity_id, name, aliases, source_chunk_ids, vector) checked against their source texts and the graph's vectors.

    Contexts are the first characters of the source chunks (``bounded_context``), neighbours the ``k`` nearest other entities of ``min_score``
    or more; both go to ``verify_entities``. Gives entity_id, confidence, status, neighbour_id and neighbour_score (null without one). Entities without a
    vector are judged by text alone, those without a source text by vectors alone. Ids are distinct.
    """
    contexts = bounded_context(entities, chunks, "entity_id", CONTEXT_CAPS["entity"], " \n ")
    asked = entities.where("vector is not null").select(F.col("entity_id").alias("query_id"), "vector")
    near = neighbours_of(asked, entity_vectors, k, min_score, skip_self=True).where(F.col("rank") == 1)
    near = near.select(F.col("query_id").alias("entity_id"), F.col("item_id").alias("neighbour_id"), F.col("score").alias("neighbour_score"))
    rows = entities.join(contexts, "entity_id", "left").join(near, "entity_id", "left").withColumn("has_vectors", F.col("vector").isNotNull())
    return verify_entities(rows).select("entity_id", "confidence", "status", "neighbour_id", "neighbour_score")


def verify_documents(
    documents: DataFrame, entities: DataFrame, edges: DataFrame, chunks: DataFrame, entity_vectors: DataFrame, stages: dict[str, Stage] | None = None, conflicts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The verify stage of a run over documents: entities first, then the edges between them; both tables as they are afterwards, and counts.

    What is judged has one of the ``documents`` (document_id) in source_document_ids and no status yet (null, empty or unverified). Entities are
    checked by ``verify_entities_in_graph`` (a table without ``vector`` by text alone). Edges get their ends' names and their source texts as context and
    run through the cascade (``stages``; text match alone by default, as in batches without a model); those among ``conflicts`` (relationship_id)
    are rejected. Judged rows get status, verification_confidence (3 places) and the annotations verification_status and verification_confidence, where the table has a
    map of annotations; all others stay. Counts: kind, status, n. Ids are distinct and not null; without targets nothing changes.
    """
    wanted = documents.select(F.col("document_id").cast("string").alias("document_id")).distinct()

    def targets(df: DataFrame, id_col: str) -> DataFrame:
        fresh = df.where(F.trim(F.coalesce("status", F.lit(""))).isin("", "unverified"))
        named = fresh.select(id_col, F.explode(F.col("source_document_ids").cast("array<string>")).alias("document_id"))
        return fresh.join(named.join(wanted, "document_id", "left_semi").select(id_col).distinct(), id_col, "left_semi")

    def kept(df: DataFrame, judged: DataFrame, id_col: str) -> DataFrame:
        said = judged.select(id_col, F.col("verification_status").alias("said"), F.round("confidence", 3).alias("sure"))
        out = df.drop("verification_confidence").join(said, id_col, "left")
        if "annotations" in df.columns:
            notes = annotate(F.col("annotations"), verification_status=F.col("said"), verification_confidence=F.col("sure"))
            out = out.withColumn("annotations", F.when(F.col("said").isNotNull(), notes).otherwise(F.col("annotations")))
        return out.withColumn("status", F.coalesce("said", "status")).withColumnRenamed("sure", "verification_confidence").drop("said")

    some = targets(entities, "entity_id")
    for name, kind in (("vector", "array<double>"), ("aliases", "array<string>")):
        some = some if name in some.columns else some.withColumn(name, F.lit(None).cast(kind))
    trusts = entities.select("entity_id", F.col("trust").alias("source_trust"))
    first = stage(classify_entities(verify_entities_in_graph(some, chunks, entity_vectors).join(trusts, "entity_id")), "verified-entities")
    nodes = kept(entities, first, "entity_id")

    rows = enrich_endpoints(targets(edges, "relationship_id"), entities).drop("context")
    rows = rows.join(bounded_context(rows, chunks, "relationship_id", CONTEXT_CAPS["verify"]), "relationship_id", "left")
    rows = rows.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("extra_terms", F.array().cast("array<string>"))
    judged = run_cascade(rows.drop("status", "confidence"), stages or {"text": verify_text}).withColumn("source_trust", F.col("trust"))
    against = conflicts.select("relationship_id", F.lit(True).alias("conflict")).distinct() if conflicts is not None else None
    judged = judged.withColumn("conflict", F.lit(False)) if against is None else judged.drop("conflict").join(against, "relationship_id", "left")
    second = stage(classify_relationships(judged).select("relationship_id", "confidence", "verification_status", "reasoning"), "verified-edges")
    counts = None
    for kind, df in (("entity", first), ("relationship", second)):
        n = df.groupBy(F.lit(kind).alias("kind"), F.col("verification_status").alias("status")).agg(F.count("*").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    return nodes, kept(edges, second, "relationship_id"), counts
