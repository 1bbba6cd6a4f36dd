"""Exports, stores and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TERMINAL_JOBS
from ..sources.document_writer import write_document
from .graph import check_endpoints, drop_rejected

# Colours of nodes by type, and of any other.
COLOURS = {
    "Person": "#4C9BE8", "Organization": "#E87B4C", "Location": "#4CE87B", "Product": "#E8D44C", "Technology": "#9B4CE8", "Concept": "#4CE8D4",
    "Event": "#E84C9B", "Document": "#A0A0A0", "Category": "#E8A04C", "Brand": "#4CA0E8", "Feature": "#A0E84C", "Specification": "#E84CA0",
}
DEFAULT_COLOUR = "#CCCCCC"


def colour(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in COLOURS.items() for x in p]), kind), F.lit(DEFAULT_COLOUR))


def encode_props(df: DataFrame, maps: list[str]) -> DataFrame:
    """Map columns as JSON text, without null values; empty maps become null."""
    for c in maps:
        kept = F.map_filter(c, lambda k, v: v.isNotNull())
        df = df.withColumn(c, F.when(F.size(kept) > 0, F.to_json(kept)))
    return df


def decode_props(df: DataFrame, maps: list[str]) -> DataFrame:
    """JSON text back to maps; what can't be read becomes an empty map."""
    for c in maps:
        df = df.withColumn(c, F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")))
    return df


def visible(entities: DataFrame, edges: DataFrame, include_rejected: bool = False) -> tuple[DataFrame, DataFrame]:
    """What exports show: nodes that are not rejected, and such edges between shown nodes."""
    if not include_rejected:
        entities, edges = drop_rejected(entities), drop_rejected(edges)
    return entities, check_endpoints(edges, entities)[0]


def _flag(df: DataFrame, name: str) -> Column:
    """A flag that a table may lack; without it, or where it is null, it is false."""
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def export_cytoscape(entities: DataFrame, edges: DataFrame, include_rejected: bool = False) -> DataFrame:
    """Element rows: group, id, label, type, source, target, strength, colour, description, curated, rejected, properties.

    ``properties`` is a node's map where the table has one; edges have neither it nor ``rejected``. Flags that a table lacks are false.
    """
    e, r = visible(entities, edges, include_rejected)
    props = F.col("properties") if "properties" in e.columns else F.lit(None).cast("map<string,string>")
    nodes = e.select(
        F.lit("nodes").alias("group"), F.col("entity_id").alias("id"), F.col("name").alias("label"), F.col("entity_type").alias("type"),
        F.coalesce("description", F.lit("")).alias("description"), colour(F.col("entity_type")).alias("colour"),
        _flag(e, "curated").alias("curated"), _flag(e, "rejected").alias("rejected"), props.alias("properties"),
    )
    lines = r.select(
        F.lit("edges").alias("group"), F.col("relationship_id").alias("id"), F.col("relationship_type").alias("label"),
        F.coalesce("description", F.lit("")).alias("description"), F.col("source_entity_id").alias("source"),
        F.col("target_entity_id").alias("target"), "strength", _flag(r, "curated").alias("curated"),
    )
    return nodes.unionByName(lines, allowMissingColumns=True)


def export_network_rows(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge rows of a network view: tooltip, colour, and a width of three times the strength, one at least."""
    e, r = visible(entities, edges)
    tip = F.concat(F.lit("<b>"), F.col("name"), F.lit("</b><br>"), F.col("entity_type"), F.lit("<br>"), F.coalesce("description", F.lit("")))
    nodes = e.select(F.col("entity_id").alias("id"), F.col("name").alias("label"), tip.alias("title"), colour(F.col("entity_type")).alias("colour"))
    lines = r.select(
        F.col("relationship_id").alias("id"), F.col("relationship_type").alias("label"),
        F.greatest(F.lit(1.0), F.bround(F.col("strength") * 3, 0)).cast("long").alias("width"),
    )
    return nodes.unionByName(lines, allowMissingColumns=True)


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(entities: DataFrame, edges: DataFrame, include_rejected: bool = False) -> DataFrame:
    """GraphML as lines (part, id, value): head, nodes, edges, foot; write them in this order."""
    e, r = visible(entities, edges, include_rejected)
    # The keys of the format's attributes.
    keys = [
        ("d0", "node", "label", "string"), ("d1", "node", "type", "string"), ("d2", "node", "description", "string"),
        ("d3", "node", "curated", "boolean"), ("d4", "node", "rejected", "boolean"), ("d5", "edge", "label", "string"),
        ("d6", "edge", "strength", "double"), ("d7", "edge", "description", "string"), ("d8", "edge", "curated", "boolean"),
    ]
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/graphml">\n' + "\n".join(f'<key id="{k}" for="{f}" attr.name="{n}" attr.type="{t}"/>' for k, f, n, t in keys) + '\n<graph id="G" edgedefault="directed">'

    def data(key: str, v: Column) -> Column:
        return F.concat(F.lit(f'<data key="{key}">'), _xml(F.coalesce(v.cast("string"), F.lit(""))), F.lit("</data>"))

    node = F.concat(
        F.lit('<node id="'), _xml(F.col("entity_id")), F.lit('">'), data("d0", F.col("name")), data("d1", F.col("entity_type")),
        data("d2", F.col("description")), data("d3", _flag(e, "curated")), data("d4", _flag(e, "rejected")), F.lit("</node>"),
    )
    edge = F.concat(
        F.lit('<edge id="'), _xml(F.col("relationship_id")), F.lit('" source="'), _xml(F.col("source_entity_id")), F.lit('" target="'),
        _xml(F.col("target_entity_id")), F.lit('">'), data("d5", F.col("relationship_type")), data("d6", F.col("strength")),
        data("d7", F.col("description")), data("d8", _flag(r, "curated")), F.lit("</edge>"),
    )
    spark = entities.sparkSession
    ends = spark.createDataFrame([(0, "", head), (3, "", "</graph>\n</graphml>")], "part int, id string, value string")
    return ends.unionByName(e.select(F.lit(1).alias("part"), F.col("entity_id").alias("id"), node.alias("value"))).unionByName(
        r.select(F.lit(2).alias("part"), F.col("relationship_id").alias("id"), edge.alias("value")),
    )


def write_graphml(entities: DataFrame, edges: DataFrame, path: str, include_rejected: bool = False) -> None:
    """Text part files that, one after the other, are the GraphML document; for graphs too large for one file."""
    graphml_lines(entities, edges, include_rejected).orderBy("part", "id").select("value").write.text(path)


def write_graphml_document(entities: DataFrame, edges: DataFrame, path: str, include_rejected: bool = False) -> None:
    """One GraphML file at ``path``, which appears whole or not at all."""
    lines = graphml_lines(entities, edges, include_rejected)
    head, foot = (r.value for r in lines.where("part in (0, 3)").orderBy("part").collect())
    write_document(lines.where("part in (1, 2)"), path, head + "\n", foot + "\n", ["part", "id"])


def export_json(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines below ``path``: entities, relationships and statistics."""
    from .graph import graph_stats

    for name, df in (("entities", entities), ("relationships", edges), ("statistics", graph_stats(entities, edges))):
        df.write.json(f"{path}/{name}")


def json_document_rows(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a JSON document {entities, relationships, statistics} (part, id, value); write them in this order.

    Null fields are left out. Sections without rows are empty arrays.
    """
    from .graph import graph_stats

    spark = entities.sparkSession

    def items(df: DataFrame, part: int, id_col: str) -> DataFrame:
        first = df.agg(F.min(id_col).alias("first_id"))
        rows = df.crossJoin(F.broadcast(first))  # one row
        comma = F.when(F.col(id_col) == F.col("first_id"), "").otherwise(",")
        return rows.select(F.lit(part).alias("part"), F.col(id_col).cast("string").alias("id"), F.concat(comma, F.to_json(F.struct(*df.columns))).alias("value"))

    ends = spark.createDataFrame([(0, "", '{"entities": ['), (2, "", '], "relationships": ['), (4, "", '], "statistics": '), (6, "", "}")], "part int, id string, value string")
    stats = graph_stats(entities, edges)
    stats = stats.select(F.lit(5).alias("part"), F.lit("").alias("id"), F.to_json(F.struct(*stats.columns)).alias("value"))
    return ends.unionByName(items(entities, 1, "entity_id")).unionByName(items(edges, 3, "relationship_id")).unionByName(stats)


def write_json_document(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON file {entities, relationships, statistics} at ``path``, which appears whole or not at all; ids are distinct and not null."""
    write_document(json_document_rows(entities, edges), path, "", "", ["part", "id"])


def report_rows(df: DataFrame) -> DataFrame:
    """Verified relationships (relationship_id, status, confidence, text_…, embedding_…, llm_… status and confidence) with their stage list.

    ``stages`` has an entry for each stage that ran, in order.
    """
    each = [
        F.when(F.col(f"{p}_status").isNotNull(), F.struct(F.lit(name).alias("stage"), F.col(f"{p}_status").alias("status"), F.col(f"{p}_confidence").cast("double").alias("confidence"))) for p, name in (("text", "text_match"), ("embedding", "embedding"), ("llm", "llm"))
    ]
    return df.select("relationship_id", "status", "confidence", F.filter(F.array(*each), lambda s: s.isNotNull()).alias("stages"))


def write_report(df: DataFrame, path: str) -> None:
    """One JSON record for each verified relationship, with its stage list."""
    report_rows(df).write.json(path)


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Audit records below ``path``; lines that are no JSON of that schema are passed over, as half-written ones are."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def keep_audit(spark: SparkSession, path: str, target: str, schema: str, n: int = 5000) -> None:
    """The newest ``n`` records of the log at ``path`` as a log at ``target``, for the next appends to go to."""
    audit_tail(read_audit(spark, path, schema), n).write.mode("overwrite").json(target)


def audit_tail(records: DataFrame, n: int = 5000) -> DataFrame:
    """The newest n records, newest first."""
    return records.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def compact_jobs(jobs: DataFrame, n: int = 500) -> DataFrame:
    """The newest n jobs."""
    return jobs.orderBy(F.desc("created"), "job_id").limit(n)


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """After a restart every job that has not ended is failed, with an event that says so."""
    lost = ~F.col("status").isin(*TERMINAL_JOBS)
    return jobs.withColumn("note", F.when(lost, "interrupted by restart")).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def upsert_documents(stored: DataFrame, new: DataFrame, id_col: str, order: str) -> DataFrame:
    """The latest row of each id."""
    rows = stored.unionByName(new, allowMissingColumns=True)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order)))).where("nth = 1").drop("nth")


def delete_documents(docs: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of the ids."""
    wanted = ids.select("document_id").distinct()
    return docs.join(wanted, "document_id", "left_anti"), chunks.join(wanted, "document_id", "left_anti")
