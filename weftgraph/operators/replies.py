"""Model replies as a table (request_id, reply): parsing, checking, and requests built for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import camel_key, capitalised, parse_reply, relation_name, title_case
from .chunking import CONTEXT_CAPS

ENTITY_REPLY = "entities array<struct<name:string,type:string,description:string,confidence:double>>"
RELATIONSHIP_REPLY = "relationships array<struct<source_entity:string,target_entity:string,relationship_type:string,description:string,confidence:double,evidence:string>>"


def _whole(rows: DataFrame, schema: str, items: str, needed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    parsed = rows.withColumn("items", parse_reply(F.col("reply"), schema)[items])
    good = F.col("items").isNotNull() & F.forall("items", lambda x: _present(x, needed))
    parsed = parsed.withColumn("good", F.coalesce(good, F.lit(False)))
    return parsed.where("good").select("request_id", F.posexplode("items").alias("pos", "item")).select("request_id", "pos", "item.*"), parsed.where("not good").select("request_id")


def _present(x: Column, needed: tuple[str, ...]) -> Column:
    ok = x.isNotNull()
    for f in needed:
        ok = ok & x[f].isNotNull()
    return ok


def parse_entity_replies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (request_id, pos, name, type, …) of good replies, and the requests whose reply failed.

    A reply without the list, or with one item that lacks a name or type, fails as a whole.
    """
    return _whole(rows, ENTITY_REPLY, "entities", ("name", "type"))


def parse_relationship_replies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _whole(rows, RELATIONSHIP_REPLY, "relationships", ("source_entity", "target_entity", "relationship_type"))


def parse_classifications(rows: DataFrame) -> DataFrame:
    r = parse_reply(F.col("reply"), "classifications array<struct<category:string,confidence:double,reasoning:string>>, primary_category string")
    return rows.select("request_id", r["primary_category"].alias("primary_category"), F.explode_outer(r["classifications"]).alias("c")).select(
        "request_id", "primary_category", "c.category", "c.confidence",
    )


def parse_summaries(rows: DataFrame) -> DataFrame:
    r = parse_reply(F.col("reply"), "summary string, key_points array<string>, entities_mentioned array<string>, themes array<string>")
    return rows.select("request_id", r.alias("r")).select("request_id", "r.*")


def parse_entity_matches(rows: DataFrame) -> DataFrame:
    """Matches that name both sides: request_id, pos, new_name, existing_name, confidence."""
    r = parse_reply(F.col("reply"), "matches array<struct<new_name:string,existing_name:string,confidence:double,reasoning:string>>")
    m = rows.select("request_id", F.posexplode(r["matches"]).alias("pos", "m")).select("request_id", "pos", "m.*")
    return m.where("coalesce(new_name, '') <> '' and coalesce(existing_name, '') <> ''").drop("reasoning")


def parse_rel_duplicate(rows: DataFrame, n_candidates: str = "n_candidates") -> DataFrame:
    """duplicate_of where it is a whole number in [0, n), else null; with its confidence."""
    r = parse_reply(F.col("reply"), "duplicate_of string, confidence double, reasoning string")
    index = F.expr("try_cast(d as int)")
    rows = rows.withColumn("d", r["duplicate_of"]).withColumn("confidence", r["confidence"])
    return rows.withColumn("duplicate_of", F.when((index >= 0) & (index < F.col(n_candidates)), index)).drop("d", "reply")


def parse_graph_replies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node/edge replies: wrapped lists are unwrapped, incomplete items skipped, end types filled in.

    An end without a type takes that of the request's first node of its id. Where a request has one reply these stand in the row; only
    requests of several replies need their nodes gathered.
    """
    node, edge = "array<struct<id:string,type:string>>", "array<struct<source_node_id:string,source_node_type:string,target_node_id:string,target_node_type:string,type:string>>"
    flat = parse_reply(F.col("reply"), f"nodes {node}, relationships {edge}")
    boxed = parse_reply(F.col("reply"), f"nodes struct<Items:{node}>, relationships struct<Items:{edge}>")
    held = F.coalesce(flat["nodes"], boxed["nodes"]["Items"])
    nodes = (
        rows.select("request_id", F.posexplode(held).alias("pos", "n"))
        .where("n.id is not null")
        .select("request_id", "pos", title_case(F.col("n.id")).alias("id"), _node_type(F.col("n.type")).alias("type"))
    )
    alone = rows.where("request_id is not null").groupBy("request_id").count().where("count > 1").isEmpty()
    known = [F.transform(held, lambda n: title_case(n["id"])).alias("ids"), F.transform(held, lambda n: _node_type(n["type"])).alias("types")] if alone else []
    names = ["ids", "types"] if alone else []
    edges = (
        rows.select("request_id", F.coalesce(flat["relationships"], boxed["relationships"]["Items"]).alias("rs"), *known)
        .select("request_id", *names, F.posexplode("rs").alias("pos", "r"))
        .where("r.source_node_id is not null and r.target_node_id is not null and r.type is not null")
        .select(
            "request_id", "pos", title_case(F.col("r.source_node_id")).alias("source"), F.col("r.source_node_type").alias("source_type"),
            title_case(F.col("r.target_node_id")).alias("target"), F.col("r.target_node_type").alias("target_type"),
            relation_name(F.col("r.type")).alias("type"), *names,
        )
    )
    first = nodes.groupBy("request_id", "id").agg(F.min_by("type", "pos").alias("first_type"))
    for end in ("source", "target"):
        if alone:
            at = F.array_position("ids", F.col(end))
            edges = edges.withColumn(f"{end}_first", F.when((at > 0) & F.col("request_id").isNotNull(), F.get("types", (at - 1).cast("int"))))
        else:
            edges = edges.join(first.withColumnsRenamed({"id": end, "first_type": f"{end}_first"}), ["request_id", end], "left")
        edges = edges.withColumn(f"{end}_type", capitalised(F.coalesce(f"{end}_type", f"{end}_first"))).drop(f"{end}_first")
    return nodes, edges.select("request_id", "pos", "source", "source_type", "target", "target_type", "type")


def _node_type(kind: Column) -> Column:
    return capitalised(F.coalesce(kind, F.lit("node")))


def parse_triples(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and edges of triple replies (head, head_type, relation, tail, tail_type)."""
    r = F.from_json("reply", "array<struct<head:string,head_type:string,relation:string,tail:string,tail_type:string>>")
    t = rows.select("request_id", F.inline(r))
    nodes = (
        t.select("request_id", F.col("head").alias("id"), F.col("head_type").alias("type"))
        .unionByName(t.select("request_id", F.col("tail").alias("id"), F.col("tail_type").alias("type")))
        .distinct()
    )
    return nodes, t.select("request_id", F.col("head").alias("source"), F.col("tail").alias("target"), relation_name(F.col("relation")).alias("type"))


def parse_schema_replies(rows: DataFrame) -> DataFrame:
    r = parse_reply(F.col("reply"), "labels array<string>, relationshipTypes array<string>")
    a = rows.select(F.lit("label").alias("kind"), F.explode(r["labels"]).alias("value"))
    return a.unionByName(rows.select(F.lit("relationship").alias("kind"), F.explode(r["relationshipTypes"]).alias("value"))).distinct()


def build_requests(chunks: DataFrame, entities: DataFrame, most: int = CONTEXT_CAPS["relationship_prompt"]) -> DataFrame:
    """Request rows: the chunk's text, cut, and a line ``- name (type): description`` for each of its entities, in order."""
    line = F.concat(
        F.lit("- "), F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit(")"),
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), F.col("description"))).otherwise(""),
    )
    lists = entities.groupBy("chunk_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("name").alias("n"), line.alias("line")))), lambda x: x["line"]), "\n").alias("entity_lines"),
    )
    return chunks.join(lists, "chunk_id", "left").select(
        "chunk_id", F.substring("content", 1, most).alias("text"), F.coalesce("entity_lines", F.lit("")).alias("entity_lines"),
    )


def to_graph_rows(edges: DataFrame, properties: str) -> DataFrame:
    """Edges with the keys of a property map in camel case."""
    return edges.withColumn(properties, F.transform_keys(properties, lambda k, v: camel_key(k)))
