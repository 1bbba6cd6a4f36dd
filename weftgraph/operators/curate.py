"""Curation events applied to entities and relationships, and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import snippet
from ..schemas import RELATIONSHIP_TYPES
from .graph import enrich_endpoints

# The actions that events may name.
ACTIONS = ("approve_entity", "reject_entity", "correct_entity", "approve_relationship", "reject_relationship", "correct_relationship")


def resolve_action(events: DataFrame) -> DataFrame:
    """Short action names (approve, reject, correct, flag) with the kind of their target; flag means reject."""
    short = F.when(F.col("action") == "flag", "reject").otherwise(F.col("action"))
    kind = F.when(F.col("relationship_id").isNotNull(), "relationship").otherwise("entity")
    named = F.when(F.col("action").isin("approve", "reject", "correct", "flag"), F.concat(short, F.lit("_"), kind)).otherwise(F.col("action"))
    return events.withColumn("target_id", F.coalesce("entity_id", "relationship_id")).withColumn("action", named)


def validate_events(events: DataFrame) -> DataFrame:
    """Errors of a dry run: seq and message for an unknown action or a missing target."""
    message = F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit("")))).when(F.coalesce("target_id", F.lit("")) == "", "missing target_id")
    return events.select("seq", message.alias("message")).where("message is not null")


def _faults(kind: str, fields: tuple[str, ...]) -> Column:
    """What makes a correction impossible: a type out of the closed set, a strength that is no number; else null."""
    said, fault = F.col("corrections"), F.lit(None).cast("string")
    if kind == "relationship" and "strength" in fields:
        bad = said["strength"].isNotNull() & said["strength"].try_cast("double").isNull()
        fault = F.when(bad, F.concat(F.lit("not a number: "), said["strength"])).otherwise(fault)
    if kind == "relationship" and "relationship_type" in fields:
        bad = said["relationship_type"].isNotNull() & ~said["relationship_type"].isin(*RELATIONSHIP_TYPES)
        fault = F.when(bad, F.concat(F.lit("not a relationship type: "), said["relationship_type"])).otherwise(fault)
    return F.when(F.col("action").startswith("correct"), fault)


def apply_curation(targets: DataFrame, events: DataFrame, id_col: str, kind: str, fields: tuple[str, ...], close_on_decision: bool = False) -> tuple[DataFrame, DataFrame]:
    """Targets after all events of their kind, and error rows (seq, message) for events that apply to none.

    Events (seq, action, target_id, curator, reason, corrections map) of one target are folded in order of seq over what is stored:
    every event sets curated and curated_by, a reason that is not empty sets curation_reason, the last decision sets rejected, the last
    correction of a field sets it, and version counts the events. Fields without an event keep their stored values, so batches
    applied one after the other give what all their events at once give. ``properties`` as a field takes corrections as JSON text and merges their keys.
    An event with an impossible correction changes nothing and is an error. With ``close_on_decision`` a decision also sets the
    status verified or rejected.
    """
    known = [a for a in ACTIONS if a.endswith(kind)]
    called = events.where(F.col("action").isin(known)).withColumn("fault", _faults(kind, fields))
    mine = called.where("fault is null")
    decision = F.when(F.col("action").startswith("approve"), "approve").when(F.col("action").startswith("reject"), "reject")
    corrects = F.col("action").startswith("correct")
    plain = [f for f in fields if f != "properties"]

    def last(value: Column, where: Column) -> Column:
        return F.max_by(value, F.when(where, F.col("seq")))

    by_target = mine.groupBy(F.col("target_id").alias(id_col)).agg(
        last(decision, decision.isNotNull()).alias("decision"), F.count("*").alias("n_events"), F.max_by("curator", "seq").alias("new_curated_by"),
        last(F.col("reason"), F.coalesce("reason", F.lit("")) != "").alias("new_curation_reason"),
        *(last(F.col("corrections")[f], F.col("corrections")[f].isNotNull() & corrects).alias(f"new_{f}") for f in plain),
    )
    stored = {"curated": "boolean", "curated_by": "string", "curation_reason": "string", "rejected": "boolean", "version": "int"}
    rows = targets.withColumns({c: F.lit(None).cast(t) for c, t in stored.items() if c not in targets.columns}).join(by_target, id_col, "left")
    for f in (*plain, "curated_by", "curation_reason"):
        rows = rows.withColumn(f, F.coalesce(F.col(f"new_{f}").cast(rows.schema[f].dataType), f))
    if "properties" in fields:
        each = mine.where(corrects).select("seq", F.col("target_id").alias(id_col), F.explode(F.from_json(F.col("corrections")["properties"], "map<string,string>")).alias("key", "value"))
        each = each.groupBy(id_col, "key").agg(F.max_by("value", "seq").alias("value"))
        rows = rows.join(each.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("more")), id_col, "left")
        old, more = F.coalesce("properties", F.create_map().cast("map<string,string>")), F.col("more")
        rows = rows.withColumn(
            "properties", F.when(more.isNull(), F.col("properties")).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(more, k)), more)),
        ).drop("more")
    rows = rows.withColumns(
        {
            "curated": F.col("n_events").isNotNull() | F.coalesce("curated", F.lit(False)),
            "rejected": F.coalesce(F.col("decision") == "reject", "rejected", F.lit(False)),
            "version": (F.coalesce("version", F.lit(1)) + F.coalesce("n_events", F.lit(0))).cast("int"),
        }
    )
    if close_on_decision:
        rows = rows.withColumn(
            "status", F.when(F.col("decision") == "approve", "verified").when(F.col("decision") == "reject", "rejected").otherwise(F.col("status")),
        )
    missing = mine.join(targets.select(F.col(id_col).alias("target_id")), "target_id", "left_anti").select(
        "seq", F.concat(F.lit(f"{kind} not found: "), F.coalesce("target_id", F.lit(""))).alias("message"),
    )
    errors = missing.unionByName(called.where("fault is not null").select("seq", F.col("fault").alias("message")))
    return rows.drop("decision", "n_events", "new_curated_by", "new_curation_reason", *(f"new_{f}" for f in plain)), errors


def audit_records(events: DataFrame, errors: DataFrame) -> DataFrame:
    """One record for each event: success, and the error where there is one."""
    said = errors.groupBy("seq").agg(F.min("message").alias("error"))
    return events.join(said, "seq", "left").withColumn("success", F.col("error").isNull())


def curation_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count("*").alias("total"), *(F.count_if((F.col("action") == a) & F.col("success")).alias(a) for a in ACTIONS),
        F.count_if(~F.col("success")).alias("errors"),
    )


def curation_queue(entities: DataFrame, edges: DataFrame, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Items to review in one shape: rejected, flagged, unverified; newest first (``queue_page`` gives the order).

    ``n_chunks`` and ``n_documents`` count an item's provenance, ``tags`` are its own, and relationships have their ends' names and types.
    """
    def extras(df: DataFrame) -> list[Column]:
        sizes = [
            (F.coalesce(F.size(c), F.lit(0)) if c in df.columns else F.lit(0)).alias(n) for c, n in (("source_chunk_ids", "n_chunks"), ("source_document_ids", "n_documents"))
        ]
        return [
            *sizes, (F.coalesce("tags", F.array().cast("array<string>")) if "tags" in df.columns else F.array().cast("array<string>")).alias("tags"),
        ]

    none = F.lit(None).cast("string")
    ends = ("source_name", "source_type", "target_name", "target_type")
    e = entities.select(
        F.lit("entity").alias("kind"), F.col("entity_id").alias("item_id"), F.col("name").alias("title"), snippet(F.col("description")).alias("snippet"), F.col("entity_type").alias("type"),
        "trust", "status", "created", *extras(entities), *(none.alias(c) for c in ends),
    )
    title = F.concat_ws(" ", "source_name", "relationship_type", "target_name")
    r = enrich_endpoints(edges, entities)
    r = r.select(
        F.lit("relationship").alias("kind"), F.col("relationship_id").alias("item_id"), title.alias("title"), snippet(F.col("description")).alias("snippet"), F.col("relationship_type").alias("type"),
        "trust", "status", "created", *extras(edges), *ends,
    )
    rows = e.unionByName(r).where(F.col("status").isin("rejected", "flagged", "unverified"))
    for c, v in (("status", status), ("kind", kind)):
        rows = rows.where(F.col(c) == v) if v else rows
    return rows


def queue_items(entities: DataFrame, edges: DataFrame, status: str | None = None, kind: str | None = None) -> DataFrame:
    """kind, item_id, trust, status, created of the items of ``curation_queue``, which need no look at an edge's ends: for counts, and pages before they are shown."""
    rows = None
    for name, df in (("entity", entities), ("relationship", edges)):
        some = df.select(F.lit(name).alias("kind"), F.col(f"{name}_id").alias("item_id"), "trust", "status", "created")
        rows = some if rows is None else rows.unionByName(some)
    rows = rows.where(F.col("status").isin("rejected", "flagged", "unverified"))
    for c, v in (("status", status), ("kind", kind)):
        rows = rows.where(F.col(c) == v) if v else rows
    return rows


def queue_page(queue: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    rank = F.when(F.col("status") == "rejected", 0).when(F.col("status") == "flagged", 1).when(F.col("status") == "unverified", 2).otherwise(99)
    return queue.orderBy(rank, F.desc("created"), "item_id").offset(offset).limit(limit)


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("rejected", "flagged", "unverified")))


def tag_sample(entities: DataFrame, edges: DataFrame, n_entities: int = 12, n_edges: int = 8) -> DataFrame:
    """The first entities and edges by id with statuses unverified, flagged, rejected in turn (a fixture builder)."""

    def some(df: DataFrame, id_col: str, n: int) -> DataFrame:
        first = df.select(F.col(id_col).alias("item_id")).orderBy("item_id").limit(n)
        nth = F.row_number().over(Window.orderBy("item_id")) - 1
        return first.withColumn("status", F.element_at(F.array(*map(F.lit, ("unverified", "flagged", "rejected"))), (nth % 3 + 1).cast("int")))

    return some(entities, "entity_id", n_entities).unionByName(some(edges, "relationship_id", n_edges))
