"""Resolution, upserts and merges of entities and relationships.

"First" and "last" follow an explicit order column, never arrival. Every merge is a grouping on the natural key with
partial aggregation, so a key that many rows share is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import content_id
from .chunking import CONTEXT_CAPS
from .evidence import bounded_context
from .stars import star_components
from .vectors import vector_topk


def ordered_union(a: Column, b: Column) -> Column:
    """Both arrays' values once each, in order of first occurrence; nulls count as empty."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, none), F.coalesce(b, none))


def _united(rows: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """(keys, column): an array column's values over a group, once each, in order; a value is reduced to its first place before values meet."""
    places = (
        rows.select(*keys, F.col(order).alias("o"), F.posexplode(column).alias("p", "v"))
        .groupBy(*keys, "v")
        .agg(F.min(F.struct("o", "p")).alias("at"))
    )
    return places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(column))


def _last(column: str, order: str) -> Column:
    """The last value that is not null (of maps: that is not empty)."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def _upsert(rows: DataFrame, keys: list[str], id_col: str, order: str) -> DataFrame:
    """Rows (with ``fresh``) merged by natural key: first id, united arrays, last values of all other fields, version."""
    kinds = dict(rows.dtypes)
    arrays = [c for c in rows.columns if kinds[c] == "array<string>"]
    others = [c for c in rows.columns if c not in (*keys, id_col, order, "fresh", "version", *arrays)]
    maps = [c for c in others if kinds[c].startswith("map<")]
    rows = rows.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in maps}) if maps else rows
    held = F.coalesce(F.max(F.when(F.col("fresh") == 0, F.col("version"))), F.lit(0)) if "version" in rows.columns else F.lit(0)
    out = rows.groupBy(*keys).agg(
        F.min_by(id_col, order).alias(id_col), *(_last(c, order).alias(c) for c in others), (held + F.sum("fresh")).cast("int").alias("version"),
    )
    for c in arrays:
        its = _united(rows, keys, c, order)
        same = [out[k].eqNullSafe(its[k]) for k in keys]
        out = out.join(its, same, "left").select(*(out[k] for k in out.columns), F.coalesce(its[c], F.array().cast("array<string>")).alias(c))
    return out


def upsert_entities(stored: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Entities by (name, entity_type), with all their columns: the first id stays, later non-null fields win.

    Arrays of strings (provenance, aliases, tags) unite in order; a map that is not empty replaces the one before as a whole.
    Stored rows must have lower ``seq`` than new ones. ``version`` grows by the number of new rows of the key.
    Applying the same rows again changes nothing but versions.
    """
    rows = stored.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)), allowMissingColumns=True)
    return _upsert(rows, ["name", "entity_type"], "entity_id", order)


def upsert_relationships(stored: DataFrame, new: DataFrame, entities: DataFrame, order: str = "seq") -> DataFrame:
    """Relationships by (source, target, type), with the rules of ``upsert_entities``; both ends must exist."""
    rows = stored.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)), allowMissingColumns=True)
    for c in ("source_entity_id", "target_entity_id"):
        rows = rows.join(entities.select(F.col("entity_id").alias(c)), c, "left_semi")
    return _upsert(rows, ["source_entity_id", "target_entity_id", "relationship_type"], "relationship_id", order)


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """Merge rows that hold two entity structs ``a`` and ``b``: the one with the higher confidence (a on ties) is the base.

    Of each field the base's value counts, else the other's; arrays unite (aliases sorted), and of maps the other's entries win.
    """
    base_is_a = F.coalesce(F.col("a.confidence"), F.lit(0.0)) >= F.coalesce(F.col("b.confidence"), F.lit(0.0))

    def merged(name: str, kind: str) -> Column:
        a, b = F.col(f"a.`{name}`"), F.col(f"b.`{name}`")
        if kind == "array<string>":
            both = ordered_union(F.when(base_is_a, a).otherwise(b), F.when(base_is_a, b).otherwise(a)) if name == "tags" else ordered_union(a, b)
            return F.array_sort(both) if name == "aliases" else both
        if kind.startswith("map<"):
            first, second = F.when(base_is_a, a).otherwise(b), F.when(base_is_a, b).otherwise(a)
            none = F.create_map().cast(kind)
            first, second = F.coalesce(first, none), F.coalesce(second, none)
            return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)
        return F.when(base_is_a, F.coalesce(a, b)).otherwise(F.coalesce(b, a))

    fields = pairs.schema["a"].dataType.fields
    return pairs.select(*(merged(f.name, f.dataType.simpleString()).alias(f.name) for f in fields))


def close_mapping(mapping: DataFrame) -> DataFrame:
    """A mapping (entity_id -> primary_id) whose chains are followed to their ends; rows that map an id to itself go.

    Ids that belong together by the mapping get one primary: the one that is not mapped on (the smallest of several, and in a
    circle the smallest of all).
    """
    pairs = mapping.select("entity_id", "primary_id").where("entity_id <> primary_id").distinct()
    onward = pairs.select(F.col("entity_id").alias("primary_id"))
    twice = pairs.groupBy("entity_id").count().where("count > 1")
    if pairs.join(onward, "primary_id", "left_semi").isEmpty() and twice.isEmpty():
        return pairs
    groups = star_components(pairs.select(F.col("entity_id").alias("a"), F.col("primary_id").alias("b")))
    mapped = pairs.select(F.col("entity_id").alias("node"), F.lit(True).alias("mapped")).distinct()
    ends = groups.join(mapped, "node", "left").groupBy("root").agg(F.min(F.when(F.col("mapped").isNull(), F.col("node"))).alias("end"))
    closed = groups.join(ends, "root").select(F.col("node").alias("entity_id"), F.coalesce("end", "root").alias("primary_id"))
    return closed.where("entity_id <> primary_id")


def merge_entities(entities: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge duplicates into primaries: mapping (entity_id -> primary_id), whose chains are followed.

    Edges (of distinct ids) move to the primaries and edges within a merge go; equal edges become one, with the smallest id and the strongest
    one's other fields, and ``merged`` counts them. The duplicates' names become aliases. Gives entities (with ``aliases``) and edges.
    """
    mapping = close_mapping(mapping)
    named = (
        mapping.join(entities.select("entity_id", "name"), "entity_id")
        .groupBy("primary_id")
        .agg(F.array_sort(F.collect_set("name")).alias("merged_names"))
    )
    kept = entities.join(mapping.select("entity_id"), "entity_id", "left_anti").join(
        named.withColumnRenamed("primary_id", "entity_id"), "entity_id", "left",
    )
    own = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in entities.columns else F.array().cast("array<string>")
    kept = kept.withColumn("aliases", F.array_except(ordered_union(own, F.col("merged_names")), F.array("name"))).drop("merged_names")
    moved = edges
    for end in ("source", "target"):
        to = mapping.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("primary_id").alias(f"{end}_to"))
        moved = (
            moved.join(to, f"{end}_entity_id", "left")
            .withColumn(f"{end}_entity_id", F.coalesce(f"{end}_to", f"{end}_entity_id"))
            .drop(f"{end}_to")
        )
    keys = ["source_entity_id", "target_entity_id", "relationship_type"]
    rest = [c for c in edges.columns if c not in (*keys, "relationship_id")]
    # dealt out before they are grouped: texts are grouped by sorting, and a task would sort all edges that it reads
    one = (
        moved.where("source_entity_id <> target_entity_id")
        .repartition(*keys)
        .groupBy(*keys)
        .agg(
            F.min("relationship_id").alias("first_id"),
            # ids decide first; the other fields follow the strongest edge alone
            F.max_by(F.struct("relationship_id", *rest), F.struct("strength", "relationship_id")).alias("top"), F.count("*").alias("merged"),
        )
    )
    return kept, one.where("top.relationship_id is not null").select(*keys, F.col("first_id").alias("relationship_id"), *[F.col("top")[c].alias(c) for c in rest], "merged")


def resolve_endpoints(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (document_id, source_name, target_name, …) with entity ids found by name within the document.

    Case and outer spaces are ignored; of entities of one name the last (by ``seq``) counts; unresolved edges go.
    """
    key = F.lower(F.trim("name")).alias("key")
    known = entities.select("document_id", key, "entity_id", "seq").groupBy("document_id", "key").agg(F.max_by("entity_id", "seq").alias("id"))
    for end in ("source", "target"):
        side = known.select(F.col("document_id"), F.col("key").alias(f"{end}_key"), F.col("id").alias(f"{end}_entity_id"))
        edges = edges.withColumn(f"{end}_key", F.lower(F.trim(f"{end}_name"))).join(side, ["document_id", f"{end}_key"]).drop(f"{end}_key")
    return edges


def resolve_fallback(edges: DataFrame, entities: DataFrame, decisions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``resolve_endpoints`` after names that decisions (document_id, new_name, existing_id, confidence) identify are known too."""
    alias = decisions.where(F.col("confidence") >= threshold).select(
        "document_id", F.col("new_name").alias("name"), F.col("existing_id").alias("entity_id"), F.lit(-1).cast("long").alias("seq"),
    )
    return resolve_endpoints(edges, entities.select("document_id", "name", "entity_id", F.col("seq").cast("long").alias("seq")).unionByName(alias))


def vector_aliases(edges: DataFrame, entities: DataFrame, name_vectors: DataFrame, entity_vectors: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """Candidates for names that ``resolve_endpoints`` leaves: (document_id, new_name, existing_id, score), the ``k`` nearest entities each.

    ``name_vectors`` (name, vector) has the names as they stand; ``entity_vectors`` (item_id, vector) the stored entities. Decisions
    on the candidates go to ``resolve_fallback``.
    """
    known = entities.select("document_id", F.lower(F.trim("name")).alias("key")).distinct()
    names = edges.select("document_id", F.explode(F.array("source_name", "target_name")).alias("new_name")).distinct()
    open_ = names.withColumn("key", F.lower(F.trim("new_name"))).join(known, ["document_id", "key"], "left_anti")
    asked = open_.select("new_name").distinct().join(name_vectors.withColumnRenamed("name", "new_name"), "new_name")
    hits = vector_topk(asked.select(F.col("new_name").alias("query_id"), "vector"), entity_vectors, k).where(F.col("score") >= least)
    return open_.join(hits, F.col("new_name") == F.col("query_id")).select("document_id", "new_name", F.col("item_id").alias("existing_id"), "score")


def rel_dup_candidates(new: DataFrame, stored: DataFrame) -> DataFrame:
    """For each new edge with stored edges on its ordered pair: is the type among them, and the other edges' ids."""
    old = stored.select(
        "source_entity_id", "target_entity_id", F.col("relationship_type").alias("old_type"), F.col("relationship_id").alias("old_id"),
    )
    met = new.join(old, ["source_entity_id", "target_entity_id"])
    same = F.col("relationship_type") == F.col("old_type")
    return met.groupBy("relationship_id").agg(
        F.bool_or(same).alias("exact"), F.array_sort(F.collect_set(F.when(~same, F.col("old_id")))).alias("candidates"),
    )


def rel_dup_rows(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored edges on each new edge's ordered pair, a row each: relationship_id, old_id, same_type, nth.

    ``nth`` numbers the edges of another type from 0 in order of id, as a decision's index does; it is null for the same type. A pair with
    very many stored edges makes rows, no array.
    """
    old = stored.select(
        "source_entity_id", "target_entity_id", F.col("relationship_type").alias("old_type"), F.col("relationship_id").alias("old_id"),
    ).distinct()
    met = new.join(old, ["source_entity_id", "target_entity_id"]).withColumn("same_type", F.col("relationship_type") == F.col("old_type"))
    nth = F.row_number().over(Window.partitionBy("relationship_id", "same_type").orderBy("old_id")) - 1
    return met.select("relationship_id", "old_id", "same_type", F.when(~F.col("same_type"), nth).alias("nth"))


def apply_rel_rows(new: DataFrame, candidates: DataFrame, decisions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """New edges with the candidate they duplicate by a decision (relationship_id, duplicate_of, confidence), or null to insert.

    What ``apply_rel_decisions`` gives, from the rows of ``rel_dup_rows``.
    """
    sure = decisions.where(F.col("confidence") >= threshold).select("relationship_id", F.col("duplicate_of").cast("int").alias("nth"))
    chosen = sure.join(candidates.where("nth is not null").select("relationship_id", "nth", "old_id"), ["relationship_id", "nth"])
    return new.join(chosen, "relationship_id", "left").select("relationship_id", F.col("old_id").alias("duplicate_id"))


def apply_entity_decisions(new: DataFrame, stored: DataFrame, decisions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Outcome of each new entity: the stored one it is decided to be (confident, same type, last decision), or its own.

    A merged target gets the union of provenance and the longer description.
    """
    chosen = decisions.where(F.col("confidence") >= threshold).groupBy("new_name").agg(F.max_by("existing_name", "pos").alias("existing_name"))
    targets = stored.select(
        F.col("name").alias("existing_name"), "entity_type", F.col("entity_id").alias("target_id"), F.col("description").alias("old"),
        F.col("source_chunk_ids").alias("old_chunks"),
    )
    rows = new.join(chosen, new["name"] == chosen["new_name"], "left").join(targets, ["existing_name", "entity_type"], "left")
    longer = F.when(F.length(F.coalesce("description", F.lit(""))) > F.length(F.coalesce("old", F.lit(""))), F.col("description")).otherwise(
        F.col("old"),
    )
    return rows.select(
        "entity_id", F.coalesce("target_id", "entity_id").alias("resolved_id"), F.col("target_id").isNotNull().alias("merged"),
        F.when(F.col("target_id").isNotNull(), longer).otherwise(F.col("description")).alias("description"), ordered_union(F.col("old_chunks"), F.col("source_chunk_ids")).alias("source_chunk_ids"),
    )


def apply_rel_decisions(new: DataFrame, candidates: DataFrame, decisions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """New edges with the candidate they duplicate (decision index into its ordered candidates), or null to insert."""
    rows = new.join(candidates.select("relationship_id", "candidates"), "relationship_id", "left").join(decisions, "relationship_id", "left")
    index = F.col("duplicate_of")
    valid = (F.col("confidence") >= threshold) & (index >= 0) & (index < F.size("candidates"))
    return rows.withColumn("duplicate_id", F.when(valid, F.get("candidates", index))).select("relationship_id", "duplicate_id")


def build_context(edges: DataFrame, chunks: DataFrame, most: int = CONTEXT_CAPS["verify"]) -> DataFrame:
    """Texts of each edge's source chunks in order, joined by blank lines and cut (``bounded_context``)."""
    return bounded_context(edges, chunks, "relationship_id", most)


def seed_graph(stored: DataFrame, seed: DataFrame, id_col: str) -> DataFrame:
    """Stored rows and the seed rows whose id is absent; running it again adds nothing."""
    return stored.unionByName(seed.join(stored.select(id_col), id_col, "left_anti"), allowMissingColumns=True)


def dedup_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a key of their sorted names and candidates, and one row for each key to be answered."""
    keyed = requests.withColumn("key", content_id(F.array_join(F.array_sort("new_names"), "|"), F.array_join(F.array_sort("candidates"), "|")))
    order = Window.partitionBy("key").orderBy("request_id")
    return keyed, keyed.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def distinct_texts(rows: DataFrame, column: str) -> DataFrame:
    """Distinct texts to embed, by trimmed lower case."""
    return rows.select(F.lower(F.trim(column)).alias("key")).where("key <> ''").distinct()
