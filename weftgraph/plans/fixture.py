"""A property graph built from the star schema, and the same graph as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


def _entity(df: DataFrame, kind: str, key: str, name: str, entity_type: str, trust: str, description: Column | None = None) -> DataFrame:
    k = F.col(key)
    return df.select(
        F.concat(F.lit(kind + ":"), k.cast("string")).alias("entity_id"), F.col(name).alias("name"), F.lit(entity_type).alias("entity_type"),
        (F.lit(None).cast("string") if description is None else description).alias("description"),
        (k.cast("long") if dict(df.dtypes)[key] != "string" else F.length(k).cast("long")).alias("k"), F.lit(trust).alias("trust"),
    )


def _status(k: Column) -> Column:
    return F.when(k % 7 == 0, "flagged").when(k % 7 == 1, "rejected").when(k % 7 == 2, "verified").otherwise("unverified")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, name, entity_type, description, k, trust, status, created, rejected."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "supplier", "customer", "part")}
    rows = _entity(t["region"], "region", "r_regionkey", "r_name", "Location", "curated")
    for more in (
        _entity(t["nation"], "nation", "n_nationkey", "n_name", "Location", "curated"),
        _entity(t["supplier"], "supplier", "s_suppkey", "s_name", "Organization", "reviewed", F.concat(F.lit("supplier in nation "), F.col("s_nationkey").cast("string"))),
        _entity(t["customer"], "customer", "c_custkey", "c_name", "Organization", "user", F.col("c_mktsegment")),
        _entity(t["part"], "part", "p_partkey", "p_name", "Product", "extracted", F.concat_ws(" ", "p_brand", "p_type")),
        _entity(t["part"].select("p_brand").distinct(), "brand", "p_brand", "p_brand", "Brand", "extracted"),
        _entity(t["part"].select("p_type").distinct(), "type", "p_type", "p_type", "Category", "extracted"),
    ):
        rows = rows.unionByName(more)
    return rows.withColumn("status", _status(F.col("k"))).withColumn("created", F.col("k") * 37 % 1000).withColumn("rejected", F.col("k") % 7 == 1)


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relationship_id, source and target ids, relationship_type, description, strength, k, trust, status, created, rejected."""

    def edge(df: DataFrame, src: Column, kind: str, dst: Column, k: Column, strength: Column | None = None, description: Column | None = None, trust: str = "curated") -> DataFrame:
        return df.select(
            F.concat(src, F.lit(f">{kind}>"), dst).alias("relationship_id"), src.alias("source_entity_id"), dst.alias("target_entity_id"), F.lit(kind).alias("relationship_type"),
            (F.lit(None).cast("string") if description is None else description).alias("description"),
            (F.lit(1.0) if strength is None else strength).alias("strength"), k.cast("long").alias("k"), F.lit(trust).alias("trust"),
        )

    def node(kind: str, key: str) -> Column:
        return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))

    t = {n: table(spark, sf_dir, n) for n in ("nation", "supplier", "customer", "part", "lineitem")}
    made = t["lineitem"].groupBy("l_suppkey", "l_partkey").agg(F.round(F.lit(1.0) - F.avg("l_discount"), 6).alias("strength"))
    supplies = F.concat(
        F.when((F.col("l_partkey") + F.col("l_suppkey")) % 5 == 0, "does not supply part ").otherwise("supplies part "),
        F.col("l_partkey").cast("string"),
    )
    rows = edge(t["nation"], node("nation", "n_nationkey"), "PART_OF", node("region", "n_regionkey"), F.col("n_nationkey"))
    for more in (
        edge(t["supplier"], node("supplier", "s_suppkey"), "LOCATED_IN", node("nation", "s_nationkey"), F.col("s_suppkey"), trust="reviewed"),
        edge(t["customer"], node("customer", "c_custkey"), "LOCATED_IN", node("nation", "c_nationkey"), F.col("c_custkey"), trust="user"),
        edge(made, node("supplier", "l_suppkey"), "MANUFACTURES", node("part", "l_partkey"), F.col("l_suppkey") + F.col("l_partkey"), F.col("strength"), supplies, "extracted"),
        edge(t["part"], node("part", "p_partkey"), "CATEGORIZED_AS", node("type", "p_type"), F.col("p_partkey"), trust="extracted"),
        edge(t["part"], node("part", "p_partkey"), "RELATED_TO", node("brand", "p_brand"), F.col("p_partkey"), trust="extracted"),
    ):
        rows = rows.unionByName(more)
    return rows.withColumn("status", _status(F.col("k"))).withColumn("created", F.col("k") * 37 % 1000).withColumn("rejected", F.col("k") % 7 == 1)


_STATUS_SQL = "CASE k % 7 WHEN 0 THEN 'flagged' WHEN 1 THEN 'rejected' WHEN 2 THEN 'verified' ELSE 'unverified' END AS status, k * 37 % 1000 AS created, k % 7 = 1 AS rejected"

#: Begins a statement: the tables ``e`` and ``r``.
GRAPH_SQL = f"""WITH e0 AS (
  SELECT 'region:' || r_regionkey AS entity_id, r_name AS name, 'Location' AS entity_type, CAST(NULL AS VARCHAR) AS description, CAST(r_regionkey AS BIGINT) AS k, 'curated' AS trust FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'Location', NULL, n_nationkey, 'curated' FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'Organization', 'supplier in nation ' || s_nationkey, s_suppkey, 'reviewed' FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'Organization', c_mktsegment, c_custkey, 'user' FROM customer
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'Product', concat_ws(' ', p_brand, p_type), p_partkey, 'extracted' FROM part
  UNION ALL SELECT DISTINCT 'brand:' || p_brand, p_brand, 'Brand', NULL, length(p_brand), 'extracted' FROM part
  UNION ALL SELECT DISTINCT 'type:' || p_type, p_type, 'Category', NULL, length(p_type), 'extracted' FROM part),
r0 AS (
  SELECT 'nation:' || n_nationkey AS s, 'PART_OF' AS t, 'region:' || n_regionkey AS d, CAST(NULL AS VARCHAR) AS description, CAST(1.0 AS DOUBLE) AS strength, CAST(n_nationkey AS BIGINT) AS k, 'curated' AS trust FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'LOCATED_IN', 'nation:' || s_nationkey, NULL, 1.0, s_suppkey, 'reviewed' FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'LOCATED_IN', 'nation:' || c_nationkey, NULL, 1.0, c_custkey, 'user' FROM customer
  UNION ALL SELECT 'supplier:' || l_suppkey, 'MANUFACTURES', 'part:' || l_partkey, CASE WHEN (l_partkey + l_suppkey) % 5 = 0 THEN 'does not supply part ' ELSE 'supplies part ' END || l_partkey, round(1.0 - avg(l_discount), 6), l_suppkey + l_partkey, 'extracted' FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'part:' || p_partkey, 'CATEGORIZED_AS', 'type:' || p_type, NULL, 1.0, p_partkey, 'extracted' FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'RELATED_TO', 'brand:' || p_brand, NULL, 1.0, p_partkey, 'extracted' FROM part),
e AS MATERIALIZED (SELECT *, {_STATUS_SQL} FROM e0),
r AS MATERIALIZED (SELECT s || '>' || t || '>' || d AS relationship_id, s AS source_entity_id, d AS target_entity_id, t AS relationship_type, description, strength, k, trust, {_STATUS_SQL} FROM r0)
"""
