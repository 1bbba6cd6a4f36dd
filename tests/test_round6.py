"""Findings of round 3, third part: what the driver and a single task hold."""

import contextlib
import io

from pyspark.sql import functions as F


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


# ---- pipeline: the driver's memory ----

def test_rounds_without_a_hub_broadcast_nothing(spark, monkeypatch):
    from weftgraph.operators import stars

    plans, stage = [], stars.stage
    monkeypatch.setattr(stars, "stage", lambda df, name: plans.append(plan(df)) or stage(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (80, 90), (5, 5), (None, 3)], "a long, b long")
        assert {tuple(x) for x in stars.star_components(chain).collect()} == {(i, 0) for i in range(41)} | {(80, 80), (90, 80)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_stars_need_no_round(spark, monkeypatch):
    from weftgraph.operators import stars

    names, stage = [], stars.stage
    monkeypatch.setattr(stars, "stage", lambda df, name: names.append(name) or stage(df, name))
    pairs = spark.createDataFrame([(7, 3), (3, 9), (3, 8), (20, 21)], "a long, b long")
    assert {tuple(x) for x in stars.star_components(pairs).collect()} == {(3, 3), (7, 3), (9, 3), (8, 3), (20, 20), (21, 20)}
    assert len(names) == 1
    assert stars.star_components(pairs.limit(0)).count() == 0


def test_filter_has_few_rows_and_loses_none(spark):
    from weftgraph.llm import keyfilter

    keys = spark.range(60_000).select((F.col("id") * 7 - 9).alias("key"))
    filters = keyfilter.key_filter(keys)
    assert filters.count() <= 1 << 10
    rows = spark.range(1_000_000).select((F.col("id") - 10).alias("k")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    may = keyfilter.with_may(rows, keys, "k")
    assert may.columns == ["k", "may"] and may.count() == 1_000_001
    held = may.where((F.col("k") % 7 == 5) & (F.col("k") < 7 * 60_000 - 9))
    assert held.where("not may").count() == 0 and held.count() >= 59_990
    assert may.where("may").count() < 80_000
    assert keyfilter.with_may(rows, keys.limit(0), "k").where("may").count() == 0


# ---- F21: graph_reply_edges ----

def test_end_types_stand_in_the_reply(spark):
    import json

    from weftgraph.operators import replies

    nodes = [{"id": "ann lee", "type": None}, {"id": None, "type": "x"}, None, {"id": "Ann Lee", "type": "person"}, {"id": "bob", "type": "tHING"}]
    edge = lambda a, b, **more: {"source_node_id": a, "target_node_id": b, "type": "knows of"} | more
    edges = [edge("ANN lee", "bob"), edge("bob", "carl"), edge("bob", "ann lee", target_node_type="robot"), edge(None, "bob"), edge("", "bob")]
    want = [
        (0, "Ann Lee", "Node", "Bob", "Thing", "KNOWS_OF"), (1, "Bob", "Thing", "Carl", None, "KNOWS_OF"), (2, "Bob", "Thing", "Ann Lee", "Robot", "KNOWS_OF"),
        (4, "", None, "Bob", "Thing", "KNOWS_OF"),
    ]
    flat, boxed = json.dumps({"nodes": nodes, "relationships": edges}), json.dumps({"nodes": {"Items": nodes}, "relationships": {"Items": edges}})
    rows = [(1, flat), (2, boxed), (3, "sorry"), (4, json.dumps({"relationships": edges[1:2]})), (None, flat), (None, flat)]
    untyped = [(None, *w[:2], "Robot" if w[2] == "Robot" else None, w[3], "Robot" if w[4] == "Robot" else None, w[5]) for w in want]
    every = [(k, *w) for k in (1, 2) for w in want] + [(4, 0, "Bob", None, "Carl", None, "KNOWS_OF")] + untyped * 2
    found = replies.parse_graph_replies(spark.createDataFrame(rows, "request_id long, reply string"))[1]
    assert sorted(map(repr, every)) == sorted(repr(tuple(x)) for x in found.collect())
    assert "Exchange" not in plan(found)  # nodes were sorted and joined before
    # a request of several replies knows the nodes of all
    several = [(1, json.dumps({"relationships": edges[:1]})), (1, json.dumps({"nodes": nodes[3:]}))]
    found = replies.parse_graph_replies(spark.createDataFrame(several, "request_id long, reply string"))[1]
    assert [tuple(x) for x in found.collect()] == [(1, 0, "Ann Lee", "Person", "Bob", "Thing", "KNOWS_OF")]


# ---- F24: unconnected ----

def test_unconnected_reads_edges_once(spark, tmp_path):
    from weftgraph.operators import graph

    pairs = [("a", "b"), ("c", "c"), (None, "d"), ("d", None), ("x", "gone")]
    spark.createDataFrame(pairs, "source_entity_id string, target_entity_id string").write.parquet(str(tmp_path / "edges"))
    e = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "x", "alone", None)], "entity_id string")
    found = graph.unconnected(e, spark.read.parquet(str(tmp_path / "edges")))
    assert plan(found).count("FileScan parquet") == 1  # 2 before
    assert {x.entity_id for x in found.collect()} == {"c", "d", "alone", None}


# ---- F31: merge_entities ----

def test_merged_edges_are_read_once_and_sorted_where_dealt(spark, tmp_path):
    from weftgraph.operators import resolve

    edge = "source_entity_id string, target_entity_id string, relationship_type string, relationship_id string, strength double, note map<string,string>"
    rows = [("a", "c", "T", "r1", 0.2, {"k": "weak"}), ("b", "c", "T", "r2", 0.9, {"k": "strong"}), ("a", "b", "T", "r3", 1.0, None), ("c", "a", "T", "r4", None, None), ("c", "b", "T", "r0", 0.9, None), ("b", "c", "T", "r9", 0.9, {"k": "last"})]
    spark.createDataFrame(rows, edge).write.parquet(str(tmp_path / "edges"))
    e = spark.createDataFrame([(x, x.upper()) for x in "abc"], "entity_id string, name string")
    merged = resolve.merge_entities(e, spark.read.parquet(str(tmp_path / "edges")), spark.createDataFrame([("b", "a")], "entity_id string, primary_id string"))[1]
    found = plan(merged)
    assert merged.columns == ["source_entity_id", "target_entity_id", "relationship_type", "relationship_id", "strength", "note", "merged"]
    assert sorted(map(tuple, merged.collect())) == [("a", "c", "T", "r1", 0.9, {"k": "last"}, 3), ("c", "a", "T", "r0", 0.9, None, 2)]
    assert found.count("/edges]") == 1  # 2 before: the other fields were joined again
    below = found[found.index("partial_max_by"):]
    assert below.index("REPARTITION_BY_COL") < below.index("FileScan")  # grouping starts above the exchange
