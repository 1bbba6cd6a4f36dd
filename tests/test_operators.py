import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import curate, graph, pages, replies, resolve, sinks, vectors, verify
from weftgraph.sources import documents as sources
from weftgraph.streaming import jobs


def test_upsert_is_idempotent_on_content(spark):
    kind = "entity_id string, name string, entity_type string, description string, aliases array<string>, source_chunk_ids array<string>, version int, seq long"
    stored = spark.createDataFrame([("e1", "TNF", "GENE", "old", ["a"], ["c1"], 3, 0)], kind)
    new = spark.createDataFrame([("e9", "TNF", "GENE", None, [], ["c2", "c1"], 1, 5), ("e2", "Aspirin", "DRUG", "x", [], ["c2"], 1, 6)], kind)
    once = resolve.upsert_entities(stored, new)
    got = {r["name"]: r for r in once.collect()}
    assert got["TNF"]["entity_id"] == "e1" and got["TNF"]["description"] == "old" and got["TNF"]["version"] == 4
    assert got["TNF"]["source_chunk_ids"] == ["c1", "c2"] and got["TNF"]["aliases"] == ["a"]
    again = resolve.upsert_entities(once.withColumn("seq", F.lit(0).cast("long")), new)
    cols = ["entity_id", "name", "description", "source_chunk_ids", "aliases"]
    assert sorted(map(str, again.select(cols).collect())) == sorted(map(str, once.select(cols).collect()))


def test_resolve_fallback(spark):
    e = spark.createDataFrame([("d", "Alpha", "e1", 1), ("d", "alpha", "e2", 2)], "document_id string, name string, entity_id string, seq long")
    edges = spark.createDataFrame([("d", " ALPHA ", "Alfa", "r1"), ("d", "alpha", "nobody", "r2")], "document_id string, source_name string, target_name string, rid string")
    decisions = spark.createDataFrame([("d", "alfa", "e1", 0.8), ("d", "nobody", "e1", 0.6)], "document_id string, new_name string, existing_id string, confidence double")
    got = resolve.resolve_fallback(edges, e, decisions).collect()
    assert [(r.rid, r.source_entity_id, r.target_entity_id) for r in got] == [("r1", "e2", "e1")]
    assert resolve.resolve_endpoints(edges, e).count() == 0


def test_merge_pairs(spark):
    kind = "entity_id string, name string, entity_type string, description string, aliases array<string>, source_chunk_ids array<string>, confidence double"
    rows = spark.createDataFrame([(("a", "A", "GENE", None, ["x"], ["c1"], 0.5), ("b", "B", "GENE", "d", None, ["c2", "c1"], 0.5))], f"a struct<{kind.replace(' ', ':').replace(',:', ',')}>, b struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    r = resolve.merge_pairs(rows).first()
    assert (r.entity_id, r.description, r.aliases, r.source_chunk_ids) == ("a", "d", ["x"], ["c1", "c2"])


@pytest.mark.parametrize(
    ("reply", "n_ok", "n_failed"),
    [
        ('{"entities": [{"name": "a", "type": "GENE"}]}', 1, 0),
        ('```json\n{"entities": [{"name": "a", "type": "GENE"}, {"name": "b", "type": "DRUG"}]}\n```', 2, 0),
        ('{"entities": [{"name": "a", "type": "GENE"}, {"name": "b"}]}', 0, 1),
        ('{"things": []}', 0, 1),
        ("no json", 0, 1),
        (None, 0, 1),
        ('{"entities": []}', 0, 0),
    ],
)
def test_entity_replies(spark, reply, n_ok, n_failed):
    ok, failed = replies.parse_entity_replies(spark.createDataFrame([(1, reply)], "request_id int, reply string"))
    assert (ok.count(), failed.count()) == (n_ok, n_failed)


def test_graph_replies(spark):
    reply = {"nodes": {"Items": [{"id": "tnf-alpha", "type": "gene"}, {"id": None, "type": "x"}]}, "relationships": {"Items": [{"source_node_id": "tnf-alpha", "target_node_id": "asthma", "type": "linked to"}]}}
    nodes, edges = replies.parse_graph_replies(spark.createDataFrame([(1, json.dumps(reply))], "request_id int, reply string"))
    assert [(r.id, r.type) for r in nodes.collect()] == [("Tnf-Alpha", "Gene")]
    assert [(r.source, r.source_type, r.type, r.target_type) for r in edges.collect()] == [("Tnf-Alpha", "Gene", "LINKED_TO", None)]


def test_other_replies(spark):
    def rows(reply):
        return spark.createDataFrame([(1, json.dumps(reply))], "request_id int, reply string")

    assert replies.parse_classifications(rows({"classifications": [{"category": "a", "confidence": 0.5}], "primary_category": "a"})).first()["category"] == "a"
    assert replies.parse_summaries(rows({"summary": "s", "themes": ["t"]})).first()["themes"] == ["t"]
    assert replies.parse_entity_matches(rows({"matches": [{"new_name": "a", "existing_name": "b", "confidence": 1}, {"new_name": "a"}]})).count() == 1
    assert {r.value for r in replies.parse_schema_replies(rows({"labels": ["A"], "relationshipTypes": ["B"]})).collect()} == {"A", "B"}
    props = spark.createDataFrame([({"birth date": "x"},)], "properties map<string,string>")
    assert replies.to_graph_rows(props, "properties").first()["properties"] == {"birthDate": "x"}


def test_cascade_skips_and_absent_stages(spark):
    rows = spark.createDataFrame(
        [("failed", 0.5, "skipped", None, None, None), (None, None, "skipped", None, None, None), (None, None, None, None, None, None), ("passed", 0.9, "passed", 0.1, "failed", 0.1), ("failed", 0.4, "passed", 0.5, "passed", 0.6)],
        "text_status string, text_confidence double, embedding_status string, embedding_confidence double, llm_status string, llm_confidence double",
    )
    got = [(r.status, r.confidence) for r in verify.verify_cascade(rows).select("status", "confidence").collect()]
    assert got == [("passed", 0.5), ("skipped", 0.0), ("failed", 0.0), ("passed", 0.9), ("passed", 0.525)]
    assert verify.undecided(rows, "text").count() == 4


def test_verdicts_and_conflict_verdicts(spark):
    rows = spark.createDataFrame([("c", '{"verdict": "valid", "confidence": 7}'), ("c", "x"), ("", '{"verdict": "valid", "confidence": 1}'), ("c", None)], "context string, reply string")
    assert [(r.llm_status, r.llm_confidence) for r in verify.parse_verdict(rows).collect()] == [("passed", 1.0), ("failed", 0.0), ("failed", 0.0), (None, None)]
    said = spark.createDataFrame([('{"verdict": "contradictory"}',), ('{"verdict": "redundant"}',), ("x",)], "reply string")
    assert verify.apply_conflict_verdicts(said).count() == 1


def test_curation_folds_in_order(spark):
    e = spark.createDataFrame([("e1", "n", "d", False, 1, "flagged"), ("e2", "m", "d", True, 1, "flagged")], "entity_id string, name string, description string, rejected boolean, version int, status string")
    ev = spark.createDataFrame(
        [(1, "reject_entity", "e1", {}), (2, "correct_entity", "e1", {"name": "better"}), (3, "approve_entity", "e1", {}), (4, "approve_entity", "gone", {}), (5, "approve_relationship", "e2", {})],
        "seq long, action string, target_id string, corrections map<string,string>",
    ).withColumn("curator", F.lit("c")).withColumn("reason", F.lit("r"))
    done, errors = curate.apply_curation(e, ev, "entity_id", "entity", ("name",), close_on_decision=True)
    got = {r.entity_id: r for r in done.collect()}
    assert (got["e1"]["name"], got["e1"].curated, got["e1"].rejected, got["e1"].version, got["e1"].status) == ("better", True, False, 4, "verified")
    assert (got["e2"].curated, got["e2"].rejected, got["e2"].version) == (False, True, 1)
    assert [r.seq for r in errors.collect()] == [4]
    short = spark.createDataFrame([("flag", None, "r1"), ("approve", "e1", None), ("reject_entity", "e1", None)], "action string, entity_id string, relationship_id string")
    assert [r.action for r in curate.resolve_action(short).collect()] == ["reject_relationship", "approve_entity", "reject_entity"]


def test_crawl_order_matches_a_queue(spark):
    links = {"a": ["b", "c"], "b": ["d", "a"], "c": ["e", "d"], "d": ["f"], "e": []}
    rows = spark.createDataFrame([(f"http://x.y/{u}", i, f"http://x.y/{v}") for u, vs in links.items() for i, v in enumerate(vs)], "url string, pos int, link string")
    seeds = spark.createDataFrame([("http://x.y/a", 1)], "url string, rank int")
    got = [r.url[-1] for r in pages.crawl_order(rows, seeds, ["y"], [], 5).orderBy("rank").collect()]
    queue, seen = ["a"], ["a"]
    while queue:
        for v in links.get(queue.pop(0), []):
            if v not in seen and len(seen) < 5:
                seen.append(v)
                queue.append(v)
    assert got == seen
    assert pages.crawl_order(rows, seeds, [], ["x.y"], 5).count() == 0


def test_hashed_search_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    q = e.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    exact = {(r.query_id, r.item_id) for r in vectors.vector_topk(q, e, 5, skip_self=True).collect()}
    near = {(r.query_id, r.item_id) for r in vectors.vector_topk_hashed(q, e, 5, skip_self=True).collect()}
    assert near == exact


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_hashed_search_recall(spark, sf, size):
    """The registered query with the parameters it runs with, against the exact one, on each size there is."""
    from weftgraph.plans import QUERIES

    path = Path(sf).parent / size
    if not path.is_dir():
        pytest.skip("no such tables")
    exact, near = ({(r.query_id, r.item_id) for r in QUERIES[name](spark, str(path)).collect()} for name in ("vector_topk", "vector_topk_hashed"))
    assert len(exact & near) >= 0.9 * len(exact)


def test_relationship_search_and_match(spark):
    hits = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5)], "query_id int, item_id string, score double")
    edges = spark.createDataFrame([("r1", "b", "c"), ("r2", "a", "b"), ("r3", "c", "d")], "relationship_id string, source_entity_id string, target_entity_id string")
    assert [(r.relationship_id, r.score) for r in vectors.vector_topk_relationships(hits, edges, 5).orderBy("rank").collect()] == [("r2", 0.9), ("r1", 0.5)]
    a = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    b = spark.createDataFrame([(7, [0.0, 1.0]), (8, [1.0, 0.1])], "item_id int, vector array<double>")
    assert vectors.best_match(a, b).first()["item_id"] == 8


def test_claims_pair_all_named_entities(spark):
    from weftgraph.operators import claims as C

    claim = spark.createDataFrame([(1, "item is bad")], "claim_id long, text string")
    e = spark.createDataFrame([(f"e{i:02}", f"item {i}") for i in range(60)], "entity_id string, name string")
    r = spark.createDataFrame([("r1", "e55", "e58", "MAKES", "x"), ("r2", "e01", "e02", "MAKES", "x")], "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, description string").withColumn("trust", F.lit("user"))
    assert C.claim_pairs(claim, e).count() == 60 * 59 // 2
    assert {x.old_relationship_id for x in C.claim_conflicts(claim, e, r).collect()} == {"r1", "r2"}


def test_rules_validity_strict(spark):
    chunks = spark.createDataFrame([("c1", "Alpha beta"), ("c2", "gamma")], "chunk_id string, content string")
    rules = spark.createDataFrame([("r1", ["alpha"], None, False), ("r2", ["alpha"], ["gamma"], True)], "rule_id string, patterns array<string>, keywords array<string>, case_sensitive boolean")
    assert {(r.chunk_id, r.rule_id) for r in graph.match_rules(chunks, rules).collect()} == {("c1", "r1"), ("c2", "r2")}
    edges = spark.sql("select 1 as id, named_struct('start_date', timestamp'2024-01-01', 'end_date', timestamp'2024-02-01') as temporal_validity union all select 2, null union all select 3, named_struct('start_date', timestamp'2025-01-01', 'end_date', cast(null as timestamp))")
    assert {r.id for r in graph.valid_at(edges, F.lit("2024-02-01").cast("timestamp")).collect()} == {1, 2}
    nodes = spark.createDataFrame([("n", "Gene")], "id string, type string")
    rels = spark.createDataFrame([("GENE", "drug", "t")], "source_type string, target_type string, type string")
    a, b = graph.strict_filter(nodes, rels, ["gene"], [])
    assert (a.count(), b.count()) == (1, 0)


def test_sources_and_sinks_roundtrip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    (tmp_path / "in" / "b.md").write_text("# T\nx")
    (tmp_path / "items.json").write_text('[{"a": "x", "b": ["p", "q"]}, {"a": "y"}]')
    (tmp_path / "events.json").write_text('[{"action": "approve_entity", "target_id": "e1", "corrections": {"name": "n"}}]')
    (tmp_path / "ctx.json").write_text('{"r1": "passage"}')
    assert {(r.title, r.content) for r in sources.documents_from_dir(spark, str(tmp_path / "in")).collect()} == {("a", "hello"), ("b", "# T\nx")}
    assert [(r.page_number, r.total_pages, r.text) for r in sources.json_pages(spark, str(tmp_path / "items.json")).collect()] == [(1, 2, "x\np\nq"), (2, 2, "y")]
    assert sources.read_curation_events(spark, str(tmp_path / "events.json")).first()["corrections"] == {"name": "n"}
    assert sources.read_context_map(spark, str(tmp_path / "ctx.json")).first()["context"] == "passage"
    e = spark.createDataFrame([("e1", "A<&", "GENE", None, False), ("e2", "B", "DRUG", "d", False)], "entity_id string, name string, entity_type string, description string, rejected boolean")
    r = spark.createDataFrame([("r1", "e1", "e2", "RELATED_TO", None, 0.5, False), ("r2", "e1", "zz", "RELATED_TO", None, 0.5, False)], "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, description string, strength double, rejected boolean")
    sinks.export_json(e, r, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "entities")).count() == 2
    import xml.etree.ElementTree as ET

    text = "\n".join(x.value for x in sinks.graphml_lines(e, r).orderBy("part", "id").collect())
    root = ET.fromstring(text.encode())
    names = [x.tag.split("}")[1] for x in root.iter()]
    assert (names.count("node"), names.count("edge"), names.count("key")) == (2, 1, 9)
    m = spark.createDataFrame([({"a": "1", "b": None},), ({},)], "p map<string,string>")
    assert [x.p for x in sinks.decode_props(sinks.encode_props(m, ["p"]), ["p"]).collect()] == [{"a": "1"}, {}]


def test_xml_products_associations_articles(spark):
    x = spark.createDataFrame([("<r><title>T</title><b>u <c>v</c></b></r>",)], "x string")
    title, text = sources.xml_to_doc(F.col("x"))
    assert tuple(x.select(title.alias("t"), text.alias("b")).first()) == ("T", "T u v")
    p = spark.sql("select 'Pump' as t, array('a', 'b') as k, cast(null as string) as d, array(map('Size', '3')) as s")
    assert p.select(sources.product_text(F.col("t"), F.col("k"), F.col("d"), F.col("s")).alias("x")).first()["x"] == "Title: Pump\nKeywords: a, b\nSpecification: Size: 3"
    rows = spark.createDataFrame([("d1", "Asthma", "t1", "IL6", "interleukin 6", "protein", 1.4), ("d1", "Asthma", "t2", None, "other", "rna", 0.1)], "disease_id string, disease_name string, target_id string, symbol string, target_name string, biotype string, score double")
    nodes, edges = sources.ingest_associations(rows, 0.5)
    assert {(r.name, r.alias) for r in nodes.collect()} == {("Asthma", None), ("IL6", "interleukin 6")}
    assert [(r.description, r.strength) for r in edges.collect()] == [("Association score: 1.400", 1.0)]
    arts = spark.createDataFrame([("p1", "T", "abs", ["A", "A", "B"], ["M"], ["M", "K"]), ("p2", "U", None, ["a"], None, None)], "pmid string, title string, abstract string, authors array<string>, mesh_terms array<string>, keywords array<string>")
    nodes, edges = sources.ingest_articles(arts)
    assert nodes.groupBy("entity_type").count().collect().__len__() == 3
    assert nodes.where("entity_type = 'Person'").count() == 2 and edges.count() == 5


def test_streams(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(20)
    docs.write.parquet(str(tmp_path / "src"))
    q = jobs.stream_documents(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    n = spark.read.parquet(str(tmp_path / "out")).count()
    q = jobs.stream_documents(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert n > 0 and spark.read.parquet(str(tmp_path / "out")).count() == n
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "1.json").write_text('{"seq": 1, "action": "approve_entity", "target_id": "e1"}\n')
    seen = []
    jobs.stream_curation(spark, str(tmp_path / "ev"), lambda df, k: seen.extend((r.seq, k) for r in df.collect()), str(tmp_path / "ck2")).awaitTermination()
    assert seen == [(1, 0)]
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"))
    e.write.parquet(str(tmp_path / "jobs"))
    s = jobs.stream_snapshots(spark.readStream.schema(e.schema).parquet(str(tmp_path / "jobs")), str(tmp_path / "snapshots"), str(tmp_path / "ck3"))
    s.processAllAvailable()
    s.stop()
    got = {(r.job_id, r.status, r.n_events) for r in spark.read.parquet(str(tmp_path / "snapshots")).collect()}
    now = jobs.job_snapshots(e)
    assert got == {(r.job_id, r.status, r.n_events) for r in now.collect()}
    assert jobs.changed_snapshots(now, now).count() == 0


def test_stream_of_documents_makes_a_graph(spark, tmp_path):
    kind = "doc_id long, text string"
    spark.createDataFrame([(1, "Aspirin treats Headache"), (2, "Bayer makes Aspirin")], kind).coalesce(1).write.parquet(str(tmp_path / "src"))

    def extract(chunks):
        words = chunks.select("chunk_id", F.explode(F.split("content", " ")).alias("name")).where("name rlike '^[A-Z]'")
        entities = words.select(F.md5(F.concat("chunk_id", "name")).alias("entity_id"), "name", F.lit("Concept").alias("entity_type"), F.array("chunk_id").alias("source_chunk_ids"), F.xxhash64("chunk_id").alias("seq"))
        ends = words.groupBy("chunk_id").agg(F.min("name").alias("a"), F.max("name").alias("b"))
        edges = ends.select(F.col("chunk_id").alias("relationship_id"), F.md5(F.concat("chunk_id", "a")).alias("source_entity_id"), F.md5(F.concat("chunk_id", "b")).alias("target_entity_id"), F.lit("RELATED_TO").alias("relationship_type"), F.lit(0).cast("long").alias("seq"))
        return entities, edges

    versions = []
    for more in ([], [(3, "Aspirin helps Fever")]):
        if more:
            spark.createDataFrame(more, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        jobs.stream_documents(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck"), extract=extract).awaitTermination()
        stores = jobs.graph_stores(spark, f"{tmp_path}/out-graph")
        versions.append({k: s.read() for k, s in zip(("entities", "relationships"), stores, strict=True)})
    first, second = versions
    assert {r.name for r in first["entities"].collect()} == {"Aspirin", "Headache", "Bayer"}
    found = {r.name: r for r in second["entities"].collect()}
    assert set(found) == {"Aspirin", "Headache", "Bayer", "Fever"} and len(found["Aspirin"].source_chunk_ids) == 3 and found["Aspirin"].version == 3
    assert found["Aspirin"].entity_id == {r.name: r.entity_id for r in first["entities"].collect()}["Aspirin"]
    assert second["relationships"].count() == 3 and graph.check_endpoints(second["relationships"], second["entities"])[1].count() == 0


def test_staged_tables_can_be_dropped(spark):
    from weftgraph import staging

    df = staging.stage(spark.range(5), "five")
    path = df.inputFiles()[0].split("five")[0].removeprefix("file://")
    assert df.count() == 5 and Path(path).is_dir() and staging.drop_staged(spark) >= 1 and not Path(path).is_dir()
    assert staging.drop_staged(spark) == 0


def test_progress_rows(spark, tmp_path):
    path = str(tmp_path / "events")
    for i, stage in enumerate(("fetch", "chunk", "completed")):
        jobs.append_progress(spark, path, "j", i, stage)
    r = jobs.job_snapshots(spark.read.parquet(path)).first()
    assert (r.status, r.current_stage, r.n_events, r.last_events, set(r.stages)) == ("completed", "completed", 3, [2, 1, 0], {"fetch", "chunk", "completed"})


def test_last_events_are_cut_in_parts(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("job_id"), F.col("id").alias("seq"), F.lit("fetch").alias("stage"), F.current_timestamp().alias("ts"))
    for r in jobs.job_snapshots(rows, 7).collect():
        assert r.last_events == [4998 + r.job_id - 2 * i for i in range(7)] and r.n_events == 2500


def test_components_of_a_long_chain(spark):
    ids = [f"n{i:04}" for i in range(301)]
    e = spark.createDataFrame([(x,) for x in [*ids, "alone"]], "entity_id string")
    order = sorted(range(300), key=lambda i: i * 7919 % 300)
    r = spark.createDataFrame([(str(i), ids[i], ids[i + 1]) for i in order] + [("gone", "n0000", "missing"), ("back", "missing", "alone")], "relationship_id string, source_entity_id string, target_entity_id string")
    assert {x.entity_id: x.component for x in graph.components(e, r).collect()} == {x: "n0000" for x in ids} | {"alone": "alone"}
    assert graph.components(e.limit(0), r).count() == 0
    from weftgraph.operators.stars import star_components

    with pytest.raises(RuntimeError, match="still move"):
        star_components(r.select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b")), 2)


def test_upsert_keeps_every_field(spark):
    kind = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, strength double, trust string, tags array<string>, properties map<string,string>, version int, seq long"
    stored = spark.createDataFrame([("r1", "a", "b", "T", 0.5, "user", ["x"], {"k": "1"}, 2, 0)], kind)
    new = spark.createDataFrame([("r2", "a", "b", "T", None, "curated", ["y", "x"], {}, 1, 1), ("r3", "a", "b", "T", None, None, None, {"m": "2"}, 1, 2), ("r4", "a", "gone", "T", 1.0, None, None, None, 1, 3)], kind)
    e = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    (r,) = resolve.upsert_relationships(stored, new, e).collect()
    assert (r.relationship_id, r.strength, r.trust, r.tags, r.properties, r.version) == ("r1", 0.5, "curated", ["x", "y"], {"m": "2"}, 4)
    mapping = spark.createDataFrame([("b", "a")], "entity_id string, primary_id string")
    named = spark.createDataFrame([("a", "A", ["old"]), ("b", "B", None), ("c", "C", None)], "entity_id string, name string, aliases array<string>")
    edges = spark.createDataFrame([("r1", "a", "c", "T", 0.5, "weak"), ("r2", "b", "c", "T", 0.9, "strong"), ("r3", "a", "b", "T", 1.0, "x")], "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, strength double, description string")
    kept, moved = resolve.merge_entities(named, edges, mapping)
    assert {x.entity_id: x.aliases for x in kept.collect()} == {"a": ["old", "B"], "c": []}
    assert [(x.relationship_id, x.strength, x.description, x.merged) for x in moved.collect()] == [("r1", 0.9, "strong", 2)]


def test_names_left_over_get_vector_candidates(spark):
    e = spark.createDataFrame([("d", "Alpha", "e1")], "document_id string, name string, entity_id string")
    edges = spark.createDataFrame([("d", "alpha", "Alfa"), ("d", "Alpha", "nobody")], "document_id string, source_name string, target_name string")
    names = spark.createDataFrame([("Alfa", [1.0, 0.1]), ("nobody", [-1.0, 0.0]), ("alpha", [1.0, 0.0])], "name string, vector array<double>")
    stored = spark.createDataFrame([("e1", [1.0, 0.0]), ("e2", [0.0, 1.0])], "item_id string, vector array<double>")
    got = {(r.document_id, r.new_name, r.existing_id) for r in resolve.vector_aliases(edges, e, names, stored).collect()}
    assert got == {("d", "Alfa", "e1")}


def test_csv_files_and_stored_pages(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z,w\n" + "".join(f"{i},b,,d\n" for i in range(7)))
    rows = sources.csv_to_doc(spark, str(tmp_path), 3).orderBy("part").collect()
    assert [r.row_count for r in rows] == [3, 3, 1] and rows[0].title == "CSV Data: x, y, z" and rows[0].column_count == 4
    assert rows[2].content == "x | y | z | w\n6 | b |  | d"
    docs = spark.createDataFrame([("1", " ", "u1", None), ("2", "own", "u1", None), ("3", None, "u2", None)], "document_id string, content string, source_url string, tags array<string>")
    ok, bad = sources.documents_from_text(docs, spark.createDataFrame([("u1", "stored ")], "url string, content string"))
    assert {(r.document_id, r.content) for r in ok.collect()} == {("1", "stored"), ("2", "own")} and [r.document_id for r in bad.collect()] == ["3"]


def test_chunks_by_a_users_function(spark):
    from weftgraph.operators import chunking

    docs = spark.createDataFrame([(1, "a;b;; c"), (2, None), (3, "")], "document_id int, content string")
    got = [(r.document_id, r.chunk_index, r.content) for r in chunking.chunk_with(docs, lambda c: F.split(c, ";")).collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, " c")]
    upper = F.udf(lambda t: None if t is None else [t.upper(), None], "array<string>")
    assert [r.content for r in chunking.chunk_with(docs, upper).collect()] == ["A;B;; C"]


def test_crawl_goes_as_deep_as_it_must(spark):
    rows = spark.createDataFrame([(f"http://x.y/{i}", 0, f"http://x.y/{i + 1}") for i in range(80)], "url string, pos int, link string")
    seeds = spark.createDataFrame([("http://x.y/0", 1)], "url string, rank int")
    got = pages.crawl_order(rows, seeds, ["x.y"], [], 100).collect()
    assert len(got) == 81 and max(r.level for r in got) == 80


def test_search_terms_of_a_long_text(spark):
    from weftgraph.functions import core

    text = " ".join(f"Word{i % 20000}" if i % 2 else f"word{i % 20000}" for i in range(60000)) + " the of"
    terms = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(core.search_terms(F.col("t")).alias("x")).collect()
    assert terms[0].x == [f"Word{i}" if i % 2 else f"word{i}" for i in range(20000)] and terms[1].x == [] and terms[2].x is None


def test_blocks_cover_all_queries_once(spark):
    from weftgraph.operators.blocks import in_blocks

    queries = spark.range(50).withColumnRenamed("id", "q")
    rows = spark.range(20)
    got = in_blocks(queries, "q", lambda some: rows.join(some, F.col("id") == F.col("q") % 20), rows=7)
    assert sorted(r.q for r in got.collect()) == list(range(50))
    wide = queries.select("q", F.array_repeat(F.lit(1.0), 1 << 17).alias("v"))
    assert in_blocks(wide, "q", lambda some: rows.join(some.select("q"), F.col("id") == F.col("q"))).count() == 20
    assert in_blocks(queries.limit(0), "q", lambda some: rows.join(some, F.col("id") == F.col("q"))).count() == 0
