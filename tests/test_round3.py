"""Curation over stored state, pattern matching, the vector index, names by keys, merge chains, keyed job state, the bucket store."""

import json
import random
import re
import xml.etree.ElementTree as ET
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.operators import automaton, cells, chunking, curate, graph, names, resolve, sinks, vectors, verify
from weftgraph.sources.json_split import json_items
from weftgraph.store import BucketStore
from weftgraph.streaming import jobs

EVENT = "seq long, action string, target_id string, curator string, reason string, corrections map<string,string>"


# ---- curation ----

def folded(rows, events):
    """One event after the other on a dictionary."""
    rows = {k: dict(v) for k, v in rows.items()}
    for _, action, target, curator, reason, said in sorted(events):
        row = rows.get(target)
        if row is None or not action.endswith("entity"):
            continue
        if action.startswith("correct"):
            row |= {k: v for k, v in (said or {}).items() if k == "name"}
        else:
            row["rejected"] = action.startswith("reject")
        row |= {"curated": True, "curated_by": curator, "version": row["version"] + 1}
        row["curation_reason"] = reason or row["curation_reason"]
    return rows


def test_curation_by_batches_is_a_sequential_fold(spark):
    r = random.Random(4)
    kinds = ("approve_entity", "reject_entity", "correct_entity", "approve_relationship")
    events = [(i, r.choice(kinds), f"e{r.randrange(7)}", f"c{i}", r.choice(["", None, f"r{i}"]), {"name": f"n{i}"}) for i in range(40)]
    events = [(1000, "reject_entity", "e0", "c", "r", {}), (1001, "correct_entity", "e0", "c", None, {"name": "x"}), *events]
    start = {f"e{i}": {"name": f"e{i}", "curated": i == 3, "rejected": i == 4, "curated_by": None, "curation_reason": None, "version": 1} for i in range(6)}
    kind = "entity_id string, name string, curated boolean, rejected boolean, version int"
    rows = spark.createDataFrame([(k, v["name"], v["curated"], v["rejected"], 1) for k, v in start.items()], kind)
    want = folded(start, events)
    for cuts in ([(0, 2000)], [(0, 13), (13, 27), (27, 2000)]):
        now = rows
        for low, high in cuts:
            batch = spark.createDataFrame([e for e in events if low <= e[0] < high], EVENT)
            now, _ = curate.apply_curation(now, batch, "entity_id", "entity", ("name",))
        assert len(now.columns) == len(set(now.columns))
        assert {x.entity_id: {k: x[k] for k in next(iter(want.values()))} for x in now.collect()} == want
    assert want["e0"]["curated"] and want["e0"]["rejected"]


def test_impossible_corrections_are_errors_and_properties_merge(spark):
    rows = spark.createDataFrame([("r1", "RELATED_TO", 0.5, {"a": "1", "b": "1"})], "relationship_id string, relationship_type string, strength double, properties map<string,string>")
    events = [
        (1, "correct_relationship", "r1", "c", "", {"strength": "much"}), (2, "correct_relationship", "r1", "c", "", {"relationship_type": "LIKES"}),
        (3, "correct_relationship", "r1", "c", "", {"strength": "0.75", "properties": '{"b": "2"}'}), (4, "correct_relationship", "r1", "d", "why", {"properties": '{"c": "3"}'}),
    ]
    done, errors = curate.apply_curation(rows, spark.createDataFrame(events, EVENT), "relationship_id", "relationship", ("relationship_type", "strength", "properties"))
    got = done.first()
    assert (got.relationship_type, got.strength, got.properties, got.version, got.curated_by) == ("RELATED_TO", 0.75, {"a": "1", "b": "2", "c": "3"}, 3, "d")
    assert sorted(r.seq for r in errors.collect()) == [1, 2]


def test_stored_graph_is_curated_by_a_stream(spark, tmp_path):
    """Three files of events, each a batch; a run over the same checkpoint changes nothing; corrected names move to other buckets."""
    path = str(tmp_path / "graph")
    nodes = spark.createDataFrame([(f"e{i}", f"n{i}", "Concept", None, False, i) for i in range(20)], "entity_id string, name string, entity_type string, description string, rejected boolean, seq long")
    links = spark.createDataFrame([("r1", "e1", "e2", "RELATED_TO", None, 1.0, False, 1)], "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, description string, strength double, rejected boolean, seq long")
    jobs.upsert_graph(spark, path, 0, nodes, links, 8)
    (tmp_path / "ev").mkdir()
    lines = [
        '{"seq": 1, "action": "reject_entity", "target_id": "e1", "curator": "a", "reason": "x"}\n{"seq": 2, "action": "approve_relationship", "target_id": "r1", "curator": "a"}',
        '{"seq": 3, "action": "correct_entity", "target_id": "e1", "curator": "b", "corrections": {"name": "better"}}\n{"seq": 4, "action": "approve_entity", "target_id": "gone", "curator": "b"}',
        '{"seq": 5, "action": "approve_entity", "target_id": "e2", "curator": "c"}\n{"seq": 6, "action": "view", "target_id": "e2", "curator": "c"}',
    ]
    for i, text in enumerate([*lines, None]):
        if text:
            (tmp_path / "ev" / f"{i}.json").write_text(text + "\n")
        jobs.stream_curated_graph(spark, str(tmp_path / "ev"), path, str(tmp_path / "audit"), str(tmp_path / "ck"), 8).awaitTermination()
    stores = jobs.graph_stores(spark, path, 8)
    got = {r.entity_id: r for r in stores[0].read().collect()}
    assert len(got) == 20 and (got["e1"].name, got["e1"].curated, got["e1"].rejected, got["e1"].curation_reason, got["e1"].version) == ("better", True, True, "x", 3)
    assert (got["e2"].curated, got["e2"].rejected, got["e2"].version) == (True, False, 2) and not got["e3"].curated
    assert stores[1].read().first()["curated"]
    audit = {r.seq: r.success for r in spark.read.json(str(tmp_path / "audit")).collect()}
    assert audit == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False}
    # the corrected name is where its keys belong: an upsert finds it
    again = spark.createDataFrame([("new", "better", "Concept", "d", None, 50)], nodes.schema)
    assert stores[0].upsert(7, again, resolve.upsert_entities) == 1
    assert {r.entity_id: r.description for r in stores[0].read().collect()}["e1"] == "d"


# ---- the bucket store ----

def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "t"), ["k"], 64)
    assert store.read() is None

    def merge(stored, new):
        return stored.unionByName(new, allowMissingColumns=True).groupBy("k").agg(F.max_by("v", "seq").alias("v"))

    def rows(pairs):
        return spark.createDataFrame([(k, v, 0) for k, v in pairs], "k string, v string, seq long")

    def files():
        return {str(p) for p in (tmp_path / "t" / "data").rglob("*.parquet")}

    every = {f"k{i}": "a" for i in range(500)}
    assert store.upsert(0, rows(every.items()), merge) == 64
    before, three = files(), rows([(f"k{i}", "b") for i in (1, 2, 3)])
    buckets = store.touched(three)
    assert store.upsert(1, three, merge) == len(buckets) <= 3
    fresh = files() - before
    assert {int(re.search(r"bucket=(\d+)", f)[1]) for f in fresh} == set(buckets)
    every |= {"k1": "b", "k2": "b", "k3": "b"}
    assert {r.k: r.v for r in store.read().collect()} == every
    assert store.upsert(1, three, merge) == 0 and files() == before | fresh
    # a run that dies after its data, before its version: readers see the old version, the batch comes again
    publish, store._publish = store._publish, lambda state: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError, match="killed"):
        store.upsert(2, rows([("k9", "c")]), merge)
    store._publish = publish
    other = BucketStore(spark, str(tmp_path / "t"), ["k"], 8)
    assert other.buckets == 64 and {r.k: r.v for r in other.read().collect()} == every
    assert other.upsert(2, rows([("k9", "c")]), merge) == 1
    every["k9"] = "c"
    assert other.drop_old() > 0 and {r.k: r.v for r in BucketStore(spark, str(tmp_path / "t"), ["k"]).read().collect()} == every


# ---- job state ----

def test_job_state_stream_equals_snapshots(spark, sf, tmp_path):
    """Three runs over one checkpoint; a run without news emits nothing; a job's row comes only when it has changed."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"),
    )
    most = e.agg(F.max("seq")).first()[0]
    few = sorted(r.job_id for r in e.select("job_id").distinct().collect())[:3]
    parts = [e.where(F.col("seq") < most // 2), e.where((F.col("seq") >= most // 2) & F.col("job_id").isin(few)), None, e.where((F.col("seq") >= most // 2) & ~F.col("job_id").isin(few))]
    source, sizes = str(tmp_path / "src"), []
    for part in parts:
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(source)
        q = jobs.stream_job_states(spark.readStream.schema(e.schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "ck"), last=5, keep_hours=24 * 3650, lateness="3650 days", once=True)
        q.awaitTermination()
        sizes.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert sizes[1] - sizes[0] == 3 and sizes[2] == sizes[1]
    rows = spark.read.parquet(str(tmp_path / "out"))
    last = rows.withColumn("nth", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("batch")))).where("nth = 1")
    want = jobs.job_snapshots(e, 5)
    cols = want.columns
    assert {r.job_id: repr(tuple(r[c] for c in cols)) for r in last.collect()} == {r.job_id: repr(tuple(r[c] for c in cols)) for r in want.collect()}


# ---- patterns ----

@pytest.mark.parametrize("most", [automaton.SET_TERMS, 7])
def test_terms_are_found_as_substrings(spark, monkeypatch, most):
    monkeypatch.setattr(automaton, "SET_TERMS", most)
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abÉ ") for _ in range(n))
    texts = [(i, word(r.randrange(40))) for i in range(60)] + [(100, None), (101, ""), (1, "ab")]
    terms = [*{word(r.randrange(1, 5)) for _ in range(40)}, "", "ab", "ab", None]
    got = Counter((x.id, x.term) for x in automaton.find_terms(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), ["id"]).collect())
    assert got == Counter((i, t) for i, text in texts for t in {t for t in terms if t is not None} if text is not None and t in text)
    none = spark.createDataFrame([], "id int, text string")
    assert automaton.find_terms(none, spark.createDataFrame([("a",)], "term string"), ["id"]).collect() == []


def test_many_rules_without_a_nested_loop(spark):
    rules = spark.range(100_000).select(F.col("id").alias("rule_id"), F.lit(None).cast("boolean").alias("case_sensitive"), F.array(F.format_string("t%06dx", "id")).alias("patterns"), F.lit(None).cast("array<string>").alias("keywords"))
    chunks = spark.createDataFrame([("c1", "a T000017X b t099999x"), ("c2", None), ("c3", "t1")], "chunk_id string, content string")
    found = graph.match_rules(chunks, rules)
    assert {(r.chunk_id, r.rule_id) for r in found.collect()} == {("c1", 17), ("c1", 99999)}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


# ---- vectors ----

def clustered(n, size=24, groups=30):
    r = np.random.default_rng(1)
    centre = r.normal(size=(groups, size))
    return [(i, (centre[i % groups] + 0.25 * r.normal(size=size)).tolist()) for i in range(n)]


def test_cells_find_all_and_score_few(spark):
    rows = clustered(3000)
    rows += [(5000, [0.0] * 24), (5001, None), (5002, rows[5][1])]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>")
    index = cells.VectorCells(items)
    assert index.sizes.max() <= 30 and index.sizes.sum() == 3002
    queries = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    for least, scale in ((-1.0, "raw"), (0.9, "unit")):
        got = {tuple(r) for r in index.search(queries, 4, least, skip_self=True, scale=scale).collect()}
        want = {tuple(r) for r in vectors.vector_topk(queries, items.where("vector is not null"), 4, least, skip_self=True, scale=scale).collect()}
        assert got == want
    scored, pairs = index.shares[0]
    assert scored < pairs / 2
    assert vectors.vector_topk_cells(queries.limit(0), items, 3).collect() == [] and vectors.vector_topk_cells(queries, items.limit(0), 3).collect() == []


# ---- names ----

def test_names_by_keys_equal_all_pairs(spark):
    r = random.Random(2)
    rows = [(f"e{i}", "".join(r.choice("abcdeéÉ #12") for _ in range(r.choice([0, 1, 2, 4, 6, 9, 14, 90]))), r.choice("XY")) for i in range(150)]
    e = spark.createDataFrame([*rows, ("n", None, "X"), ("m1", "q" * 80, "X"), ("m2", "q" * 70, "X"), ("m3", "z" + "q" * 70 + "z", "X")], "entity_id string, name string, entity_type string")
    rows = [tuple(x) for x in e.where("name is not null").collect()]

    def score(x, y, weak):
        x, y = x.lower(), y.lower()
        return 1.0 if x == y else 0.8 if x in y or y in x else weak(x, y)

    def chars(x, y):
        return round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)

    def half(x, y):
        return 0.6 if x[: len(x) // 2] in y else 0.0

    for t in (0.5, 0.8, 0.9):
        got = Counter((x.a_id, x.b_id, x.score) for x in names.similar_by_chars(e, e, t).collect())
        assert got == Counter((a, b, s) for a, x, k in rows for b, y, m in rows if a != b and k == m and (s := score(x, y, chars)) >= t)
    for t in (0.6, 0.8):
        got = {(x.a_id, x.b_id, x.score, x["rank"]) for x in names.similar_by_prefix(e, e, t, 5).collect()}
        want = set()
        for a, x, k in rows:
            best = sorted((-s, b) for b, y, m in rows if a != b and k == m and (s := score(x, y, half)) >= t)[:5]
            want |= {(a, b, -s, i + 1) for i, (s, b) in enumerate(best)}
        assert got == want
    with pytest.raises(ValueError, match="every name"):
        names.similar_by_chars(e, e, 0)


# ---- merges, exports ----

def test_merges_follow_chains(spark):
    e = spark.createDataFrame([(x, x.upper()) for x in "abcdefgh"], "entity_id string, name string")
    r = spark.createDataFrame([("r1", "a", "d", "T", 0.5, "x"), ("r2", "b", "d", "T", 0.9, "y"), ("r3", "a", "c", "T", 1.0, "z"), ("r4", "e", "h", "T", 1.0, "z")], "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, strength double, note string")
    mapping = spark.createDataFrame([("a", "b"), ("b", "c"), ("e", "f"), ("f", "e"), ("g", "g")], "entity_id string, primary_id string")
    nodes, links = resolve.merge_entities(e, r, mapping)
    assert {x.entity_id: x.aliases for x in nodes.collect()} == {"c": ["A", "B"], "d": [], "e": ["F"], "g": [], "h": []}
    assert {(x.relationship_id, x.source_entity_id, x.target_entity_id, x.strength, x.note, x.merged) for x in links.collect()} == {("r1", "c", "d", 0.9, "y", 2), ("r4", "e", "h", 1.0, "z", 1)}


def test_exports_say_what_is_curated(spark):
    e = spark.createDataFrame([("e1", "A<b", "Concept", None, True, False, {"k": "1"}), ("e2", "B", "Concept", "d", None, None, None)], "entity_id string, name string, entity_type string, description string, curated boolean, rejected boolean, properties map<string,string>")
    r = spark.createDataFrame([("r1", "e1", "e2", "RELATED_TO", None, 1.0, True)], "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, description string, strength double, curated boolean").withColumn("rejected", F.lit(False))
    rows = {x.id: x for x in sinks.export_cytoscape(e, r).collect()}
    assert (rows["e1"].curated, rows["e1"].properties, rows["e2"].curated, rows["r1"].curated, rows["r1"].rejected) == (True, {"k": "1"}, False, True, None)
    text = "\n".join(x.value for x in sinks.graphml_lines(e, r).orderBy("part", "id").collect())
    space = "{http://graphml.graphdrawing.org/graphml}"
    root = ET.fromstring(text.encode())
    said = {(x.get("id"), d.get("key")): d.text for x in root.iter() if x.get("id") for d in x.findall(f"{space}data")}
    assert (said["e1", "d3"], said["e2", "d3"], said["r1", "d8"], said["e1", "d0"]) == ("true", "false", "true", "A<b")


# ---- stages, conflicts ----

def test_stages_see_only_open_rows(spark):
    rows = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "relationship_id long, x double").withColumn("text_status", F.lit("old"))
    seen = {}

    def said(p, confidence):
        def run(some):
            seen[p] = sorted(r.relationship_id for r in some.collect())
            return some.select("relationship_id", F.lit("passed").alias(f"{p}_status"), confidence.alias(f"{p}_confidence"))

        return run

    stages = {
        "text": said("text", F.when(F.col("x") == 0, 0.9).when(F.col("x") == 1, 0.1).otherwise(0.5)),
        "embedding": said("embedding", F.when(F.col("x") == 2, 0.8).otherwise(0.4)), "llm": said("llm", F.lit(0.6)),
    }
    got = {r.relationship_id: r for r in verify.run_cascade(rows, stages).collect()}
    assert seen == {"text": list(range(50)), "embedding": [i for i in range(50) if i % 5 > 1], "llm": [i for i in range(50) if i % 5 > 2]}
    assert {i % 5: got[i].decisive_stage for i in range(5)} == {0: "text_match", 1: "text_match", 2: "embedding", 3: "llm", 4: "llm"}
    assert got[0].reasoning == "PASSED — decided at text_match stage (confidence 0.90). Weighted confidence 0.9000. text_match: PASS (0.90)"
    assert got[3].reasoning == "PASSED — decided at llm stage (confidence 0.60). Weighted confidence 0.5100. text_match: PASS (0.50); embedding: PASS (0.40); llm: PASS (0.60)"
    assert verify.run_cascade(rows.limit(0), stages).collect() == []
    with pytest.raises(ValueError, match="stages"):
        verify.run_cascade(rows, {"vision": stages["text"]})
    assert {r.reasoning for r in verify.run_cascade(rows, {}).collect()} == {"No stages were run."}


EDGE = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, description string, trust string"


def test_conflict_classes_expand_to_pairs(spark):
    r = random.Random(3)
    words = ["is it", "is not it", "", None, " Without it", "has", "HAS"]

    def edges(prefix, n):
        return [(f"{prefix}{i}", *r.sample("abc", 2), r.choice(["T", "U"]), r.choice(words), r.choice(["user", "curated", None])) for i in range(n)]

    old = edges("o", 40)
    new = edges("n", 30) + old[:5]
    a, b = spark.createDataFrame(new, EDGE), spark.createDataFrame(old, EDGE)
    classes, members = verify.conflict_classes(a, b)
    want = Counter(tuple(x) for x in verify.detect_conflicts(a, b).collect())
    assert Counter(tuple(x) for x in verify.expand_conflicts(classes, members).collect()) == want
    assert sum(x.n_pairs for x in classes.collect()) == sum(want.values()) > 100


def test_a_hot_pair_of_ends_costs_its_edges(spark):
    def edges(prefix, kind):
        return spark.range(10_000).select(F.concat(F.lit(prefix), "id").alias("relationship_id"), F.lit("a").alias("source_entity_id"), F.lit("b").alias("target_entity_id"), F.lit(kind).alias("relationship_type"), F.lit("x").alias("description"), F.lit("user").alias("trust"))

    classes, members = verify.conflict_classes(edges("n", "T"), edges("o", "U"))
    assert [x.n_pairs for x in classes.collect()] == [100_000_000] and members.count() == 20_000


# ---- JSON files, streamed chunks ----

@pytest.mark.parametrize("split", [40, 1 << 20])
def test_json_files_are_split(spark, tmp_path, split):
    """Commas, brackets and quotes in strings, escapes, nested items, several files; four splits and more of one file."""
    r = random.Random(5)
    odd = ["a,b", "[", "]", '"', '\\', "}{", "é, ü", "", "\n", "x\\\",y"]

    def value(depth):
        kind = r.randrange(4 if depth else 2)
        if kind == 0:
            return r.choice(odd)
        if kind == 1:
            return r.randrange(1000)
        return [value(depth - 1) for _ in range(r.randrange(3))] if kind == 2 else {r.choice(odd) + str(i): value(depth - 1) for i in range(r.randrange(3))}

    (tmp_path / "in").mkdir()
    files = {f"{i}.json": [value(3) for _ in range(n)] for i, n in enumerate((0, 1, 37))}
    files |= {"o.json": {f"k{i},": value(2) for i in range(20)}, "empty.json": {}}
    for k, (name, data) in enumerate(files.items()):
        (tmp_path / "in" / name).write_text(("﻿ " if k == 2 else " \n") + json.dumps(data, indent=[None, 1][k % 2], ensure_ascii=k % 2 == 0) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = json_items(spark, str(tmp_path / "in")).collect()
        splits = spark.read.option("lineSep", ",").text(str(tmp_path / "in" / "2.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits >= 4 or split > 40
    got = {}
    for x in sorted(rows, key=lambda x: (x.file, x.pos)):
        name = x.file.rsplit("/", 1)[1]
        if name == "o.json":
            got.setdefault(name, {}).update(json.loads("{" + x.item + "}"))
        else:
            assert x.pos == len(got.setdefault(name, []))
            got[name].append(json.loads(x.item))
        assert x.n_items == len(files[name])
    assert got == {k: v for k, v in files.items() if v}


def test_chunks_are_streamed(spark):
    texts = ["", " ", "abc", "x" * 512, "ab  " * 400, "é" * 513, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, content string")
    got = {tuple(r) for r in chunking.chunk_streamed(docs, chunking.fixed_pieces(100, 20)).collect()}
    want = {(r.document_id, r.chunk_index, r.content, r.start_position) for r in chunking.chunk_fixed(docs, 100, 20).collect()}
    assert got == want
    # a generator is asked for no more than what has left
    asked = []

    def pieces(text):
        for i in range(10**9):
            asked.append(i)
            yield i, "p"

    import itertools

    import pyarrow as pa

    class Held:
        schema = docs.schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    run = chunking.chunk_streamed(Held(), pieces)
    list(itertools.islice(run(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["t"])], names=["a", "b"])])), 3))
    assert len(asked) <= 4 * chunking.STREAMED


# ---- one document ----

def test_documents_are_one_valid_file(spark, sf, tmp_path):
    from weftgraph.plans.fixture import entities, relationships

    e, r = entities(spark, sf).drop("k"), relationships(spark, sf).drop("k")
    path = tmp_path / "graph.graphml"
    sinks.write_graphml_document(e, r, str(path))
    root = ET.parse(path).getroot()
    space = "{http://graphml.graphdrawing.org/graphml}"
    nodes, links = sinks.visible(e, r)
    assert (len(root.findall(f".//{space}node")), len(root.findall(f".//{space}edge")), len(root.findall(f"{space}key"))) == (nodes.count(), links.count(), 9)
    sinks.write_json_document(e, r, str(tmp_path / "g.json"))
    said = json.loads((tmp_path / "g.json").read_text())
    assert [x["entity_id"] for x in said["entities"]] == sorted(x.entity_id for x in e.collect())
    assert len(said["relationships"]) == r.count() == said["statistics"]["n_relationships"]
    sinks.write_json_document(e.limit(0), r.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text())["entities"] == []
    assert sorted(p.name for p in tmp_path.iterdir()) == ["g.json", "graph.graphml", "none.json"]


def test_a_failed_document_leaves_what_was(spark, tmp_path):
    from weftgraph.sources.document_writer import write_document

    path = tmp_path / "d.txt"
    write_document(spark.range(100).selectExpr("id", "cast(id as string) as value"), str(path), "<", ">", ["id"], "")
    assert path.read_text() == "<" + "".join(map(str, range(100))) + ">"
    broken = spark.range(100).selectExpr("id", "if(id = 77, raise_error('broken'), cast(id as string)) as value")
    with pytest.raises(Exception, match="broken"):
        write_document(broken, str(path), "<", ">", ["id"])
    assert path.read_text().endswith("99>") and [p.name for p in tmp_path.iterdir()] == ["d.txt"]


def test_audit_logs_pass_over_corrupt_lines(spark, tmp_path):
    log = tmp_path / "audit"
    kind = "seq long, ts long, action string"
    sinks.append_audit(spark.createDataFrame([(i, i // 2, "a") for i in range(10)], kind).coalesce(1), str(log))
    (log / "half.json").write_text('{"seq": 99, "ts": 99, "action": "b"}\n{"seq": 100, "ts"')
    rows = sinks.read_audit(spark, str(log), kind)
    assert [r.seq for r in sinks.audit_tail(rows, 3).collect()] == [99, 9, 8]
    sinks.keep_audit(spark, str(log), str(tmp_path / "kept"), kind, 4)
    assert sorted(r.seq for r in sinks.read_audit(spark, str(tmp_path / "kept"), kind).collect()) == [7, 8, 9, 99]
