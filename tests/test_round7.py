"""Findings of round 4: whole tables, and what a query keeps on disk."""

from pyspark.sql import functions as F

from weftgraph.plans import ORACLE_SQL, QUERIES
from weftgraph.plans.registry import table

# ---- F6: best_match ----


def test_every_vector_has_its_best_match(spark, sf):
    n = table(spark, sf, "embeddings").count()
    assert QUERIES["best_match"](spark, sf).count() == n  # one in a hundred before
    assert "vec_id % 100" not in ORACLE_SQL["best_match"]


def test_any_number_of_blocks_covers_all_queries(spark, monkeypatch):
    from weftgraph.operators import blocks

    monkeypatch.setattr(blocks, "MOST_BLOCKS", 3)
    queries, rows = spark.range(50).withColumnRenamed("id", "q"), spark.range(20)
    for size, n in ((7, 50), (9, 50), (50, 50), (17, 50)):  # 8, 6, 1 and 3 blocks; more than MOST_BLOCKS raised before
        got = blocks.in_blocks(queries, "q", lambda some: rows.join(some, F.col("id") == F.col("q") % 20), rows=size)
        assert sorted(r.q for r in got.collect()) == list(range(n))


# ---- F2, F7: similar_by_chars ----


def test_every_entity_has_its_similar_ones(spark, sf):
    n = table(spark, sf, "part").count()
    found = QUERIES["similar_by_chars"](spark, sf)
    assert found.where("a_id like 'part:%'").select("a_id").distinct().count() > n // 2  # one in a hundred before
    assert "k % 100" not in ORACLE_SQL["similar_by_chars"]


def test_a_crowd_of_one_name_is_dealt_out(spark, monkeypatch):
    from weftgraph.operators import blocks, names

    monkeypatch.setattr(blocks, "MOST_BLOCKS", 2)
    monkeypatch.setattr(names, "TILE", 10)
    monkeypatch.setattr(names, "QUERY_ROWS", 16)  # more blocks than MOST_BLOCKS: raised before
    rows = spark.range(90).selectExpr("concat('p', id) entity_id", "concat('ring', if(id = 7, 'let', '')) name", "'Product' entity_type")
    got = names.similar_by_chars(rows, rows, 0.8)
    assert sorted({(r.score, r["count"]) for r in got.groupBy("score").count().collect()}) == [(0.8, 2 * 89), (1.0, 89 * 88)]
    near = names.similar_by_chars(rows, rows, 0.9)
    assert near.count() == near.distinct().count() == 89 * 88


def test_pairs_are_made_by_many_tasks(spark):
    from weftgraph.operators import names

    rows = spark.range(900).selectExpr("concat('p', id) entity_id", "concat('Thing#', id) name", "'Product' entity_type")
    found = names.similar_by_chars(rows, rows, 0.9)
    assert found.rdd.getNumPartitions() >= 64  # few bytes were one task before, whatever they were joined with


# ---- F8: similar_by_prefix ----


def test_every_entity_has_its_best_ten(spark, sf):
    found = QUERIES["similar_by_prefix"](spark, sf)
    assert found.where("a_id like 'customer:%'").select("a_id").distinct().count() == table(spark, sf, "customer").count()  # one in a hundred before
    assert "k % 100" not in ORACLE_SQL["similar_by_prefix"]


def test_keys_have_lengths_that_names_have(spark):
    from weftgraph.operators import names

    e = spark.createDataFrame([("1", "abcabc", "X"), ("2", "ca", "X"), ("3", "", "X"), ("4", "b", "Y"), ("5", "bb", None), ("6", "q" * 70, "X"), ("7", "zz" + "q" * 71, "X")], "entity_id string, name string, entity_type string")
    a, b = names._sides(e, e)
    got = {(r.x, r.y) for r in names.holding_names(a, b).where("entity_type = 'X'").collect()}
    every = [r[1] for r in e.where("entity_type = 'X'").collect()]
    assert got == {(x, y) for x in every for y in every if x in y or y in x}


# ---- F1: pipeline, near copies ----


def _long_sets(n: int, size: int = 4000):
    import numpy as np

    r = np.random.default_rng(11)
    sets = [np.sort(r.choice(1 << 40, size, replace=False).astype(np.uint64)) for _ in range(n)]
    near = [np.sort(np.concatenate([s[: size - size // 20], np.arange(size // 20, dtype=np.uint64) + np.uint64(1 << 50)])) for s in sets[: n // 3]]
    return [*sets, *near]


def test_long_texts_that_chance_fills_alike_are_ruled_out(spark):
    import numpy as np
    import pyarrow as pa

    from weftgraph.llm import jaccard

    sets = _long_sets(30)
    size = np.array([len(s) for s in sets])
    values, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
    points = jaccard.count_vectors(values, bounds).astype(np.int64)
    fine = jaccard.Fine(pa.chunked_array([pa.array(jaccard.fine_vectors(values, bounds), pa.binary())]), size)
    linked = {(i, 30 + i) for i in range(10)}

    def found(tree):
        return {tuple(sorted((int(x[i]), int(y[j])))) for x, y, may in tree.pairs(80) for i, j in zip(*np.nonzero(may), strict=True)}

    assert len(found(jaccard.Tree(points, size))) > 10 * len(linked)  # each of these was verified by its texts before
    assert found(jaccard.Tree(points, size, fine)) == linked
    few = [jaccard._small(np.array([0]), np.array([len(sets)]), np.arange(len(sets)), size, points, 80, False, f) for f in (None, fine)]
    assert len(few[0][0]) > 10 * len(linked) and {tuple(sorted(p)) for p in zip(*(x.tolist() for x in few[1]), strict=True)} == linked
    assert jaccard.fine_vectors(values[:100], np.array([0, 100])) == [None]
    # a full count bounds nothing
    full = np.arange(2000, dtype=np.uint64) * np.uint64(jaccard.FINE_GROUPS)
    one = jaccard.Fine(pa.chunked_array([pa.array(jaccard.fine_vectors(np.concatenate([full, full]), np.array([0, 2000, 4000])), pa.binary())]), np.array([2000, 2000]))
    assert one.lets(np.array([0]), np.array([1]), 80).tolist() == [True]


def test_keys_are_shuffled_once(spark, monkeypatch):
    import contextlib
    import io

    from weftgraph.llm import jaccard

    plans, stage = {}, jaccard.stage

    def seen(df, name):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain()
        plans.setdefault(name, out.getvalue())
        return stage(df, name)

    monkeypatch.setattr(jaccard, "stage", seen)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2) * 50 + j}" for j in range(40 + i % 2))) for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 80).collect()}
    assert got == {i: i // 2 * 2 for i in range(20)}
    assert "shared" not in plans  # these were shuffled and written, and a filter chose keys for a second shuffle: all of them in a large corpus
    assert "BroadcastExchange" not in plans["met"]


# ---- F3: conflict_reasoning ----


def test_conflicts_bring_their_texts_along(spark, sf):
    import contextlib
    import io

    from weftgraph.operators import verify

    edge = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, description string, trust string"
    new = spark.createDataFrame([
        ("n1", "b", "a", "T", "is not so", "user"), ("n2", "a", "b", "U", "x", None), ("n3", "a", "gone", "T", None, "curated"), ("n4", None, "a", "T", "not", "user"), ("s1", "a", "b", "T", "is so", "curated"), ("n5", "c", "c", "U", "", "extracted"),
    ], edge)
    stored = spark.createDataFrame([("s1", "a", "b", "T", "is so", "curated"), ("s2", "gone", "a", "V", "never", "odd"), ("s3", "c", "c", "T", None, None), ("s4", "b", "a", "T", "%s not", "user")], edge)
    names = spark.createDataFrame([("a", "Ann"), ("b", None), ("c", "Carl")], "entity_id string, name string")
    want = verify.conflict_reasoning(verify.detect_conflicts(new, stored), new, stored, names)
    got = verify.reasoned_conflicts(new, stored, names)
    assert got.columns == want.columns and got.count() > 5
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES["conflict_reasoning"](spark, sf).explain()
    assert not any("Exchange hashpartitioning(_hash" in x and "relationship_id#" in x for x in out.getvalue().splitlines())  # edges were looked for again by id
