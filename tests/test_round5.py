"""Findings of round 3, second part: work and memory of a task that grow no faster than the input."""

import contextlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


# ---- pipeline: pairs of the second search ----

def test_second_search_gives_a_pair_once(spark):
    from weftgraph.llm import jaccard

    held = {1: range(0, 60), 2: range(0, 60), 3: range(40, 90), 4: range(50, 120)}  # classes and the keys of their trees
    vector = np.full(jaccard.GROUPS, 3, np.uint16).tobytes()
    rows = sorted((k, m) for m, keys in held.items() for k in keys if sum(k in x for x in held.values()) > 1)
    columns = {
        "key": [k for k, _ in rows], "mark": [m for _, m in rows], "root": [m for _, m in rows], "low": [0] * len(rows), "high": [0] * len(rows),
        "n_shingles": [3 * jaccard.GROUPS] * len(rows), "vector": [vector] * len(rows), "first": [list(held[m])[:32] for _, m in rows],
    }
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k in ("low", "high") else None) for k, v in columns.items()})
    got = [(r["key"], r["a"], r["b"]) for b in jaccard._searched(80, False)(iter([batch])) for r in b.to_pylist()]
    meets = {(a, b): min(set(held[a]) & set(held[b])) for a in held for b in held if a < b}
    assert {(a, b) for _, a, b in got} == set(meets)  # none is lost
    assert all((meets[p], *p) in got for p in meets)  # each where its smallest key is
    assert sum(p == (1, 2) for _, *x in got for p in [tuple(x)]) == 1 and len(got) < 100  # 160 before


# ---- F14 F15 F19 F20 F28 F29: conflicts ----

EDGE = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, description string, trust string"


def test_edges_meet_by_a_number_and_without_descriptions(spark):
    from weftgraph.operators import verify

    a = spark.createDataFrame([("n", "b", "a", "T", " Not it", "user"), ("m", "b", "a", "U", None, "user")], EDGE)
    b = spark.createDataFrame([("o", "a", "b", "T", "is it", "curated"), ("p", "a", "b", "T", "cannot be", "user")], EDGE)
    found = verify.detect_conflicts(a, b)
    assert {tuple(x) for x in found.collect()} == {("n", "o", "contradictory", "high", True), ("m", "o", "inconsistent", "medium", True), ("m", "p", "inconsistent", "medium", False)}
    assert "hashpartitioning(pair" in plan(found)


# ---- F16 F17 F18: components ----

def test_a_hub_is_met_by_a_broadcast_row(spark, monkeypatch):
    from weftgraph.operators import graph, stars

    monkeypatch.setattr(stars, "CROWD", 10)
    pairs = [("hub", f"leaf{i}") for i in range(60)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("x", "gone"), ("y", "y")]
    edges = spark.createDataFrame(pairs, "source_entity_id string, target_entity_id string")
    ids = sorted({x for p in pairs for x in p} - {"gone"}) + ["alone", "x"]
    e = spark.createDataFrame([(x,) for x in ids] + [(None,)], "entity_id string")
    want = [(x, "hub" if x.startswith(("hub", "leaf")) else "c0" if x[0] == "c" else x) for x in ids] + [(None, None)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in graph.components(e, edges).collect())


# ---- F12: sentences ----

def test_trigrams_are_hashed_together():
    import random
    import zlib

    from weftgraph.operators import vectors

    def one(s):
        v = np.zeros(64, np.float32)
        for i in range(len(s) - 2):
            h = zlib.crc32(s[i : i + 3].encode())
            v[h % 64] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        return v / n if n else v

    r = random.Random(2)
    texts = [" " + "".join(r.choice("ab cé漢😀\x00.") for _ in range(r.randrange(40))) + " " for _ in range(300)] + ["  ", " " + "the cat. " * 9000 + " "]
    for most in (1, 100, 1 << 20):
        assert np.array_equal(vectors.trigram_vectors(texts, most), np.array([one(t) for t in texts]))
    assert vectors.trigram_vectors([]).shape == (0, 64)


def test_sentences_group_as_by_means_of_all():
    from weftgraph.operators import chunking

    def naive(vectors, words, most, least, threshold):
        groups = []
        for i, n in enumerate(words):
            if groups:
                now = groups[-1]
                centre = vectors[now].mean(axis=0)
                scale = np.linalg.norm(centre) * np.linalg.norm(vectors[i])
                held = sum(words[j] for j in now)
                if held < least or ((float(centre @ vectors[i] / scale) if scale else 0.0) >= threshold and held + n <= most):
                    now.append(i)
                    continue
            groups.append([i])
        merged = []
        for g in groups:
            if merged and (sum(words[j] for j in g) < least or sum(words[j] for j in merged[-1]) < least):
                merged[-1] = merged[-1] + g
            else:
                merged.append(g)
        return merged

    r = np.random.default_rng(4)
    for _ in range(60):
        n = int(r.integers(1, 80))
        v, w = r.normal(size=(n, 4)).astype(np.float32).astype(float), r.integers(0, 40, n).tolist()
        assert chunking.group_sentences(v, w, 120, 30, 0.2) == naive(v, w, 120, 30, 0.2)


# ---- F23: job states ----

def test_a_job_costs_few_calls_on_state():
    import pandas as pd

    from weftgraph.streaming.job_state import JobState

    calls = []

    class Fake:
        def __init__(self):
            self.held = {}

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("updateValue", "put", "update"):
                    self.held[args[0] if name == "updateValue" else 0] = args[-1]
                return {"exists": lambda: bool(self.held), "get": lambda: self.held.get(0), "iterator": lambda: list(self.held.items()), "listTimers": lambda: [7],
                        "containsKey": lambda: args[0] in self.held, "getValue": lambda: self.held[args[0]]}.get(name, lambda: None)()

            return call

    handle, job = Fake(), JobState(3, 1000)
    handle.getMapState = handle.getListState = handle.getValueState = lambda *a: Fake()
    job.init(handle)
    frame = pd.DataFrame([(f"s{i}", 2, 10 * i, 10 * i + 5, i, [i]) for i in range(8)], columns=["stage", "n", "first_us", "last_us", "last_seq", "seqs"])
    first = next(job.handleInputRows(("j",), iter([frame]), None))
    assert len(calls) <= 12  # eight of them write the stages
    calls.clear()
    again = next(job.handleInputRows(("j",), iter([frame]), None))
    assert (first.n_events[0], again.n_events[0], again.last_events[0], again.current_stage[0]) == (16, 32, [7, 7, 6], "s7") and len(calls) <= 18
    assert again.stages[0][1] == {"stage": "s1", "n": 4, "first_us": 10, "last_us": 15}
