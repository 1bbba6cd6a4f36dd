"""The registered queries and the pipeline on the supplied tables, against brute force and held-out labels."""

import collections
import hashlib
from pathlib import Path

import numpy as np
import pytest
from test_small import WORD, components_by_force, components_by_words, counts_by_force, licenses_by_force, repeats_by_force

import corpus_pipeline
from weftgraph.llm.langid import fold
from weftgraph.llm.quality import fit_quality, judge_quality
from weftgraph.llm.queries import QUERIES, table, vocabulary
from weftgraph.staging import stage


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source").collect()]


def run(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def test_op1(spark, sf, rows):
    want = {r[0]: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for r, (n, gone, runs, kept) in zip(rows, repeats_by_force([r[1] for r in rows], 200), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, sf, "op1_repeats")} == want


def test_op2(spark, sf, rows):
    got = {r.doc_id: r for r in run(spark, sf, "op2_quality")}
    for i, text, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_by_force(text)


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    y = np.array(labels, bool)
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.fixture(scope="module")
def larger(sf):
    """Tables with some hundred held-out labels; the small ones have a handful of toxic rows among theirs."""
    path = Path(sf).parent / "sf0.1"
    if not path.is_dir():
        pytest.skip("no such tables")
    return str(path)


def test_op2_on_labels_left_out(spark, larger):
    """Ranking and calibration on a fifth of the labels that the fit has not seen."""
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    model = fit_quality(docs, labels.where(fold("doc_id", 5) != 0))
    held = {r.doc_id: r.quality for r in labels.where(fold("doc_id", 5) == 0).collect()}
    got = [(r.probability, held[r.doc_id]) for r in judge_quality(docs, model).collect() if r.doc_id in held]
    p, y = np.array([x for x, _ in got]), np.array([q for _, q in got])
    assert auc(p, y) > 0.9 and np.mean((p >= 0.5) == y) > 0.85
    assert np.mean((p - y) ** 2) < 0.12 and abs(p.mean() - y.mean()) < 0.1


def test_op3(spark, sf, rows):
    got = {(r.doc_id, r.template): r.containment for r in run(spark, sf, "op3_licenses")}
    assert got == pytest.approx(licenses_by_force(rows))


def test_op7_and_op9_on_held_out_rows(spark, sf, rows):
    langs = {r[0]: r[2] for r in rows}
    found = [r for r in run(spark, sf, "op9_langid") if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in found]) > 0.97
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    said = [(r.predicted, labels[r.doc_id]) for r in run(spark, sf, "op7_toxicity") if r.held_out and r.doc_id in labels]
    assert np.mean([p == t for p, t in said]) > 0.85


def test_op7_on_held_out_rows(spark, larger):
    """Better than the share of clean rows, which "never toxic" reaches."""
    labels = {r.doc_id: r.toxic for r in table(spark, larger, "labels").collect()}
    found = [(r.score, r.predicted, labels[r.doc_id]) for r in run(spark, larger, "op7_toxicity") if r.held_out and r.doc_id in labels]
    score, predicted, y = (np.array(c) for c in zip(*found, strict=True))
    assert np.mean(predicted == y) > max(0.93, 1 - y.mean()) and auc(score, y) > 0.95 and np.mean(predicted[y == 1]) > 0.7


def test_op8(spark, sf, rows):
    want = {i: (n, c) for i, n, c in components_by_force(rows)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, sf, "op8_jaccard")} == want


def test_pipeline_near_copies(spark, sf, rows):
    """The stage keeps one document of each group of five-word Jaccard 0.8; by op8's rule more would stay."""
    docs = table(spark, sf, "documents")
    held = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf).collect()]
    want = {c for _, _, c in components_by_words(held, 80, 5)}
    assert sorted(kept) == sorted(want) and len(want) < len({c for _, _, c in components_by_force(held)})


def test_pipeline_stage_by_stage(spark, sf, rows):
    """Each stage's result from its own input, by plain means."""
    docs = table(spark, sf, "documents")
    work = dict(corpus_pipeline.STAGES)
    one = stage(work["language identification"](spark, docs, sf), "one")
    assert one.columns == docs.columns and one.count() >= 0.99 * len(rows)
    held = [(r.doc_id, r.text) for r in one.collect()]
    two = stage(work["n-gram Jaccard join"](spark, one, sf), "two")
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, _, c in components_by_words(held, 80, 5)})
    held = [tuple(r) for r in two.collect()]
    three = stage(work["suffix-array dedup"](spark, two, sf), "three")
    want = {r[0]: kept.decode(errors="ignore") for r, (_, _, _, kept) in zip(held, repeats_by_force([r[1] for r in held], 200), strict=True)}
    got = {r.doc_id: (r.text, r.n_chars) for r in three.collect()}
    assert {i: t for i, (t, _) in got.items()} == want and all(n == len(t) for t, n in got.values())
    four = stage(work["mixing sources"](spark, three, sf), "four")
    copies, texts = collections.Counter(r.doc_id for r in four.collect()), {i: t for i, (t, _) in got.items()}
    assert max(copies.values()) <= 3
    total = sum(len(WORD.findall(t)) for t in texts.values())
    assert abs(sum(k * len(WORD.findall(texts[i])) for i, k in copies.items()) - total) <= 0.01 * total
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    n = sum(k * (len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1) for i, k in copies.items())
    five = work["packing"](spark, four, sf).collect()
    assert sum(r.length for r in five) == n
    assert corpus_pipeline.run(spark, sf).count() == len(five)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, root long, row_key long"


def test_pipeline_stages_on_odd_rows(spark, sf):
    """Null and repeated ids, equal rows, texts without words, clashing columns, no rows."""
    work = dict(corpus_pipeline.STAGES)
    a, b, c = (" ".join(f"{x}{i * i % 97}" for i in range(60)) for x in "uvw")
    rows = [(7, a, "en", "s", 1), (7, b, "en", "s", 1), (1, c, None, "s", 1), (2, c, "en", "t", 1), (2, a + " z", "en", "s", 1), (None, b, "en", "s", 1), (None, c + " y", None, None, 1), (9, None, "en", "s", None), (None, None, None, None, None), (9, " ", "en", "s", 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in [*rows, rows[0], rows[2], rows[5]]], COLUMNS).repartition(3)
    kept = work["n-gram Jaccard join"](spark, df, sf)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == collections.Counter([(2, a + " z"), (7, b), (1, c), (9, None), (None, None), (9, " ")])
    mixed = collections.Counter((r.doc_id, r.text) for r in work["mixing sources"](spark, df, sf).collect())
    assert set(mixed) <= {(r[0], r[1]) for r in rows if (r[1] or "").strip()} and sum(mixed.values()) > 0
    for name, f in corpus_pipeline.STAGES[1:]:
        assert f(spark, df.limit(0), sf).collect() == [], name
