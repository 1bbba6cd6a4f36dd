"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows, extra columns and no rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import jaccard, langid, licenses, media, mixing, packing, quality, repeats, sharding, textbatch, toxicity
from weftgraph.llm.queries import vocabulary
from weftgraph.operators.stars import star_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, part int, word long, size double, mark string"


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'é' if r.random() < 0.1 else ''}{r.choice(['', '', ',', '.'])}" for _ in range(n))


def corpus():
    base, passage = prose(120, 1), prose(60, 2)
    near = base.split()
    near[50] = "changed"
    texts = [
        base, base, " ".join(near), base.upper(), prose(80, 3) + "\n" + passage + "\n" + prose(50, 4), prose(70, 5) + " " + passage, passage + prose(40, 6),
        None, "", " \t\n", "one", "two words", "One", "a b c", prose(20000, 7), "ab" * 600, "x" * 500, "x" * 230, "\x00" * 300 + "q", "é" * 150, prose(119, 1) + " z",
        "Released under the MIT License.", prose(30, 8) + "\nReleased under the MIT  license, " + prose(30, 9), "repeat me now please\n" * 30, prose(100, 10, 5),
    ]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None if t is None else len(t), 1, "r", None, 5, 0.5, None))
    rows += [rows[5], rows[9], rows[14], (None, prose(100, 11), "fr", "s1", 5, 1, "r", 1, 5, 0.5, "m"), (None, base, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def by_id(rows, *fields):
    return collections.Counter((r["doc_id"], *(r[f] for f in fields)) for r in rows)


# ---- op 1 ----

def repeats_by_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("crowd", [1024, 1])
def test_repeats(docs, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    got = by_id(repeats.cut_repeats(docs, 200).collect(), "n_bytes", "n_removed", "n_spans", "kept")
    rows = corpus()
    want = collections.Counter((r[0], *x) for r, x in zip(rows, repeats_by_force([r[1] for r in rows], 200), strict=True))
    assert {k[:4] for k in got} == {k[:4] for k in want}
    assert got == want


def test_repeats_of_nothing(none):
    assert repeats.cut_repeats(none).collect() == []


def test_run_index_matching_statistics():
    """All matches of three bytes or more, with copies that lengthen runs and add none."""
    for seed in range(8):
        r = random.Random(seed)
        strings = list(dict.fromkeys([bytes(r.choice(b"ab\x00") for _ in range(r.randrange(1, 60))) for _ in range(8)] + [b"abababab" * r.randrange(1, 5)]))
        times = [r.choice([1, 1, 2]) for _ in strings]
        parts = [np.frombuffer(s, np.uint8) for s in strings]
        index = repeats.RunIndex(parts, times)
        assert len(index.lengths) == len(repeats.RunIndex(parts, [1] * len(parts)).lengths)
        assert index.lengths.sum() == sum(n * (len(s) + 1) for n, s in zip(times, strings, strict=True))
        got = {(k, i): n for x in index.matching_statistics(3) for k, i, n in zip(*(c.tolist() for c in x), strict=True)}
        want = {}
        for k, s in enumerate(strings):
            for i in range(len(s)):
                best = max((n for n in range(3, len(s) - i + 1) if times[k] > 1 or sum(t.startswith(s[i : i + n], j) for t in strings for j in range(len(t))) > 1), default=0)
                if best:
                    want[k, i] = best
        assert got == want


def test_all_marks_come_from_the_index(docs, monkeypatch):
    def silent(batches):
        for b in batches:
            yield b.select(["anchor", "context"]).append_column("s", b.column("anchor")).append_column("e", b.column("anchor")).slice(0, 0)

    monkeypatch.setattr(repeats, "_indexed", lambda length: silent)
    assert all(r.n_removed == 0 for r in repeats.cut_repeats(docs, 200).collect())


def thue_morse(n):
    """Two texts of 2**n letters that polynomial hashes modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_texts_that_linear_hashes_confuse(spark):
    x, y = thue_morse(11)
    rows = [(1, f"{x}\n{y}\n{x} z"), (2, f"p q {x}"), (3, f"p q {y}"), (4, x), (5, y), (6, x[:1024] + " " + y[:1024]), (7, prose(30, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_id(quality.judge_quality(df, None).collect(), *fields) == collections.Counter((r[0], *counts_by_force(r[1])) for r in rows)
    assert by_id(jaccard.jaccard_components(df).collect(), "n_shingles", "component_id") == collections.Counter(components_by_force(rows))
    got = by_id(repeats.cut_repeats(df, 200).collect(), "n_bytes", "n_removed", "n_spans", "kept")
    assert got == collections.Counter((r[0], *z) for r, z in zip(rows, repeats_by_force([r[1] for r in rows], 200), strict=True))


# ---- op 2 ----

def counts_by_force(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(docs, none):
    got = quality.judge_quality(docs, None).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_id(got, *fields) == collections.Counter((r[0], *counts_by_force(r[1])) for r in corpus())
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed) and r.probability is None
    assert quality.judge_quality(none, None).collect() == []


def test_quality_learns(spark, none):
    good = [(i, prose(60, i), 1) for i in range(60)]
    bad = [(100 + i, " | ".join(prose(60, i).split()) + " ###", 0) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.fit_quality(rows.select("doc_id", "text"), rows.select("doc_id", "quality").where("doc_id % 5 > 0"))
    got = {r.doc_id: r.probability for r in quality.judge_quality(rows, model).collect()}
    held = [i for i in got if i % 5 == 0]
    assert all((got[i] > 0.5) == (i < 100) for i in held)
    assert quality.fit_quality(none, none.withColumn("quality", F.lit(1))) is None


# ---- op 3 ----

def licenses_by_force(rows, containment=0.8):
    def words(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    def runs(text, n):
        w = words(text)
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    out = collections.defaultdict(float)
    for r in rows:
        for k, (_name, text) in enumerate(licenses.TEMPLATES + licenses.NOTICES):
            n = min(5, len(words(text)))
            held, its = runs(r[1], n), set(runs(text, n))
            step = -(-len(its) // 2)
            for s in range(0, len(held), step):
                part = len(its & set(held[s : s + 2 * len(its)])) / len(its)
                if part >= containment:
                    out[r[0], k] = max(out[r[0], k], part)
    return dict(out)


def test_licenses(spark, docs, none):
    mit, apache = licenses.TEMPLATES[3][1], licenses.TEMPLATES[1][1].split()
    more = [(900, prose(40, 12) + " " + mit + " " + prose(9, 13)), (901, " ".join(apache[:20] + ["other"] + apache[20:])), (902, " ".join(apache[:9])), (903, None)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {(r.doc_id, r.template): r.containment for r in licenses.scan_licenses(rows).collect()}
    assert got == pytest.approx(licenses_by_force(corpus() + more))
    assert (900, 3) in got and (21, 2) in got and licenses.scan_licenses(none).collect() == []


def test_short_notices(spark):
    rows = [(1, "a b c d\nAll rights reserved."), (2, "all rights are reserved"), (3, "ALL  Rights, reserved"), (4, "rights reserved"), (5, None), (6, "small rights reserved")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    number = len(licenses.TEMPLATES)
    got = {(r.doc_id, r.template): (r.license, r.containment) for r in licenses.scan_licenses(df).collect()}
    assert got == {(1, number): ("All-rights-reserved", 1.0), (3, number): ("All-rights-reserved", 1.0)}
    with pytest.raises(ValueError, match="empty"):
        licenses.scan_licenses(df, (("empty", " -- "), ("MIT", "Released under the MIT License.")))


# ---- op 4 ----

def test_shards(docs, none):
    got = sharding.shard_documents(docs, 4).collect()
    rows = corpus()
    assert by_id(got, "size", "text_crc32") == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    total, most = sum(r.size for r in got), max(r.size for r in got)
    for s, held in itertools.groupby(sorted(got, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        held = list(held)
        assert 0 <= s < 4 and [r.slot for r in held] == list(range(len(held)))
        assert abs(sum(r.size for r in held) - total / 4) <= most
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order) and sharding.shard_documents(none, 4).collect() == []


# ---- op 5 ----

def targets_by_force(sizes, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if level * weight[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: level * weight[s] for s in rest}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(spark, docs, none):
    rows = [(i, prose(5 + i % 40, i), f"s{i % 4}" if i % 9 else None) for i in range(600)] + [(1000 + i, prose(30, i), "big") for i in range(600)] + [(5000, prose(9, 1), "tiny"), (5001, None, "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert by_id(got, "size") == collections.Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets_by_force(sizes)
    for s in sizes:
        its = [r for r in got if r.source == s]
        assert its[0].target == pytest.approx(want[s]) and its[0].source_size == sizes[s]
        taken = sum(r.taken for r in its)
        assert abs(taken - want[s]) <= max(3 if s != "tiny" else 9, 0.002 * want[s])
        assert all(r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size for r in its)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert by_id(again, "taken") == by_id(got, "taken")
    assert mixing.mix_sources(none).collect() == [] and mixing.mix_sources(docs).count() == len(corpus())


def test_flight_keeps_totals():
    r = random.Random(1)
    flight, settled = mixing.Flight(), []
    units = [((i,), 0.3, float(r.randrange(1, 500))) for i in range(400)]
    for u in units:
        settled += flight.add(*u)
    left = flight.open
    assert len(left) <= mixing.LANDING
    size = {u[0]: u[2] for u in units}
    assert sum(k for _, k in settled) + sum(x[1] for x in left) == pytest.approx(0.3 * 400)
    assert sum(k * size[row] for row, k in settled) + sum(x[1] * x[2] for x in left) == pytest.approx(0.3 * sum(size.values()))


# ---- op 6 ----

def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    odd = ["<|endoftext|>a b", "ΑΣ ΣΑΣ", "é İx", "don't I'LL", "a b\x1cc　d", "日本 123 x9y", "ǅ ﬁ №"]
    rows = [(r[0] if r[0] is not None else -1, r[1]) for r in corpus()] + [(500 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(None if i == -1 else i, t) for i, t in rows], "doc_id long, text string")
    got = packing.pack_documents(df, vocabulary(), 256).collect()
    tokenizer = Tokenizer.from_file(vocabulary())
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    pieces = collections.Counter((-1 if r.doc_id is None else r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got)
    for i, x in ids:
        mine = [p for p in pieces if p[0] == i and p[1] == len(x) and p[4] == zlib.crc32(np.array(x[p[2] : p[2] + p[3]], "<u4").tobytes())]
        assert sum(n for p in {(p[2], p[3]) for p in mine} for n in [p[1]]) >= len(x)
    for s, held in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        held = list(held)
        assert [r.offset for r in held] == list(np.cumsum([0] + [r.length for r in held[:-1]]))
        assert sum(r.length for r in held) == 256 or s == max(r.sequence_id for r in got)
    assert packing.pack_documents(none, vocabulary()).collect() == []


# ---- op 7 ----

def test_marginals_by_force():
    r = np.random.default_rng(5)
    unary, move = r.normal(size=7), r.normal(size=(2, 2))
    head = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    p, moves = toxicity.marginals(unary, head, move)
    want, pairs = np.zeros(7), np.zeros((2, 2))
    for a, z in ((0, 4), (4, 7)):
        total = 0.0
        got, two = np.zeros(z - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=z - a):
            w = np.exp(sum(unary[a + i] * v for i, v in enumerate(y)) + sum(move[u, v] for u, v in itertools.pairwise(y)))
            total += w
            got += w * np.array(y)
            for u, v in itertools.pairwise(y):
                two[u, v] += w
        want[a:z] = got / total
        pairs += two / total
    assert p == pytest.approx(want) and moves == pytest.approx(pairs)


def test_toxicity_learns_and_locates(spark, docs, none):
    rows = [(i, prose(40, i) + (" you grotty fool. " if i % 4 == 0 else " ") + prose(10, i + 1), int(i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id % 3 > 0"))
    scored = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    for i, text, toxic in rows:
        assert (scored[i].score >= 0.5) == bool(toxic)
        for s in scored[i].spans:
            assert text[s.start : s.end].split()[0] in ("you", "grotty", "fool")
        assert bool(scored[i].spans) == bool(toxic)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(none, model).collect() == [] and toxicity.fit_toxicity(none, none.withColumn("toxic", F.lit(1))) is None


# ---- op 8 ----

def components_by_force(rows, percent=90):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(lower))
        sets.append(frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def components_by_words(rows, percent, k):
    """``components_by_force`` for shingles of k words."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [WORD.findall((r[1] or "").translate(lower)) for r in rows]
    sets = [frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else []) for w in words]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if group[i] != group[j] and a and b and 100 * len(a & b) >= percent * len(a | b):
            group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return [(r[0], len(s), least.get(g) if s else r[0]) for g, r, s in zip(group, rows, sets, strict=True)]


def test_jaccard(spark, docs, none, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = [(r[0], r[1]) for r in corpus()]
    for g in range(6):  # crowds of near copies, each a few words away from its base
        base = prose(60 + 40 * g, 100 + g).split()
        for k in range(12):
            r, t = random.Random(g * 50 + k), list(base)
            for _ in range(k % 4):
                t[r.randrange(len(t))] = f"new{r.randrange(99)}"
            rows.append((1000 + g * 50 + k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = by_id(jaccard.jaccard_components(df, 90).collect(), "n_shingles", "component_id")
    assert got == collections.Counter(components_by_force(rows))
    assert jaccard.jaccard_components(none).collect() == []


def edited(words, n, seed):
    r, out = random.Random(seed), list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"new{r.randrange(9999)}"
    return " ".join(out)


def test_rows_without_id_link_others(spark):
    """1 and 3 are linked by a text that stands in rows with a null id alone."""
    base = prose(200, 77).split()
    bridge = " ".join(base[:190] + ["u"] * 3 + base[190:])
    rows = [(3, " ".join(base[:190] + ["u"] * 3 + base[190:-9])), (None, bridge), (None, bridge), (1, " ".join(base[6:190] + ["u"] * 3 + base[190:])), (8, prose(90, 5)), (None, prose(80, 6))]
    want = collections.Counter(components_by_force(rows))
    assert any(i == 3 and c == 1 for i, _, c in want)
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect(), "n_shingles", "component_id")
    assert got == want


@pytest.mark.parametrize("block", [2048, 64])
def test_crowd_that_does_not_link(spark, monkeypatch, block):
    """Classes that share most of a text, so that all meet in many buckets, and link with none but their own few copies."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    common, rows = prose(60, 1).split(), []
    for i in range(600):
        own = prose(10, 1000 + i // 2, 5000).split()
        rows.append((i, " ".join(common + own + (["last"] if i % 2 else []))))
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 90).collect(), "component_id")
    assert got == collections.Counter((i, i // 2 * 2) for i in range(600))


def test_forest_holds_together_what_pairs_would():
    r = np.random.default_rng(4)
    points = np.repeat(r.integers(0, 6, size=(30, jaccard.GROUPS)).astype(np.int64), 7, axis=0) + (r.random((210, jaccard.GROUPS)) < 0.01)
    size, root = points.sum(axis=1), np.arange(210)
    tree = jaccard.Tree(points, size)
    joined = []
    for pairs in (jaccard._forest(tree, root, 90), jaccard._apart(tree, root, 90)):
        pairs, label = list(pairs), list(range(210))
        for i, j in pairs:
            label = [label[i] if x == label[j] else x for x in label]
        joined.append([label.index(x) for x in label])
        assert pairs and (len(joined) > 1 or len(pairs) < 210)
    assert joined[0] == joined[1]


def test_groups_are_enough_for_every_linked_size():
    bands = jaccard.Bands(90)
    for a in range(1, 400):
        for b in range(a, a * 100 // 90 + 1):
            most = a + b - 2 * int(jaccard.enough(np.array(a), np.array(b), 90))
            assert most < bands.groups[bands.of(np.array([a]))[0]]


def test_five_words_and_four_fifths(spark, docs, monkeypatch):
    """What the pipeline's stage asks for: a fifth appended, a block cut out, words changed here and there."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = [(r[0], r[1]) for r in corpus()]
    for g in range(12):
        base, r = prose(30 + 30 * g, 300 + g).split(), random.Random(g)
        n, at = len(base), len(base) // 3
        spots = {(2 * i + 1) * n // (2 * max(1, n // 50)) for i in range(max(1, n // 50))}
        more = [base + prose(n * 12 // 100, 500 + g).split(), base + prose(n * 22 // 100, 600 + g).split(), base + prose(n * 27 // 100, 700 + g).split(), base[:at] + base[at + n * 14 // 100 :]]
        more += [[f"new{r.randrange(99)}" if i in spots else w for i, w in enumerate(base)], base[: 1 + g % 6]]
        rows += [(2000 + 10 * g + i, " ".join(t)) for i, t in enumerate([base, *more])]

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = by_id(jaccard.jaccard_components(df, 80, k=5).collect(), "n_shingles", "component_id")
    assert got == collections.Counter(components_by_words(rows, 80, 5))
    assert got != collections.Counter(components_by_words(rows, 90, 3))


def test_sets_of_four_fifths_share_a_key():
    """A linked pair of any size meets in a bucket, empty groups or not."""
    bands, r = jaccard.Bands(80), np.random.default_rng(3)
    for a in [*range(1, 60), *range(60, 900, 37)]:
        for b in {a, a * 9 // 10, -(-a * 80 // 100)}:
            both = int(jaccard.enough(np.array(a), np.array(b), 80))
            if b < 1 or both > b:
                continue
            pool = r.integers(0, 1 << 54, a + b, dtype=np.uint64)
            x, y = np.sort(pool[:a]), np.sort(np.concatenate([pool[:both], pool[a : a + b - both]]))
            key, which = jaccard.signatures(np.concatenate([x, y]), np.array([0, a, a + b]), bands)
            assert set(key[which == 0].tolist()) & set(key[which == 1].tolist()), (a, b)


def test_tree_finds_all_within_the_bound():
    r = np.random.default_rng(2)
    points = r.integers(0, 6, size=(200, jaccard.GROUPS)).astype(np.int64)
    points[100:] = np.maximum(0, points[:100] + (r.random((100, jaccard.GROUPS)) < 0.02))
    size = points.sum(axis=1)
    got = {tuple(sorted((int(x[i]), int(y[j])))) for x, y, may in jaccard.Tree(points, size).pairs(90) for i, j in zip(*np.nonzero(may), strict=True)}
    may = jaccard.bounded(points, size, points, size, 90)
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if may[i, j]} and len(got) >= 100
    first, n = np.array([0, 2, 7]), np.array([2, 5, 9])
    for forest in (False, True):
        a, b = jaccard._small(first, n, np.arange(200), size, points, 90, forest)
        want = {(i, j) for x, k in zip(first, n, strict=True) for i in range(x, x + k) for j in range(i + 1, x + k) if may[i, j]}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) <= want and (forest or len(a) == len(want))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    want = {x: find(x) for a, b in edges for x in (a, b) if a is not None and a != b}
    got = {x.node: x.root for x in star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# ---- op 9 ----

def test_languages(spark, docs, none):
    alphabets = {"xx": "abcde", "yy": "fghij"}

    def text(lang, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randrange(2, 7))) for _ in range(30))

    rows = [(i, text(x, i), x) for i in range(80) for x in [("xx", "yy")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(df.where("doc_id < 60"))
    got = {r.doc_id: r for r in langid.identify_languages(df, model).collect()}
    assert all(got[i].lang_pred == x and 0.5 < got[i].score <= 1 for i, _, x in rows)
    said, share = langid.Scorer(model).texts(pa.array(["abcdeabcde", "zzz fff", None, "12 ²½ _", ""]))
    assert said == ["xx", "yy", "und", "und", "und"] and list(share[2:]) == [0, 0, 0]
    said = langid.identify_languages(docs.withColumn("score", F.lit("old")), model)
    assert said.count() == len(corpus()) and set(docs.columns) < set(said.columns) and dict(said.dtypes)["score"] == "double"
    assert langid.identify_languages(none, langid.fit_languages(none)).collect() == []
    blank = langid.fit_languages(none)
    assert {r.lang_pred for r in langid.identify_languages(docs, blank).collect()} == {"und"}


def test_scores_do_not_depend_on_what_a_worker_remembers(monkeypatch, spark):
    rows = [(i, prose(40, i), ("p", "q")[i % 2]) for i in range(20)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in rows] + [rows[3][1]]
    want = langid.Scorer(model).texts(pa.array(texts))
    monkeypatch.setattr(langid, "MEMORY_TOKENS", 5)
    monkeypatch.setattr(langid, "ROWS", 3)
    got = langid.Scorer(model).texts(pa.array(texts))
    assert got[0] == want[0] and got[1].tolist() == want[1].tolist() and want[1][3] == want[1][20]


def test_samples_have_their_size(spark):
    rows = spark.createDataFrame([(i % 50, f"t{i}") for i in range(500)] + [(None, "x"), (None, None)], "id long, text string")
    for n in (1, 20, 49, 600):
        got = langid.bounded_sample(rows, "id", n).collect()
        assert len(got) <= min(n, 51) and len({r.id for r in got}) == len(got)
    assert len(langid.bounded_sample(rows, "id", 600).collect()) == 51 and langid.bounded_sample(rows.limit(0), "id", 5).collect() == []


# ---- op 10 ----

def test_media(docs, none):
    got = media.media_columns(docs).collect()
    want = collections.Counter()
    for r in corpus():
        raw = (r[1] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert by_id(got, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    same = collections.defaultdict(set)
    for r in got:
        same[r.payload_sha256].add((r.media_sha256, r.feature, r.shard, r.offset))
        assert (r.width, r.height * 192, r.bits, r.length) == (192, r.payload_bytes, 8, r.media_bytes)
    assert all(len(x) == 1 for x in same.values()) and media.media_columns(none).collect() == []


def test_shards_are_tar_files_of_png(docs, tmp_path):
    import tarfile

    media.media_columns(docs, folder=f"file://{tmp_path}").count()
    names = []
    for f in tmp_path.glob("*.tar"):
        with tarfile.open(f) as t:
            for m in t.getmembers():
                payload = media.from_png(t.extractfile(m).read())
                assert m.name == hashlib.sha256(payload).hexdigest() + ".png"
                names.append(m.name)
    assert set(names) and tarfile


# ---- helpers ----

def test_hashes_depend_on_content_alone():
    data = np.frombuffer(b"xxabcabcdabcab" + b"q" * 600 + b"r" + b"q" * 600, np.uint8)
    h = textbatch.span_hash(data, np.array([2, 5, 9, 0, 14, 615, 14]), np.array([5, 8, 12, 3, 614, 1215, 613]))
    assert h[0] == h[1] == h[2] != h[3] and h[4] == h[5] != h[6]
    for k in (8, 9, 16, 48, 200):
        grams = textbatch.gram_hash(data, k).tolist()
        assert len(grams) == len(data) - k + 1 and len(set(grams)) == len({data[i : i + k].tobytes() for i in range(len(grams))})
    assert len(textbatch.gram_hash(data[:5], 8)) == 0


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = ["", " a  b", None, "c\x0b\x0cd\n", "é x", "last", ""]
    for first, last, data, offsets in textbatch.chunks(pa.array(texts), limit=4):
        s, e, bounds = textbatch.words(data, offsets)
        for i in range(last - first):
            got = [data[a:b].tobytes().decode() for a, b in zip(s[bounds[i] : bounds[i + 1]], e[bounds[i] : bounds[i + 1]], strict=True)]
            assert got == WORD.findall(texts[first + i] or "")


# ---- scores ----

def test_language_scores_by_force(spark):
    """Own frequencies of known words, else the longest order of n-grams with a known one, from counts of the whole sample."""
    rows = [(i, prose(60, i, 60) + " " + prose(5, 1000 + i), ("p", "q")[i % 3 == 0]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(df)
    count = {k: collections.defaultdict(lambda: np.zeros(2)) for k in (0, 5, 4, 3, 2, 1)}
    letters = re.compile(r"[^\W\d_]+")
    for _, text, lang in rows:
        for w in letters.findall(text.lower()):
            count[0][w]["pq".index(lang)] += 1
            for k in (5, 4, 3, 2, 1):
                for i in range(len(w) + 3 - k):
                    count[k][f" {w} "[i : i + k]]["pq".index(lang)] += 1
    kept = {k: {g: c for g, c in its.items() if c.sum() >= (5 if k else 2)} for k, its in count.items()}
    logs = {}
    for k, its in kept.items():
        total = sum(its.values(), np.zeros(2)) + 0.5 * max(1, len(its))
        logs[k] = {g: np.round(np.log((c + 0.5) / total) * langid.SCALE).astype(np.int64) for g, c in its.items()}

    def word(w):
        if w in logs[0]:
            return logs[0][w]
        for k in (5, 4, 3, 2, 1):
            found = [logs[k][g] for i in range(len(w) + 3 - k) if (g := f" {w} "[i : i + k]) in logs[k]]
            if found:
                return sum(found) // len(found)
        return np.zeros(2, np.int64)

    words = sorted({w for _, t, _ in rows for w in letters.findall(t.lower())} | {"wwww", "éw", "zq", "w"})
    got = langid.Scorer(model).words(words)
    assert [tuple(x) for x in got.tolist()] == [tuple(word(w).tolist()) for w in words]


def test_fits_keep_to_bytes(spark):
    rows = spark.createDataFrame([(i, "é" * 50) for i in range(40)], "id long, text string")
    assert langid.within_bytes(rows, "id", "text", 1000).count() == 10 and langid.within_bytes(rows, "id", "text", 10).count() == 1
    assert langid.within_bytes(rows, "id", "text", 1 << 20).count() == 40 and langid.within_bytes(rows.limit(0), "id", "text", 5).count() == 0


def test_large_models_raise(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_BYTES", 100)
    with pytest.raises(ValueError, match="a model of"):
        langid.fit_languages(spark.createDataFrame([(1, prose(50, 1) * 2, "p")], "doc_id long, text string, lang string"))


def test_equal_texts_score_alike_wherever_they_stand(spark):
    """Toxicity and quality scores of a text to the last bit, at several places of several batches."""
    text = prose(70, 5)
    rows = [(i, prose(30 + i % 7, i) if i % 10 else text, i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("quality", F.col("toxic"))
    marks = df.select("doc_id", "toxic", "quality")
    toxic, quality_model = toxicity.fit_toxicity(df, marks, least_docs=1), quality.fit_quality(df, marks)
    for n in (1, 4):
        some = df.repartition(n)
        same = {r.score for r in toxicity.score_toxicity(some, toxic).collect() if r.doc_id % 10 == 0}
        assert len(same) == 1
        assert len({r.probability for r in quality.judge_quality(some, quality_model).collect() if r.doc_id % 10 == 0}) == 1


# ---- results that stay, other vocabularies ----

def test_media_outlive_staged_tables(spark, docs):
    """Payloads are results: dropping intermediate tables leaves them, and rows find them by folder, shard, offset and length."""
    from weftgraph.staging import drop_staged

    rows = media.media_columns(docs).collect()
    assert drop_staged(spark) > 0 and {r.shard for r in rows} <= {f"shard-{i:06d}.tar" for i in range(99)}
    for r in rows:
        with media._open(f"{r.folder}/{r.shard}", False) as f:
            f.seek(r.offset)
            image = f.read(r.length)
        assert hashlib.sha256(image).hexdigest() == r.media_sha256 and hashlib.sha256(media.from_png(image)).hexdigest() == r.payload_sha256
    with pytest.raises(FileExistsError):
        media.media_columns(docs, folder=rows[0].folder)


def test_packing_by_another_vocabulary(spark, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    texts = ["Hello  World\n\nit's", " a<|endoftext|> b ", None, "", "\r\n x\x1c!", prose(50, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = collections.defaultdict(list)
    for r in packing.pack_documents(df, path, 16).collect():
        whole[r.doc_id].append((r.start, r.length, r.ids_crc32))
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == crc for a, n, crc in whole[i]) and sum(n for _, n, _ in whole[i]) == len(ids)
    other = tmp_path / "t.json"
    other.write_text('{"model": {"type": "WordPiece", "vocab": {}, "merges": []}}')
    with pytest.raises(ValueError, match="not among those"):
        packing.pack_documents(df, str(other))
