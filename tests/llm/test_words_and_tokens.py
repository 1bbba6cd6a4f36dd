"""Spelling variants, BPE through distinct words and token alignment against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from test_small import corpus

from weftgraph.llm import alignment, tokens, variants
from weftgraph.llm.queries import QUERIES, table, vocabulary
from weftgraph.llm.vocabularies import Rules, blocks, from_varints, to_varints, visible_bytes

KIND = "doc_id long, text string, word string, n long, ids string, chunk long, key string"
ODD = [
    "<|endoftext|>a b", "ΑΣ ΣΑΣ", "é İx", "don't I'LL", "a b\x1cc　d!\x1c!", "日本 123 x9y", "ǅ ﬁ №", "a▁b", "x <s> </s> <0x0A> <unk>", "a\r  b\r\nc \n\n\t d;\r\n e  ",
    "   ", "\n", "\x00z", " lead  two", "é ́x", "it's's    q", "<|endoftext|> <|endoftext|>", "Étude ÉTUDE étude",
]


@pytest.fixture(scope="module")
def rows():
    held = [(r[0], r[1] if r[1] is None else r[1][:4000]) for r in corpus()]
    return held + [(500 + i, t) for i, t in enumerate(ODD)] + [(500, ODD[0])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "i", 2, "k") for i, t in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


# ---- op 11 ----

def words_by_force(rows, drop=199, least=5):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            word = word[: h % len(word)] + word[h % len(word) + 1 :] if h % drop == 0 else word
            count[word] += len(word) >= 6
    return {w: n for w, n in count.items() if n >= least}


def near(u, w):
    if len(u) == len(w):
        return sum(a != b for a, b in zip(u, w, strict=True)) == 1
    u, w = sorted((u, w), key=len)
    return len(w) == len(u) + 1 and any(w[:i] + w[i + 1 :] == u for i in range(len(w)))


def variants_by_force(words, factor=5):
    forms, counts = {}, {}
    for w in words:
        its = [x for x in words if x != w and near(w, x)]
        best = min(its, key=lambda x: (-words[x], x), default=None)
        forms[w], counts[w] = best if best and words[best] >= factor * words[w] else None, len(its)

    def root(w):
        return root(forms[w]) if forms[w] else w

    return {(w, forms[w], root(w), words[w], counts[w], words.get(forms[w])) for w in words}


@pytest.mark.parametrize("long_word", [256, 8, 7])
def test_variants(spark, monkeypatch, long_word):
    """Equal letters in a row, ties, chains of forms; long words by hashes give the same."""
    monkeypatch.setattr(variants, "LONG_WORD", long_word)
    r = random.Random(long_word)
    words = {"".join(r.choice("abç") for _ in range(r.randrange(5, 12))): r.choice([5, 6, 6, 30, 31, 200, 1000, 5000, 25000]) for _ in range(300)}
    words |= {"a" * 300: 40, "a" * 299 + "b": 7, "a" * 301: 7, "a" * 299: 300}
    got = [tuple(x) for x in variants.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)).collect()]
    assert len(got) == len(words) and set(got) == variants_by_force(words)


def test_word_counts(docs, rows, none):
    got = {r.word: r.n for r in variants.count_words(docs, 6, 2, 3).collect()}
    assert got == words_by_force(rows, 3, 2)
    assert variants.count_words(none).collect() == [] and variants.variant_groups(none).collect() == []


def test_marked_words_raise(spark):
    with pytest.raises(Exception, match="marks rotations"):
        variants.variant_groups(spark.createDataFrame([("a$bcdef", 5)], "word string, n long")).collect()


def test_op11(spark, sf):
    held = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = [tuple(r) for r in QUERIES["op11_variants"](spark, sf).collect()]
    assert set(got) == variants_by_force(words_by_force(held)) and len(got) == len(set(got))


# ---- op 12 ----

def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def encoded_by_force(rows, name):
    t, out = tokenizer(name), collections.Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out[i, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("chunk", [tokens.CHUNK_BYTES, 3000])
def test_encode_and_decode(spark, docs, rows, monkeypatch, name, chunk):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(tokens, "STEP", 100 if chunk == 3000 else tokens.STEP)
    path = vocabulary(name)
    found = tokens.decode_documents(tokens.encode_documents(docs, path), tokens.piece_table(spark, path), Rules(path).joint)
    got = collections.Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in found.collect())
    assert got == encoded_by_force(rows, name)


def test_each_distinct_word_is_encoded_once(docs, monkeypatch):
    """Over all chunks and tasks, the words that meet the tokenizer are distinct."""
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 3000)
    named = docs.select("doc_id", "text").mapInArrow(tokens._named(vocabulary(), 4), tokens._NAMED).where("bucket >= 0")
    asked = []
    for r in named.collect():
        at = np.cumsum(from_varints(tokens.unsqueeze(bytes(r.sizes)))[0].astype(int)).tolist()
        data = tokens.unsqueeze(bytes(r.data)).tobytes()
        asked += [(r.bucket, data[a:z]) for a, z in zip([0, *at[:-1]], at, strict=True)]
    assert len(asked) > len(set(asked)) and len({w for _, w in asked}) == len(set(asked))


def test_decode_of_odd_ids(spark, none):
    ids = [(1, None), (2, b""), (3, np.array([5, 99_999_999, 6], "<u4").tobytes())]
    df = spark.createDataFrame(ids, "doc_id long, ids binary")
    got = {r.doc_id: r.decoded for r in tokens.decode_documents(df, tokens.piece_table(spark, vocabulary())).collect()}
    assert got == {1: None, 2: "", 3: tokenizer("word_bpe_49k.json").decode([5, 6], skip_special_tokens=False)}
    assert tokens.encode_documents(none, vocabulary()).collect() == []


def test_unknown_rules_raise(tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"model": {"type": "BPE", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "Whitespace"}}')
    with pytest.raises(ValueError, match="not among those"):
        Rules(str(path))


def test_blocks_and_varints():
    text = "ab  c\n" * 700_000
    assert "".join(blocks(text)) == text and len(list(blocks(text))) > 2
    x = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1])
    assert from_varints(to_varints(x)[0])[0].tolist() == x.tolist() and len(from_varints(to_varints(x[:0])[0])[0]) == 0


def test_op12(spark, sf):
    held = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = {(i, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for i, n, ids, text in encoded_by_force(held, "word_bpe_49k.json")}
    assert {tuple(r) for r in QUERIES["op12_bpe"](spark, sf).collect()} == want


# ---- op 13 ----

def aligned_by_force(rows):
    """Both tokenizers on whole texts, and all pairs of their tokens' byte ranges."""
    import sentencepiece

    a_side, b_side = tokenizer("byte_bpe_50k.json"), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    back, names = visible_bytes(), {i: t for t, i in a_side.get_vocab().items()}

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    per, count = [], collections.Counter()
    for i, text in rows:
        raw = f" {text}".encode()
        a = a_side.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        sides = [[bytes(back[c] for c in names[k]) for k in a], [b_bytes(k) for k in b]]
        if not text or any(b"".join(s) != raw for s in sides):
            per.append((i, 0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(x) for x in s]) for s in sides]
        starts = [e - [len(x) for x in s] for e, s in zip(ends, sides, strict=True)]
        met = np.argwhere((starts[0][:, None] < ends[1][None]) & (starts[1][None] < ends[0][:, None]))
        links = [(a[x], b[y]) for x, y in met.tolist()]
        cuts, groups, before = sorted(set(ends[0].tolist()) & set(ends[1].tolist())), [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(k) for k, e in zip(ids, its, strict=True) if before < e <= cut) for ids, its in zip((a, b), ends, strict=True)))
            before = cut
        per.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(set(links))
    top = collections.Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    found = collections.Counter((i, na, nb, g, len(x), sum(count[p] == top[p[0]] for p in x), sum(count[p] for p in x), h) for i, na, nb, g, x, h in per)
    return found, {(a, b, n, n == top[a]) for (a, b), n in count.items()}


def paths():
    return vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk", [alignment.CHUNK_BYTES, 3000])
def test_alignment(docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "STEP", 50 if chunk == 3000 else alignment.STEP)
    monkeypatch.setattr(alignment, "BLOCK", 200)
    short = [(i, t if t is None else t[:1200]) for i, t in rows]
    found, pairs = alignment.align_texts(docs.selectExpr("doc_id", "substring(text, 1, 1200) as text", "key", "chunk"), *paths())
    want, want_pairs = aligned_by_force(short)
    assert collections.Counter(tuple(r) for r in found.collect()) == want
    assert {tuple(r) for r in pairs.collect()} == want_pairs


def test_alignment_of_nothing(none):
    found, pairs = alignment.align_texts(none, *paths())
    assert found.collect() == [] and pairs.collect() == []


def test_op13(spark, sf):
    held = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    cut = [(i, t) for i, t in held if len(t or "") < 30_000]
    if len(cut) == len(held):
        assert collections.Counter(tuple(r) for r in QUERIES["op13_alignment"](spark, sf).collect()) == aligned_by_force(held)[0]
    else:  # brute force looks at all pairs of tokens
        df = spark.createDataFrame(cut, "doc_id long, text string")
        assert collections.Counter(tuple(r) for r in alignment.align_texts(df, *paths())[0].collect()) == aligned_by_force(cut)[0]
