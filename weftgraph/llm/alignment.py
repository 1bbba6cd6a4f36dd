"""Two tokenizers side by side: which tokens of one overlap which of the other, text by text and over the corpus.

Texts are shuffled whole, so that each distinct one is tokenised and aligned once and counts as often as it stands in
the table. A task works through some megabytes of distinct texts at a time: it parts them where both tokenizers must cut, tokenises
each distinct part once and lays the ends of both token streams over each other. It gives its own counts of linked id pairs and keeps a text
as the pairs it holds. The pairs' totals over the corpus come from a Spark aggregation, go back to the chunks that hold
them, and a text's measures are joined to its rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .tokens import numbered
from .vocabularies import BLOCK, BYTE_SPLIT, WHITE, from_varints, ragged, rules, to_varints

#: Bytes of distinct text that are worked through together; parts whose pairs are gathered at a time.
CHUNK_BYTES, STEP = 24 << 20, 1 << 18

_SPACE = "▁"


class Sides:
    """Both tokenizers, and where a text may be parted so that neither notices."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2

        ranks = rules(a_path).ranks()
        # the same merges by a faster library; with no special tokens, their strings are plain text
        self.a = tiktoken.Encoding("a", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.a_sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.a_bytes: list[bytes] = [b""] * len(self.a_sizes)
        for piece, i in ranks.items():
            self.a_bytes[i], self.a_sizes[i] = piece, len(piece)
        model = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            model.ParseFromString(f.read())
        said = model.normalizer_spec
        if said.name != "identity" or said.remove_extra_whitespaces or not said.escape_whitespaces or not said.add_dummy_prefix:
            raise ValueError(f"{b_path}: only models that leave texts as they are, with a space in front, can be aligned by bytes")
        said.add_dummy_prefix = False  # parts hold their own spaces, the first one too
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.b_bytes, kinds = [], model.SentencePiece.Type
        inner = set()
        for p in model.pieces:
            byte = p.type == kinds.BYTE
            self.b_bytes.append(bytes([int(p.piece[3:5], 16)]) if byte else p.piece.replace(_SPACE, " ").encode())
            inner |= set() if byte else set(re.findall(f"(?<=[^{WHITE}])[{WHITE}]", p.piece.replace(_SPACE, " ")))
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # white space that some piece has after another sign doesn't part; a space among it leaves texts whole
        joins = "".join(re.escape(c) for c in sorted(inner))
        more = f"(?:[{joins}][{WHITE}]*[^{WHITE}]*)*" if joins else ""
        self.parts = re.compile(f"[{WHITE}]*[^{WHITE}]+{more}|[{WHITE}]+")

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all parts by both tokenizers, and how many each part has."""
        a, b = [self.a(x) for x in parts], self.b.encode(parts, num_threads=1)
        out = []
        for ids in (a, b):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            out += [np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum())), sizes]
        return tuple(out)


_SIDES: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    if (a_path, b_path) not in _SIDES:
        _SIDES[a_path, b_path] = Sides(a_path, b_path)
    return _SIDES[a_path, b_path]


class Aligned:
    """Distinct parts of texts: their tokens, groups and links; arrays of all parts lie end to end.

    A part's bytes are those it was made of by both tokenizers, else it is not ``sound``.
    """

    def __init__(self, parts: list[str], both: Sides) -> None:
        a, self.n_a, b, self.n_b = both.encode(parts)
        raw = [p.encode() for p in parts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sound = np.ones(len(parts), bool)
        for ids, counts, sizes, pieces in ((a, self.n_a, both.a_sizes, both.a_bytes), (b, self.n_b, both.b_sizes, both.b_bytes)):
            sound &= _sums(sizes[ids], counts) == size
            joined = b"".join([pieces[i] for i in ids.tolist()])
            if joined != b"".join(raw):  # then some part differs: find out which
                at = np.concatenate([[0], np.cumsum(_sums(sizes[ids], counts))]).tolist()
                sound &= np.array([joined[x:y] == r for x, y, r in zip(at[:-1], at[1:], raw, strict=True)], bool)
        self.sound = sound
        # a part that isn't sound makes its texts empty: its own tokens are of no use
        a, b = a[np.repeat(sound, self.n_a)], b[np.repeat(sound, self.n_b)]
        self.n_a, self.n_b = np.where(sound, self.n_a, 0), np.where(sound, self.n_b, 0)
        a_ends, b_ends = np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b])
        # groups end where both streams have an end
        a_cut, b_cut = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
        part_a, part_b = np.repeat(np.arange(len(parts)), self.n_a), np.repeat(np.arange(len(parts)), self.n_b)
        self.n_groups = np.bincount(part_a[a_cut], minlength=len(parts))
        # links: tokens of B from the one that holds a token's first byte to the one that holds its last
        first = np.searchsorted(b_ends, a_ends - both.a_sizes[a], side="right")
        last = np.searchsorted(b_ends, a_ends, side="left")
        fan = last - first + 1
        self.links = (np.repeat(a, fan) << 32) | b[ragged(first, fan)]
        self.n_links = _sums(fan, self.n_a)
        self.link_starts = np.cumsum(self.n_links) - self.n_links
        self.texts = _written(a, b, a_cut, b_cut, part_a, part_b, len(parts), len(both.a_sizes), len(both.b_sizes))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _written(a, b, a_cut, b_cut, part_a, part_b, n_parts: int, size_a: int, size_b: int) -> pa.LargeStringArray:
    """Each part's groups as text, ``a1,a2|b1;`` for one group."""
    group_a = np.cumsum(a_cut) - a_cut
    group_b = np.cumsum(b_cut) - b_cut
    # all tokens in order of group, side, place; each writes its id and the sign that follows it
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    kind = np.concatenate([np.where(a_cut, 1, 0), np.where(b_cut, 2, 0)])[order]
    ids, most = np.concatenate([a, b])[order], max(size_a, size_b)
    signs = pa.array([f"{i}{s}" for s in ",|;" for i in range(most)], pa.large_string())
    told = signs.take(pa.array(kind * most + ids))
    offsets = np.frombuffer(told.buffers()[1], np.int64, count=len(told) + 1) if len(told) else np.zeros(1, np.int64)
    per_part = np.bincount(part_a, minlength=n_parts) + np.bincount(part_b, minlength=n_parts)
    bounds = offsets[np.concatenate([[0], np.cumsum(per_part)])]
    return pa.LargeStringArray.from_buffers(n_parts, pa.py_buffer(np.ascontiguousarray(bounds)), told.buffers()[2] if len(told) else pa.py_buffer(b""))


_KEPT = "chunk long, pairs array<long>, counts array<long>, key string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def _aligned(a_path: str, b_path: str):
    """For each chunk of distinct texts: its pairs with the number of documents that hold them, and its texts' measures and pairs.

    A text keeps its distinct pairs as ascending codes, each as its distance from the one before, and how often each is linked.
    """
    names = [c.split()[0] for c in _KEPT.split(", ")]

    def batch(chunk: int, n: int, **held: pa.Array) -> pa.RecordBatch:
        kinds = {"pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "key": pa.string(), "groups_sha256": pa.string(), "codes": pa.binary(), "times": pa.binary()}
        cols = {k: pa.nulls(n, kinds.get(k, pa.int64())) for k in names} | {"chunk": pa.array(np.full(n, chunk))} | held
        return pa.RecordBatch.from_arrays([cols[k] for k in names], names=names)

    def flush(chunk: int, parts: dict[str, int], keys: list[str], times: list[int], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        its = Aligned(list(parts), sides(a_path, b_path))
        pairs, links = np.unique(its.links, return_inverse=True)
        weights, bounds = np.zeros(len(pairs), np.int64), np.concatenate([[0], np.cumsum([len(x) for x in held])])
        first = 0
        while first < len(held):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + STEP, side="right")) - 1)
            codes, n = np.concatenate(held[first:last]), np.diff(bounds[first : last + 1])
            text = np.repeat(np.arange(last - first), n)
            sound = np.bincount(text, weights=~its.sound[codes], minlength=last - first) == 0
            live = sound[text]
            text, codes = text[live], codes[live]
            sums = {k: np.bincount(text, weights=getattr(its, k)[codes], minlength=last - first).astype(np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
            shas = _digests(its.texts, codes, np.searchsorted(text, np.arange(last - first + 1)))
            # a text's distinct parts and how often each stands in it, then its distinct pairs and how often each is linked
            keyed, often = np.unique(text * len(parts) + codes, return_counts=True)
            text, codes = keyed // max(1, len(parts)), keyed % max(1, len(parts))
            fan = its.n_links[codes]
            keyed, at = np.unique(np.repeat(text, fan) * len(pairs) + links[ragged(its.link_starts[codes], fan)], return_inverse=True)
            linked = np.bincount(at, weights=np.repeat(often, fan), minlength=len(keyed)).astype(np.int64)
            text, which = keyed // max(1, len(pairs)), keyed % max(1, len(pairs))
            weights += np.bincount(which, weights=np.array(times[first:last], np.int64)[text], minlength=len(pairs)).astype(np.int64)
            cuts = np.searchsorted(text, np.arange(last - first + 1))
            step = np.diff(which, prepend=0)
            heads = cuts[:-1][cuts[:-1] < cuts[1:]]
            step[heads] = which[heads]
            packed = [_spans(x, cuts) for x in (step, linked)]
            yield batch(
                chunk, last - first, key=pa.array(keys[first:last]), groups_sha256=pa.array(shas), codes=packed[0], times=packed[1],
                **{k: pa.array(v) for k, v in sums.items()},
            )
            first = last
        lists = [pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(x)) for x in (pairs, weights)]
        yield batch(chunk, 1, pairs=lists[0], counts=lists[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, cut = TaskContext.get().partitionId() << 32, sides(a_path, b_path).parts
        every, each = cut.findall, cut.finditer
        parts, keys, times, held, size = numbered(), [], [], [], 0
        for b in batches:
            for key, n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = text.as_py()
                found = every(" " + raw) if len(raw) <= BLOCK else (m[0] for m in each(" " + raw))
                held.append(np.fromiter(map(parts.__getitem__, found), np.int64))
                keys.append(key)
                times.append(n)
                size += len(raw) + 64
                if size >= CHUNK_BYTES:
                    yield from flush(chunk, parts, keys, times, held)
                    parts, keys, times, held, size, chunk = numbered(), [], [], [], 0, chunk + 1
        if keys:
            yield from flush(chunk, parts, keys, times, held)

    return run


def _digests(written: pa.LargeStringArray, codes: np.ndarray, bounds: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups, from the groups of its parts; '' for a text without any."""
    out = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        made = hashlib.sha256()
        for at in range(first, last, STEP):
            end = min(last, at + STEP)
            told = written.take(pa.array(codes[at:end]))
            size = int(np.frombuffer(told.buffers()[1], np.int64, count=len(told) + 1)[-1])
            made.update(memoryview(told.buffers()[2])[: size - (end == last)])
        out.append(made.hexdigest() if last > first else "")
    return out


def _spans(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of numbers between cuts, each as the bytes of its varints."""
    packed, ends = to_varints(values)
    bounds = np.concatenate([[0], ends])[cuts].tolist()
    whole = packed.tobytes()
    return pa.array([whole[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())


_MEASURES = "key string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _measured(told: pa.Table, texts: pa.Table) -> pa.Table:
    """The measures of a chunk's texts from the corpus-wide counts of its pairs."""
    code = told.column("code").to_numpy()
    total, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    total[code], best[code] = told.column("total").to_numpy(), told.column("best").to_numpy().astype(np.int64)
    sums, bests = [], []
    for raw, often in zip(texts.column("codes"), texts.column("times"), strict=True):
        codes = np.cumsum(from_varints(np.frombuffer(raw.as_py(), np.uint8))[0].astype(np.int64))
        n = from_varints(np.frombuffer(often.as_py(), np.uint8))[0].astype(np.int64)
        sums.append(int((total[codes] * n).sum()))
        bests.append(int((best[codes] * n).sum()))
    cols = {k: texts.column(k) for k in ("key", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(cols | {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": texts.column("groups_sha256")})


def align_texts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Align the tokens of every whole text by two tokenizers; returns the documents' measures and the table of pairs.

    ``a_path`` is a byte-level tokenizers file, ``b_path`` a sentencepiece model that leaves texts as they are (else ValueError).
    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row for each row of ``docs``.
    Pairs: a, b, n (documents that hold the pair linked), best (whether n is the highest of its a).
    Nulls: a null or empty text has no tokens: zeros, and '' as groups; so has a text that the pieces of either side don't spell. A null
    id stays null. Repeated rows count each. Extra columns are not read. An empty table gives two empty tables.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(text != "", text).alias("text"))
    distinct = rows.where("text is not null").groupBy("text").agg(F.count("*").alias("times"))
    kept = stage(distinct.select(F.sha2("text", 256).alias("key"), "times", "text").mapInArrow(_aligned(a_path, b_path), _KEPT), "aligned")
    held = kept.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("code", "held"))
    held = held.select("chunk", "code", F.col("held.pairs").alias("pair"), F.col("held.counts").alias("n"))
    counts = stage(held.groupBy("pair").agg(F.sum("n").alias("total")), "pairs").withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("total").alias("most"))
    counts = counts.join(most, "a").select("pair", "a", "total", (F.col("total") == F.col("most")).alias("best"))
    told = held.select("chunk", "code", "pair").join(counts, "pair").select("chunk", "code", "total", "best")
    texts = kept.where("pairs is null").drop("pairs", "counts").withColumnRenamed("chunk", "of")
    measures = told.groupBy("chunk").cogroup(texts.groupBy("of")).applyInArrow(_measured, _MEASURES)
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("key"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    found = keyed.join(measures, "key", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )
    pairs = counts.select(F.col("a").cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), F.col("total").alias("n"), "best")
    return found, pairs
