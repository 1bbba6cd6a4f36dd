"""Toxic spans by a linear-chain conditional random field over words.

Labels mark documents, so token labels come first: a word of a toxic training document is a toxic token when it, its
beginning or its ending marks toxic documents by document counts (a floor on how many, and on their share). The
field has two states; its unary scores are hashed features of a word, its parts and its neighbours, its chains are
sentences. Forward-backward runs in
lock step over all chains of a batch. A document's score comes from its tokens' marginals by a small calibrated
logistic function, and runs of words with a marginal of a half or more are the offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import bounded_sample, one_of_each
from .textbatch import chunks, lower_ascii, mix, owner, span_hash, span_sums

BITS = 18
#: Words a chain has at most; sentences longer than that are parted.
CHAIN = 64

#: Bytes of letters (those beyond ASCII count as letters), and bytes that end a sentence.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
STOP = np.zeros(256, dtype=bool)
STOP[np.frombuffer(b".!?\n", np.uint8)] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters: starts, ends, hashes in lower case, bounds of the texts, and where a new chain begins.

    The hashes have a column for each unit: the word, its first 4 and 6 bytes, its last 5.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros((0, 4), np.uint64), np.zeros(len(offsets), np.int64), z.astype(bool)
    inside = LETTER[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    heads, tails = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    start[heads], end[tails] = inside[heads], inside[tails]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    bounds = np.searchsorted(s, offsets)
    stops = np.concatenate([[0], np.cumsum(STOP[data])])[s]
    head = np.zeros(len(s), dtype=bool)
    head[1:] = stops[1:] != stops[:-1]
    head[bounds[:-1][bounds[:-1] < len(s)]] = True
    if len(s):
        begins = np.flatnonzero(head)
        place = np.arange(len(s)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(s)]])))
        head |= place % CHAIN == 0
    lower = lower_ascii(data)
    units = [(s, e), (s, np.minimum(e, s + 4)), (s, np.minimum(e, s + 6)), (np.maximum(s, e - 5), e)]
    return s, e, np.stack([span_hash(lower, x, y) + np.uint64(k) for k, (x, y) in enumerate(units)], axis=1), bounds, head


def chain_features(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Feature codes of each word, one column each: its units, the pair with the word before, and with the one after."""
    shift, units, h = np.uint64(64 - BITS), h, h[:, 0]
    before, after = np.zeros_like(h), np.zeros_like(h)
    before[1:] = np.where(head[1:], np.uint64(0), h[:-1])
    after[:-1] = np.where(head[1:], np.uint64(0), h[1:])
    pairs = [mix(before * np.uint64(5) + h), mix(after * np.uint64(7) + h + np.uint64(1))]
    return np.stack([(x >> shift).astype(np.int64) for x in (*units.T, *pairs)], axis=1)


class Chains:
    """Words laid out step by step over all chains, longest first: a step of all chains is one slice."""

    def __init__(self, head: np.ndarray) -> None:
        begins = np.flatnonzero(head)
        length = np.diff(np.append(begins, len(head)))
        order = np.argsort(-length, kind="stable")
        begins, longest = begins[order], int(length.max(initial=0))
        alive = np.searchsorted(-length[order], -np.arange(1, longest + 1), side="right")
        #: places of the words in the order of the steps, and where each step begins
        self.place = np.concatenate([np.zeros(0, np.int64), *(begins[:n] + t for t, n in enumerate(alive.tolist()))])
        self.steps = np.concatenate([[0], np.cumsum(alive)]).tolist()

    def marginals(self, unary: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(state 1) of each word and the expected counts of the four moves between neighbours, words in the order of ``place``.

        unary: score of state 1 over state 0; move[i, j]: score of going from state i to j.
        """
        moves, n = np.zeros((2, 2)), len(unary)
        if not n:
            return np.zeros(0), moves
        emit, m = np.exp(np.clip(unary, -30, 30)), np.exp(move - move.max())
        past = np.empty(n)  # P(state 1) by what came before
        past[: self.steps[1]] = emit[: self.steps[1]] / (1 + emit[: self.steps[1]])
        for t in range(1, len(self.steps) - 1):
            x, y = self.steps[t], self.steps[t + 1]
            before = past[self.steps[t - 1] : self.steps[t - 1] + y - x]
            up = (m[0, 1] + (m[1, 1] - m[0, 1]) * before) * emit[x:y]
            past[x:y] = up / (up + m[0, 0] + (m[1, 0] - m[0, 0]) * before)
        odds = np.ones(n)  # of what comes after, state 1 over state 0
        for t in range(len(self.steps) - 2, 0, -1):
            x, y, z = self.steps[t], self.steps[t + 1], self.steps[t - 1]
            b = emit[x:y] * odds[x:y]
            one = past[z : z + y - x]
            from0, from1 = m[0, 0] + m[0, 1] * b, m[1, 0] + m[1, 1] * b
            total = (1 - one) * from0 + one * from1
            share0, share1 = (1 - one) / total, one / total
            moves += [[m[0, 0] * share0.sum(), m[0, 1] * (share0 @ b)], [m[1, 0] * share1.sum(), m[1, 1] * (share1 @ b)]]
            odds[z : z + y - x] = from1 / from0
        up = past * odds
        return up / (1 - past + up), moves


def marginals(unary: np.ndarray, head: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Chains.marginals`` for words in the order of the text."""
    chains, p = Chains(head), np.empty(len(unary))
    p[chains.place], moves = chains.marginals(unary[chains.place], move)
    return p, moves


def document_features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text: log odds of its largest marginal, log(1 + sum of its marginals), log of their share, and 1."""
    n = len(bounds) - 1
    top = np.zeros(n)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        top[full] = np.maximum.reduceat(p, bounds[:-1][full])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    total = span_sums(p, bounds)
    return np.stack([np.log(top / (1 - top)), np.log1p(total), np.log((total + 0.05) / (np.diff(bounds) + 10)), np.ones(n)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression of few columns, by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
    return w


def _fit(epochs: int, rate: float, least_docs: int, least_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, heads, docs, y, n = [], [], [], [], 0
        for b in batches:
            y.append(b.column("label").to_numpy(zero_copy_only=False).astype(np.float64))
            for first, _last, data, offsets in chunks(b.column("text")):
                _s, _e, h, bounds, head = tokens(data, offsets)
                hs.append(h)
                heads.append(head)
                docs.append(owner(bounds) + n + first)
            n += b.num_rows
        if not n:
            return
        h, head, doc, y = map(np.concatenate, (hs, heads, docs, y))
        label, n_toxic, n_clean = np.zeros(len(doc), bool), max(1.0, y.sum()), max(1.0, (1 - y).sum())
        for unit in h.T:
            kinds, at = np.unique(unit, return_inverse=True)
            pair = np.unique(doc * (len(kinds) + 1) + at)
            marked, which = y[pair // (len(kinds) + 1)] > 0, pair % (len(kinds) + 1)
            toxic, clean = (np.bincount(which[k], minlength=len(kinds)) for k in (marked, ~marked))
            share = (toxic / n_toxic) / (toxic / n_toxic + clean / n_clean + 1e-12)
            label |= ((toxic >= least_docs) & (share >= least_share))[at]
        label = (label & (y[doc] > 0)).astype(np.float64)
        chains = Chains(head)
        place, code = chains.place, chain_features(h, head)
        w, move, bias = np.zeros(1 << BITS), np.zeros((2, 2)), -4.0
        gw, gm, gb = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8), 1e-8
        step = ~head
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[:-1][step[1:]].astype(int), label[1:][step[1:]].astype(int)), 1)
        count = max(1.0, label.sum())
        columns, wanted = [np.ascontiguousarray(c[place]) for c in code.T], label[place]
        for _ in range(epochs):
            p, moves = chains.marginals(sum(w[c] for c in columns) + bias, move)
            err = (p - wanted) / count
            g = sum(np.bincount(c, err, minlength=1 << BITS) for c in columns) + 1e-6 * w
            gw += g * g
            w -= rate * g / np.sqrt(gw)
            d = (moves - seen) / count + 1e-3 * move
            gm += d * d
            move -= rate * d / np.sqrt(gm)
            e = err.sum()
            gb += e * e
            bias -= rate * e / np.sqrt(gb)
        w = w.astype(np.float32)
        p, _ = marginals(w[code].sum(axis=1) + bias, head, move)
        x = document_features(p, np.searchsorted(doc, np.arange(n + 1)))
        top = logistic(x, y)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.tobytes()], pa.binary()), pa.array([move.ravel().tolist()]), pa.array([float(bias)]), pa.array([top.tolist()])],
            names=["weights", "move", "bias", "top"],
        )

    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = 4000, epochs: int = 30, rate: float = 0.5, least_docs: int = 5, least_share: float = 0.85,
) -> dict | None:
    """Fit on ``max_rows`` labelled ids at most, one row each (those of the smallest hashes); None when none has a label and a text.

    ``least_docs`` and ``least_share`` say which words of toxic documents count as toxic tokens: in how many of them
    at least, and what part of the word's (class-balanced) documents must be toxic.
    """
    marked = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    chosen = bounded_sample(marked, "doc_id", max_rows).withColumnRenamed("doc_id", "labelled_id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("labelled_id"))
    rows = one_of_each(rows.where(F.col("text").isNotNull()).select("id", "text", "label"), "id").select("text", "label")
    found = (
        rows.repartition(1).sortWithinPartitions("label", F.xxhash64("text"))
        .mapInArrow(_fit(epochs, rate, least_docs, least_share), "weights binary, move array<double>, bias double, top array<double>").collect()
    )
    if not found:
        return None
    r = found[0]
    return {
        "weights": np.frombuffer(r["weights"], np.float32), "move": np.array(r["move"]).reshape(2, 2), "bias": r["bias"], "top": np.array(r["top"]),
    }


def score_toxicity(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and spans (start and end in code points) for every row.

    Whole texts are read. A null or empty text has no marginal, hence the lowest score and no span; without a model
    every score is 0. A null id stays null, repeated rows each get their row, extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit, score, found = shared.value, np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            for first, last, data, offsets in chunks(b.column(1)) if fit else ():
                s, e, h, bounds, head = tokens(data, offsets)
                p, _ = marginals(fit["weights"][chain_features(h, head)].sum(axis=1) + fit["bias"], head, fit["move"])
                z = (document_features(p, bounds) * fit["top"]).sum(axis=1)  # row by row: no bit depends on the batch
                score[first:last] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    who = owner(bounds)[hit]
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    new = np.ones(len(hit), dtype=bool)
                    new[1:] = (np.diff(hit) > 1) | (np.diff(who) > 0) | head[hit[1:]]
                    begin = np.flatnonzero(new)
                    stop = np.concatenate([begin[1:], [len(hit)]]) - 1
                    base = points[offsets[:-1][who[begin]]]
                    for r, x, y in zip(who[begin].tolist(), (points[s[hit[begin]]] - base).tolist(), (points[e[hit[stop]]] - base).tolist(), strict=True):
                        found[first + r].append({"start": x, "end": y})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(found, pa.list_(span))], names=["doc_id", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")
