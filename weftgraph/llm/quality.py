"""Quality rules: counts over whole texts, and a calibrated logistic regression on hashed n-grams.

The classifier sees hashed words, word pairs and runs of three and four characters (code points). A text's value for a feature is
its share among the text's features of that kind, so a score is a mean of weights: one gather and one sum over the
batch's text. Fitting takes a bounded sample of labelled rows in one task; the weights (1 MB) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import bounded_sample, one_of_each
from .textbatch import SPACE, chunks, grouped_sum, mix, owner, span_hash, span_sums, words

#: Hash bits of each kind of feature; the kinds are word, word pair, 3 characters, 4 characters.
BITS, KINDS = 16, 4

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind the hashed features of a chunk's texts in order, and the bounds of each text's features."""
    s, e, bounds = words(data, offsets)
    h = span_hash(data, s, e)
    shift = np.uint64(64 - BITS)
    out = [((h >> shift).astype(np.int64), bounds)]
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    whole = np.ones(len(pair), dtype=bool)
    inner = bounds[1:-1]
    whole[inner[(inner > 0) & (inner < len(h))] - 1] = False
    at = np.flatnonzero(whole)
    out.append(((pair[at] >> shift).astype(np.int64) + (1 << BITS), np.searchsorted(at, bounds)))
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # the texts' bounds in code points
    for kind, n in ((2, 3), (3, 4)):
        m = max(0, len(points) - n + 1)
        key = np.zeros(m, np.uint64)
        for k in range(n):
            key = (key ^ points[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        code = ((key * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64) + (kind << BITS)
        starts = np.minimum(at[:-1], m)
        ends = np.clip(at[1:] - n + 1, starts, m)
        keep = np.zeros(m + 1, np.int64)
        np.add.at(keep, starts, 1)
        np.add.at(keep, ends, -1)
        use = np.flatnonzero(np.cumsum(keep[:-1]) > 0) if m else np.zeros(0, np.int64)
        out.append((code[use], np.concatenate([np.searchsorted(use, starts), [len(use)]])))
    return out


def raw_scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The linear part of the model for each text: bias plus, for each kind, the mean weight of its features."""
    out = np.full(len(column), float(weights[-1]))
    for first, last, data, offsets in chunks(column):
        for code, bounds in features(data, offsets):
            out[first:last] += span_sums(weights[code], bounds) / np.maximum(1, np.diff(bounds))
    return out


def _fit(epochs: int, rate: float, decay: float):
    """Fit on all rows of the one task: weights by Adam on three quarters, Platt's scaling on the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = KINDS << BITS
        code, value, row, y, lot, n = [], [], [], [], [], 0
        for b in batches:
            y.append(b.column("label").to_numpy(zero_copy_only=False).astype(np.float64))
            lot.append(b.column("lot").to_numpy(zero_copy_only=False))
            for first, _last, data, offsets in chunks(b.column("text")):
                for c, bounds in features(data, offsets):
                    who = owner(bounds)
                    key, k = np.unique(who * size + c, return_counts=True)
                    who, c = key // size, key % size
                    code.append(c.astype(np.int32))
                    value.append((k / np.diff(bounds)[who]).astype(np.float32))
                    row.append((who + n + first).astype(np.int32))
            n += b.num_rows
        if not n:
            return
        code, value, row, y, lot = map(np.concatenate, (code, value, row, y, lot))
        train = lot > 0 if (lot > 0).any() and (lot == 0).any() else np.ones(n, dtype=bool)
        w, m, v = (np.zeros(size + 1) for _ in range(3))
        base = np.clip(y[train].mean(), 1e-3, 1 - 1e-3)
        w[-1] = np.log(base / (1 - base))
        use = train[row]
        tc, tv, tr = code[use], value[use], row[use]
        for t in range(1, epochs + 1):
            z = np.bincount(tr, tv * w[tc], minlength=n) + w[-1]
            err = np.where(train, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0.0) / train.sum()
            g = np.concatenate([np.bincount(tc, tv * err[tr], minlength=size), [err.sum()]]) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w = w.astype(np.float32)
        z = np.bincount(row, value * w[code], minlength=n) + w[-1]
        part = ~train if not train.all() else train
        a, c = platt(z[part], y[part])
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([a]), pa.array([c])], names=["weights", "slope", "shift"])

    return run


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make a score a probability, with Platt's smoothed targets."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(1e-6, float(z.std()))
    x = np.stack([(z - z.mean()) / scale, np.ones_like(z)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        w -= np.linalg.solve(h, x.T @ (p - t) + 1e-4 * w)
    return float(w[0] / scale), float(w[1] - w[0] * z.mean() / scale)


def fit_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = 2500, epochs: int = 60, rate: float = 0.3, decay: float = 1e-7,
) -> dict | None:
    """Fit on ``max_rows`` labelled ids at most, one row each (those of the smallest hashes); None when none has a label and a text."""
    marked = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    chosen = bounded_sample(marked, "doc_id", max_rows).withColumnRenamed("doc_id", "labelled_id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("labelled_id"))
    rows = one_of_each(rows.where(F.col("text").isNotNull()).select("id", "text", "label"), "id").select(
        "text", "label", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("lot"),
    )
    found = (
        rows.repartition(1)
        .sortWithinPartitions("lot", "label", F.xxhash64("text"))
        .mapInArrow(_fit(epochs, rate, decay), "weights binary, slope double, shift double")
        .collect()
    )
    if not found:
        return None
    return {"weights": np.frombuffer(found[0]["weights"], np.float32), "slope": found[0]["slope"], "shift": found[0]["shift"]}


def counts(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The base counts of each text of a chunk."""
    n = len(offsets) - 1
    s, e, bounds = words(data, offsets)
    point = (data & 0xC0) != 0x80
    out = {
        "n_words": np.diff(bounds),
        "word_chars": grouped_sum((point & ~SPACE[data]).astype(np.int64), offsets),
        "n_symbols": grouped_sum(SYMBOLS[data].astype(np.int64), offsets),
    }
    # lines: parted by \n and by the texts' ends; only those with a word count
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    ends = ends - ((ends > starts) & (data[ends - 1] == 10)) if len(starts) else ends
    text = np.searchsorted(offsets, starts, side="right") - 1
    worded = np.searchsorted(s, ends) > np.searchsorted(s, starts)
    starts, ends, text = starts[worded], ends[worded], text[worded]
    kinds = np.unique(np.stack([text.astype(np.uint64), span_hash(data, starts, ends)], axis=1), axis=0) if len(starts) else np.zeros((0, 2), np.uint64)
    out["n_dup_lines"] = np.bincount(text, minlength=n) - np.bincount(kinds[:, 0].astype(np.int64), minlength=n)
    # words in windows that the text has twice
    h, m = span_hash(data, s, e), len(s) - window + 1
    covered = np.zeros(len(s) + 1, np.int64)
    if m > 0:
        key = np.zeros(m, np.uint64)
        for k in range(window):
            key = mix(key + h[k : k + m] + np.uint64(k))
        who = owner(bounds)
        at = np.flatnonzero(who[:m] == who[window - 1 :])
        tag = mix(key[at]) ^ mix(who[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(tag, kind="stable")
        same = tag[order][1:] == tag[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + window, -1)
    out["n_repeat_words"] = grouped_sum((np.cumsum(covered[:-1]) > 0).astype(np.int64), bounds)
    return out


def judge_quality(
    docs: DataFrame, model: dict | None, threshold: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts, base rules and the classifier's verdict for every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability (of
    quality 1). A text is kept unless a base rule fails it or its probability is below ``threshold``; without a model
    the base rules alone decide and probability is null. Nulls: a null text has no words, so base rules fail it; a
    null id stays null. Repeated rows each get their row; extra columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fit = b.num_rows, shared.value
            got = {k: np.zeros(n, np.int64) for k in names}
            for first, last, data, offsets in chunks(b.column(1)):
                for k, v in counts(data, offsets).items():
                    got[k][first:last] = v
            failed = (got["n_words"] < min_words) | (100 * got["n_repeat_words"] > max_repeat_percent * got["n_words"])
            p = np.full(n, np.nan) if fit is None else 1 / (1 + np.exp(-np.clip(fit["slope"] * raw_scores(b.column(1), fit["weights"]) + fit["shift"], -30, 30)))
            kept = ~failed & ~(p < threshold)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(got[k]) for k in names), pa.array(failed), pa.array(kept), pa.array(p, from_pandas=True)],
                names=["doc_id", *names, "base_failed", "kept", "probability"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{k} long' for k in names)}, base_failed boolean, kept boolean, probability double")
