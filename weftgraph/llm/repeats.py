"""Suffix-array dedup with a run-length index: bytes covered by long strings that start twice or more.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else too. The work is dealt out by
content, so that each task indexes a bounded text in which every match it must find is present:

* Anchors. Of each window of ``length`` bytes the smallest hashed k-gram is its anchor; equal windows have equal
  anchors at equal places. Neighbouring windows of one anchor make a context, and each window is in exactly one.
  A context whose anchor occurs once in the corpus cannot match and is left out; of the others each distinct one
  is read once, with the number of times it occurs.
* Index. All contexts of an anchor go to one task. The task sorts their suffixes, writes the Burrows-Wheeler
  transform as runs (copies of a context lengthen runs and add none) with match lengths sampled at run ends, and drops
  text and suffix array. Matching statistics stream out of the runs: all strings are read backwards in lock step by
  stepping from a row to the row of the byte before, where a match grows by one inside a run and is the sample at its end.
  Matches of ``length`` or more are marked, and marks go back to all places where their context occurs.
* Crowds. An anchor with more than ``CROWD`` distinct contexts is split by longer anchors, at last by whole windows,
  of which each has one context. No task holds a crowd.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..staging import stage
from .keyfilter import with_may
from .textbatch import chunks, eights, gram_hash, mix

#: Distinct contexts of one anchor that a task indexes; bytes of an index, and of a string of contexts that follow one another.
CROWD, INDEX_BYTES, STRETCH = 1024, 1 << 19, 1024

#: Lengths of anchors in 200ths of a window: first of all windows, then of crowds, at last whole windows.
ANCHORS = (48, 152, 188, 200)


def anchored(data: np.ndarray, offsets: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, context hash, text number, start and end (in the chunk) of every context of a chunk's texts."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if not len(data) or sizes.max(initial=0) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    w = length - k + 1
    h = gram_hash(data, k)
    bits = np.uint64(max(21, int(len(data)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = h & ~low
    least |= np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if w > span:
        least = np.minimum(least[: span - w], least[w - span :])
    least &= low  # of each window of the chunk, where its anchor begins
    stops = np.maximum(offsets[:-1], offsets[1:] - length + 1)  # where a text's windows end
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, offsets[:-1], stops, [len(least)]]))
    s, last = cuts[:-1], cuts[1:] - 1
    text = np.searchsorted(offsets, s, side="right") - 1
    use = np.flatnonzero((s < len(least)) & (s < stops[np.minimum(text, len(stops) - 1)]))
    s, e, text = s[use], last[use] + length, text[use]
    at = least[s].astype(np.int64)
    raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    context = np.fromiter((digest(raw[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(s))
    return h[at], context + mix((at - s).astype(np.uint64) + np.uint64(5)), text, s, e


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of some strings, each there once or (``times`` over 1) twice.

    Kept are, for each run: its symbol, its first row and length, the row of the byte before its first row (as a run
    and a place in it), and two sampled matches: of the byte before its first row with the row above that, and of the
    byte before its last row with the row below. Neither text nor suffix array stays.
    """

    def __init__(self, strings: list[np.ndarray], times: list[int]) -> None:
        self.size, times = np.array([len(x) for x in strings], np.int64), np.minimum(times, 2)
        starts = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]
        n = int(self.size.sum()) + len(strings)
        # 0 parts strings; a zero byte of a string becomes one that UTF-8 doesn't have
        text = np.zeros(n, np.uint8)
        for at, x in zip(starts.tolist(), strings, strict=True):
            text[at : at + len(x)] = x
        np.copyto(text, np.uint8(0xF8), where=text == 0)
        text[starts + self.size] = 0
        stop = np.repeat((starts + self.size).astype(np.int32), self.size + 1)  # of each byte's string
        at8 = eights(text)
        order, rank = self._suffixes(at8, stop, n)
        before = text[order - 1]  # of the first suffix the last byte, a separator
        head = np.ones(n, bool)
        np.not_equal(before[1:], before[:-1], out=head[1:])
        head |= before == 0
        first = np.flatnonzero(head)
        last = np.concatenate([first[1:], [n]]) - 1
        self.symbols = before[first]
        self.lengths = np.add.reduceat(np.repeat(times, self.size + 1)[order], first)
        self.begins = np.cumsum(self.lengths) - self.lengths
        # the row of the byte before a run's first row: all rows that begin with smaller symbols, then earlier runs of this one
        by_symbol = np.argsort(self.symbols, kind="stable")
        to = np.empty(len(first), np.int64)
        to[by_symbol] = np.cumsum(self.lengths[by_symbol]) - self.lengths[by_symbol]
        to_run = np.searchsorted(self.begins, to, side="right") - 1
        inner = self.symbols != 0
        up, down = rank[np.where(inner, order[first] - 1, 0)], rank[np.where(inner, order[last] - 1, 0)]
        #: columns: length, match above, match below, run and place of the byte before
        self.runs = np.zeros((len(first), 5), np.int32)
        self.runs[:, 0], self.runs[:, 3], self.runs[:, 4] = self.lengths, to_run, to - self.begins[to_run]
        use = np.flatnonzero(inner & (up > 0))
        self.runs[use, 1] = _common(at8, stop, order[up[use]], order[up[use] - 1])
        use = np.flatnonzero(inner & (down < n - 1))
        self.runs[use, 2] = _common(at8, stop, order[down[use]], order[down[use] + 1])
        ends = np.cumsum(times) - times  # the row of each string's (first copy's) end
        self.end_run = np.searchsorted(self.begins, ends, side="right") - 1
        self.end_off = ends - self.begins[self.end_run]

    @staticmethod
    def _suffixes(at8: np.ndarray, stop: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order and each one's rank; separators are smaller than all bytes and ordered by place."""
        left = np.minimum(stop - np.arange(n, dtype=np.int32), 8)
        word = at8[:n].byteswap()
        word &= np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(9)], np.uint64)[left]
        order = np.argsort(word)
        word = word[order]
        same = np.zeros(n + 1, bool)
        np.equal(word[1:], word[:-1], out=same[1:-1])
        order, rank = order.astype(np.int32), np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(same[:-1], np.int32(0), np.arange(n, dtype=np.int32)))
        group = np.flatnonzero(same[:-1] | same[1:]).astype(np.int32)  # places in the order that are not settled
        rows, width = order[group], 0
        while len(group):
            # first those that end within eight bytes, by place; then all others by what follows
            further = rank[np.minimum(rows + width, n - 1)] if width else np.where(left[rows] < 8, rows, 0)
            key = rank[rows].astype(np.int64) << 32 | further
            again = np.argsort(key)
            rows, key = rows[again], key[again]
            order[group] = rows
            same = np.zeros(len(group) + 1, bool)
            np.equal(key[1:], key[:-1], out=same[1:-1])
            rank[rows] = np.maximum.accumulate(np.where(same[:-1], np.int32(0), group))
            still = same[:-1] | same[1:]
            group, rows, width = group[still], rows[still], 2 * width or 8
        return order, rank

    def long_matches(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String number, start and end of each maximal stretch that matches of ``least`` bytes or more cover."""
        none = np.iinfo(np.int64).max
        low, high, out = np.full(len(self.size), none), np.zeros(len(self.size), np.int64), []
        for which, at, held in self.matching_statistics(least):
            # read backwards, ends never rise: a match loses a byte a step at most
            end, before = at + held, low[which]
            new = end < before
            done = which[new & (before < none)]
            out.append((done, low[done], high[done]))
            high[which[new]] = end[new]
            low[which] = at
        left = np.flatnonzero(low < none)
        out.append((left, low[left], high[left]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def matching_statistics(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """String number, place, and how long a string that starts there also starts elsewhere, where ``least`` or more.

        The places of a string come last to first.
        """
        todo = np.argsort(-self.size, kind="stable")
        size, run, off = self.size[todo], self.end_run[todo], self.end_off[todo].astype(np.int32)
        up, down = np.zeros(len(todo), np.int32), np.zeros(len(todo), np.int32)
        length = np.ascontiguousarray(self.runs[:, 0])
        alive = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # strings that have a byte left
        for step, n in enumerate(alive.tolist()):
            run, off, up, down = run[:n], off[:n], up[:n] + 1, down[:n] + 1
            now = self.runs.take(run, axis=0)
            np.copyto(up, now[:, 1], where=off == 0)
            np.copyto(down, now[:, 2], where=off + 1 == now[:, 0])
            run, off = now[:, 3], off + now[:, 4]
            over = np.flatnonzero(off >= length[run])
            if len(over):  # a run's rows go to one run or to several that follow one another
                run = run.copy()
                place = self.begins[run[over]] + off[over]
                run[over] = np.searchsorted(self.begins, place, side="right") - 1
                off[over] = place - self.begins[run[over]]
            held = np.maximum(up, down)
            hit = np.flatnonzero(held >= least)
            if len(hit):
                yield todo[hit], size[hit] - step - 1, held[hit]


def _common(at8: np.ndarray, stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common, within their strings."""
    room = np.minimum(stop[a] - a, stop[b] - b)
    out, live = room.copy(), np.flatnonzero(room > 0)
    at = 0
    while len(live):
        apart = at8[a[live] + at] ^ at8[b[live] + at]
        same = apart == 0
        here = live[~same]
        lowest = apart[~same] & (~apart[~same] + np.uint64(1))
        out[here] = np.minimum(room[here], at + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
        at += 8
        live = live[same]
        live = live[room[live] > at]
    return out


def _contexts(k: int, length: int):
    """Contexts of whole texts: rows (text key, text) -> anchor, context, key, start, end, times.

    A text that a batch has several times is read once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, once, times = np.unique(b.column(0).to_numpy(), return_index=True, return_counts=True)
            for first, _last, data, offsets in chunks(b.column(1).take(pa.array(once))):
                a, c, text, s, e = anchored(data, offsets, k, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(key[first + text]), pa.array((s - offsets[text]).astype(np.int64)), pa.array((e - offsets[text]).astype(np.int64)), pa.array(times[first + text])],
                    names=["anchor", "context", "key", "s", "e", "times"],
                )

    return run


def _finer(k: int, length: int):
    """Contexts of contexts, with their bytes; the outer one's anchor and hash are ``of`` and ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x, np.uint8) for x in b.column("bytes").to_pylist()]
            of, key, times = (b.column(c).to_numpy() for c in ("anchor", "context", "times"))
            for i in range(0, len(parts), 1024):
                some = parts[i : i + 1024]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])])
                data = np.concatenate(some)
                a, c, text, s, e = anchored(data, offsets, k, length)
                whole = [data[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(of[i + text]), pa.array(key[i + text]), pa.array(s - offsets[text]), pa.array(e - offsets[text]), pa.array(times[i + text]), pa.array(whole, pa.binary())],
                    names=["anchor", "context", "of", "key", "s", "e", "times", "bytes"],
                )

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of an index, from rows that carry a text and the spans of its contexts.

    A context whose anchor stands in no other context matches its own copies alone. Such contexts that follow one another
    in a text overlap by all but a few bytes, so they are read as one string of about ``STRETCH`` bytes;
    ``inner`` has anchor, context, start and end of each. Any other context is a string of its own, and ``inner`` is null.
    """
    for b in batches:
        rows: list[tuple] = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            raw = text.encode()
            rows += [(x["anchor"], x["context"], x["times"], raw[x["s"] : x["e"]], None) for x in spans if x["several"]]
            held: list[dict] = []
            for x in [*sorted((x for x in spans if not x["several"]), key=lambda x: x["s"]), None]:
                if held and (x is None or x["s"] > held[-1]["e"] or x["e"] - held[0]["s"] > STRETCH):
                    at = held[0]["s"]
                    inner = np.array([(y["anchor"], y["context"], y["s"] - at, y["e"] - at) for y in held], np.int64)
                    rows.append((held[0]["anchor"], held[0]["context"], min(y["times"] for y in held), raw[at : held[-1]["e"]], inner.tobytes()))
                    held = []
                held.append(x)
        cols = list(zip(*rows, strict=True)) or [()] * 5
        arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(),) * 3 + (pa.binary(),) * 2, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "context", "times", "bytes", "inner"])


def _indexed(length: int):
    """Marks in the contexts of whole anchors; rows come sorted by anchor, an index ends where an anchor does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            anchor, context, times, strings, inner = zip(*held, strict=True)
            which, s, e = RunIndex(list(strings), list(times)).long_matches(length)
            single = np.array([x is None for x in inner])[which]
            out = [np.stack([np.array(anchor)[which[single]], np.array(context)[which[single]], s[single], e[single]], axis=1)]
            for i, x, y in zip(which[~single].tolist(), s[~single].tolist(), e[~single].tolist(), strict=True):
                part = np.frombuffer(inner[i], np.int64).reshape(-1, 4)
                low, high = np.maximum(part[:, 2], x), np.minimum(part[:, 3], y)
                hit = low < high
                out.append(np.stack([part[hit, 0], part[hit, 1], (low - part[:, 2])[hit], (high - part[:, 2])[hit]], axis=1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out).T.copy()], names=["anchor", "context", "s", "e"])

        for b in batches:
            for anchor, context, times, raw, inner in zip(*(b.column(k).to_pylist() for k in ("anchor", "context", "times", "bytes", "inner")), strict=True):
                if size >= INDEX_BYTES and anchor != last:
                    yield flush()
                    held, size = [], 0
                held.append((anchor, context, times, np.frombuffer(raw, np.uint8), inner))
                size, last = size + len(raw) + 1, anchor
        if held:
            yield flush()

    return run


def _spread(places: DataFrame, marks: DataFrame, *own: str) -> DataFrame:
    """Marks of contexts at all places where these occur."""
    at = F.col("p.s")
    return (
        places.alias("p").join(marks.alias("m"), ["anchor", "context"])
        .select(*own, (at + F.col("m.s")).alias("s"), (at + F.col("m.e")).alias("e")).distinct()
    )


def _marks(held: DataFrame, finer: tuple[int, ...], length: int) -> DataFrame:
    """Marks (anchor, context, s, e) in distinct contexts (anchor, context, times, bytes, inner)."""
    calm = held
    if finer:
        crowded = stage(held.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("anchor"), "crowded")
        calm = held.join(crowded, "anchor", "left_anti")
    marks = (
        calm.repartition("anchor")
        .sortWithinPartitions("anchor", "context")
        .mapInArrow(_indexed(length), "anchor long, context long, s long, e long")
    )
    if not finer or not crowded.take(1):
        return marks
    kind = "anchor long, context long, of long, key long, s long, e long, times long, bytes binary"
    parts = stage(held.join(crowded, "anchor").mapInArrow(_finer(finer[0], length), kind), "finer")
    twice = stage(parts.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "twice")
    places = parts.join(twice.hint("shuffle_hash"), "anchor")
    each = stage(
        places.groupBy("anchor", "context").agg(
            F.sum("times").alias("times"), F.first("bytes").alias("bytes"), F.lit(None).cast("binary").alias("inner"),
        ),
        "contexts",
    )
    inner = _spread(places.select("anchor", "context", "of", "key", "s"), _marks(each, finer[1:], length), "of", "key")
    return marks.unionByName(inner.select(F.col("of").alias("anchor"), F.col("key").alias("context"), "s", "e"))


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """Spans (key, s, e) that repeated strings cover, for rows (key, text); rows with one key have one text.

    Every row counts as a document of its own. The spans of a key may overlap one another.
    """
    if length < 8:
        raise ValueError("strings of fewer than 8 bytes can't be told apart by anchors")
    first, *finer = (max(8, length * x // 200) for x in ANCHORS)
    long = texts.where(F.octet_length("text") >= length)
    found = stage(long.mapInArrow(_contexts(first, length), "anchor long, context long, key long, s long, e long, times long"), "found")
    # written first: a join right above an aggregation could not be split where an anchor is frequent
    twice = found.groupBy("anchor").agg(F.sum("times").alias("n"), (F.min("context") != F.max("context")).alias("several")).where("n > 1")
    twice = stage(twice.select("anchor", "several"), "twice")
    may = with_may(found, twice.select(F.col("anchor").alias("key")), "anchor").where("may").drop("may")
    places = stage(may.join(twice.hint("shuffle_hash"), "anchor"), "places")
    each = stage(
        (
            places.groupBy("anchor", "context")
            .agg(F.sum("times").alias("times"), F.min(F.struct("key", "s", "e", "several")).alias("at"))
            .select("anchor", "context", "times", "at.*")
        ),
        "contexts",
    )
    wanted = each.groupBy("key").agg(F.collect_list(F.struct("anchor", "context", "times", "s", "e", "several")).alias("spans"))
    one = with_may(long, each.select("key")).where("may").select("key", "text").dropDuplicates(["key"])
    held = stage(one.join(wanted, "key").mapInArrow(_cut_out, "anchor long, context long, times long, bytes binary, inner binary"), "held")
    return _spread(places, _marks(held, tuple(finer), length), "key")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its spans."""
    for b in batches:
        removed, runs, kept, said = [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            change = np.zeros(len(raw) + 1, np.int64)
            for x in spans or ():
                change[x["s"]] += 1
                change[x["e"]] -= 1
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0)
            kept.append(raw[~gone].tobytes())
            said.append(kept[-1].decode(errors="ignore"))
        columns = [
            b.column("row"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array(said, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n_removed", "n_spans", "kept", "kept_text"])


def cut_repeats(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """All rows with n_bytes, n_removed, n_spans, kept (the bytes that are left) and kept_text.

    kept_text is kept without the bytes of characters that a cut has broken.

    Every row is a document of its own, repeated rows included, so a text of ``length`` bytes or more that two rows hold goes
    altogether. Nulls: a null text is an empty one, with nothing to remove; other columns may hold anything. Columns
    of ``docs`` that have one of the new names are replaced. An empty table gives no rows. Texts are known by 64-bit keys.
    """
    own = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept", "kept_text")]
    row, key = F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.xxhash64(F.col(text_col))
    texts = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    spans = stage(repeated_spans(texts, length), "spans")
    flagged = with_may(docs.select(row, key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), spans.select("key"))
    none = F.lit(0).cast("long")
    clean = flagged.where("not may").select(
        "row", none.alias("n_removed"), none.alias("n_spans"), F.encode("text", "UTF-8").alias("kept"), F.col("text").alias("kept_text"),
    )
    by_text = spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    struck = flagged.where("may").join(by_text, "key", "left").select("row", "text", "spans")
    kind = StructType(
        [
            struck.schema["row"],
            *(
                StructField(k, t) for k, t in (("n_removed", LongType()), ("n_spans", LongType()), ("kept", BinaryType()), ("kept_text", StringType()))
            ),
        ],
    )
    done = clean.unionByName(struck.mapInArrow(_apply, kind))
    return done.select(
        "row.*", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept", "kept_text",
    )
