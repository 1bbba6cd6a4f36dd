"""Spelling variants by permuterm rotations: words that differ by one inserted, deleted or replaced code point.

A word is marked with a terminator and rotated so that each of its code points comes last once. Rotations that agree
up to that last code point belong to words that differ there by a replacement; the whole rotation of a shorter word,
which heads the same range, differs from them by an insertion. Rotations are dealt out by what comes before the skipped
code point and sorted; a scan reads group after group and emits, for each word in it, how many neighbours the group
holds and which is the most frequent, so no group is turned into pairs. A group has one row at most for each code
point of the alphabet and one for the shorter word, however the data are skewed.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .textbatch import chunks, lower_ascii

#: Words of more code points are compared by hashes of their rotations, since the rotations' text grows with the square.
LONG_WORD = 256
#: Modulus and base of those hashes.
_PRIME, _BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F % ((1 << 127) - 1)

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _x = _i
    for _ in range(8):
        _x = (_x >> 1) ^ (0xEDB88320 if _x & 1 else 0)
    _CRC[_i] = _x

#: Bytes of a run beyond which its checksum is taken alone.
_SPAN = 48


def span_crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span [start, end) that continues the checksum ``before`` of what stands in front of it."""
    state, size = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), end - start
    for at in range(min(_SPAN, int(size.max(initial=0)))):
        live = np.flatnonzero((size > at) & (size <= _SPAN))
        now = state[live]
        state[live] = _CRC[(now ^ data[start[live] + at]) & np.uint32(255)] ^ (now >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _SPAN).tolist():
        state[i] = zlib.crc32(data[start[i] : end[i]], int(before[i]))
    return state


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` in texts of UTF-8 bytes that lie end to end."""
    wide = data == 0xC3  # the lead byte of U+00C0 to U+00FF, and of no other code point
    inside = ((data | 32) >= 97) & ((data | 32) <= 122) | wide
    inside[1:] |= wide[:-1]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True  # runs end where texts end
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edges[1:-1]
    end[:-1] &= ~inside[1:] | edges[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _counted(least_length: int, drop_every: int):
    """Words of each batch and how often they stand there; one code point goes where ``drop_every`` divides the checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [str(i) if i is not None else "" for i in b.column(0).to_pylist()]
            for first, _last, raw, offsets in chunks(b.column(1), 1 << 22):
                data = lower_ascii(raw)
                start, end = letter_runs(data, offsets)
                tails = np.concatenate([[0], np.cumsum(data == 0xC3)])  # bytes of two-byte code points count once
                size = end - start - (tails[end] - tails[start])
                long = size >= least_length
                start, end, size = start[long], end[long], size[long]
                if not len(start):
                    continue
                kept, dropped = np.ones(len(start), bool), []
                if drop_every:
                    its = np.searchsorted(offsets, start, side="right") - 1
                    heads = np.zeros(len(offsets) - 1, np.uint32)
                    for t in np.unique(its).tolist():
                        heads[t] = zlib.crc32(f"{names[first + t]}:".encode())
                    check = span_crc32(data, start, end, heads[its])
                    for i in np.flatnonzero(check % np.uint32(drop_every) == 0).tolist():
                        kept[i], word = False, data[start[i] : end[i]].tobytes().decode()
                        at = int(check[i]) % len(word)
                        if len(word) > least_length:
                            dropped.append(word[:at] + word[at + 1 :])
                ends = np.cumsum((end - start)[kept])
                marks = np.zeros(len(data) + 1, np.int8)
                marks[start[kept]] += 1
                marks[end[kept]] -= 1
                body = data[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]
                words = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(body))
                counts = pa.concat_arrays([words, pa.array(dropped, pa.large_string())]).value_counts()
                yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])

    return run


def count_words(
    docs: DataFrame, least_length: int = 6, least_count: int = 5, drop_every: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The distinct words of all texts and how often they stand there: word, n.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A to Z in lower case, of ``least_length`` code points or more;
    those of ``least_count`` occurrences or more are given. ``drop_every`` (0: never) plants misspellings: where it
    divides the crc32 of ``<id>:<word>``, the code point at that checksum modulo the length is left out of this occurrence.
    Nulls: a null text has no words, a null id counts as an empty one. Repeated rows count each. Extra columns are not
    read. An empty table has no words.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    words = rows.mapInArrow(_counted(least_length, drop_every), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word's rotations: up to the skipped code point (``skipped``), and whole (``skipped`` is empty).

    ``first`` tells whether the skipped code point begins a run of equal ones: leaving out any of a run gives the same
    shorter word, which is met once. Long words are named by their digest.
    """
    kinds = {"prefix": pa.string(), "skipped": pa.string(), "first": pa.bool_(), "word": pa.string(), "n": pa.int64()}
    for b in batches:
        out: dict[str, list] = {k: [] for k in kinds}

        def give(whole: bool, prefixes: list[str], word: str, name: str, n: int, out: dict[str, list] = out) -> None:
            out["prefix"] += prefixes
            out["skipped"] += [""] * len(prefixes) if whole else list(word)
            out["first"] += [True] * len(prefixes) if whole else [i == 0 or word[i - 1] != c for i, c in enumerate(word)]
            out["word"] += [name] * len(prefixes)
            out["n"] += [n] * len(prefixes)

        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            size, twice = len(word), f"{word}${word}"
            name, held = word if size <= LONG_WORD else long_name(word), None
            for whole in (True, False):
                wide, places = size + whole, range(1 - whole, size + 1)
                if wide <= LONG_WORD:
                    give(whole, [twice[i : i + wide] for i in places], word, name, n)
                    continue
                held = held or _heads(twice)
                power = pow(_BASE, wide, _PRIME)
                give(whole, [f"#{wide}:{(held[i + wide] - held[i] * power) % _PRIME:x}" for i in places], word, name, n)
            if len(out["n"]) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))
                for rows in out.values():
                    rows.clear()
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))


def long_name(word: str) -> str:
    return "#" + hashlib.sha256(word.encode()).hexdigest()


def _heads(text: str) -> list[int]:
    """Hashes of all beginnings of a text, from which those of its parts follow."""
    held = [0]
    for c in text:
        held.append((held[-1] * _BASE + ord(c)) % _PRIME)
    return held


def neighbours_in(group: list[tuple[int, str, str, bool]]) -> Iterator[tuple[str, int, int, str]]:
    """For each word of a group (-n, word, skipped, first): word, neighbours, n and name of the most frequent one.

    Names that stand for long words can't be put in order: where a group has one, all of the largest n are given.
    """
    group = sorted(group)
    whole = [g for g in group if not g[2]]
    skips = [g for g in group if g[2]]
    firsts = [g for g in skips if g[3]]
    named = any(g[1].startswith("#") for g in group)
    for g in group:
        near = whole if g[2] and g[3] else []
        peers, n_peers = (skips, len(skips) - 1) if g[2] else (firsts, len(firsts))
        best = sorted([x for x in (peers if named else peers[:2]) if x is not g] + near)
        for k, x in enumerate(x for x in best[: None if named else 1] if x[0] == best[0][0]):
            yield g[1], 0 if k else n_peers + len(near), -x[0], x[1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted rotations group by group; a group that the end of a batch cuts is carried over."""
    held: pa.Table | None = None

    def found(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        prefix, out = rows.column("prefix"), []
        same = pc.equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False) if len(prefix) > 1 else np.zeros(0, bool)
        ends = np.concatenate([np.flatnonzero(~same) + 1, [len(prefix)]]) if len(prefix) else np.zeros(0, int)
        sizes = np.diff(ends, prepend=0)
        many = np.repeat(sizes > 1, sizes)
        rows = rows.filter(pa.array(many)) if len(prefix) else rows
        members = list(
            zip(pc.negate(rows.column("n")).to_pylist(), *(rows.column(c).to_pylist() for c in ("word", "skipped", "first")), strict=True)
        )
        at = 0
        for size in sizes[sizes > 1].tolist():
            out += neighbours_in(members[at : at + size])
            at += size
        cols = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])

    for b in batches:
        rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if not len(rows):
            continue
        prefix = rows.column("prefix")
        last = pc.index(pc.equal(prefix, prefix[len(prefix) - 1]), True).as_py()  # equal prefixes are neighbours
        if last:
            yield found(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None:
        yield found(held)


def variant_groups(words: DataFrame, factor: int = 5) -> DataFrame:
    """Tie each distinct word to its most frequent near word where that one is ``factor`` times as frequent or more.

    ``words`` has word and n, a row for each distinct word. Two words are near if one inserted, deleted or replaced code
    point makes one of the other. Returns word, form (the near word of the largest n, of equal ones the first in code
    point order, if that n is at least ``factor`` times the word's; else null), root (what following forms ends at; the
    word itself without a form), n, n_near, form_n.
    Nulls: a null word, and one that is empty, is left out. A word with "$" or "#" raises. Extra columns are not read.
    An empty table gives no rows. Rounds that follow forms double their reach and number log2(log_factor(largest n)).
    """
    wrong = F.when(F.col("word").rlike("[$#]"), F.raise_error(F.lit("a word holds a sign that marks rotations")).cast("string")).otherwise(F.col("word"))
    words = stage(words.where("word is not null and word <> ''").select(wrong.alias("word"), F.col("n").cast("long")), "words")
    sorted_rotations = words.mapInArrow(_rotations, "prefix string, skipped string, first boolean, word string, n long").repartition("prefix").sortWithinPartitions("prefix")
    found = stage(sorted_rotations.mapInArrow(_scan, "word string, n_near long, best_n long, best string"), "found")
    longs = words.where(F.length("word") > LONG_WORD).select(F.concat(F.lit("#"), F.sha2("word", 256)).alias("name"), F.col("word").alias("full"))
    odd = found.where("word like '#%' or best like '#%'")
    for col in ("word", "best"):
        odd = odd.join(longs, odd[col] == F.col("name"), "left").withColumn(col, F.coalesce("full", col)).drop("name", "full")
    near = (
        found.where("word not like '#%' and best not like '#%'").unionByName(odd)
        .groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top"))
    )
    held = F.col("top.n") * -1 >= F.col("n") * factor
    tied = stage(
        words.join(near, "word", "left").select(
            "word", F.when(held, F.col("top.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(held, F.col("top.n") * -1).alias("form_n"),
        ),
        "forms",
    )
    most = words.agg(F.max("n")).first()[0] or 1
    steps = math.floor(math.log(max(1, most), factor)) + 1 if factor > 1 else 1
    roots = tied.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stage(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return tied.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
