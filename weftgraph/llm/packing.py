"""Concatenate and cut: token streams laid end to end, cut into fixed windows.

Pass one turns each text into token ids where it lies (no shuffle) and notes, within each task's partition, how
many tokens come before it; the rows are written to the shared folder. The partitions' totals, one row each, give
every partition's global offset. Pass two reads the written rows, cuts them at multiples of the window and gives
one boundary record for each piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .vocabularies import blocks, rules

#: Words kept by each worker's memory; beyond it further words are looked up without being kept.
MEMORY_WORDS = 400_000

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Signs at which Python parts words and the vocabulary doesn't.
_ODD = regex.compile("[\x1c-\x1f]")
_MEMORIES: dict[str, Memory] = {}


class Memory(dict):
    """Word -> its ids as little-endian unsigned 16-bit values, filled as words appear.

    The vocabulary's rules never join two words, and they part a word into runs of letters, single digits and
    runs of other signs, so a text's ids are its words' ids one after the other. Words that hold signs for which
    lower-casing or composing could depend on the neighbours go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.runs = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def run(self, piece: str) -> bytes:
        """The ids of one run of letters or signs, by the vocabulary's model alone."""
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        ids = np.array([t.id for t in tokens], dtype="<u2").tobytes()
        if len(self.runs) < MEMORY_WORDS:
            self.runs[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if "<|" in word or _ODD.search(word) or not word.isascii() and any(not ("À" <= c <= "ɏ" or c.isascii()) for c in word):
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u2").tobytes()
        else:
            known = self.runs.get
            ids = b"".join([known(p) or self.run(p) for p in _PIECES.findall(word.lower())])
        if len(self) < MEMORY_WORDS:
            self[word] = ids
        return ids


class Words(dict):
    """The same for any vocabulary whose rules keep words apart: each word goes through the whole tokenizer when it is first met."""

    def __init__(self, path: str) -> None:
        self.rules = rules(path)

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.rules.encode([word])[0], dtype="<u2").tobytes()
        if len(self) < MEMORY_WORDS:
            self[word] = ids
        return ids


def token_ids(path: str, texts: list[str | None]) -> list[bytes]:
    """For each text the ids of the vocabulary at ``path`` as little-endian unsigned 16-bit values."""
    memory = _MEMORIES.get(path)
    if memory is None:
        memory = _MEMORIES[path] = Words(path) if rules(path).byte_level else Memory(path)
    look = memory.__getitem__
    if isinstance(memory, Words):
        return [b"".join([look(w) for block in blocks(t) for w in memory.rules.split(block)]) if t else b"" for t in texts]
    return [b"".join(map(look, [t] if _ODD.search(t) else t.split())) if t else b"" for t in texts]


def pack_documents(
    docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Lay all documents' tokens end to end and cut them every ``window`` tokens.

    ``vocabulary`` is a tokenizers file with 65536 ids at most whose rules keep words apart (``vocabularies.Rules``; else ValueError). Each document's ids are followed by ``end_id``.
    Returns one row for each piece: doc_id, start, length, ids_crc32 (of little-endian unsigned 32-bit ids),
    doc_tokens, sequence_id, offset. Every sequence but the last is full, so no padding is needed.
    Nulls: a null text is an empty one and has the end id alone; a null id stays null. Repeated rows are packed
    each. Extra columns are not read. An empty table gives an empty result. The order of documents is that of the
    table's files, so reruns agree.
    """
    if rules(vocabulary).size > 65536:
        raise ValueError(f"{vocabulary} has more than 65536 ids")
    end = np.array([end_id], dtype="<u2").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [x + end for x in token_ids(vocabulary, b.column(1).to_pylist())]
            n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                names=["doc_id", "part", "before", "doc_tokens", "ids"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            begins, sizes = (b.column(k).to_numpy() for k in ("begins", "doc_tokens"))
            pieces = (begins + sizes - 1) // window - begins // window + 1
            row = np.repeat(np.arange(len(pieces)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = np.maximum(begins[row], (begins[row] // window + nth) * window)
            hi = np.minimum(begins[row] + sizes[row], (begins[row] // window + nth + 1) * window)
            crc = np.empty(len(row), np.int64)
            wide, last = np.zeros(0, "<u4"), -1
            for i, (r, a, z) in enumerate(zip(row.tolist(), (lo - begins[row]).tolist(), (hi - begins[row]).tolist(), strict=True)):
                if r != last:
                    wide, last = np.frombuffer(b.column("ids")[r].as_buffer(), "<u2").astype("<u4"), r
                crc[i] = zlib.crc32(wide[a:z])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), *map(pa.array, (lo - begins[row], hi - lo, crc, sizes[row], lo // window, lo % window))], names=names
            )

    tokens = stage(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            tokenise, "doc_id long, part int, before long, doc_tokens long, ids binary"
        ),
        "tokens",
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        tokens.groupBy("part")
        .agg(F.sum("doc_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    )
    return (
        tokens.join(F.broadcast(totals), "part")  # a row of two numbers for each task of pass one
        .select("doc_id", (F.col("first") + F.col("before")).alias("begins"), "doc_tokens", "ids")
        .mapInArrow(
            cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        )
    )
