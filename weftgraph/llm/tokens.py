"""BPE encoding and decoding through a table of distinct words.

Texts are parted into words where they lie; a task names each distinct word of some tens of megabytes once and keeps
a text as the names of its words in order. Only those distinct words move: dealt out by a hash, each distinct word of the
corpus is encoded once, by the whole tokenizer, in the one task that it falls to. Its ids go back to the chunks that asked
and are put in by position. Decoding looks each id up in the table of pieces, which has a row for each id.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..staging import stage_bucketed
from .textbatch import give_back, span_hash
from .vocabularies import blocks, from_varints, ragged, rules, to_varints

#: Characters of text whose words are named together.
CHUNK_BYTES = 16 << 20
#: Words that are put in, and ids that are decoded, at a time.
STEP = 1 << 18
#: Ids beyond which a vocabulary is not sent to every task.
MOST_IDS = 1 << 21

#: Rows of distinct words (bucket 0 and on), of a chunk's order of words (ORDER) and of runs of texts (TEXTS).
_NAMED = "chunk long, bucket int, sizes binary, data binary, ids array<long>"
_FIELDS = ["chunk", "bucket", "sizes", "data", "ids"]
ORDER, TEXTS = -1, -2


def numbered() -> collections.defaultdict:
    """A dictionary that numbers its keys as they are first asked for."""
    out: collections.defaultdict = collections.defaultdict()
    out.default_factory = out.__len__
    return out


def _named(path: str, buckets: int):
    """A chunk's distinct words, dealt out to buckets, and its texts as codes of words; numbers and words are compressed.

    A code is a word's rank by how often it stands in the chunk, so most take one or two bytes. Words are sorted in each bucket; the
    order row has their ranks, bucket after bucket.
    """

    def rows(chunk: int, bucket: list[int], sizes: list[np.ndarray], data: list[np.ndarray], ids: pa.Array | None = None) -> pa.RecordBatch:
        n = len(bucket)
        cols = [pa.array(np.full(n, chunk)), pa.array(bucket, pa.int32()), *(pa.array([squeeze(x) for x in c], pa.binary()) for c in (sizes, data))]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.list_(pa.int64())) if ids is None else ids], names=_FIELDS)

    def flush(chunk: int, names: dict[str, int], ids: list, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes, bounds = np.concatenate([*held, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in held])])
        rank = np.empty(len(names), np.uint32)
        rank[np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")] = np.arange(len(names), dtype=np.uint32)
        words = pa.array(names, pa.large_string())
        by = pc.sort_indices(words).to_numpy()
        words = words.take(pa.array(by))
        offsets, data = _buffers(words)
        bucket = (span_hash(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)
        dealt = np.argsort(bucket, kind="stable")
        words, by = words.take(pa.array(dealt)), by[dealt]
        offsets, data = _buffers(words)
        cuts = np.searchsorted(bucket[dealt], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        sizes = [to_varints(np.diff(offsets[cuts[k] : cuts[k + 1] + 1]))[0] for k in full]
        yield rows(chunk, full, sizes, [data[offsets[cuts[k]] : offsets[cuts[k + 1]]] for k in full])
        yield rows(chunk, [ORDER], [np.zeros(0, np.uint8)], [rank[by].astype("<u4").view(np.uint8)])
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + STEP, side="right")) - 1)
            packed = to_varints(rank[codes[bounds[first] : bounds[last]]])[0]
            yield rows(chunk, [TEXTS], [to_varints(np.diff(bounds[first : last + 1]))[0]], [packed], pa.array([ids[first:last]], pa.list_(pa.int64())))
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, chunk = rules(path).split, TaskContext.get().partitionId() << 32
        names = numbered()
        ids: list = []
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_py() or ""
                parts = []
                for block in blocks(raw):
                    words = split(block)
                    parts.append(np.fromiter(map(names.__getitem__, words), np.uint32, len(words)))
                ids.append(doc_id)
                held.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
                size += len(raw) + 64
                if size >= CHUNK_BYTES:
                    yield from flush(chunk, names, ids, held)
                    names, ids, held, size, chunk = numbered(), [], [], 0, chunk + 1
                    give_back()
        if ids:
            yield from flush(chunk, names, ids, held)
        del names, held
        give_back()

    return run


def _buffers(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of an array that begins at its buffer ends, and all words' bytes."""
    if not len(words):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = words.buffers()
    return np.frombuffer(offsets, np.int64, count=len(words) + 1), np.frombuffer(data or b"", np.uint8)


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def unsqueeze(data: bytes, kind: str = "u1") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _encoded(path: str):
    """The ids of a bucket's words, in their order; a word that several chunks ask for is encoded when first met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = rules(path).encode, {}
        for b in batches:
            for chunk, bucket, sizes, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ends = np.concatenate([[0], np.cumsum(from_varints(unsqueeze(sizes))[0].astype(np.int64))])
                words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(unsqueeze(data))).to_pylist()
                new = [w for w in words if w not in known]
                known.update(zip(new, (np.array(x, "<u4").tobytes() for x in encode(new)), strict=True))
                found = [known[w] for w in words]
                counts = to_varints(np.fromiter(map(len, found), np.int64, len(found)) >> 2)[0]
                its = np.frombuffer(b"".join(found), np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([squeeze(counts)], pa.binary()), pa.array([squeeze(its)], pa.binary())],
                    names=_FIELDS[:4],
                )
        known.clear()
        give_back()

    return run


def _placed(asked: pa.Table, texts: pa.Table) -> pa.Table:
    """The ids of a chunk's texts: each word's ids put in where its code stands."""
    give_back()
    asked, kinds = asked.sort_by("bucket"), texts.column("bucket").to_pylist()
    counts = [from_varints(unsqueeze(x))[0] for x in asked.column("sizes").to_pylist()]
    counts = np.concatenate([*counts, np.zeros(0, np.uint32)]).astype(np.int64)
    flat = np.concatenate([*(unsqueeze(x, "<u4") for x in asked.column("data").to_pylist()), np.zeros(0, "<u4")])
    order = unsqueeze(texts.column("data")[kinds.index(ORDER)].as_py(), "<u4")
    starts, sizes = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    starts[order], sizes[order] = np.cumsum(counts) - counts, counts
    out: list[bytes] = []
    ids: list = []
    for i in (i for i, kind in enumerate(kinds) if kind == TEXTS):
        codes = from_varints(unsqueeze(texts.column("data")[i].as_py()))[0]
        n = from_varints(unsqueeze(texts.column("sizes")[i].as_py()))[0].astype(np.int64)
        ids += texts.column("ids")[i].as_py()
        if len(n) == 1:  # may be very long
            out.append(b"".join(flat[ragged(starts[c], sizes[c])].tobytes() for c in (codes[at : at + STEP] for at in range(0, len(codes), STEP))))
            continue
        whole = flat[ragged(starts[codes], sizes[codes])].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[np.concatenate([[0], np.cumsum(n)])] * 4
        out += [whole[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array([len(x) >> 2 for x in out], pa.int64()), "ids": pa.array(out, pa.binary())})


def encode_documents(docs: DataFrame, vocabulary: str, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every whole text: doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers, one after the other).

    ``vocabulary`` is a tokenizers file whose rules keep words apart (else ValueError); ids are those of the whole tokenizer
    without truncation, padding and outer special tokens. Distinct words are dealt out to ``buckets`` tasks (the session's number of
    shuffle partitions by default). Nulls: a null text is an empty one and has no ids; a null id stays null. Repeated rows are encoded each.
    Extra columns are not read. An empty table gives no rows. Very long texts are parted block by block.
    """
    spark = docs.sparkSession
    rules(vocabulary)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # in buckets of the chunk: texts need no shuffle to meet their words' ids
    named = stage_bucketed(rows.mapInArrow(_named(vocabulary, buckets), _NAMED), "named", buckets, "chunk")
    words = named.where("bucket >= 0").drop("ids").repartitionById(buckets, F.col("bucket"))
    asked = words.mapInArrow(_encoded(vocabulary), "chunk long, bucket int, sizes binary, data binary")
    asked = asked.withColumnRenamed("chunk", "of")
    texts = named.where("bucket < 0")
    return asked.groupBy("of").cogroup(texts.groupBy("chunk")).applyInArrow(_placed, "doc_id long, n_tokens long, ids binary")


def piece_table(spark: SparkSession, vocabulary: str) -> DataFrame:
    """The pieces of a vocabulary: id, piece (bytes)."""
    pieces = rules(vocabulary).pieces()
    table = pa.table({"id": pa.array(range(len(pieces)), pa.int64()), "piece": pieces.cast(pa.binary())})
    return spark.createDataFrame(table.filter(pc.is_valid(table.column("piece"))))


def decode_documents(encoded: DataFrame, pieces: DataFrame, joint: bytes = b" ", ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``: the pieces of each row's ids with ``joint`` between them, read as UTF-8.

    ``pieces`` (id, piece) joins by id; it has MOST_IDS rows at most (else ValueError) and goes to every task. An id that it
    lacks adds nothing. Null ids give a null text, empty ids an empty one; bytes that are no UTF-8 give U+FFFD. All other columns
    stay; a column named decoded is replaced.
    """
    if pieces.limit(MOST_IDS + 1).count() > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} pieces")
    table = pieces.where("id is not null and piece is not null").select(F.col("id").cast("long"), "piece").toArrow().sort_by("id")
    known = np.zeros(1 + max([-1, *table.column("id").to_pylist()]), bool)
    known[table.column("id").to_numpy()] = True
    dense = np.cumsum(known) - 1  # an id's row in the table
    shared = encoded.sparkSession.sparkContext.broadcast((known, dense, table.column("piece").combine_chunks().cast(pa.large_binary())))
    kept = encoded.drop("decoded")
    at = kept.columns.index(ids_col)

    def text_of(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        known, dense, its = shared.value
        out = []
        for first in range(0, len(raw), 4 * STEP):
            ids = np.frombuffer(raw[first : first + 4 * STEP], "<u4").astype(np.int64)
            ids = ids[ids < len(known)]
            found = its.take(pa.array(dense[ids[known[ids]]]))
            if not len(found):
                continue
            out.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(found)], pa.int64()), found), pa.scalar(joint, pa.large_binary()))[0].as_py())
        return joint.join(out).decode(errors="replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 200):
                part = b.slice(first, 200)
                texts = [text_of(x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])
        give_back()

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", StringType())]))

