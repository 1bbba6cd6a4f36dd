"""Chunks of documents and the edges between them."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.core import content_id

# How many characters of context each step may use.
CONTEXT_CAPS = {"verify": 4000, "embedding": 2000, "verdict": 3000, "entity": 8000, "entity_prompt": 4000, "relationship_prompt": 3000}


#: Chunks that leave a task together, and the white space that windows lose at their ends.
STREAMED, BLANKS = 500, "".join(chr(i) for i in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def capped(text: Column, step: str) -> Column:
    """The beginning of a context that a step may use."""
    return F.substring(text, 1, CONTEXT_CAPS[step])


def _starts(length: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    n = F.ceil(F.greatest(F.lit(0), length - size) / step)
    return F.sequence(F.lit(0), (n * step).cast("int"), F.lit(step))


def chunk_window(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Fixed character windows, untrimmed: document_id, chunk_index, content, start_position, end_position."""
    text = docs.where(F.length("content") > 0).select(
        "document_id", "content", F.posexplode(_starts(F.length("content"), size, overlap)).alias("chunk_index", "start"),
    )
    piece = F.substring("content", F.col("start") + 1, F.lit(size))
    return text.select(
        "document_id", "chunk_index", piece.alias("content"), F.col("start").alias("start_position"),
        (F.col("start") + F.length(piece)).alias("end_position"),
    )


def chunk_fixed(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Fixed windows, trimmed; blank windows are skipped and use no index."""
    cut = chunk_window(docs, size, overlap).withColumn("content", F.regexp_replace("content", r"(?U)^\s+|\s+$", "")).where("content <> ''")
    by = Window.partitionBy("document_id").orderBy("start_position")
    return cut.withColumn("chunk_index", F.row_number().over(by) - 1)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def chunk_tokens(docs: DataFrame, size: int = 200, overlap: int = 20) -> DataFrame:
    """Windows of white-space tokens; columns beside document_id and content (a page number, say) are kept."""
    keep = [c for c in docs.columns if c != "content"]
    rows = docs.select(*keep, tokens(F.col("content")).alias("words")).where(F.size("words") > 0)
    rows = rows.select(*keep, "words", F.posexplode(_starts(F.size("words"), size, overlap)).alias("chunk_index", "start"))
    return rows.select(*keep, "chunk_index", F.array_join(F.slice("words", F.col("start") + 1, size), " ").alias("content"))


def chunk_with(docs: DataFrame, split: Callable[[Column], Column], keep_blank: bool = False) -> DataFrame:
    """Chunks (document_id, chunk_index, content) by a user's function from a text column to an array of texts.

    The function may be made of built-in functions or be a UDF; null results and null or (unless kept) blank pieces give no chunk.
    """
    rows = docs.select(
        "document_id",
        F.posexplode(F.filter(split(F.col("content")), lambda x: x.isNotNull() & (F.lit(keep_blank) | (F.trim(x) != "")))).alias(
            "chunk_index", "content",
        ),
    )
    return rows


def chunk_streamed(docs: DataFrame, pieces: Callable[[str], Iterator[tuple[int, str]]]) -> DataFrame:
    """Chunks (document_id, chunk_index, content, start_position) by a generator of (start, piece) from a text.

    Chunks leave the task as the generator makes them, STREAMED at a time, so that no document's chunks are ever held together, by Python or
    in an array; blank pieces use no index. A null text has no chunks; a null document_id stays null.
    """
    kind = docs.schema["document_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1)):
                found, nth = pieces(text.as_py() or ""), 0
                while some := list(itertools.islice(found, STREAMED)):
                    some = [x for x in some if x[1].strip()]
                    who = b.column(0).take(pa.array([i] * len(some), pa.int64()))
                    cols = [pa.array(range(nth, nth + len(some)), pa.int64()), pa.array([x[1] for x in some], pa.string()), pa.array([x[0] for x in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays([who, *cols], names=["document_id", "chunk_index", "content", "start_position"])
                    nth += len(some)

    out = StructType([StructField("document_id", kind), *StructType.fromDDL("chunk_index long, content string, start_position long").fields])
    return docs.select("document_id", "content").mapInArrow(run, out)


def fixed_pieces(size: int = 512, overlap: int = 50) -> Callable[[str], Iterator[tuple[int, str]]]:
    """The windows of ``chunk_fixed``, one by one, trimmed."""

    def run(text: str) -> Iterator[tuple[int, str]]:
        step = size - overlap
        for start in range(0, max(0, -(-(len(text) - size) // step)) * step + 1 if text else 0, step):
            yield start, text[start : start + size].strip(BLANKS)

    return run


def split_sentences(c: Column) -> Column:
    """Sentences: cut after . ! ? with white space, then at blank lines; blank ones go."""
    parts = F.flatten(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), lambda s: F.split(s, r"\n{2,}")))
    return F.filter(parts, lambda s: F.trim(s) != "")


def group_sentences(vectors: np.ndarray, words: list[int], most: int, least: int, threshold: float) -> list[list[int]]:
    """Numbers of the sentences of each chunk: break on a turn of topic or a full chunk, then merge small ones."""
    groups: list[list[int]] = []
    sizes: list[int] = []
    for i, n in enumerate(words):
        if groups:
            now = groups[-1]
            centre = total / len(now)
            scale = np.linalg.norm(centre) * np.linalg.norm(vectors[i])
            alike = float(centre @ vectors[i] / scale) if scale else 0.0
            if sizes[-1] < least or (alike >= threshold and sizes[-1] + n <= most):
                now.append(i)
                sizes[-1] += n
                total += vectors[i]
                continue
        groups.append([i])
        sizes.append(n)
        total = vectors[i].astype(float)
    merged: list[list[int]] = []
    held: list[int] = []
    for g, n in zip(groups, sizes, strict=True):
        if merged and (n < least or held[-1] < least):
            merged[-1] += g
            held[-1] += n
        else:
            merged.append(g)
            held.append(n)
    return merged


def chunk_semantic(sentences: DataFrame, most: int = 512, least: int = 30, threshold: float = 0.5) -> DataFrame:
    """Chunks of neighbouring sentences that stay on topic.

    Takes (document_id, sentences array<string>, vectors array<array<float>>), one row a document; a document's walk
    is sequential, documents are spread over tasks. Gives document_id, chunk_index, content, token_count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, said, vecs in zip(b["document_id"], b["sentences"], b["vectors"], strict=True):
                words = [len(s.split()) for s in said]
                if not words:
                    continue
                for k, g in enumerate(group_sentences(np.array(list(vecs), float), words, most, least, threshold)):
                    rows.append((doc, k, " ".join(said[i] for i in g), sum(words[i] for i in g)))
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "content", "token_count"])

    kind = sentences.schema["document_id"].dataType.simpleString()
    return sentences.select("document_id", "sentences", "vectors").mapInPandas(
        run, f"document_id {kind}, chunk_index int, content string, token_count int",
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Words, sentences, average word length and content density of each chunk."""
    words = tokens(F.col("content"))
    n, length = F.size(words), F.length("content")
    letters = F.aggregate(F.transform(words, lambda w: F.length(w)), F.lit(0), lambda s, v: s + v)
    return chunks.select(
        "*", n.alias("word_count"), (length - F.length(F.translate("content", ".!?", ""))).alias("sentence_count"),
        F.when(n > 0, letters / n).otherwise(0.0).alias("avg_word_length"), F.when(length > 0, n / length).otherwise(0.0).alias("content_density"),
    )


def chunk_identity(chunks: DataFrame) -> DataFrame:
    """Content id, length, position from 1 and running offset of each chunk of a document."""
    by = Window.partitionBy("document_id").orderBy("chunk_index")
    return chunks.select(
        "*", content_id(F.col("document_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"), F.length("content").alias("length"),
        F.row_number().over(by).alias("position"),
        F.coalesce(F.sum(F.length("content")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("content_offset"),
    )


def chunk_links(chunks: DataFrame) -> DataFrame:
    """FIRST_CHUNK from the document and NEXT_CHUNK between neighbours: src_id, dst_id, edge_type."""
    by = Window.partitionBy("document_id").orderBy("chunk_index")
    doc = F.col("document_id").cast("string")
    ranked = chunks.select(doc.alias("doc"), "chunk_id", F.row_number().over(by).alias("n"), F.lead("chunk_id").over(by).alias("next"))
    first = ranked.where("n = 1").select(F.col("doc").alias("src_id"), F.col("chunk_id").alias("dst_id"), F.lit("FIRST_CHUNK").alias("edge_type"))
    return first.unionByName(
        ranked.where("next is not null").select(
            F.col("chunk_id").alias("src_id"), F.col("next").alias("dst_id"), F.lit("NEXT_CHUNK").alias("edge_type"),
        ),
    )


def chunk_membership(chunks: DataFrame) -> DataFrame:
    """HAS_CHUNK and PART_OF edges between documents and chunks."""
    doc = F.col("document_id").cast("string")
    has = chunks.select(doc.alias("src_id"), F.col("chunk_id").alias("dst_id"), F.lit("HAS_CHUNK").alias("edge_type"))
    return has.unionByName(chunks.select(F.col("chunk_id").alias("src_id"), doc.alias("dst_id"), F.lit("PART_OF").alias("edge_type")))


def combine_chunks(chunks: DataFrame, n: int) -> DataFrame:
    """One request text for every n neighbouring chunks, and the ids it holds in order."""
    both = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content")))
    rows = chunks.groupBy("document_id", F.floor(F.col("chunk_index") / n).cast("int").alias("batch")).agg(both.alias("held"))
    return rows.select("document_id", "batch", F.array_join("held.content", "").alias("content"), F.col("held.chunk_id").alias("combined_chunk_ids"))


def spread_combined(replies: DataFrame) -> DataFrame:
    """A combined reply for each of its chunks."""
    return replies.select(F.explode("combined_chunk_ids").alias("chunk_id"), *[c for c in replies.columns if c != "combined_chunk_ids"])


def has_entity_edges(mentions: DataFrame) -> DataFrame:
    """Distinct HAS_ENTITY edges from chunks to the entities (entity_id, source_chunk_ids) they gave."""
    return mentions.select(F.explode("source_chunk_ids").alias("src_id"), F.col("entity_id").alias("dst_id"), F.lit("HAS_ENTITY").alias("edge_type")).distinct()


def provenance_edges(rows: DataFrame, id_col: str, edge_type: str, chunks: DataFrame) -> DataFrame:
    """Edges to source chunks that are new (not in old_chunk_ids) and exist."""
    new = rows.select(
        F.col(id_col).alias("src_id"),
        F.explode(F.array_except("source_chunk_ids", F.coalesce("old_chunk_ids", F.array().cast("array<string>")))).alias("chunk_id"),
    )
    return new.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select(
        "src_id", F.col("chunk_id").alias("dst_id"), F.lit(edge_type).alias("edge_type"),
    )
