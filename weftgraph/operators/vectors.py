"""Vector search: all pairs for a stated query set, cells for many queries; both exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from .blocks import in_blocks
from .cells import VectorCells

#: Pairs that a task scores at once.
PAIRS = 1 << 22


def _ranked(pairs: DataFrame, k: int, least: float) -> DataFrame:
    """The k best of each query among scored pairs: rounded scores, ties by id."""
    kept = pairs.where(F.col("score") >= least)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))).where(F.col("rank") <= k)


def _by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of vectors; null vectors and vectors that hold a null are left out."""
    n = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    if flat.null_count:
        n[pc.list_parent_indices(lists).filter(flat.is_null()).to_numpy(zero_copy_only=False)] = -1
    for length in np.unique(n[n >= 0]):
        rows = np.nonzero(n == length)[0]
        yield int(length), rows, lists.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), length)


def _dots(x: np.ndarray, r: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of the rows r of x with the rows c of y, summed from the first place to the last."""
    found = np.zeros(len(r))
    for j in range(x.shape[1]):
        found += x[r, j] * y[c, j]
    return found


def _sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the rows, the rows as single-precision unit vectors (zeros stay), and which rows have no finite length."""
    at = np.arange(len(x))
    with np.errstate(all="ignore"):
        norm = np.sqrt(_dots(x, at, x, at))
        return norm, (x / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32), ~np.isfinite(norm)


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values of two id columns are; -1 for null."""
    kind = a.type if a.type == b.type else pa.int64() if pa.types.is_integer(a.type) and pa.types.is_integer(b.type) else pa.string()
    its = pa.concat_arrays([a.cast(kind), b.cast(kind)]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return its[: len(a)], its[len(a) :]


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of equal numbers, rising in i."""
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    n = high - low
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.repeat(low, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]


def _first_ids(query: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k of the smallest ids of their query and score: of equals, no more can be wanted."""
    order = np.lexsort((place, score, query))
    q, s = query[order], score[order]
    new = np.ones(len(order), bool)
    new[1:] = (q[1:] != q[:-1]) | ((s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1])))
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def _best(held, k: int, floor: float, skip_self: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of items (item_id, vector): query_id, item_id and raw cosine of all pairs that may be among the k best of a query.

    Matrix products in single precision choose, with a margin for their error and for what rounding to six places may tie; what they
    choose is scored in double precision. A task remembers the k best of each query, so later batches give only what may be better.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        q_ids = asked.column("query_id").combine_chunks()
        sides = {n: (rows, x, *_sides(x)) for n, rows, x in _by_length(asked.column("query_vector").combine_chunks())}
        tops = {n: np.full((len(rows), k), -np.inf, np.float32) for n, (rows, *_) in sides.items()}
        for b in batches:
            ids = b.column("item_id")
            place = np.empty(len(ids), np.int64)
            place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy(zero_copy_only=False)] = np.arange(len(ids))
            mine, its = _codes(q_ids, ids) if skip_self else (None, None)
            for n, rows, y in _by_length(b.column("vector")):
                if n not in sides:
                    continue
                q_rows, x, x_norm, x_unit, x_odd = sides[n]
                y_norm, y_unit, y_odd = _sides(y)
                if skip_self:
                    same_q, same_i = _equal(mine[q_rows], its[rows])
                slack = np.float32(4e-6 + 4e-7 * n)
                step = max(1, PAIRS // len(y))
                for first in range(0, len(x), step):
                    some = slice(first, first + step)
                    with np.errstate(all="ignore"):
                        near = x_unit[some] @ y_unit.T
                    near[x_odd[some]], near[:, y_odd] = np.inf, np.inf  # scores that are no numbers stand first
                    if skip_self:
                        part = slice(*np.searchsorted(same_q, (first, first + step)))
                        near[same_q[part] - first, same_i[part]] = -np.inf
                        near[mine[q_rows[some]] < 0], near[:, its[rows] < 0] = -np.inf, -np.inf
                    top = tops[n][some]
                    edge = top[:, -1]
                    if np.isneginf(edge).any() and k < near.shape[1]:
                        edge = np.maximum(edge, np.partition(near, -k, axis=1)[:, -k])
                    r, c = np.nonzero((near >= np.maximum(edge, np.float32(floor))[:, None] - slack) & (near > -np.inf))
                    if not len(r):
                        continue
                    seen = near[r, c]
                    order = np.lexsort((-seen, r))
                    begins = np.searchsorted(r, np.arange(len(top)))
                    nth = np.arange(len(r)) - begins[r]
                    more = np.full(top.shape, -np.inf, np.float32)
                    more[r[nth < k], nth[nth < k]] = seen[order][nth < k]
                    tops[n][some] = -np.sort(-np.concatenate([top, more], axis=1), axis=1)[:, :k]
                    with np.errstate(all="ignore"):
                        norm = x_norm[some][r] * y_norm[c]
                        raw = np.where(norm == 0, 0.0, _dots(x[some], r, y, c) / norm)
                    one = _first_ids(r, raw, place[rows[c]], k)
                    yield pa.RecordBatch.from_arrays(
                        [q_ids.take(pa.array(q_rows[some][r[one]])), ids.take(pa.array(rows[c[one]])), pa.array(raw[one])], names=["query_id", "item_id", "raw"],
                    )

    return run


def vector_topk(queries: DataFrame, items: DataFrame, k: int, least: float = -1.0, skip_self: bool = False, scale: str = "raw") -> DataFrame:
    """query_id, item_id, score, rank: the k nearest items of each query by cosine (6 places), exactly.

    The queries are a stated set, held against all items in blocks: each task multiplies its items with a block and keeps what may be
    among the k best. For vectors that lie in clusters, ``vector_topk_cells`` scores fewer pairs. scale "unit" gives (1 + cosine) / 2.
    Null vectors find nothing, vectors of different lengths are not compared. ``k`` below 1 raises ValueError.
    """
    if k < 1:
        raise ValueError("k is below 1")
    spark, floor = items.sparkSession, 2 * least - 1 if scale == "unit" else least
    q = queries.select("query_id", F.col("vector").alias("query_vector")).where("query_vector is not null")
    # dealt out by number, since a small file of many vectors is much work
    dealt = items.select("item_id", "vector").where("vector is not null").repartition(2 * spark.sparkContext.defaultParallelism, "item_id")
    kind = StructType([q.schema["query_id"], dealt.schema["item_id"], *StructType.fromDDL("raw double").fields])
    found = in_blocks(q, "query_id", lambda some: dealt.mapInArrow(_best(spark.sparkContext.broadcast(some.toArrow()), k, floor, skip_self), kind))
    score = F.round((1 + F.col("raw")) / 2 if scale == "unit" else F.col("raw"), 6)
    return _ranked(found.select("query_id", "item_id", score.alias("score")), k, least)


def vector_topk_cells(queries: DataFrame, items: DataFrame, k: int, least: float = -1.0, skip_self: bool = False, scale: str = "raw") -> DataFrame:
    """What ``vector_topk`` gives, through an index of cells (``cells.VectorCells``): for very many queries, or clustered vectors."""
    return VectorCells(items).search(queries, k, least, skip_self, scale)


def vector_topk_hashed(queries: DataFrame, items: DataFrame, k: int, least: float = -1.0, skip_self: bool = False, scale: str = "raw") -> DataFrame:
    """The former approximate search by hashed bands; the cells that took its place find all neighbours."""
    return vector_topk_cells(queries, items, k, least, skip_self, scale)


def vector_topk_relationships(hits: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Edges that touch a hit entity (query_id, item_id, score), scored by their better end; the k best of a query."""
    by_end = []
    for end in ("source_entity_id", "target_entity_id"):
        by_end.append(
            (
                edges.select("relationship_id", F.col(end).alias("item_id"))
                .join(hits.select("query_id", "item_id", "score"), "item_id")
                .select("query_id", "relationship_id", "score")
            ),
        )
    best = by_end[0].unionByName(by_end[1]).groupBy("query_id", "relationship_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "relationship_id"))).where(
        F.col("rank") <= k,
    )


def best_match(left: DataFrame, right: DataFrame, skip_self: bool = False) -> DataFrame:
    """For each vector of the left table (query_id) the most similar of the right (item_id)."""
    return vector_topk(left, right, 1, skip_self=skip_self)


def reembed(rows: DataFrame, text, embed) -> DataFrame:
    """Rows with a new vector column, made by a column function from a text column."""
    return rows.withColumn("vector", embed(text))


@F.pandas_udf(ArrayType(FloatType()))
def hashed_embedding(texts):
    """Default vectors: signed feature hashing of character trigrams into 64 places (not a trained model)."""
    import pandas as pd

    return pd.Series(list(trigram_vectors([f" {(t or '').lower()} " for t in texts])), dtype=object)


def trigram_vectors(texts: list[str], most: int = 1 << 20) -> np.ndarray:
    """Unit vectors (float32) of the crc32 of each three neighbouring characters in UTF-8; ``most`` characters at a time, or one text."""
    out, first, held = np.zeros((len(texts), 64), np.float32), 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most or i == len(texts) - 1:
            out[first : i + 1] = _trigram_counts(texts[first : i + 1])
            first, held = i + 1, 0
    norm = np.array([np.linalg.norm(v) for v in out], np.float32)
    return np.divide(out, norm[:, None], out=out, where=norm[:, None] > 0)


def _trigram_counts(texts: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.append(starts, len(data))[3:]
    n = np.array([len(t) for t in texts])
    who = np.repeat(np.arange(len(texts)), n)
    whole = who[:-2] == who[2:]  # trigrams of one text
    who, low, high = who[:-2][whole], starts[:-2][whole], ends[whole]
    crc = np.full(len(low), 0xFFFFFFFF, np.uint32)
    for k in range(int((high - low).max(initial=0))):
        at = slice(None) if k < 3 else np.flatnonzero(low + k < high)
        crc[at] = CRC[(crc[at] ^ data[low[at] + k]) & 0xFF] ^ (crc[at] >> 8)
    crc ^= 0xFFFFFFFF
    sign = np.where(crc >> 31, 1.0, -1.0)
    return np.bincount(who * 64 + crc % 64, weights=sign, minlength=len(texts) * 64).reshape(-1, 64)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


#: What a byte does to a crc32.
CRC = _crc_table()
