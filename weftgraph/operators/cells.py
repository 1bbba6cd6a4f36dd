"""Exact nearest neighbours by cosine through cells: vectors near one centre lie together and are ruled out together.

Centres come from a k-means pass over a bounded sample. Every vector belongs to its nearest centre and lies at some angle
from it; a block holds the vectors of one cell and one shell of angles. For a query at angle a from the centre, no vector at
angle t from it is nearer than |a - t| (the triangle inequality on the sphere), so blocks whose shell lies too far need not be read.
A first pass searches each query's most promising blocks; the k-th best of what it finds is a bound, and a second pass
searches every block that the bound leaves open. Results are those of scoring all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..staging import stage

#: Vectors of the sample that centres are fitted on; centres; shells of the half turn; vectors of a block; queries that meet a block at once.
SAMPLE, CENTRES, SHELLS, BLOCK_ITEMS, BLOCK_QUERIES = 20_000, 1024, 48, 20_000, 4096
#: Rows of a plan, with a vector each, that a task makes at once.
PLANNED_ROWS = 8192
#: Blocks at most, since a row for each goes to every task.
MOST_BLOCKS = 1 << 19
#: What rounding to six places and floating point may hide.
_SLACK = 2e-6


def _unit(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit vectors (zeros stay) and which rows are no zeros."""
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1.0)[:, None], norm > 0


def _with(df: DataFrame, more: str) -> StructType:
    """A table's schema with further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def fit_centres(items: DataFrame, n: int, seed: int = 7, rounds: int = 6) -> np.ndarray:
    """Unit centres of about 2 sqrt(n) cells, by spherical k-means on the SAMPLE vectors of the smallest hashes of their ids."""
    h = F.xxhash64(F.col("item_id"), F.lit(seed))
    rows = items.select("vector", h.alias("h")).orderBy("h").limit(SAMPLE).select("vector").toArrow()
    x, real = _unit(rows.column("vector").combine_chunks() if len(rows) else pa.array([], pa.list_(pa.float64())))
    x = x[real]
    k = min(len(x), max(1, min(CENTRES, int(2 * math.sqrt(n)))))
    if not k:
        return np.zeros((0, x.shape[1]))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        its = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, its, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1.0)[:, None], centres)
    return centres


class VectorCells:
    """An index over items (item_id, vector): ``search`` gives exactly what scoring every pair would give.

    Vectors have one length. Null vectors are left out; zero vectors have cosine 0 with everything and lie in blocks that
    every query searches. No block has more than one hundredth of the items (but for tables of fewer than a hundred), nor more than BLOCK_ITEMS.
    More than MOST_BLOCKS blocks raise ValueError: raise BLOCK_ITEMS, or search parts of the table. ``shares`` lists, for each
    search, pairs scored, all pairs.
    """

    def __init__(self, items: DataFrame, seed: int = 7) -> None:
        self.spark, self.shares = items.sparkSession, []
        rows = items.select("item_id", "vector").where("vector is not null")
        self.n = rows.count()
        self.centres = centres = fit_centres(rows, self.n, seed)
        shared = self.spark.sparkContext.broadcast(centres)

        def placed(batches):
            c = shared.value
            for b in batches:
                x, real = _unit(b.column("vector"))
                near = x @ c.T if len(c) and len(x) else np.zeros((len(x), 1))
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(np.where(real, cell, -1).astype(np.int32)), pa.array(angle), pa.array((angle * (SHELLS / math.pi)).astype(np.int32))],
                    names=["item_id", "vector", "cell", "angle", "shell"],
                )

        kind = _with(rows, "cell int, angle double, shell int")
        near = stage(rows.mapInArrow(placed, kind), "placed")
        most = max(1, min(BLOCK_ITEMS, self.n // 100))
        sizes = near.groupBy("cell", "shell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()  # cells times shells at most
        first, table = {}, []
        for r in sorted(sizes, key=lambda r: (r.cell, r.shell)):
            # hash parts are uneven: leave a margin
            parts = 1 if r.n <= most else -(-r.n * 5 // (most * 4)) + 1
            first[r.cell, r.shell] = (len(table), parts)
            table += [(r.cell, r.low, r.high)] * parts
        if len(table) > MOST_BLOCKS:
            raise ValueError(f"{len(table)} blocks")
        self.blocks = np.array([(c, low, high) for c, low, high in table]).reshape(-1, 3)
        starts = self.spark.createDataFrame([(c, s, b, p) for (c, s), (b, p) in first.items()], "cell int, shell int, first int, parts int")
        block = F.col("first") + F.pmod(F.xxhash64("item_id", F.lit("part")), F.col("parts")).cast("int")
        self.items = stage(near.join(F.broadcast(starts), ["cell", "shell"]).select(block.alias("block"), "item_id", "vector"), "cells")
        held = {r.block: r.n for r in self.items.groupBy("block").agg(F.count("*").alias("n")).collect()}
        self.sizes = np.array([held.get(b, 0) for b in range(len(table))], np.int64)

    def _planned(self, queries: DataFrame, wanted: int, later: bool) -> DataFrame:
        """Rows (query_id, vector, bound, block, n): the first pass's blocks of each query, or those that its bound leaves open after them.

        A first pass takes the blocks of the smallest possible angle until they hold ``wanted`` items.
        """
        shared = self.spark.sparkContext.broadcast((self.centres, self.blocks, self.sizes))

        def plan(batches):
            centres, blocks, sizes = shared.value
            cell, low, high = blocks[:, 0].astype(np.int64), blocks[:, 1], blocks[:, 2]
            for b in batches:
                x, _ = _unit(b.column("query_vector"))
                bound = b.column("bound").to_numpy(zero_copy_only=False)
                step = max(1, (1 << 20) // max(1, len(blocks)))
                for first in range(0, len(x), step):
                    some = x[first : first + step]
                    angle = np.arccos(np.clip(some @ centres.T, -1.0, 1.0)) if len(centres) else np.zeros((len(some), 1))
                    its = np.where(cell < 0, 0.0, angle[:, np.maximum(cell, 0)])
                    least = np.where(cell < 0, 0.0, np.maximum(0.0, np.maximum(its - high, low - its)))
                    order = np.argsort(least, axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    taken = np.zeros(least.shape, bool)
                    np.put_along_axis(taken, order, before < wanted, axis=1)
                    if later:
                        taken = ~taken & (np.cos(least) >= bound[first : first + step, None] - _SLACK)
                    rows, whiches = np.nonzero(taken)
                    for begin in range(0, len(rows), PLANNED_ROWS):  # each row repeats its query's vector
                        row, which = rows[begin : begin + PLANNED_ROWS], whiches[begin : begin + PLANNED_ROWS]
                        at = pa.array(row + first)
                        yield pa.RecordBatch.from_arrays(
                            [*(c.take(at) for c in b.columns), pa.array(which.astype(np.int32)), pa.array(sizes[which])],
                            names=["query_id", "query_vector", "bound", "block", "n"],
                        )

        return stage(queries.mapInArrow(plan, _with(queries, "block int, n long")), "planned")

    def _scored(self, planned: DataFrame, k: int, skip_self: bool) -> DataFrame:
        """The best k of each query in each planned block, with all that rounding may tie with the k-th.

        Many queries of one block meet copies of it, BLOCK_QUERIES at a time or so.
        """
        count = planned.groupBy("block").agg(F.count("*").alias("asked"))
        copies = count.select("block", F.ceil(F.col("asked") / BLOCK_QUERIES).cast("int").alias("copies"))
        asked = planned.join(F.broadcast(copies), "block").select(  # a row of two numbers for each block
            "block", F.pmod(F.xxhash64("query_id", F.lit("copy")), F.col("copies")).cast("int").alias("copy"), "query_id", "query_vector",
        )
        held = self.items.join(F.broadcast(copies), "block").select(
            F.col("block").alias("its_block"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("its_copy"), "item_id", "vector",
        )
        kinds = {"query_id": asked.schema["query_id"].dataType, "item_id": held.schema["item_id"].dataType}

        def score(asked: pa.Table, held: pa.Table) -> pa.Table:
            q, ids = asked.column("query_id").combine_chunks(), held.column("item_id").combine_chunks()
            if not len(q) or not len(ids):
                return pa.table({"query_id": q.slice(0, 0), "item_id": ids.slice(0, 0), "raw": pa.array([], pa.float64())})
            x, y = _unit(asked.column("query_vector").combine_chunks())[0], _unit(held.column("vector").combine_chunks())[0]
            rows, cols, raws = [], [], []
            step = max(1, (1 << 22) // len(y))
            same = np.array(ids.to_pylist(), object) if skip_self else None
            for first in range(0, len(x), step):
                raw = x[first : first + step] @ y.T
                if skip_self:
                    for i, its in enumerate(q.slice(first, step).to_pylist()):
                        raw[i, same == its] = -np.inf
                edge = np.partition(raw, -k, axis=1)[:, -k] if k < raw.shape[1] else np.full(len(raw), -2.0)
                r, c = np.nonzero(raw >= np.maximum(edge - _SLACK, -2.0)[:, None])
                rows.append(r + first)
                cols.append(c)
                raws.append(raw[r, c])
            r, c = np.concatenate(rows), np.concatenate(cols)
            return pa.table({"query_id": q.take(pa.array(r)), "item_id": ids.take(pa.array(c)), "raw": pa.array(np.concatenate(raws))})

        out = f"query_id {kinds['query_id'].simpleString()}, item_id {kinds['item_id'].simpleString()}, raw double"
        return asked.groupBy("block", "copy").cogroup(held.groupBy("its_block", "its_copy")).applyInArrow(score, out)

    def search(self, queries: DataFrame, k: int, least: float = -1.0, skip_self: bool = False, scale: str = "raw") -> DataFrame:
        """query_id, item_id, score (6 places), rank: the k best items of each query (query_id, vector) of at least that score, ties by id.

        scale "unit" gives (1 + cosine) / 2. A null vector finds nothing; a zero vector has score 0 with everything. ``k`` below 1 raises ValueError.
        """
        if k < 1:
            raise ValueError("k is below 1")
        floor = 2 * least - 1 if scale == "unit" else least
        asked = queries.select("query_id", F.col("vector").alias("query_vector")).where("query_vector is not null").withColumn("bound", F.lit(float(floor)))
        wanted = max(4 * (k + 1), self.n // 64)
        one = self._planned(asked, wanted, False)
        hits = stage(self._scored(one, k, skip_self), "hits")
        kth = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw")))).where(F.col("nth") == k)
        bounds = kth.select("query_id", F.greatest("raw", F.lit(float(floor))).alias("kth"))
        open_ = asked.join(bounds, "query_id", "left").select("query_id", "query_vector", F.coalesce("kth", "bound").alias("bound"))
        two = self._planned(open_, wanted, True)
        scored = one.unionByName(two).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.shares.append((scored, self.n * asked.count()))
        both = hits.unionByName(self._scored(two, k, skip_self))
        score = F.round((1 + F.col("raw")) / 2 if scale == "unit" else F.col("raw"), 6)
        kept = both.select("query_id", "item_id", score.alias("score")).where(F.col("score") >= least)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
        return kept.withColumn("rank", rank).where(F.col("rank") <= k)
