"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target (water-filled under the cap) over its size is the expected number of takes of each of its
documents. The whole part is taken outright; the fractional part is an inclusion probability that the cube method
turns into 0 or 1 while it keeps, exactly, the expected number of documents and of tokens: a move along the null
space of the two balancing constraints over three undecided documents settles at least one of them. Tasks run the
flight over blocks of a source and leave a handful of undecided documents; these meet again in coarser blocks. What
is left of a source, a dozen documents at most, is not drawn: it lands as the subset that misses the expected tokens
least, so its documents' inclusion probabilities hold nearly, those of all others exactly.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: Documents a block has on average, and blocks that meet in one coarser block.
BLOCK_DOCS, FAN_IN = 4096, 256
#: Undecided documents that a block leaves at most; the landing tries all their subsets.
LANDING = 12

_NEAR = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """Targets for rows (source, source_size): weights repeat over sources by code point, null last.

    The targets share ``share`` of all sizes by weight; none exceeds ``cap`` times its source's size, and what
    is above is shared again among the rest. With sources ordered by cap over weight, those before some place are
    capped and the others get one common amount for each unit of weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    table = sizes.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("level", level)
    common = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return table.withColumn("common", common).select(
        "source", "source_size", "n_docs", F.least(F.col("most"), F.coalesce(F.col("common") * F.col("weight"), F.col("most"))).alias("target")
    )


def _chance(*values: object) -> float:
    """A number in [0, 1) that depends on the given values alone."""
    a = zlib.crc32(repr(values).encode())
    return (zlib.crc32(struct.pack("<I", a), 77) + 0.5) / 4294967296


class Flight:
    """Undecided documents of one block, ``LANDING`` at most; ``add`` moves three of them whenever one more comes."""

    def __init__(self) -> None:
        self.open: list[list] = []

    def add(self, row: tuple, p: float, size: float) -> list[tuple[tuple, float]]:
        if p <= _NEAR or p >= 1 - _NEAR:
            return [(row, round(p))]
        self.open.append([row, p, size])
        done: list = []
        while len(self.open) > LANDING:
            three, rest = self.open[:3], self.open[3:]
            a, b, c = (x[2] for x in three)
            u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
            up = min(((1 - x[1]) if k > 0 else x[1]) / abs(k) for x, k in zip(three, u, strict=True) if k)
            down = min((x[1] if k > 0 else (1 - x[1])) / abs(k) for x, k in zip(three, u, strict=True) if k)
            step = up if _chance(*[x[0][0] for x in three]) * (up + down) < down else -down
            for x, k in zip(three, u, strict=True):
                x[1] += step * k
            done += [(x[0], round(x[1])) for x in three if x[1] <= _NEAR or x[1] >= 1 - _NEAR]
            self.open = [x for x in three if _NEAR < x[1] < 1 - _NEAR] + rest
        return done

    def land(self) -> list[tuple[tuple, float]]:
        """Settle the last ones: of all their subsets, that whose tokens, then count, come nearest the expected."""
        if not self.open:
            return []
        n = len(self.open)
        p, size = (np.array([x[k] for x in self.open]) for k in (1, 2))
        subsets = np.arange(1 << n)[:, None] >> np.arange(n) & 1
        off = np.abs(subsets @ size - p @ size)
        best = np.lexsort((np.abs(subsets.sum(axis=1) - p.sum()), np.round(off)))[0]
        done = [(x[0], float(k)) for x, k in zip(self.open, subsets[best], strict=True)]
        self.open = []
        return done


def _fly(last: bool):
    """A task's flight over rows sorted by (source, block): settled rows have p 0 or 1, the others between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, key = Flight(), None
        for b in batches:
            out: list[tuple[tuple, float]] = []
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*cols, strict=True):
                # row: doc_id, source, size, source_size, target, whole, p, block
                if (row[1], row[7]) != key:
                    out += flight.land() if last else [(x[0], x[1]) for x in flight.open]
                    flight, key = Flight(), (row[1], row[7])
                out += flight.add(row, row[6], float(row[2]))
            yield _batch(out, b.schema)
            schema = b.schema
        if key is not None:
            yield _batch(flight.land() if last else [(x[0], x[1]) for x in flight.open], schema)

    return run


def _batch(rows: list[tuple[tuple, float]], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*[(*r[:6], float(p), r[7]) for r, p in rows], strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, schema, strict=True)], names=schema.names)


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, share: float = 1.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each document: doc_id, size (words), source_size, target, taken (words), copies.

    Words are ``[^\\x20\\x09-\\x0D]+``. Each source's sum of ``taken`` misses its target by what the best of
    the last subsets leaves, a few words for all but tiny sources. Nulls: a null text has no words, a null source is a source of its own (the
    last), a null id stays null. Documents without words are taken 0 times. Equal rows are decided each; choices
    depend on the rows alone, so reruns and other partitionings agree. Empty tables give empty results.
    """
    kind = "doc_id long, source string, size long, source_size long, target double, whole int, p double, block long"
    light = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    targets = source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, cap, share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        light.join(targets.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source")))
        .withColumn("rate", F.when(F.col("size") > 0, F.least(rate, F.lit(cap))).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("rate") + _NEAR).cast("int"))
        .withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n_docs") / BLOCK_DOCS)))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "p", "block")
    )
    most, everything = light.groupBy("source").count().agg(F.max("count"), F.sum("count")).first()
    blocks, parts, n_rows = -(-(most or 0) // BLOCK_DOCS), [], everything or 0
    while True:
        last = blocks <= 1
        order = ["source", "block", F.xxhash64("doc_id", "size"), "doc_id", "size", "p"]
        # a row is few bytes but much work: a task for some blocks, whatever their bytes
        flown = (
            rows.repartition(max(1, min(n_rows // BLOCK_DOCS, 64), n_rows // (64 * BLOCK_DOCS)), "source", "block")
            .sortWithinPartitions(*order)
            .mapInArrow(_fly(last), kind)
        )
        if last:
            parts.append(flown)
            break
        flown = stage(flown, "flight")
        parts.append(flown.where("p = 0 or p = 1"))
        rows = flown.where("p > 0 and p < 1").withColumn("block", F.col("block").cast("long") - F.pmod("block", F.lit(FAN_IN)))
        rows = rows.withColumn("block", (F.col("block") / FAN_IN).cast("long"))
        blocks, n_rows = -(-blocks // FAN_IN), n_rows * LANDING // BLOCK_DOCS
    settled = parts[0]
    for x in parts[1:]:
        settled = settled.unionByName(x)
    copies = (F.col("whole") + F.round("p").cast("int")).cast("long")
    return settled.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source")
