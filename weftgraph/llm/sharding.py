"""Contiguous shards of nearly equal bytes, from prefix sums over per-partition totals.

Rows are ordered by id. Range partitions hold neighbouring ids; each task runs through its sorted rows once and
notes the rows and bytes before each row within the partition. The totals of the partitions (one row each) give
every partition's start, and a row's place in the whole decides its shard. Only (id, size, checksum) rows move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, rows, size_sum = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = b.column("size").to_numpy(zero_copy_only=False)
        ends = size_sum + np.cumsum(size)
        n = len(size)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(ends - size)],
            names=[*b.schema.names, "part", "rows_before", "bytes_before"],
        )
        rows, size_sum = rows + n, int(ends[-1]) if n else size_sum


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``n_shards`` contiguous shards whose byte sums are nearly equal.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law ("bytes"), shard, slot (place within the shard, from 0)
    and grown_shard (null: the law is not ``key``). A row goes where the middle of its bytes falls among equal
    targets, so a shard misses its target by less than the size of one document at either cut.
    Nulls: a null text has size 1 and checksum 0; a null id sorts first. Repeated rows each get a slot of their
    own. Extra columns are not read. An empty table gives an empty result.
    """
    light = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("text_crc32"),
    )
    keys = ["doc_id", "text_crc32", "size"]
    spread = light.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(
        spread.mapInArrow(_running, "doc_id long, size long, text_crc32 long, part int, rows_before long, bytes_before long"), "placed"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    totals = (
        placed.groupBy("part")
        .agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        .select(
            "part",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_start"),
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_start"),
            F.sum("bytes").over(everything).alias("total"),
        )
    )
    cut = placed.join(F.broadcast(totals), "part").select(  # a row of four numbers for each task
        "doc_id", "size", "text_crc32",
        (F.col("rows_start") + F.col("rows_before")).alias("place"),
        F.expr(f"cast((2 * (bytes_start + bytes_before) + size) * {n_shards} div (2 * total) as int)").alias("shard"),
    )
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
