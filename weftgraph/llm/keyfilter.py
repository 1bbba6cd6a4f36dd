"""A filter of fixed size over 64-bit keys: rows that cannot have one of a table's keys need no shuffle to know.

It never loses a row; where a table has many more keys than the filter has bits it lets most rows through, and the
join behind it does all the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, and words of 64 bits that one of its rows holds, as powers of two: few long rows cost the driver and each executor far less than a row a word.
FILTER_BITS, ROW_WORDS = 24, 8


def key_filter(keys: DataFrame) -> DataFrame:
    """A filter of fixed size over a table's ``key``: rows (slab, masks), 2**10 at most of 2**8 words each, made by aggregation."""
    words = keys.select(*_place(F.col("key"))).groupBy("slab", "word").agg(F.bit_or("bit").alias("mask"))
    held = words.groupBy("slab").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("held"))
    every = F.sequence(F.lit(0), F.lit((1 << ROW_WORDS) - 1))
    return held.select("slab", F.transform(every, lambda i: F.coalesce(F.col("held")[i], F.lit(0).cast("long"))).alias("masks"))


def _place(key: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    h = F.xxhash64(key, F.lit("filter"))
    one = F.expr("1L")
    bit = F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int"))
    word = F.pmod(h, F.lit(1 << (FILTER_BITS - 6)))
    slab, word = F.shiftright(word, ROW_WORDS).cast("int"), F.pmod(word, F.lit(1 << ROW_WORDS)).cast("int")
    return slab.alias("slab"), word.alias("word"), bit.alias("bit")


def with_may(rows: DataFrame, keys: DataFrame, col: str = "key") -> DataFrame:
    """Column ``may`` tells which rows can have a ``key`` of the table in ``col``; rows without it need no shuffle to know."""
    slab, word, bit = _place(F.col(col))
    found = rows.withColumn("slab", slab).join(F.broadcast(key_filter(keys)), "slab", "left")
    return found.withColumn("may", F.coalesce(F.get("masks", word).bitwiseAND(bit) != 0, F.lit(False))).drop("slab", "masks")
