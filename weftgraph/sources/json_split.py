"""Items of large JSON arrays and objects, of which several tasks read one file.

A file is read as the pieces between its commas, so Spark can split it anywhere. Whether a comma parts two items depends on all that comes
before it: is it inside a string, and how deep? Each split first says what it does to that state, for a start outside and for one inside a string; a
prefix over the splits (a row each) gives every split its true start. A second pass joins the pieces of each item, and items that a split
cuts are put together by their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage

#: What matters in a piece: an escaped sign is passed over, quotes and brackets count.
_SIGNS = re.compile(r'\\.|["\[\]{}]', re.DOTALL)


def _step(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a piece ends inside a string, and by how much deeper, from where it begins."""
    depth = 0
    for sign in _SIGNS.findall(text):
        if sign == '"':
            inside = not inside
        elif not inside and sign[0] != "\\":
            depth += 1 if sign in "[{" else -1
    return inside, depth


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: (flips, depth from outside, depth from inside)."""
    found: dict[tuple, list] = {}
    for b in batches:
        for file, block, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            now = found.setdefault((file, block), [False, 0, True, 0])
            now[0], more = _step(text, now[0])
            now[1] += more
            now[2], more = _step(text, now[2])
            now[3] += more
    rows = [(f, k, int(v[0]), v[1], v[3]) for (f, k), v in found.items()]
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "block", "flips", "outside", "inside"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each item of a split, joined: (file, block, nth item of the split, text). Every comma at depth one ends an item."""
    at, held, out = None, [], []
    inside, depth, nth = False, 0, 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "block", "nth", "text"])

    def close() -> None:
        if at is not None and (held or nth):
            out.append((*at, nth, ",".join(held) if held else None))  # no text: the split's last comma ended an item

    for b in batches:
        for file, block, text, started, deep in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, block) != at:
                close()
                at, held, inside, depth, nth = (file, block), [], bool(started), deep, 0
            held.append(text)
            inside, more = _step(text, inside)
            depth += more
            if not inside and depth == 1:
                close()
                held, nth = [], nth + 1
            if len(out) >= 1000:
                yield batch()
    close()
    yield batch()


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of JSON array or object files below ``path``: file, pos (from 0), item (its text; of objects ``"key": value``), n_items.

    Files are UTF-8 text of one array or object each; spaces around items are cut. An empty array, or a file that is none, has no items. One item must fit a
    task; a file need not.
    """
    block, file = F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_path").alias("file")
    pieces = spark.read.option("lineSep", ",").text(path).select(file, block, "value")
    effects = stage(pieces.mapInArrow(_effects, "file string, block long, flips int, outside long, inside long"), "effects")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = effects.withColumn("started", (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).cast("int"))
    starts = starts.withColumn("depth", F.coalesce(F.sum(F.when(F.col("started") == 0, F.col("outside")).otherwise(F.col("inside"))).over(before), F.lit(0)))
    told = pieces.join(F.broadcast(starts.select("file", "block", "started", "depth")), ["file", "block"])  # a row for each split
    parts = stage(told.select("file", "block", "value", "started", "depth").mapInArrow(_parts, "file string, block long, nth long, text string"), "parts")
    counts = parts.groupBy("file", "block").agg(F.max("nth").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.withColumn("last", F.max(F.col("first") + F.col("n")).over(Window.partitionBy("file")))
    whole = parts.where("text is not null").join(F.broadcast(counts.drop("n")), ["file", "block"])
    items = whole.groupBy("file", (F.col("first") + F.col("nth")).alias("pos"), "last").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("its"))
    items = items.select("file", "pos", "last", F.regexp_replace(F.array_join("its.text", ","), r"^[\s\uFEFF]+|\s+$", "").alias("text"))
    items = items.withColumn("text", F.when(F.col("pos") == 0, F.expr("substring(text, 2)")).otherwise(F.col("text")))
    items = items.withColumn("text", F.when(F.col("pos") == F.col("last"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text")))
    items = items.select("file", "pos", F.regexp_replace("text", r"^\s+|\s+$", "").alias("item"), (F.col("last") + 1).alias("n_items"))
    return items.where("item <> ''")
