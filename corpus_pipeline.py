"""A corpus pipeline of five stages; each works on all that the stage before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``;
each stage's rows are written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.jaccard import jaccard_rows, row_key
from weftgraph.llm.keyfilter import with_may
from weftgraph.llm.langid import fit_languages, fold, identify_languages
from weftgraph.llm.mixing import mix_sources
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.queries import documents, small_batches, vocabulary
from weftgraph.llm.repeats import cut_repeats
from weftgraph.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document whose best language has a smaller share of the likelihood is rejected.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language: no letter, or no clear language, goes. A null lang is filled in."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    found = identify_languages(docs, fit_languages(docs.where(fold("doc_id", 4) != 2)))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def by_row(docs: DataFrame, chosen: DataFrame, key: F.Column) -> DataFrame:
    """Documents whose ``key`` (equal for equal rows) is in ``chosen`` (row_key, n and more); of n > 1 equal rows one."""
    keyed = docs.withColumn("row_key", key)
    single = keyed.join(chosen.where("n = 1").hint("shuffle_hash"), "row_key")
    repeated = chosen.where("n > 1")
    may = with_may(keyed, repeated.select(F.col("row_key").alias("key")), "row_key").where("may").drop("may")
    return single.unionByName(may.dropDuplicates(["row_key"]).join(repeated, "row_key"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group that links hold together: that with the smallest id, then by a hash of its text.

    Documents link from a Jaccard similarity of 0.8 up between their sets of five-word shingles. The choice is made
    by row: equal ids with different texts are judged by their texts, a null id comes after all others, and of
    equal rows one stays. Texts without words belong to no group and stay.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    found = stage(jaccard_rows(docs, 80, k=5), "groups")
    rows = found.where("root is not null").groupBy("root", "doc_id", "row_key").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "n")).alias("first"))
    kept = by_row(docs, first.select("first.row_key", "first.n"), row_key())
    return kept.select(*COLUMNS).unionByName(docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 200 bytes or more that start twice in the corpus; a document stays with what is left of it."""
    small_batches(spark)
    found = cut_repeats(docs.select(*COLUMNS), 200)
    left = found.withColumn("text", F.when((F.col("n_removed") > 0) | F.col("text").isNotNull(), F.col("kept_text")))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix says: rows are left out, or stand up to three times.

    The mix decides by row, whatever its id; what it takes of equal rows is taken of one of them.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    key = F.xxhash64(*COLUMNS)
    mixed = (
        mix_sources(docs.withColumn("row_key", key), id_col="row_key")
        .groupBy("doc_id")
        .agg(F.count("*").alias("n"), F.sum("copies").cast("int").alias("copies"))
    )
    taken = stage(mixed.where("copies > 0").withColumnRenamed("doc_id", "row_key"), "taken")
    return by_row(docs, taken, key).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows of 2048 tokens."""
    small_batches(spark)
    return pack_documents(docs, vocabulary(), 2048)


STAGES = [
    ("language identification", language),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", long_repeats),
    ("mixing sources", mixture),
    ("packing", packed),
]

#: Stages learn a model, follow links and draw a balanced sample: no SQL that DuckDB runs can express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = documents(spark, sf_dir)
    for k, (_name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage{k}")
    return docs
