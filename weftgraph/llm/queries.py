"""The registered queries of this package: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_texts
from .jaccard import jaccard_components
from .langid import fit_languages, fold, identify_languages
from .licenses import scan_licenses
from .media import media_columns
from .mixing import mix_sources
from .packing import pack_documents
from .quality import fit_quality, judge_quality
from .repeats import cut_repeats
from .sharding import shard_documents
from .tokens import decode_documents, encode_documents, piece_table
from .toxicity import fit_toxicity, score_toxicity
from .variants import count_words, variant_groups
from .vocabularies import rules

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Batches to Python hold few rows, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeats(documents(spark, sf_dir).select("doc_id", "text"), 200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 16)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = score_toxicity(docs, fit_toxicity(docs.where(fold("doc_id", 5) != 0), labels))
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), 90)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_languages(docs.where(fold("doc_id", 4) != 2))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir)).drop("folder")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(count_words(documents(spark, sf_dir), 6, 5, drop_every=199), 5)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    found = decode_documents(encode_documents(documents(spark, sf_dir), path), piece_table(spark, path), rules(path).joint)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_texts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))[0]


QUERIES: dict[str, Query] = {
    "op1_repeats": op1_repeats,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard": op8_jaccard,
    "op9_langid": op9_langid,
    "op10_media": op10_media,
    "op11_variants": op11_variants,
    "op12_bpe": op12_bpe,
    "op13_alignment": op13_alignment,
}

#: None of these can be expressed in SQL that DuckDB runs: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
