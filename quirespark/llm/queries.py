"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, class_lm, exact_dedup, language_id, license_scan, media, packing, repeated_windows, simhash_dedup, spelling_variants, sql, token_alignment, token_counts, toxicity
from .common import id_remainder


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    verdict = index.ingest(_documents(spark, sf_dir))
    index.close()
    return verdict


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: they are filed by number, a thousand to a directory and twenty to each of
    its own, where every twentieth is the licence file, every thousandth that of the directory above."""
    number = F.col("doc_id")
    top, below = F.floor(number / 1000).cast("string"), F.floor(number / 20).cast("string")
    path = (
        F.when(number % 1000 == 0, F.concat(F.lit("shelf/"), top, F.lit("/LICENSE")))
        .when(number % 20 == 0, F.concat(F.lit("shelf/"), top, F.lit("/"), below, F.lit("/LICENSE")))
        .otherwise(F.concat(F.lit("shelf/"), top, F.lit("/"), below, F.lit("/"), number.cast("string"), F.lit(".txt")))
    )
    return license_scan.scan(_documents(spark, sf_dir).withColumn("path", path))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = id_remainder("doc_id", 4) == 2
    model = toxicity.fit(docs.where(~held_out), _labels(spark, sf_dir))
    return toxicity.score(docs, model, held_out=held_out)


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(_documents(spark, sf_dir), held_out=id_remainder("doc_id", 7) == 2)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = id_remainder("doc_id", 4) == 2
    return language_id.identify(docs, language_id.fit(docs.where(~held_out)), held_out=held_out)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(_documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.to_media(_documents(spark, sf_dir)))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows.removal_digests(_documents(spark, sf_dir))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(_documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(_documents(spark, sf_dir))


_ALL = (
    op1_token_counts, op2_simhash_near_dedup, op3_exact_dedup, op4_license_scan, op5_toxicity, op6_class_lm,
    op7_best_fit_packing, op8_language_id,
    op9_bpe_round_trip, op10_media_columns, op11_substring_dedup,
    op12_tokenizer_alignment, op13_spelling_variants,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
