"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, media, mixing, neighbours, ngram_join, packing, pii, quality, repeats, token_counts
from tessera.llm.common import documents


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents labelled good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), trusted(spark, sf_dir))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.media_columns(documents(spark, sf_dir)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_personal_data, op2_ngram_jaccard_join, op3_source_mix, op4_quality_classifier, op5_best_fit_packing, op6_media_columns, op7_language_id, op8_nearest_neighbours, op9_repeated_passages, op10_token_counts)}
ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard_join": ngram_join.ORACLE, "op3_source_mix": mixing.ORACLE, "op9_repeated_passages": repeats.ORACLE}
