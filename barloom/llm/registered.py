"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_transducer, html_extract, language_id, ngram_join, packing, paragraph_dedup, periodic_runs, projection_join, quality_rules, sharding, spelling_variants, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.dedup_paragraphs(table(spark, sf_dir, "documents"))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_transducer.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.classify_documents(table(spark, sf_dir, "documents"))


def op8_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_projection_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op11_letter_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_seeded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_suffix_repetition, op2_rendezvous_sharding, op3_best_fit_packing, op4_url_vocabulary, op5_paragraph_minhash, op6_bpe_transducer, op7_compression_language,
        op8_prefix_tree_join, op9_projection_collisions,
        op10_dom_trees, op11_letter_trees, op12_toxic_segments, op13_seeded_runs,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_repetition": quality_rules.SQL, "op2_rendezvous_sharding": sharding.SQL, "op4_url_vocabulary": url_filter.SQL,
    "op8_prefix_tree_join": ngram_join.SQL, "op11_letter_trees": spelling_variants.SQL, "op13_seeded_runs": periodic_runs.SQL,
}
