"""Registered queries of this folder: ``opN_<name>(spark, sf_dir)`` over whole tables."""
from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from facetwise.llm import cross_align, decontaminate, language_id, line_dedup, lm_scoring, ngram_join, periodic_runs, piece_codec, quality_rules, secret_scan, sharding, substring_dedup, token_output
from facetwise.llm.oracles import ORACLES  # noqa: F401
from facetwise.llm.tables import documents

#: Where the public tokenizers' files are; a name in it is a parameter of the operators.
TOKENIZERS = os.environ.get("FACETWISE_TOKENIZERS") or os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, documents(spark, sf_dir))


@query
def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_codec(documents(spark, sf_dir), f"{TOKENIZERS}/piece_bpe_32k.model")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(spark, documents(spark, sf_dir))


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(spark, documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(spark, documents(spark, sf_dir), f"{TOKENIZERS}/word_bpe_49k.json")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.decontaminate(spark, documents(spark, sf_dir), benchmark))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.quality_rules(spark, documents(spark, sf_dir), labels)


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(spark, documents(spark, sf_dir))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(spark, documents(spark, sf_dir), k=line_dedup.SHINGLE)


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(spark, documents(spark, sf_dir)))


@query
def op11_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align.cross_align(spark, documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(documents(spark, sf_dir), periodic_runs.tenth_repeats))


@query
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scoring(spark, documents(spark, sf_dir), f"{TOKENIZERS}/piece_bpe_32k.model")
