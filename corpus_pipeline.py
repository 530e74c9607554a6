"""Corpus pipeline: the stages a training corpus goes through, in order.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and reread as the next stage's documents. All
stages but the last return the columns of documents.

* quality rules: documents that the rules reject go.
* line dedup: of similar lines only the first stays; documents left without a line go.
* near duplicates: one document of each group of linked documents stays.
* benchmark decontamination: words of benchmark phrases are cut out of the texts.
* piece encoding: adds the piece ids, their count and checksum, and whether decoding them
  gives the text again.

Null texts count as empty, an empty table passes through as an empty one. A document
column with the name of an added one is replaced in the last stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm import decontaminate, line_dedup, ngram_join, piece_codec, quality_rules
from facetwise.llm.queries import TOKENIZERS
from facetwise.llm.tables import documents, written


def _with_text(found: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The rows carried in ``row``, with another text."""
    return found.select(*[found[text].alias(c) if c == "text" else found["row"][c].alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.quality_rules(spark, docs, labels, keep_rows=True).where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(spark, docs, keep_rows=True, k=line_dedup.SHINGLE).where("n_lines > n_removed or n_lines = 0")
    return _with_text(found, docs.columns, "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_group(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_text(decontaminate.decontaminate(spark, docs, benchmark, cleaned=True), docs.columns, "clean_text")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    added = ["n_pieces", "ids_crc32", "ids", "round_trip"]
    found = piece_codec.piece_codec(docs, f"{TOKENIZERS}/piece_bpe_32k.model", keep_rows=True)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("benchmark decontamination", decontaminated), ("piece encoding", encoded)]

#: The stages train models and search by signatures; SQL cannot state their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
