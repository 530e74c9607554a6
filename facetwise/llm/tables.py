"""Row identity, written intermediate tables and connected components on Spark."""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.session import shared_path


def new_folder(spark: SparkSession, what: str) -> str:
    """A path that no other run uses, below the shared folder."""
    return shared_path(spark, f"llm-{what}-{uuid.uuid4().hex[:12]}")


def written(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage, survives lost
    executors and is computed once."""
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, *more: Column) -> DataFrame:
    """Only the columns an operator reads, so others cannot clash with its own."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *more)


def with_row_id(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """Adds ``name``, a struct that tells rows apart and stays the same when the frame
    is read again: file and row number. A frame that is not read from files is written
    to the shared folder first."""
    try:
        return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")))
    except AnalysisException:
        return with_row_id(spark, written(spark, docs, "rows"), name)


def components(spark: SparkSession, links: DataFrame, what: str) -> DataFrame:
    """Connected components of ``links(a long, b long)``: rows (node, root), root the
    smallest node reachable, for every node that has a link.

    Distributed union-find: each round hooks the root of every node to the smallest
    root among its neighbours, then halves paths. Nodes that hold many links are only
    pre-aggregated minima, never one row; each round is a written table."""
    both = written(spark, links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{what}-links")
    state = written(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), f"{what}-roots")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("near"))
        own = state.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        hooks = own.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        hooked = own.join(hooks.withColumnRenamed("node", "root"), "root").select("node", F.least("low", "hook").alias("up"), F.col("root").alias("was"))
        above = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = written(spark, hooked.join(above, "up", "left").select("node", F.least("up", F.coalesce("top", "up")).alias("root"), "was"), f"{what}-roots")
        moved = step.where("root <> was").limit(1).count()
        state = step.select("node", "root")
        if not moved:
            return state
