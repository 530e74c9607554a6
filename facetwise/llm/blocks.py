"""Corpus-wide values of a document's parts, looked up by block.

A block is a slice of one partition's texts of bounded bytes (one text at least). Each
distinct part of a block (a word, a pair of ids) is one row, so what is shuffled by part
is far less than its occurrences and no part has more rows than there are blocks. The
values found come back to the block's documents by a co-grouped shuffle on the block.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from facetwise.llm import textkit as K

BLOCK_BYTES = 4 << 20


def numbered(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.RecordBatch, pa.Array]]:
    """(block, rows, their texts); a block's number is its partition's and its own there.
    The numbers are only fixed once the rows made from them are a written table."""
    here = TaskContext.get().partitionId() << 32
    for i, (rows, texts) in enumerate(K.slices(batches, limit=limit)):
        yield here | i, rows, texts


def with_values(docs: DataFrame, values: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(documents of a block, its values)``, both Arrow tables, over all blocks."""
    values = values.withColumnRenamed("block", "of_block")  # both may come from one table
    return docs.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(fn, schema)
