"""Ingest of uploaded text exports as one path: many files of unknown layout in a folder,
each with its own title lines, header and role.

1. ``numbered_lines``: every line with its file and its number there. The lines are staged
   as Parquet once, whose row index, with the prefix sums of the lines of a file's blocks,
   gives numbers that are the same on every evaluation and for every split of the input.
2. ``describe``: per file the header line (the one of the first ``HEAD_LINES`` with most
   header hints, the first of equals), its normalised names and the file's role. Everything
   is an aggregate by file; no file's contents reach the driver.
3. ``rows_of`` and ``role_feed``: the lines below the headers as maps from header to cell,
   in one scan for all layouts, and per role one frame with every header its files have,
   missing ones null, all strings.
4. ``status``: what was found for each role and which files were ignored.

A record is a line; a quoted cell may hold commas and doubled quotes, not line breaks. Short
lines give nulls, cells beyond the header are left out, lines of blank cells are dropped.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.session import shared_path

HEAD_LINES = 30
ROLES = ["sales", "market", "inventory"]  # in the order they are tried


def numbered_lines(spark: SparkSession, folder: str, file_of=None) -> DataFrame:
    """(file, line_no from 0, value) of all text files below a folder. ``file_of`` gives a
    file's path from that of a part, where files come in parts (in order of their paths).
    The table of blocks (one row for each block of the text) goes to every task, so the
    lines themselves are not shuffled."""
    staged = shared_path(spark, "upload-lines", uuid.uuid4().hex)
    text = spark.read.option("recursiveFileLookup", True).text(folder)
    text.select(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"), "value").write.parquet(staged)
    lines = spark.read.schema("part string, block long, value string").parquet(staged).select(
        "part", "block", "value", F.col("_metadata.file_path").alias("_staged"), F.col("_metadata.row_index").alias("_row"))
    blocks = lines.groupBy("part", "block", "_staged").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("part", "block", "_first").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("file", file_of(F.col("part")) if file_of else F.col("part"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(F.broadcast(blocks), ["part", "block", "_staged"]).select("file", (F.col("_before") + F.col("_row") - F.col("_first")).alias("line_no"), "value")


def cells(line: Column) -> Column:
    """The cells of a comma-separated line, quotes taken off."""
    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
    bare = lambda c: F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), '""', '"')
    return F.transform(found, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), bare(c)).otherwise(c))


def unique_names(header: Column) -> Column:
    """Header cells stripped and lower-cased; the i-th one (from 0), if blank, is col_i; a
    name already given gets the first free one of _2, _3 ..."""
    named = F.transform(header, lambda c, i: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.concat(F.lit("col_"), i.cast("string"))))

    def add(names: Column, name: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(2), F.size(names) + 2), lambda n: F.concat(name, F.lit("_"), n.cast("string")))
        free = F.get(F.filter(numbered, lambda x: ~F.array_contains(names, x)), F.lit(0))
        return F.concat(names, F.array(F.when(F.array_contains(names, name), free).otherwise(name)))
    return F.aggregate(named, F.array().cast("array<string>"), add)


def role_of(names: Column, file_name: Column) -> Column:
    """The first role that a header or the file's name hints at; null if none does."""
    out = F.lit(None).cast("string")
    for role in reversed(ROLES):
        by_header = F.arrays_overlap(names, F.array(*map(F.lit, dims.ROLE_HEADER_HINTS[role])))
        by_name = F.lit(False)
        for word in dims.ROLE_NAME_HINTS[role]:
            by_name = by_name | F.contains(F.lower(file_name), F.lit(word))
        out = F.when(by_header | by_name, F.lit(role)).otherwise(out)
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def describe(lines: DataFrame, name_of=file_name) -> DataFrame:
    """Per file: file, name, header_line, names, role, lines (below the header). ``name_of``
    gives a file's name from its path."""
    head = lines.where(F.col("line_no") < HEAD_LINES).select("file", "line_no", cells(F.col("value")).alias("cells"))
    hints = F.array(*map(F.lit, dims.HEADER_HINTS))
    score = F.size(F.filter("cells", lambda c: F.array_contains(hints, F.lower(F.trim(c)))))
    best = head.groupBy("file").agg(F.max_by(F.struct("line_no", "cells"), F.struct(score, -F.col("line_no"))).alias("best"))
    size = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    out = best.join(size, "file").select("file", name_of(F.col("file")).alias("name"), F.col("best.line_no").alias("header_line"),
                                         unique_names(F.col("best.cells")).alias("names"), (F.col("n") - F.col("best.line_no") - 1).alias("lines"))
    return out.withColumn("role", role_of(F.col("names"), F.col("name")))


def rows_of(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The lines below each recognised file's header: role, file, line_no, ``_row`` (number of
    the line among those of its role, from 1, files by name; lines of blank cells have
    numbers too) and ``cells``, a map from header to cell (empty: null)."""
    earlier = Window.partitionBy("role").orderBy("name", "file").rowsBetween(Window.unboundedPreceding, -1)
    known = files.where(F.col("role").isNotNull()).withColumn("_before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    below = lines.join(F.broadcast(known), "file").where(F.col("line_no") > F.col("header_line"))
    parts = below.select("role", "file", "line_no", "names", (F.col("_before") + F.col("line_no") - F.col("header_line")).alias("_row"), cells(F.col("value")).alias("_cells"))
    parts = parts.where(F.exists("_cells", lambda c: F.trim(c) != ""))
    padded = F.transform("names", lambda n, i: F.nullif(F.get(F.col("_cells"), i), F.lit("")))
    return parts.select("role", "file", "line_no", "_row", F.map_from_arrays("names", padded).alias("cells"))


def role_feed(rows: DataFrame, files: DataFrame, role: str) -> DataFrame:
    """One role's files under the union of their headers (in order of place, then name),
    all strings, with ``_row``. The headers are the only values collected."""
    names = files.where(F.col("role") == role).select(F.posexplode("names").alias("place", "name"))
    order = [r["name"] for r in names.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()]
    return rows.where(F.col("role") == role).select(*[F.try_element_at("cells", F.lit(n)).alias(n) for n in order], "_row")


def status(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per role (state ``loaded`` or ``missing``) and per file of no role (state
    ``ignored``): source, state, files, rows."""
    found = rows.groupBy("role").agg(F.count(F.lit(1)).alias("rows"))
    of_role = files.where(F.col("role").isNotNull()).groupBy("role").agg(F.count(F.lit(1)).alias("files"))
    roles = files.sparkSession.createDataFrame([(r,) for r in ROLES], "role string").join(of_role, "role", "left").join(found, "role", "left")
    roles = roles.select(F.col("role").alias("source"), F.when(F.col("files") > 0, F.lit("loaded")).otherwise(F.lit("missing")).alias("state"),
                         F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("rows", F.lit(0)).alias("rows"))
    ignored = files.where(F.col("role").isNull()).select(F.col("name").alias("source"), F.lit("ignored").alias("state"), F.lit(1).alias("files"), F.lit(0).alias("rows"))
    return roles.unionByName(ignored)
