"""Dashboard filters as Column predicates.

Grades: ``ALL`` = no filter; ``EX_OR_IDEAL`` = EXCELLENT or IDEAL; ``3X`` =
EXCELLENT, and a cut of ``3X`` also forces polish and symmetry to EXCELLENT.
Country and growth type select the market benchmark and never filter
inventory. Attributes missing from a frame are skipped.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRADE_ATTRS = ["cut", "polish", "symmetry", "fluorescence", "lab", "country", "growth_type"]
MARKET_ONLY = {"country", "growth_type"}


def quality_predicate(columns: list[str], filters: dict[str, str], side: str = "market",
                      sales_grades: bool = False) -> Column:
    preds: list[Column] = []
    cols = set(columns)
    requested = {k: str(v or "ALL").upper() for k, v in filters.items()}

    def grade(attr: str) -> Column:
        if not sales_grades:
            return F.col(attr)
        u = F.upper(F.trim(F.col(attr).cast("string")))
        return F.when(u == "EX", F.lit("EXCELLENT")).when(u == "ID", F.lit("IDEAL")).otherwise(u)

    three_x = requested.get("cut") == "3X"
    for attr in GRADE_ATTRS:
        want = requested.get(attr, "ALL")
        if want == "ALL" or attr not in cols:
            continue
        if side == "inventory" and attr in MARKET_ONLY:
            continue
        value = grade(attr)
        if want == "EX_OR_IDEAL":
            preds.append(value.isin("EXCELLENT", "IDEAL"))
        else:
            preds.append(value == ("EXCELLENT" if want == "3X" else want))
    if three_x:
        for attr in ("polish", "symmetry"):
            if attr in cols:
                preds.append(grade(attr) == "EXCELLENT")
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def quality_filter(df: DataFrame, filters: dict[str, str], side: str = "market") -> DataFrame:
    return df.where(quality_predicate(df.columns, filters, side, sales_grades=(side == "sales")))


def shape_filter(df: DataFrame, shape: str | None) -> DataFrame:
    if not shape or shape.upper() == "ALL" or "shape" not in df.columns:
        return df
    return df.where(F.col("shape") == shape.upper())


def live_status_filter(df: DataFrame, side: str) -> DataFrame:
    """market keeps ON HAND, inventory AVAILABLE — only when a status column exists."""
    status = next((c for c in df.columns if c.strip().lower() == "status"), None)
    if status is None:
        return df
    want = "ON HAND" if side == "market" else "AVAILABLE"
    return df.where(F.upper(F.trim(F.col(status).cast("string"))) == want)
