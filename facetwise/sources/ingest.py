"""Ingest: header normalisation, feed roles, alias resolution, canonical listings.

Everything that inspects headers runs on ``df.columns`` (driver-side metadata,
no job); everything that touches values is a Column expression.
"""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions.exprs import canon_shape, clean_number, map_or_self, norm_text, parse_date, rnd
from facetwise.session import shared_path

LISTING_COLUMNS = ["stone_id", "shape", "carat", "color", "clarity", "cut", "polish", "symmetry", "fluorescence",
                   "lab", "growth_type", "country", "price"]


def normalize_headers(names: list[str]) -> list[str]:
    """strip + lower; the i-th header, if blank, is column_i (from 1); a name already
    given gets the first free one of _2, _3 ..."""
    out: list[str] = []
    for i, raw in enumerate(names, 1):
        name = str(raw or "").strip().lower() or f"column_{i}"
        free = (f"{name}_{n}" for n in range(2, len(names) + 2))
        out.append(name if name not in out else next(x for x in free if x not in out))
    return out


def detect_role(columns: list[str], filename: str = "") -> str | None:
    """The first of sales, market and inventory that a header or the file name hints at."""
    cols = {str(c).strip().lower() for c in columns}
    hinted = lambda role: cols & set(dims.ROLE_HEADER_HINTS[role]) or any(w in filename.lower() for w in dims.ROLE_NAME_HINTS[role])
    return next((role for role in ("sales", "market", "inventory") if hinted(role)), None)


def _first_present(columns: list[str], aliases: list[str]) -> str | None:
    by_lower = {c.strip().lower(): c for c in columns}
    return next((by_lower[a] for a in aliases if a in by_lower), None)


def sequential_index(df: DataFrame, name: str) -> DataFrame:
    """0-based row number by file path and place in the file, the same on every evaluation:
    the files' own row index plus prefix sums of their rows (one row per file). A frame
    that is not read from Parquet is written to the shared folder first."""
    try:
        tagged = df.withColumns({"_f": F.col("_metadata.file_path"), "_i": F.col("_metadata.row_index")})
        tagged.schema
    except AnalysisException:
        path = shared_path(df.sparkSession, "numbered", uuid.uuid4().hex)
        df.write.parquet(path)
        return sequential_index(df.sparkSession.read.schema(df.schema).parquet(path), name)
    before = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_f").agg((F.max("_i") + 1).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return tagged.join(offsets.select("_f", "_off"), "_f").withColumn(name, F.col("_off") + F.col("_i")).drop("_f", "_i", "_off")


def resolve_listing(df: DataFrame, role: str) -> DataFrame:
    """Rename the first present alias of every canonical column (market and
    inventory choose their own id/price aliases); synthesise ids, default the
    country and the price. An id is made from ``_row``, a stable row number that uploads
    bring with them."""
    id_key, price_key = ("market_id", "market_price") if role == "market" else ("inventory_id", "inventory_price")
    renames: dict[str, str] = {}
    for canon, aliases in dims.LISTING_ALIASES.items():
        if canon in ("market_id", "inventory_id") and canon != id_key:
            continue
        if canon in ("market_price", "inventory_price") and canon != price_key:
            continue
        source = _first_present(df.columns, aliases)
        if source is not None and source not in renames:
            target = {id_key: "stone_id", price_key: "price"}.get(canon, canon)
            renames[source] = target
    status = _first_present(df.columns, ["status"])
    if status is not None and status not in renames:
        renames[status] = "status"
    targets = set(renames.values())  # a column of such a name that is not the source is set aside
    out = df.select(*[F.col(f"`{c}`").alias(renames.get(c, f"{c}_other" if c in targets else c)) for c in df.columns])
    if "stone_id" not in out.columns:
        prefix = "VDB-" if role == "market" else "DMX-"
        out = out if "_row" in out.columns else sequential_index(out, "_row").withColumn("_row", F.col("_row") + 1)
        out = out.withColumn("stone_id", F.concat(F.lit(prefix), F.col("_row").cast("string")))
    if "country" not in out.columns:
        out = out.withColumn("country", F.lit("INDIA"))
    if "price" not in out.columns:
        out = out.withColumn("price", F.lit(1000.0))
    else:
        out = out.withColumn("price", F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)))
    return out


def canonicalize(df: DataFrame) -> DataFrame:
    """Value canonicalisation of a resolved listing (carat 2 dp, shape codes,
    grade / fluorescence / country maps, upper-cased text)."""
    cols = set(df.columns)
    exprs: dict[str, Column] = {}
    if "carat" in cols:
        exprs["carat"] = rnd(F.col("carat").try_cast("double"), 2)
    if "shape" in cols:
        exprs["shape"] = canon_shape("shape")
    for c in ("color", "clarity", "lab"):
        if c in cols:
            exprs[c] = norm_text(c)
    for c in ("cut", "polish", "symmetry"):
        if c in cols:
            exprs[c] = map_or_self(dims.CUT_MAP, c)
    if "fluorescence" in cols:
        exprs["fluorescence"] = map_or_self(dims.FLUORESCENCE_MAP, "fluorescence")
    if "country" in cols:
        exprs["country"] = map_or_self(dims.COUNTRY_MAP, "country")
    return df.withColumns(exprs) if exprs else df


def canonical_listings(raw: DataFrame, role: str) -> DataFrame:
    out = canonicalize(resolve_listing(raw, role))
    keep = [c for c in LISTING_COLUMNS if c in out.columns]
    rest = [c for c in out.columns if c not in keep and c != "_row"]
    return out.select(*keep, *rest)


# ---------------------------------------------------------------- sales lines

SALE_COLUMNS = ["invoice", "stone", "sale_date", "shape", "color", "clarity", "carat", "amount", "rate"]


def resolve_sales(df: DataFrame) -> DataFrame:
    """Sale lines with canonical names, each the first of its candidate columns that has a
    value; carat/amount/rate cleaned to doubles,
    the sale date parsed, shape canonicalised like listings (always), color and
    clarity upper-cased."""
    by_lower = {c.strip().lower(): c for c in df.columns}
    taken: dict[str, list[str]] = {}
    for canon, aliases in dims.SALES_ALIASES.items():
        used = {c for cs in taken.values() for c in cs}
        there = [by_lower[a] for a in aliases if a in by_lower and by_lower[a] not in used]
        if there:
            taken[canon] = there
    first = {cs[0] for cs in taken.values()}
    value = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(f"`{c}`")
    out = df.select(*[(F.coalesce(*map(value, cs)) if len(cs) > 1 else F.col(f"`{cs[0]}`")).alias(canon) for canon, cs in taken.items()],
                    *[F.col(f"`{c}`") for c in df.columns if c not in first and c not in taken])
    types = dict(out.dtypes)
    exprs: dict[str, Column] = {}
    if "shape" in types:
        exprs["shape"] = canon_shape("shape")
    for c in ("color", "clarity"):
        if c in types:
            exprs[c] = norm_text(c)
    for c in ("carat", "amount", "rate"):
        if c in types:
            exprs[c] = F.col(c) if types[c] == "double" else clean_number(c)
    if "sale_date" in types:
        exprs["sale_date"] = parse_date("sale_date", types["sale_date"])
    out = out.withColumns(exprs)
    keep = [c for c in SALE_COLUMNS if c in out.columns]
    return out.select(*keep, *[c for c in out.columns if c not in keep])
