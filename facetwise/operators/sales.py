"""Sales and stock cohorts (size range x shape x color x clarity) and the
reports built on them. Every cohort table is one partial+final hash
aggregate; joins between cohort tables are between pre-aggregated sides."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions.exprs import rnd, safe_div, size_range, truthy
from facetwise.functions.stats import keep_last

COHORT = dims.COHORT_KEYS


def dedupe_sales(sales: DataFrame, order: list[str]) -> DataFrame:
    """Keep the last line per (invoice, stone) when both columns exist."""
    if "invoice" in sales.columns and "stone" in sales.columns:
        return keep_last(sales, ["invoice", "stone"], order)
    return sales


def dedupe_sales_fallback(sales: DataFrame, order: list[str]) -> DataFrame:
    """Keys (invoice, stone), else (stone, sale_date), else no dedupe."""
    cols = set(sales.columns)
    if {"invoice", "stone"} <= cols:
        return keep_last(sales, ["invoice", "stone"], order)
    if {"stone", "sale_date"} <= cols:
        return keep_last(sales, ["stone", "sale_date"], order)
    return sales


def sale_value(df: DataFrame) -> Column:
    """amount, else rate x carat, else 0."""
    amount = F.col("amount") if "amount" in df.columns else F.lit(None).cast("double")
    rate = F.col("rate") if "rate" in df.columns else F.lit(None).cast("double")
    return F.coalesce(amount, rate * F.col("carat"), F.lit(0.0))


def _nonblank(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def binned_sales(sales: DataFrame) -> DataFrame:
    """Sale lines with a size range (un-rounded carat) and a value; lines with a
    zero/missing carat, outside every range or with a blank key are dropped."""
    df = sales.where(truthy(F.col("carat"))).withColumns(
        {"size_range": size_range(F.col("carat")), "value": sale_value(sales)})
    return df.where(F.col("size_range").isNotNull() & _nonblank("shape") & _nonblank("color") & _nonblank("clarity"))


def sales_cohorts(sales_deduped: DataFrame) -> DataFrame:
    """Raw sums: sold_stones, sold_carats, sales_value per cohort."""
    return binned_sales(sales_deduped).groupBy(*COHORT).agg(
        F.count(F.lit(1)).alias("sold_stones"), F.sum("carat").alias("sold_carats"),
        F.sum("value").alias("sales_value"))


def stock_cohorts(matched: DataFrame) -> DataFrame:
    """Inventory cohorts with conditional market sums (only where matched)."""
    df = matched.withColumn("size_range", size_range(F.col("carat"))).where(F.col("size_range").isNotNull())
    has = F.col("market_bottom_price").isNotNull()
    return df.groupBy(*COHORT).agg(
        F.count(F.lit(1)).alias("stock_pcs"), F.sum("carat").alias("stock_carats"),
        F.sum(F.coalesce(F.col("price"), F.lit(0.0))).alias("stock_value"),
        F.sum(F.when(has, F.col("market_bottom_price")).otherwise(F.lit(0.0))).alias("market_value"),
        F.sum(F.when(has, F.col("carat")).otherwise(F.lit(0.0))).alias("market_carats"))


def _rate(num: Column, den: Column) -> Column:
    r = safe_div(num, den)
    return F.when(truthy(r), rnd(r, 2))


def stock_sales_cohorts(stock: DataFrame, sales: DataFrame) -> DataFrame:
    """FULL OUTER join of stock and sales cohorts with rates and sales %."""
    j = stock.join(sales, COHORT, "full")
    stock_pcs = F.coalesce(F.col("stock_pcs"), F.lit(0))
    sold = F.coalesce(F.col("sold_stones"), F.lit(0))
    return j.select(
        *COHORT,
        stock_pcs.alias("stock_pcs"), sold.alias("sold_pcs"),
        F.when(stock_pcs > 0, rnd(sold / stock_pcs * 100.0, 1)).alias("sales_pct"),
        _rate(F.col("stock_value"), F.col("stock_carats")).alias("current_rate"),
        _rate(F.col("sales_value"), F.col("sold_carats")).alias("historical_rate"),
        _rate(F.col("market_value"), F.col("market_carats")).alias("vdb_rate"),
    )


def size_master_frame(spark) -> DataFrame:
    rows = [(i, label, lo, hi) for i, (label, lo, hi) in enumerate(dims.SIZE_MASTER)]
    return spark.createDataFrame(rows, "ordinal int, size_range string, lo double, hi double")


def size_distribution(spark, cohorts: DataFrame) -> DataFrame:
    """All 63 ranges, zero-filled, rounded."""
    per_range = cohorts.groupBy("size_range").agg(
        F.sum("sold_stones").alias("s"), F.sum("sold_carats").alias("c"), F.sum("sales_value").alias("v"))
    sm = F.broadcast(size_master_frame(spark))  # 63 fixed rows
    j = sm.join(per_range, "size_range", "left")
    return j.select("ordinal", "size_range",
                    F.coalesce(F.col("s"), F.lit(0)).cast("long").alias("sold_stones"),
                    rnd(F.coalesce(F.col("c"), F.lit(0.0)), 2, wide=True).alias("sold_carats"),
                    rnd(F.coalesce(F.col("v"), F.lit(0.0)), 2, wide=True).alias("sales_value"))


def size_heat(distribution: DataFrame) -> DataFrame:
    """sold / max(sold over all ranges, floor 1); the window spans the 63 fixed rows."""
    w = Window.partitionBy(F.lit(1))
    return distribution.withColumn(
        "heat", rnd(F.col("sold_stones") / F.greatest(F.max("sold_stones").over(w), F.lit(1)), 4))


def shape_stock_vs_sales(matched: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Per shape: stock pcs/weight/amount (all matched stock) vs sales
    pcs/weight/amount (cohorts with a non-blank shape); FULL OUTER on shape."""
    stock = matched.groupBy("shape").agg(
        F.count(F.lit(1)).alias("stock_pcs"), F.sum("carat").alias("sw"), F.sum("price").alias("sa"))
    sold = cohorts.where(_nonblank("shape")).groupBy("shape").agg(
        F.sum("sold_stones").alias("sales_pcs"), F.sum("sold_carats").alias("lw"), F.sum("sales_value").alias("la"))
    return shape_report(stock.join(sold, "shape", "full"))


def shape_report(j: DataFrame) -> DataFrame:
    sp = F.coalesce(F.col("stock_pcs"), F.lit(0)).cast("long")
    lp = F.coalesce(F.col("sales_pcs"), F.lit(0)).cast("long")
    sw, sa = F.coalesce(F.col("sw"), F.lit(0.0)), F.coalesce(F.col("sa"), F.lit(0.0))
    lw, la = F.coalesce(F.col("lw"), F.lit(0.0)), F.coalesce(F.col("la"), F.lit(0.0))
    return j.select(
        "shape", sp.alias("stock_pcs"), rnd(sw, 2, True).alias("stock_weight"),
        F.when(sw != 0, rnd(sa / sw, 2)).otherwise(F.lit(0.0)).alias("stock_rate"),
        rnd(sa, 2, True).alias("stock_amount"), lp.alias("sales_pcs"), rnd(lw, 2, True).alias("sales_weight"),
        F.when(lw != 0, rnd(la / lw, 2)).otherwise(F.lit(0.0)).alias("sales_rate"),
        rnd(la, 2, True).alias("sales_amount"),
        F.when(sp > 0, rnd(lp / sp * 100.0, 1)).otherwise(F.lit(0.0)).alias("sales_percentage"))


def shape_report_rollup(matched: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Per-shape rows plus a grand-total row (shape 'TOTAL') with ratios
    recomputed from the summed parts (GROUPING SETS via rollup)."""
    stock = matched.groupBy("shape").agg(
        F.count(F.lit(1)).alias("stock_pcs"), F.sum("carat").alias("sw"), F.sum("price").alias("sa"))
    sold = cohorts.where(_nonblank("shape")).groupBy("shape").agg(
        F.sum("sold_stones").alias("sales_pcs"), F.sum("sold_carats").alias("lw"), F.sum("sales_value").alias("la"))
    j = stock.join(sold, "shape", "full")
    rolled = j.rollup("shape").agg(
        F.sum("stock_pcs").alias("stock_pcs"), F.sum("sw").alias("sw"), F.sum("sa").alias("sa"),
        F.sum("sales_pcs").alias("sales_pcs"), F.sum("lw").alias("lw"), F.sum("la").alias("la"),
        F.grouping("shape").alias("_g"))
    rolled = rolled.withColumn("shape", F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("shape")))
    return shape_report(rolled)


def shape_extremes(report: DataFrame) -> DataFrame:
    """Best and riskiest shape by sales % (ties -> alphabetically first)."""
    r = report.where(F.col("shape") != "TOTAL")
    return r.agg(
        F.min(F.struct((-F.col("sales_percentage")).alias("k"), F.col("shape").alias("s"))).getField("s").alias("best_shape"),
        F.max("sales_percentage").alias("best_sales_pct"),
        F.min(F.struct(F.col("sales_percentage").alias("k"), F.col("shape").alias("s"))).getField("s").alias("riskiest_shape"),
        F.min("sales_percentage").alias("riskiest_sales_pct"))


def top_bottom_sellers(cohorts: DataFrame, k: int = 10) -> DataFrame:
    """Top-k and bottom-k sales cohorts by pieces (ties by cohort key)."""
    keyed = cohorts.select(*COHORT, "sold_stones", rnd(F.col("sold_carats"), 2, True).alias("sold_carats"),
                           rnd(F.col("sales_value"), 2, True).alias("sales_value"))
    top = keyed.withColumn("list", F.lit("top")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("list").orderBy(F.col("sold_stones").desc(), *COHORT)))
    bottom = keyed.withColumn("list", F.lit("bottom")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("list").orderBy(F.col("sold_stones").asc(), *COHORT)))
    return top.where(F.col("rank") <= k).unionByName(bottom.where(F.col("rank") <= k))


def cohort_key_union(stock: DataFrame, sales: DataFrame) -> DataFrame:
    return stock.select(*COHORT).union(sales.select(*COHORT)).distinct()


def available_shapes(*frames: DataFrame) -> DataFrame:
    """Distinct non-blank canonical shapes across sources, preferred order
    first then alphabetical (ordinal column)."""
    u = None
    for f in frames:
        s = f.select(F.upper(F.trim(F.col("shape"))).alias("shape"))
        u = s if u is None else u.union(s)
    u = u.where(_nonblank("shape")).distinct()
    pref = F.create_map(*[x for i, s in enumerate(dims.PREFERRED_SHAPE_ORDER) for x in (F.lit(s), F.lit(i))])
    idx = F.coalesce(F.try_element_at(pref, F.col("shape")), F.lit(len(dims.PREFERRED_SHAPE_ORDER)))
    w = Window.partitionBy(F.lit(1)).orderBy(idx, F.col("shape"))
    # the distinct shape set is small (bounded by the shape vocabulary)
    return u.withColumn("ordinal", F.row_number().over(w))


def headline_metrics(cohorts: DataFrame, inventory_rows: DataFrame, raw_sales_rows: DataFrame) -> DataFrame:
    """Headline sales cards: three global aggregates folded into one row."""
    none = F.lit(None).cast("double")
    parts = cohorts.agg(F.sum("sold_stones").cast("double").alias("n"), F.sum("sold_carats").alias("w"),
                        F.sum("sales_value").alias("v"), none.alias("inv"), none.alias("raw"))
    parts = parts.unionByName(inventory_rows.agg(none.alias("n"), none.alias("w"), none.alias("v"),
                                                 F.count(F.lit(1)).cast("double").alias("inv"), none.alias("raw")))
    parts = parts.unionByName(raw_sales_rows.agg(none.alias("n"), none.alias("w"), none.alias("v"), none.alias("inv"),
                                                 F.count(F.lit(1)).cast("double").alias("raw")))
    one = parts.agg(*[F.max(c).alias(c) for c in ("n", "w", "v", "inv", "raw")])
    n = F.coalesce(F.col("n"), F.lit(0.0)).cast("long")
    return one.select(
        F.when(n > 0, n).otherwise(F.col("raw").cast("long")).alias("sales_records"),
        rnd(F.coalesce(F.col("w"), F.lit(0.0)), 2, True).alias("sales_carats"),
        rnd(F.coalesce(F.col("v"), F.lit(0.0)), 2, True).alias("sales_value"),
        F.coalesce(F.col("inv"), F.lit(0.0)).cast("long").alias("ev_stock"), n.alias("ev_sold"))
