"""Evidence cohorts (optional pre-aggregated stock/sold/price table):
containment into the size master, per-cohort rates, enrichment, surplus
opportunities, label histograms, search and the colour x clarity roll-up.

The reference has no rule deriving demand/confidence labels; they are inputs
of the evidence table and are carried through unchanged (except the
low-sales override of the enrichment rule)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions.exprs import containing_range, parse_range_label, rnd, safe_div

EVIDENCE_SCHEMA = ("Shape string, EV_Size_Bucket string, Color string, Clarity string, EV_Stock long, EV_Sold long, "
                   "Stock_Metric double, Diamax_Sold long, Demand_Category string, Data_Confidence string, "
                   "Recommendation string, Reason string")

LOW_SALES_RECOMMENDATION = "Insufficient historical sales data"
LOW_SALES_REASON = "own_sales_below_5"


def with_master_range(ev: DataFrame) -> DataFrame:
    lo, hi = parse_range_label(F.col("EV_Size_Bucket"))
    return ev.withColumn("size_range", containing_range(lo, hi))


def evidence_rates(ev: DataFrame) -> DataFrame:
    """Mean Stock_Metric of the evidence rows contained in each cohort."""
    e = with_master_range(ev).where(F.col("size_range").isNotNull() & F.col("Stock_Metric").isNotNull())
    return e.groupBy("size_range", F.col("Shape").alias("shape"), F.col("Color").alias("color"),
                     F.col("Clarity").alias("clarity")).agg(F.avg("Stock_Metric").alias("ev_rate"))


def enrich(ev: DataFrame) -> DataFrame:
    stock, sold = F.coalesce(F.col("EV_Stock"), F.lit(0)), F.coalesce(F.col("EV_Sold"), F.lit(0))
    total = stock + sold
    st = F.coalesce(safe_div(sold.cast("double"), total.cast("double")), F.lit(0.0))
    low = F.coalesce(F.col("Diamax_Sold"), F.lit(0)) < 5
    return ev.withColumns({
        "Total_Inventory": total, "Total_Sold_Quantity": sold, "Available_Stock": stock,
        "Sales_Percentage": rnd(st * 100, 1),
        "Stock_Percentage": rnd(F.coalesce(safe_div(stock * 100.0, total.cast("double")), F.lit(0.0)), 1),
        "Sales_Velocity": sold,
        "Demand_Score": rnd(st * 100, 0),
        "Inventory_Risk_Score": rnd(F.coalesce(safe_div(stock * 100.0, total.cast("double")), F.lit(100.0)), 0),
        "Data_Confidence": F.when(low, F.lit("Low Confidence")).otherwise(F.col("Data_Confidence")),
        "Recommendation": F.when(low, F.lit(LOW_SALES_RECOMMENDATION)).otherwise(F.col("Recommendation")),
        "Reason": F.when(low, F.lit(LOW_SALES_REASON)).otherwise(F.col("Reason")),
    })


# Plan codes by upper bound of Sales_Percentage.
SURPLUS_PLANS = [(10, "sold_below_10"), (25, "sold_below_25"), (40, "sold_below_40"), (None, "sold_40_or_more")]


def surplus_opportunities(enriched: DataFrame, limit: int = 20) -> DataFrame:
    """Cohorts with >= 5 sales and more stock than sales; top-N by (excess, risk)."""
    sold, stock = F.col("Total_Sold_Quantity"), F.col("Available_Stock")
    pct = F.col("Sales_Percentage")
    plan = None
    for bound, text in SURPLUS_PLANS:
        if bound is None:
            plan = plan.otherwise(F.lit(text))
        else:
            plan = F.when(pct < bound, F.lit(text)) if plan is None else plan.when(pct < bound, F.lit(text))
    rows = enriched.where((sold >= 5) & (stock > sold)).select(
        F.col("Shape").alias("shape"), F.col("EV_Size_Bucket").alias("size_range"), F.col("Color").alias("color"),
        F.col("Clarity").alias("clarity"), sold.alias("sold"), stock.alias("remaining_stock"),
        (stock - sold).alias("excess_stock"), pct.alias("sales_pct"), F.col("Demand_Score").alias("demand_score"),
        F.col("Inventory_Risk_Score").alias("risk_score"), plan.alias("sell_plan"))
    return rows.orderBy(F.col("excess_stock").desc(), F.col("risk_score").desc(), "shape", "size_range", "color",
                        "clarity").limit(limit)


def label_histograms(enriched: DataFrame) -> DataFrame:
    """demand / confidence histograms zero-filled over the known labels, plus
    the open set of recommendation labels (one pass: unpivot then count)."""
    long = enriched.select(F.explode(F.array(
        F.struct(F.lit("demand").alias("histogram"), F.col("Demand_Category").alias("label")),
        F.struct(F.lit("confidence").alias("histogram"), F.col("Data_Confidence").alias("label")),
        F.struct(F.lit("actions").alias("histogram"), F.col("Recommendation").alias("label")))).alias("h")).select("h.*")
    counts = long.groupBy("histogram", "label").agg(F.count(F.lit(1)).alias("count"))
    spark = enriched.sparkSession
    known = spark.createDataFrame([("demand", x) for x in dims.DEMAND_LABELS] +
                                  [("confidence", x) for x in dims.CONFIDENCE_LABELS], "histogram string, label string")
    filled = F.broadcast(known).join(counts, ["histogram", "label"], "left").select(
        "histogram", "label", F.coalesce(F.col("count"), F.lit(0)).alias("count"))
    extra = counts.join(F.broadcast(known), ["histogram", "label"], "left_anti")
    return filled.unionByName(extra)


def recommendation_search(enriched: DataFrame, search: str | None, demand: str | None, confidence: str | None,
                          page: int = 1, page_size: int = 50) -> DataFrame:
    """Case-folded substring search + label equality; one page (explicit order)
    with the total of all matching rows as a scalar subquery."""
    df = enriched
    if search:
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
                                         ("Shape", "EV_Size_Bucket", "Color", "Clarity", "Recommendation")]))
        df = df.where(hay.contains(search.strip().lower()))
    if demand:
        df = df.where(F.col("Demand_Category") == demand)
    if confidence:
        df = df.where(F.col("Data_Confidence") == confidence)
    total = df.select(F.count(F.lit(1))).scalar()
    order = ["Shape", "EV_Size_Bucket", "Color", "Clarity"]
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size).withColumn("total", total)


def color_clarity_rollup(enriched: DataFrame) -> DataFrame:
    e = enriched.where(F.col("Color").isin(*dims.MATRIX_COLORS))
    g = e.groupBy(F.col("Color").alias("color"), F.col("Clarity").alias("clarity")).agg(
        F.sum("Total_Sold_Quantity").alias("sold"), F.sum("Available_Stock").alias("remaining_stock"),
        F.avg("Demand_Score").alias("_d"))
    pct = safe_div(F.col("sold") * 100.0, F.col("remaining_stock").cast("double"))
    p0 = F.coalesce(pct, F.lit(0.0))
    return g.select("color", "clarity", "sold", "remaining_stock", rnd(pct, 1).alias("sales_pct"),
                    rnd(F.col("_d"), 1).alias("demand_score"),
                    F.when(p0 < 20, F.lit("Overstock")).when(p0 < 40, F.lit("Slow Moving"))
                    .otherwise(F.lit("Healthy")).alias("inventory_status"))
