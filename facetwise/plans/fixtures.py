"""Evidence table derived from the feeds (the reference's optional prepared
evidence file is absent, so a deterministic one is derived from the same
tables): per (shape, exact carat bucket "c-c", color, clarity) the market's
mean per-carat price, own stock count and own sales count. The label columns
are a property of this fixture (a simple band rule), not of the engine."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwise.functions.exprs import rnd
from facetwise.plans import base
from facetwise.plans import sqlparts as S

EV_KEYS = ["shape", "carat", "color", "clarity"]


def _sell_through(sold, stock):
    return F.when(stock + sold > 0, sold * 100.0 / (stock + sold)).otherwise(F.lit(0.0))


def evidence(spark, d) -> DataFrame:
    from facetwise.sources.snapshots import snapshot
    return snapshot(spark, d, "evidence", build_evidence)


def build_evidence(spark, d) -> DataFrame:
    m = base.market(spark, d).where((F.col("price") > 0) & (F.col("carat") > 0))
    for k in EV_KEYS:
        m = m.where(F.col(k).isNotNull())
    mk = m.groupBy(*EV_KEYS).agg(rnd(F.avg(F.col("price") / F.col("carat")), 2).alias("Stock_Metric"))
    inv = base.inventory(spark, d).groupBy(*EV_KEYS).agg(F.count(F.lit(1)).alias("EV_Stock"))
    sl = base.sales_last(spark, d).withColumn("carat", rnd(F.col("carat"), 2))
    sold = sl.groupBy(*EV_KEYS).agg(F.count(F.lit(1)).alias("EV_Sold"))
    ev = mk.join(inv, EV_KEYS, "left").join(sold, EV_KEYS, "left")
    stock, sold_n = F.coalesce(F.col("EV_Stock"), F.lit(0)), F.coalesce(F.col("EV_Sold"), F.lit(0))
    st = _sell_through(sold_n, stock)
    return ev.select(
        F.col("shape").alias("Shape"), F.format_string("%.2f-%.2f", F.col("carat"), F.col("carat")).alias("EV_Size_Bucket"),
        F.col("color").alias("Color"), F.col("clarity").alias("Clarity"), stock.alias("EV_Stock"),
        sold_n.alias("EV_Sold"), F.col("Stock_Metric"), sold_n.alias("Diamax_Sold"),
        F.when(st >= 60, F.lit("Excellent Demand")).when(st >= 40, F.lit("Good Demand"))
        .when(st >= 20, F.lit("Average Demand")).when(st > 0, F.lit("Slow Moving"))
        .otherwise(F.lit("Dead Inventory")).alias("Demand_Category"),
        F.when(sold_n >= 10, F.lit("High Confidence")).when(sold_n >= 5, F.lit("Medium Confidence"))
        .otherwise(F.lit("Low Confidence")).alias("Data_Confidence"),
        F.when(st >= 60, F.lit("Increase price")).when(st >= 40, F.lit("Hold price"))
        .otherwise(F.lit("Reduce price")).alias("Recommendation"),
        F.lit("Derived from feed cohort counts").alias("Reason"))


KS = ", ".join(EV_KEYS)
S.add("evidence", ["market", "inventory", "sales_d"], f"""SELECT shape AS "Shape", printf('%.2f-%.2f', carat, carat) AS "EV_Size_Bucket",
    color AS "Color", clarity AS "Clarity", stock AS "EV_Stock", sold AS "EV_Sold", "Stock_Metric", sold AS "Diamax_Sold",
    CASE WHEN st >= 60 THEN 'Excellent Demand' WHEN st >= 40 THEN 'Good Demand' WHEN st >= 20 THEN 'Average Demand'
      WHEN st > 0 THEN 'Slow Moving' ELSE 'Dead Inventory' END AS "Demand_Category",
    CASE WHEN sold >= 10 THEN 'High Confidence' WHEN sold >= 5 THEN 'Medium Confidence' ELSE 'Low Confidence' END AS "Data_Confidence",
    CASE WHEN st >= 60 THEN 'Increase price' WHEN st >= 40 THEN 'Hold price' ELSE 'Reduce price' END AS "Recommendation",
    'Derived from feed cohort counts' AS "Reason"
  FROM (SELECT mk.*, coalesce(i.n, 0) AS stock, coalesce(s.n, 0) AS sold,
      CASE WHEN coalesce(i.n, 0) + coalesce(s.n, 0) > 0 THEN coalesce(s.n, 0) * 100.0 / (coalesce(i.n, 0) + coalesce(s.n, 0)) ELSE 0.0 END AS st
    FROM (SELECT {KS}, {S.rnd('avg(price / carat)')} AS "Stock_Metric" FROM market
          WHERE price > 0 AND carat > 0 AND shape IS NOT NULL AND carat IS NOT NULL AND color IS NOT NULL AND clarity IS NOT NULL
          GROUP BY {KS}) mk
    LEFT JOIN (SELECT {KS}, count(*) AS n FROM inventory GROUP BY {KS}) i ON {S.eqj('mk', 'i', EV_KEYS)}
    LEFT JOIN (SELECT shape, {S.rnd('carat')} AS carat, color, clarity, count(*) AS n FROM sales_d GROUP BY ALL) s
      ON {S.eqj('mk', 's', EV_KEYS)}) t""")
