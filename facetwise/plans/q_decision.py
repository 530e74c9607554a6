"""Decision matrix family."""
from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.operators import decision as DM
from facetwise.plans import sqlparts as S
from facetwise.plans.q_sales import sales_deduped, stock_sales_df
from facetwise.plans.registry import register

COH = ", ".join(dims.COHORT_KEYS)
D = "CAST({} AS DOUBLE)"


def t(e: str) -> str:
    """truthy"""
    return f"coalesce(({e}) <> 0, false)"


def b(e: str) -> str:
    return f"CAST({t(e)} AS INTEGER)"


S.add("trail_counts", ["sales_d"], f"""SELECT {COH},
    count(*) FILTER (WHERE sale_date >= latest - 30) AS sales_30,
    count(*) FILTER (WHERE sale_date >= latest - 90) AS sales_90,
    count(*) FILTER (WHERE sale_date >= latest - 180) AS sales_180
  FROM (SELECT *, {S.size_range('carat')} AS size_range FROM sales_d WHERE sale_date IS NOT NULL AND carat IS NOT NULL) s,
       (SELECT max(sale_date) AS latest FROM sales_d WHERE sale_date IS NOT NULL AND carat IS NOT NULL) m
  WHERE size_range IS NOT NULL GROUP BY {COH}""")
S.add("dm0", ["stock_sales", "trail_counts"], f"""SELECT r.*, coalesce(t.sales_30, 0) AS sales_30, coalesce(t.sales_90, 0) AS sales_90,
    coalesce(t.sales_180, 0) AS sales_180
  FROM stock_sales r LEFT JOIN trail_counts t ON {S.eqj('r', 't', dims.COHORT_KEYS)}""")


def velocity_sql(src: str) -> str:
    return f"""SELECT *, CASE WHEN monthly <> 0 THEN stock_pcs / monthly END AS ratio_raw,
    CASE WHEN daily <> 0 THEN stock_pcs / daily END AS doi_raw FROM (
    SELECT *, CASE WHEN sales_90 <> 0 THEN sales_90 / CAST(3 AS DOUBLE) ELSE 0.0 END AS monthly,
      CASE WHEN sales_30 <> 0 THEN sales_30 / CAST(30 AS DOUBLE) ELSE 0.0 END AS daily,
      CASE WHEN sales_90 <> 0 THEN (sales_30 * 3 - sales_90) / CAST(sales_90 AS DOUBLE) ELSE 0.0 END AS trend
    FROM {src}) v"""


S.add("dm1", ["dm0"], velocity_sql("dm0"))
CONF = (f"least(100, CASE WHEN sales_90 > 0 THEN 40 WHEN {t('historical_rate')} THEN 20 ELSE 0 END + {b('vdb_rate')} * 30 "
        f"+ {b('stock_pcs')} * 10 + CAST({t('historical_rate')} OR {t('vdb_rate')} AS INTEGER) * 10 + CAST(sales_180 > 0 AS INTEGER) * 10)")


def recommend_sql(src: str) -> str:
    wsum = f"({b('historical_rate')} * 0.45 + {b('vdb_rate')} * 0.35 + {b('current_rate')} * 0.20)"
    vsum = (f"(CASE WHEN {t('historical_rate')} THEN historical_rate * 0.45 ELSE 0.0 END + CASE WHEN {t('vdb_rate')} "
            f"THEN vdb_rate * 0.35 ELSE 0.0 END + CASE WHEN {t('current_rate')} THEN current_rate * 0.20 ELSE 0.0 END)")
    return f"""SELECT *, {S.rnd('ai_')} AS ai_rate, CASE WHEN ai_ IS NULL THEN 'Manual Review' WHEN confidence < 40 THEN 'Manual Review'
      WHEN gap_ > 1 AND (p_ > 1.2 OR coalesce(sales_pct, 0.0) < 50) THEN 'Reduce (' || CAST(mv_ AS VARCHAR) || '%)'
      WHEN gap_ < -1 AND (p_ < 0.5 OR coalesce(sales_pct, 0.0) > 100) THEN 'Increase (+' || CAST(mv_ AS VARCHAR) || '%)'
      WHEN p_ > 2 THEN 'Promote' WHEN sales_90 = 0 THEN 'Monitor' ELSE 'Hold' END AS action,
    CASE WHEN ai_ IS NULL THEN 'no_evidence' WHEN confidence < 40 THEN 'low_confidence'
      WHEN gap_ > 1 AND (p_ > 1.2 OR coalesce(sales_pct, 0.0) < 50) THEN 'above_evidence_with_stock'
      WHEN gap_ < -1 AND (p_ < 0.5 OR coalesce(sales_pct, 0.0) > 100) THEN 'below_evidence_with_demand'
      WHEN p_ > 2 THEN 'inventory_over_demand' WHEN sales_90 = 0 THEN 'no_sales_90_days' ELSE 'near_evidence' END AS reason
  FROM (SELECT *, least(3, greatest(1, CAST({S.rnd('abs(gap_)', 0)} AS INTEGER))) AS mv_ FROM (
    SELECT *, CASE WHEN {t('current_rate')} AND {t('ai_')} THEN (current_rate - ai_) / ai_ * 100 ELSE 0.0 END AS gap_ FROM (
      SELECT *, coalesce(ratio_raw, 0.0) AS p_,
        (CASE WHEN {wsum} > 0 THEN {vsum} / {wsum} END) * (1.0 + CASE WHEN coalesce(ratio_raw, 0.0) > 2 THEN -0.025
          WHEN coalesce(ratio_raw, 0.0) > 1.2 THEN -0.01 WHEN coalesce(ratio_raw, 0.0) > 0 AND coalesce(ratio_raw, 0.0) < 0.5
          THEN 0.015 ELSE 0.0 END + least(greatest(trend, -0.01), 0.01)) AS ai_
      FROM {src}) a) b) c"""


S.add("dm2", ["dm1"], f"SELECT *, {CONF} AS confidence FROM dm1")
S.add("dm3", ["dm2"], recommend_sql("dm2"))
SCORE = (f"least(100.0, {S.rnd(f'least(sales_30 / CAST(5 AS DOUBLE), 1.0) * 35 + CASE WHEN {t(chr(114) + 'atio_raw')} AND ratio_raw < 1.2 THEN 1.0 WHEN {t('ratio_raw')} AND ratio_raw < 2 THEN 0.4 ELSE 0.0 END * 25 + {b('vdb_rate')} * 20 + least(greatest(1.0 + trend, 0.0), 1.0) * 10 + CAST(sales_180 > 0 AS INTEGER) * 10', 1)})")
OUT_SQL = ", ".join(DM.OUT)
S.add("dm", ["dm3"], f"""SELECT *, sales_90 > 0 AS sales_history_available, {S.rnd('ratio_raw', 1)} AS inventory_ratio,
    {S.rnd('doi_raw', 1)} AS days_inventory, {SCORE} AS recommendation_score FROM dm3""")


def dm_df(spark, d):
    return DM.decision_matrix(stock_sales_df(spark, d), DM.trailing_sales(sales_deduped(spark, d)))


@register("trailing_sales", S.with_ctes("SELECT * FROM trail_counts", "trail_counts"))
def trailing_sales(spark, d):
    return DM.trailing_sales(sales_deduped(spark, d))


@register("sales_velocity", S.with_ctes(f"""SELECT {COH}, stock_pcs, sales_30, sales_90, {S.rnd('monthly', 4)} AS monthly_sales,
    {S.rnd('daily', 4)} AS daily_sales, {S.rnd('ratio_raw', 4)} AS inventory_ratio, {S.rnd('doi_raw', 4)} AS days_inventory,
    {S.rnd('trend', 4)} AS trend FROM dm1""", "dm1"))
def sales_velocity(spark, d):
    df = DM.velocity(stock_sales_df(spark, d).join(DM.trailing_sales(sales_deduped(spark, d)), dims.COHORT_KEYS, "left")
                     .withColumns({f"sales_{n}": F.coalesce(F.col(f"sales_{n}"), F.lit(0)) for n in DM.WINDOWS}))
    r = DM.rnd
    return df.select(*dims.COHORT_KEYS, "stock_pcs", "sales_30", "sales_90", r(F.col("monthly_sales"), 4).alias("monthly_sales"),
                     r(F.col("daily_sales"), 4).alias("daily_sales"), r(F.col("inventory_ratio_raw"), 4).alias("inventory_ratio"),
                     r(F.col("days_inventory_raw"), 4).alias("days_inventory"), r(F.col("trend"), 4).alias("trend"))


@register("decision_matrix", S.with_ctes(f"SELECT {', '.join(DM.OUT)} FROM dm", "dm"))
def decision_matrix(spark, d):
    return dm_df(spark, d)


S.add("dmu0", ["stock_sales"], """SELECT *, 0 AS sales_30, 0 AS sales_90, 0 AS sales_180, CAST(NULL AS DOUBLE) AS ratio_raw,
    CAST(NULL AS DOUBLE) AS doi_raw, 0.0 AS trend FROM stock_sales""")
CONF_U = (f"least(100, CASE WHEN {t('historical_rate')} THEN 20 ELSE 0 END + {b('vdb_rate')} * 30 + {b('stock_pcs')} * 10 "
          f"+ CAST({t('historical_rate')} OR {t('vdb_rate')} AS INTEGER) * 10)")
S.add("dmu1", ["dmu0"], f"SELECT *, {CONF_U} AS confidence FROM dmu0")
S.add("dmu", ["dmu1"], recommend_sql("dmu1"))


@register("decision_matrix_undated", S.with_ctes(f"""SELECT {COH}, stock_pcs, sold_pcs, sales_pct, current_rate, historical_rate,
    vdb_rate, sales_30, sales_90, sales_180, false AS sales_history_available, CAST(NULL AS DOUBLE) AS inventory_ratio,
    CAST(NULL AS DOUBLE) AS days_inventory, ai_rate, confidence, action, CAST(confidence AS DOUBLE) AS recommendation_score, reason
  FROM dmu""", "dmu"))
def decision_matrix_undated(spark, d):
    """Fallback rows when the sales export has no usable sale dates."""
    return DM.decision_matrix_undated(stock_sales_df(spark, d))


MED = ("(SELECT CASE WHEN len(l) = 0 THEN NULL WHEN len(l) % 2 = 1 THEN l[len(l) // 2 + 1] "
       "ELSE (l[len(l) // 2] + l[len(l) // 2 + 1]) / 2 END FROM (SELECT list_sort(list_filter([CASE WHEN "
       + t("historical_rate") + " THEN historical_rate END, CASE WHEN " + t("vdb_rate") + " THEN vdb_rate END, CASE WHEN "
       + t("current_rate") + " THEN current_rate END], lambda x: x IS NOT NULL)) AS l))")


@register("decision_matrix_median", S.with_ctes(f"""SELECT {', '.join(DM.MEDIAN_OUT)} FROM (
  SELECT *, CASE WHEN {t('ratio_raw')} THEN {S.rnd('ratio_raw', 1)} END AS inventory_ratio,
    CASE WHEN {t('doi_raw')} THEN {S.rnd('doi_raw', 1)} END AS days_inventory,
    CASE WHEN {t('ai_')} THEN {S.rnd('ai_')} END AS ai_rate,
    CASE WHEN confidence >= 70 AND gap_ < -3 THEN 'Increase' WHEN confidence >= 70 AND gap_ > 3 THEN 'Reduce'
      WHEN confidence < 55 THEN 'Monitor' ELSE 'Hold' END AS action
  FROM (SELECT *, CASE WHEN {t('current_rate')} AND {t('ai_')} THEN (current_rate - ai_) / ai_ * 100 ELSE 0.0 END AS gap_ FROM (
    SELECT *, {MED} AS ai_, least(100, 25 + least(sales_90, 20) * 2 + {b('vdb_rate')} * 30 + {b('historical_rate')} * 20) AS confidence
    FROM dm1) a) b) c""", "dm1"))
def decision_matrix_median(spark, d):
    return DM.decision_matrix_median(stock_sales_df(spark, d), DM.trailing_sales(sales_deduped(spark, d)))


@register("decision_matrix_median_undated", S.with_ctes(f"""SELECT {COH}, stock_pcs, sold_pcs, sales_pct, current_rate, historical_rate, vdb_rate, 0 AS sales_30, 0 AS sales_90, 0 AS sales_180,
    CAST(NULL AS DOUBLE) AS inventory_ratio, CAST(NULL AS DOUBLE) AS days_inventory, coalesce({S.rnd('ai_')}, 0.0) AS ai_rate, CASE WHEN ai_ IS NULL THEN 10 ELSE 35 END AS confidence,
    'Manual Review' AS action FROM (SELECT *, {MED} AS ai_ FROM stock_sales) t""", "stock_sales"))
def decision_matrix_median_undated(spark, d):
    return DM.decision_matrix_median_undated(stock_sales_df(spark, d))


S.add("dm_opp", ["dm"], """SELECT *, CASE WHEN opportunity = 'High Demand' THEN 0 WHEN opportunity = 'Underpriced' THEN 1
    WHEN starts_with(action, 'Increase') THEN 2 WHEN opportunity = 'Overstock' THEN 3 WHEN opportunity = 'Manual Review' THEN 4 ELSE 5 END
    AS opportunity_rank FROM (SELECT *, CASE WHEN coalesce(confidence, 0) < 40 THEN 'Manual Review'
      WHEN coalesce(sales_pct, 0.0) > 100 OR (coalesce(inventory_ratio, 0.0) > 0 AND coalesce(inventory_ratio, 0.0) < 0.5) THEN 'High Demand'
      WHEN coalesce(vdb_rate, 0.0) <> 0 AND coalesce(current_rate, 0.0) < coalesce(vdb_rate, 0.0) * 0.97 THEN 'Underpriced'
      WHEN coalesce(inventory_ratio, 0.0) > 2 THEN 'Overstock'
      WHEN coalesce(vdb_rate, 0.0) <> 0 AND coalesce(current_rate, 0.0) > coalesce(vdb_rate, 0.0) * 1.03 THEN 'Overpriced'
      WHEN NOT coalesce(sales_history_available, false) THEN 'Limited Market Data' ELSE 'Normal' END AS opportunity FROM dm) o""")


@register("opportunity_rank", S.with_ctes(f"SELECT {COH}, confidence, action, recommendation_score, opportunity, opportunity_rank FROM dm_opp",
                                          "dm_opp"))
def opportunity_rank(spark, d):
    """Opportunity class and rank; display order = rank, then score desc."""
    return DM.in_order(DM.opportunity(dm_df(spark, d))).select(*dims.COHORT_KEYS, "confidence", "action", "recommendation_score",
                                                   "opportunity", "opportunity_rank")


@register("decision_bands", S.with_ctes(f"""SELECT {COH}, confidence, inventory_ratio,
    CASE WHEN confidence IS NULL THEN NULL WHEN confidence >= 95 THEN 'Very High' WHEN confidence >= 80 THEN 'High'
      WHEN confidence >= 60 THEN 'Medium' WHEN confidence >= 40 THEN 'Low' ELSE 'Very Low' END AS confidence_band,
    CASE WHEN inventory_ratio IS NULL THEN NULL WHEN inventory_ratio <= 0.5 THEN 'Short Supply' WHEN inventory_ratio <= 1.2 THEN 'Healthy'
      WHEN inventory_ratio <= 2 THEN 'Overstock' ELSE 'Excess' END AS ratio_band FROM dm""", "dm"))
def decision_bands(spark, d):
    return DM.bands(dm_df(spark, d)).select(*dims.COHORT_KEYS, "confidence", "inventory_ratio", "confidence_band",
                                            "ratio_band")


@register("decision_matrix_filter", S.with_ctes(f"""SELECT {COH}, confidence, stock_pcs, sales_pct, opportunity, opportunity_rank,
    recommendation_score FROM dm_opp WHERE coalesce(confidence, 0) >= 60 AND coalesce(confidence, 0) < 80
    AND coalesce(stock_pcs, 0) < 50 AND coalesce(sales_pct, 0.0) > 100""", "dm_opp"))
def decision_matrix_filter(spark, d):
    """Confidence band Medium, stock < 50, sales > 100%, of all shapes and sizes."""
    df = DM.opportunity(dm_df(spark, d))
    return DM.matrix_filter(df, confidence="Medium", stock="Low", sales="High (100%+)").select(
        *dims.COHORT_KEYS, "confidence", "stock_pcs", "sales_pct", "opportunity", "opportunity_rank", "recommendation_score")
