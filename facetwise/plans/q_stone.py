"""Evidence family and the stone-level sell-through board."""
from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.operators import evidence as EV
from facetwise.operators import sellthrough as ST
from facetwise.plans import base, fixtures
from facetwise.plans import sqlparts as S
from facetwise.plans.q_sales import sales_cohorts_df
from facetwise.plans.registry import register

COH = ", ".join(dims.COHORT_KEYS)


def range_hi_sql(e: str) -> str:
    return "(CASE " + e + " " + " ".join(f"WHEN '{lbl}' THEN {hi}" for lbl, _, hi in dims.SIZE_MASTER) + " END)"


LO = "(CASE WHEN len(string_split(\"EV_Size_Bucket\", '-')) = 2 THEN TRY_CAST(trim(string_split(\"EV_Size_Bucket\", '-')[1]) AS DOUBLE) END)"
HI = "(CASE WHEN len(string_split(\"EV_Size_Bucket\", '-')) = 2 THEN TRY_CAST(trim(string_split(\"EV_Size_Bucket\", '-')[2]) AS DOUBLE) END)"
S.add("ev_ranged", ["evidence"], f"""SELECT *, CASE WHEN hi_ >= lo_ AND hi_ <= {range_hi_sql(S.size_range('lo_'))}
    THEN {S.size_range('lo_')} END AS size_range FROM (SELECT e.*, {LO} AS lo_, {HI} AS hi_ FROM evidence e) t""")
S.add("ev_rates", ["ev_ranged"], """SELECT size_range, "Shape" AS shape, "Color" AS color, "Clarity" AS clarity,
    avg("Stock_Metric") AS ev_rate FROM ev_ranged WHERE size_range IS NOT NULL AND "Stock_Metric" IS NOT NULL
  GROUP BY size_range, "Shape", "Color", "Clarity\"""")
S.add("ev_enriched", ["evidence"], f"""SELECT "Shape", "EV_Size_Bucket", "Color", "Clarity", "EV_Stock", "EV_Sold", "Stock_Metric",
    "Diamax_Sold", "Demand_Category",
    CASE WHEN coalesce("Diamax_Sold", 0) < 5 THEN 'Low Confidence' ELSE "Data_Confidence" END AS "Data_Confidence",
    CASE WHEN coalesce("Diamax_Sold", 0) < 5 THEN '{EV.LOW_SALES_RECOMMENDATION}' ELSE "Recommendation" END AS "Recommendation",
    CASE WHEN coalesce("Diamax_Sold", 0) < 5 THEN '{EV.LOW_SALES_REASON}' ELSE "Reason" END AS "Reason",
    stock + sold AS "Total_Inventory", sold AS "Total_Sold_Quantity", stock AS "Available_Stock",
    {S.rnd('st * 100', 1)} AS "Sales_Percentage",
    {S.rnd('coalesce(CASE WHEN stock + sold <> 0 THEN stock * 100.0 / (stock + sold) END, 0.0)', 1)} AS "Stock_Percentage",
    sold AS "Sales_Velocity", {S.rnd('st * 100', 0)} AS "Demand_Score",
    {S.rnd('coalesce(CASE WHEN stock + sold <> 0 THEN stock * 100.0 / (stock + sold) END, 100.0)', 0)} AS "Inventory_Risk_Score"
  FROM (SELECT e.*, coalesce("EV_Stock", 0) AS stock, coalesce("EV_Sold", 0) AS sold,
      coalesce(CASE WHEN coalesce("EV_Stock", 0) + coalesce("EV_Sold", 0) <> 0
        THEN CAST(coalesce("EV_Sold", 0) AS DOUBLE) / (coalesce("EV_Stock", 0) + coalesce("EV_Sold", 0)) END, 0.0) AS st
    FROM evidence e) t""")


def enriched_df(spark, d):
    return EV.enrich(fixtures.evidence(spark, d))


ENRICHED_COLS = ["Shape", "EV_Size_Bucket", "Color", "Clarity", "EV_Stock", "EV_Sold", "Stock_Metric", "Diamax_Sold",
                 "Demand_Category", "Data_Confidence", "Recommendation", "Reason", "Total_Inventory",
                 "Total_Sold_Quantity", "Available_Stock", "Sales_Percentage", "Stock_Percentage", "Sales_Velocity",
                 "Demand_Score", "Inventory_Risk_Score"]


@register("range_containment_join", S.with_ctes(
    'SELECT "Shape", "EV_Size_Bucket", "Color", "Clarity", size_range FROM ev_ranged', "ev_ranged"))
def range_containment_join(spark, d):
    return EV.with_master_range(fixtures.evidence(spark, d)).select(
        "Shape", "EV_Size_Bucket", "Color", "Clarity", "size_range")


@register("evidence_rates", S.with_ctes("SELECT * FROM ev_rates", "ev_rates"))
def evidence_rates(spark, d):
    return EV.evidence_rates(fixtures.evidence(spark, d))


@register("evidence_enriched", S.with_ctes(f"SELECT {', '.join(chr(34) + c + chr(34) for c in ENRICHED_COLS)} FROM ev_enriched",
                                           "ev_enriched"))
def evidence_enriched(spark, d):
    return enriched_df(spark, d).select(*ENRICHED_COLS)


def _plan_sql() -> str:
    whens = " ".join(f"WHEN \"Sales_Percentage\" < {b} THEN '{t}'" for b, t in EV.SURPLUS_PLANS if b is not None)
    return f"CASE {whens} ELSE '{EV.SURPLUS_PLANS[-1][1]}' END"


@register("surplus_opportunities", S.with_ctes(f"""SELECT "Shape" AS shape, "EV_Size_Bucket" AS size_range, "Color" AS color,
    "Clarity" AS clarity, "Total_Sold_Quantity" AS sold, "Available_Stock" AS remaining_stock,
    "Available_Stock" - "Total_Sold_Quantity" AS excess_stock, "Sales_Percentage" AS sales_pct, "Demand_Score" AS demand_score,
    "Inventory_Risk_Score" AS risk_score, {_plan_sql()} AS sell_plan
  FROM ev_enriched WHERE "Total_Sold_Quantity" >= 5 AND "Available_Stock" > "Total_Sold_Quantity"
  ORDER BY excess_stock DESC, risk_score DESC, shape, size_range, color, clarity LIMIT 20""", "ev_enriched"))
def surplus_opportunities(spark, d):
    return EV.surplus_opportunities(enriched_df(spark, d), 20)


S.add("ev_hist_long", ["ev_enriched"], """SELECT 'demand' AS histogram, "Demand_Category" AS label FROM ev_enriched
    UNION ALL SELECT 'confidence', "Data_Confidence" FROM ev_enriched UNION ALL SELECT 'actions', "Recommendation" FROM ev_enriched""")
KNOWN = ", ".join([f"('demand', '{x}')" for x in dims.DEMAND_LABELS] + [f"('confidence', '{x}')" for x in dims.CONFIDENCE_LABELS])


@register("label_histograms", S.with_ctes(f"""SELECT k.histogram, k.label, coalesce(c.n, 0) AS count
  FROM (VALUES {KNOWN}) k(histogram, label) LEFT JOIN (SELECT histogram, label, count(*) AS n FROM ev_hist_long GROUP BY ALL) c
    ON k.histogram = c.histogram AND k.label = c.label
  UNION ALL SELECT c.histogram, c.label, c.n FROM (SELECT histogram, label, count(*) AS n FROM ev_hist_long GROUP BY ALL) c
  WHERE NOT EXISTS (SELECT 1 FROM (VALUES {KNOWN}) k(histogram, label) WHERE k.histogram = c.histogram AND k.label IS NOT DISTINCT FROM c.label)""",
    "ev_hist_long"))
def label_histograms(spark, d):
    return EV.label_histograms(enriched_df(spark, d))


@register("recommendation_search", S.with_ctes(f"""SELECT *, count(*) OVER () AS total FROM (
    SELECT {', '.join(chr(34) + c + chr(34) for c in ENRICHED_COLS)} FROM ev_enriched
    WHERE contains(lower(concat_ws(' ', coalesce("Shape", ''), coalesce("EV_Size_Bucket", ''), coalesce("Color", ''),
      coalesce("Clarity", ''), coalesce("Recommendation", ''))), 'round')) t
  ORDER BY "Shape", "EV_Size_Bucket", "Color", "Clarity" LIMIT 50 OFFSET 50""", "ev_enriched"))
def recommendation_search(spark, d):
    """Search 'round', page 2 of 50."""
    return EV.recommendation_search(enriched_df(spark, d), "Round", None, None, 2, 50).select(
        *ENRICHED_COLS, "total")


@register("color_clarity_rollup", S.with_ctes(f"""SELECT color, clarity, sold, remaining_stock,
    {S.rnd('CASE WHEN remaining_stock <> 0 THEN sold * 100.0 / remaining_stock END', 1)} AS sales_pct,
    {S.rnd('d_', 1)} AS demand_score,
    CASE WHEN coalesce(CASE WHEN remaining_stock <> 0 THEN sold * 100.0 / remaining_stock END, 0.0) < 20 THEN 'Overstock'
      WHEN coalesce(CASE WHEN remaining_stock <> 0 THEN sold * 100.0 / remaining_stock END, 0.0) < 40 THEN 'Slow Moving'
      ELSE 'Healthy' END AS inventory_status
  FROM (SELECT "Color" AS color, "Clarity" AS clarity, sum("Total_Sold_Quantity") AS sold, sum("Available_Stock") AS remaining_stock,
      avg("Demand_Score") AS d_ FROM ev_enriched WHERE "Color" IN ('D', 'E', 'F', 'G') GROUP BY ALL) t""", "ev_enriched"))
def color_clarity_rollup(spark, d):
    return EV.color_clarity_rollup(enriched_df(spark, d))


# ------------------------------------------------------------ stone board

S.add("st_base", ["selling"], f"SELECT * FROM (SELECT s.*, {S.size_range('carat')} AS size_range FROM selling s) t WHERE size_range IS NOT NULL")
S.add("st1", ["st_base", "sales_coh", "ev_rates"], f"""SELECT b.*, k.cohort_stock, CAST(coalesce(l.sold_stones, 0) AS BIGINT) AS sold_,
    CASE WHEN l.sold_carats <> 0 THEN l.sales_value / l.sold_carats END AS hr_, e.ev_rate,
    coalesce(b.carat, 0.0) AS carat_, coalesce(b.price, 0.0) AS current_
  FROM st_base b JOIN (SELECT {COH}, count(*) AS cohort_stock FROM st_base GROUP BY {COH}) k ON {S.eqj('b', 'k', dims.COHORT_KEYS)}
  LEFT JOIN sales_coh l ON {S.eqj('b', 'l', dims.COHORT_KEYS)} LEFT JOIN ev_rates e ON {S.eqj('b', 'e', dims.COHORT_KEYS)}""")
S.add("st2", ["st1"], f"""SELECT *, CASE WHEN carat_ <> 0 THEN current_ / carat_ END AS cr_,
    CASE WHEN market_bottom_price IS NOT NULL AND carat_ <> 0 THEN market_bottom_price / carat_ END AS vr_,
    CASE WHEN cohort_stock > 0 THEN sold_ / cohort_stock * 100.0 ELSE 0.0 END AS pct_ FROM st1""")
S.add("st3", ["st2"], f"""SELECT *, CASE WHEN coalesce(cr_ <> 0, false) AND adj_ IS NOT NULL THEN cr_ * (1.0 + adj_) END AS tr_
  FROM (SELECT *, {S.price_band('pct_')} AS adj_ FROM st2) t""")


def tr(e: str, n: int = 2) -> str:
    return f"CASE WHEN coalesce({e} <> 0, false) THEN {S.rnd(e, n)} END"


S.add("stones", ["st3"], f"""SELECT stone_id, {S.rnd('carat_')} AS carat, shape, size_range, color, clarity,
    upper(trim(coalesce(cut, ''))) AS cut, upper(trim(coalesce(polish, ''))) AS polish, upper(trim(coalesce(symmetry, ''))) AS symmetry,
    upper(trim(coalesce(fluorescence, ''))) AS fluorescence, upper(trim(coalesce(lab, ''))) AS lab,
    cohort_stock, sold_ AS cohort_sold, cohort_stock AS remaining_stock, cohort_stock - sold_ AS excess_stock,
    {S.rnd('pct_', 1)} AS sales_pct, {S.rnd('current_')} AS current_price, {tr('cr_')} AS current_rate,
    {tr('hr_')} AS historical_rate, {tr('market_bottom_price')} AS vdb_price, {tr('vr_')} AS vdb_rate, {tr('ev_rate')} AS ev_rate,
    {tr('tr_ * carat_')} AS ai_price,
    CASE WHEN coalesce(tr_ * carat_ <> 0, false) AND carat_ <> 0 THEN {S.rnd('tr_ * carat_ / carat_')} END AS recommended_rate,
    CASE WHEN market_bottom_price IS NOT NULL THEN {S.rnd('market_bottom_price - current_')} END AS vdb_difference,
    {S.rnd('CASE WHEN coalesce(cr_ <> 0, false) AND coalesce(vr_ <> 0, false) THEN (cr_ - vr_) / vr_ * 100 END', 1)} AS market_gap_pct,
    CASE WHEN tr_ IS NOT NULL THEN {S.rnd('tr_')} END AS market_target_rate, adj_ AS price_adjustment,
    CASE WHEN tr_ IS NULL THEN 'Manual review'
      WHEN adj_ < 0 THEN 'Reduce price ' || printf('%d', CAST({S.rnd('abs(adj_) * 100', 0)} AS INTEGER)) || '%'
      WHEN adj_ > 0 THEN 'Increase price ' || printf('%d', CAST({S.rnd('abs(adj_) * 100', 0)} AS INTEGER)) || '%'
      ELSE 'Hold price' END AS action,
    CASE WHEN tr_ IS NULL THEN 'no_rate' WHEN adj_ = 0 THEN printf('sold_%.1f_hold', {S.rnd('pct_', 1)})
      ELSE printf('sold_%.1f_band_%s%d', {S.rnd('pct_', 1)}, CASE WHEN adj_ > 0 THEN '+' ELSE '' END,
        CAST({S.rnd('adj_ * 100', 0)} AS INTEGER)) END AS recommendation,
    {tr('top1_listing_price')} AS top_1pct_target, price, src_part, src_supp, src_amount, src_disc, src_tax
  FROM st3""")


def stones_df(spark, d):
    return ST.stone_sell_through(base.selling_rows(spark, d), sales_cohorts_df(spark, d),
                                 EV.evidence_rates(fixtures.evidence(spark, d)))


STONE_SQL_COLS = ", ".join(ST.STONE_OUT)


@register("stone_sell_through", S.with_ctes(f"SELECT {STONE_SQL_COLS} FROM stones", "stones"))
def stone_sell_through(spark, d):
    return stones_df(spark, d).select(*ST.STONE_OUT)


TB = ["stone_id", "price", "src_part", "src_supp", "src_amount", "src_disc", "src_tax"]
TB_SQL = ", ".join(TB)


@register("stone_facet_search", S.with_ctes(f"""SELECT {STONE_SQL_COLS} FROM stones
  WHERE shape = 'ROUND' AND color = 'G' AND contains(upper(concat_ws(' ', stone_id, shape, size_range, color, clarity, cut, polish,
    symmetry, fluorescence, lab)), 'VS')
  ORDER BY excess_stock DESC, sales_pct ASC, {TB_SQL} LIMIT 500""", "stones"))
def stone_facet_search(spark, d):
    """Facets shape=ROUND, color=G, search 'vs'; board order; top 500."""
    return ST.facet_search(stones_df(spark, d), {"shape": "ROUND", "color": "G"}, "vs", 500, TB).select(*ST.STONE_OUT)


@register("stone_facets", S.with_ctes(
    "SELECT facet, value, CAST(row_number() OVER (PARTITION BY facet ORDER BY value) AS INTEGER) AS ordinal FROM (SELECT DISTINCT facet, value FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS facet, CAST({a} AS VARCHAR) AS value FROM stones" for a in ST.FACET_ATTRS)
    + ") u WHERE coalesce(value <> '', false)) t UNION ALL SELECT 'size_range', size_range, CAST(ordinal + 1 AS INTEGER) FROM "
    + S.size_master_values(), "stones"))
def stone_facets(spark, d):
    return ST.stone_facets(stones_df(spark, d))


S.add("sell_rows", ["stones"], """SELECT *, coalesce(CASE WHEN coalesce(current_rate <> 0, false) AND coalesce(recommended_rate <> 0, false)
      THEN (recommended_rate / current_rate - 1) * 100 END, 0.0) AS change_pct,
    CASE WHEN coalesce(current_rate <> 0, false) AND coalesce(recommended_rate <> 0, false) THEN recommended_rate - current_rate ELSE 0.0 END AS expected_delta
  FROM stones""")
SELL_COLS = ", ".join(ST.SELLING_ROW_COLS)


@register("selling_rows", S.with_ctes(f"SELECT {SELL_COLS} FROM sell_rows", "sell_rows"))
def selling_rows(spark, d):
    return ST.selling_rows(stones_df(spark, d)).select(*ST.SELLING_ROW_COLS)


S.add("sell_page", ["sell_rows"], f"""SELECT * FROM sell_rows WHERE contains(upper(action), 'REDUCE')
  ORDER BY change_pct ASC NULLS FIRST, {TB_SQL} LIMIT 50 OFFSET 50""")


def page_df(spark, d):
    rows = ST.selling_rows(stones_df(spark, d))
    return rows, ST.selling_page(rows, "reduce", "change_pct", "asc", 2, 50, TB)


@register("selling_action_filter", S.with_ctes(f"SELECT {SELL_COLS} FROM sell_page", "sell_page"))
def selling_action_filter(spark, d):
    """Action contains 'reduce', sorted by change % ascending (nulls first), page 2 of 50."""
    return page_df(spark, d)[1].select(*ST.SELLING_ROW_COLS)


@register("selling_page_summary", S.with_ctes(f"""SELECT
    (SELECT count(*) FROM matched) AS total_inventory,
    (SELECT count(*) FROM sell_rows WHERE contains(upper(action), 'REDUCE')) AS total_matches,
    CASE WHEN (SELECT count(*) FROM matched) > 0 THEN {S.rnd('(SELECT count(*) FROM sell_rows WHERE contains(upper(action), ' + chr(39) + 'REDUCE' + chr(39) + ')) / (SELECT count(*) FROM matched) * 100', 1)} ELSE 0.0 END AS match_rate,
    count(*) FILTER (WHERE contains(upper(action), 'REDUCE')) AS sell_now_count,
    count(*) FILTER (WHERE contains(upper(action), 'HOLD')) AS wait_count, CAST(0 AS BIGINT) AS avoid_count,
    count(*) FILTER (WHERE contains(upper(action), 'INCREASE')) AS increase_count,
    {S.rnd('coalesce(avg(change_pct), 0.0)', 4)} AS avg_profit_margin,
    {S.rnd('coalesce(sum(expected_delta), 0.0)', 2, True)} AS total_expected_profit,
    {S.rnd('coalesce(max(expected_delta), 0.0)')} AS max_profit,
    {S.rnd('coalesce(avg(sales_pct), 0.0)', 4)} AS avg_competitiveness
  FROM sell_page""", "sell_page", "matched"))
def selling_page_summary(spark, d):
    rows, page = page_df(spark, d)
    filtered = rows.where(F.upper(F.col("action")).contains("REDUCE"))
    return ST.selling_page_summary(page, filtered, base.matched(spark, d))
