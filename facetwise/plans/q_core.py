"""Core slice: canonical listings, exact match, benchmark, selling
intelligence, leaderboards, KPI summary."""
from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.operators import matching, selling
from facetwise.plans import base
from facetwise.plans import sqlparts as S
from facetwise.plans.registry import register

MATCHED_COLS = base.STONE_COLS + matching.MARKET_COLUMNS
TB_SQL = ", ".join(base.TIEBREAK)

S.add("selling0", ["matched"], """SELECT m.*,
    CASE WHEN market_bottom_price IS NOT NULL THEN market_bottom_price - price ELSE price * CAST(0.10 AS DOUBLE) END AS market_diff_abs,
    CASE WHEN market_bottom_price IS NOT NULL THEN (market_bottom_price - price) / price * 100.0 ELSE 10.0 END AS market_diff_pct
  FROM matched m""")
S.add("selling1", ["selling0"], f"""SELECT s.*,
    {S.rnd("CASE WHEN market_bottom_price IS NOT NULL THEN price + greatest(market_diff_abs, 0.0) * 0.5 ELSE price * CAST(1.04 AS DOUBLE) END")} AS min_selling_price,
    {S.rnd("CASE WHEN market_bottom_price IS NOT NULL THEN price + greatest(market_diff_abs, 0.0) * 0.75 ELSE price * CAST(1.08 AS DOUBLE) END")} AS recommended_selling_price,
    {S.rnd("CASE WHEN market_bottom_price IS NOT NULL THEN market_bottom_price ELSE price * CAST(1.10 AS DOUBLE) END")} AS premium_selling_price,
    {S.rnd("CASE WHEN market_bottom_price IS NOT NULL THEN market_bottom_price ELSE price * CAST(1.10 AS DOUBLE) END")} AS effective_market_price,
    {S.rnd("market_p01_price * CAST(0.9975 AS DOUBLE)")} AS top1_candidate_price
  FROM selling0 s""")


def _tier_sql(cfg: dict) -> str:
    t = cfg
    return f"""CASE WHEN market_diff_pct >= {t['premium_threshold']} THEN 'PREMIUM SELL OPPORTUNITY'
      WHEN market_diff_pct >= {t['sell_now_threshold']} THEN 'SELL NOW'
      WHEN market_diff_pct >= {t['good_opp_threshold']} THEN 'GOOD SELLING OPPORTUNITY'
      WHEN market_diff_pct >= {t['wait_threshold']} THEN 'WAIT' ELSE 'AVOID' END AS recommendation,
    CASE WHEN market_diff_pct >= {t['premium_threshold']} THEN 5 WHEN market_diff_pct >= {t['sell_now_threshold']} THEN 4
      WHEN market_diff_pct >= {t['good_opp_threshold']} THEN 3 WHEN market_diff_pct >= {t['wait_threshold']} THEN 2 ELSE 1 END AS stars,
    CASE WHEN market_diff_pct >= {t['good_opp_threshold']} THEN 'SELL NOW'
      WHEN market_diff_pct >= {t['wait_threshold']} THEN 'WAIT' ELSE 'AVOID' END AS action"""


def selling_sql(cfg: dict, name: str = "selling") -> None:
    S.add(name, ["selling1"], f"""SELECT s.*,
    CASE WHEN top1_candidate_price IS NOT NULL AND top1_candidate_price >= min_selling_price THEN top1_candidate_price END AS top1_listing_price,
    CASE WHEN market_p01_price IS NULL THEN 'NO_EXACT_COMPARABLE' WHEN top1_candidate_price < min_selling_price
      THEN 'BELOW_PROFIT_FLOOR' ELSE 'ELIGIBLE_FOR_VISIBILITY_TEST' END AS top1_status,
    {S.rnd("recommended_selling_price - price")} AS expected_profit,
    {S.rnd("(recommended_selling_price - price) / price * 100.0")} AS profit_pct,
    {S.rnd("least(greatest(100.0 - market_diff_pct * 0.4, 50.0), 100.0)", 1)} AS competitiveness_score,
    {_tier_sql(cfg)},
    '$' || printf('%.2f', min_selling_price) || ' - $' || printf('%.2f', premium_selling_price) AS negotiation_range
  FROM selling1 s""")


selling_sql(dims.DEFAULT_RULES)

SELL_COLS = MATCHED_COLS + ["market_diff_abs", "market_diff_pct", "min_selling_price", "recommended_selling_price",
                            "premium_selling_price", "effective_market_price", "top1_candidate_price",
                            "top1_listing_price", "top1_status", "expected_profit", "profit_pct",
                            "competitiveness_score", "recommendation", "stars", "action", "negotiation_range"]
LISTING_COLS = base.STONE_COLS


@register("canonical_listing", S.with_ctes(f"SELECT {', '.join(LISTING_COLS)} FROM inventory", "inventory"))
def canonical_listing(spark, d):
    return base.project(base.inventory(spark, d), LISTING_COLS)


@register("positive_price_filter", S.with_ctes(
    f"SELECT 'market' AS side, {', '.join(LISTING_COLS)} FROM market WHERE price > 0 "
    f"UNION ALL SELECT 'inventory' AS side, {', '.join(LISTING_COLS)} FROM inventory WHERE price > 0",
    "market", "inventory"))
def positive_price_filter(spark, d):
    m = matching.positive_price(base.market(spark, d)).select(F.lit("market").alias("side"), *LISTING_COLS)
    i = matching.positive_price(base.inventory(spark, d)).select(F.lit("inventory").alias("side"), *LISTING_COLS)
    return m.unionByName(i)


@register("market_benchmark", S.with_ctes(
    f"SELECT {S.MK}, market_bottom_price, market_p01_price, market_stone_id FROM bench", "bench"))
def market_benchmark(spark, d):
    return matching.market_benchmark(base.market(spark, d), dims.MATCH_KEYS)


@register("exact_match", S.with_ctes(f"SELECT {', '.join(MATCHED_COLS)} FROM matched", "matched"))
def exact_match(spark, d):
    return base.project(base.compute_matched(spark, d), MATCHED_COLS)


@register("unmatched_inventory", S.with_ctes(
    f"SELECT {', '.join(LISTING_COLS)} FROM inventory i WHERE price > 0 AND NOT EXISTS "
    f"(SELECT 1 FROM market m WHERE m.price > 0 AND {S.eqj('i', 'm', dims.MATCH_KEYS)})", "inventory", "market"))
def unmatched_inventory(spark, d):
    return base.project(matching.unmatched_inventory(base.inventory(spark, d), base.market(spark, d)), LISTING_COLS)


@register("selling_intelligence", S.with_ctes(f"SELECT {', '.join(SELL_COLS)} FROM selling", "selling"))
def selling_intelligence(spark, d):
    return base.project(base.compute_selling(spark, d), SELL_COLS)


BOARD_COLS = ["board", "rank", "stone_id", "shape", "carat", "color", "clarity", "price", "market_bottom_price",
              "market_diff_pct", "expected_profit", "profit_pct", "recommendation", "action"]


def _boards_sql() -> str:
    parts = []
    for name, member, sort_col, desc in selling.BOARDS:
        where = ""
        if member is not None:
            where = (f" WHERE recommendation LIKE '%{member[1]}%'" if member[0] == "recommendation_contains"
                     else f" WHERE {member[0]} = '{member[1]}'")
        key = sort_col if desc else f"-{sort_col}"
        parts.append(f"SELECT s.*, '{name}' AS board, {key} AS sort_key FROM selling s{where}")
    union = "\n  UNION ALL ".join(parts)
    return S.with_ctes(f"""SELECT {', '.join(BOARD_COLS)} FROM (
  SELECT u.*, row_number() OVER (PARTITION BY board ORDER BY sort_key DESC NULLS LAST, {TB_SQL}) AS rank
  FROM ({union}) u) r WHERE rank <= 10""", "selling")


@register("leaderboards", _boards_sql())
def leaderboards(spark, d):
    return selling.leaderboards(base.compute_selling(spark, d), 10, base.TIEBREAK).select(*BOARD_COLS)


@register("kpi_summary", S.with_ctes(f"""SELECT count(*) AS total_inventory, count(market_bottom_price) AS total_matches,
  CASE WHEN count(*) > 0 THEN {S.rnd('count(market_bottom_price) / count(*) * 100.0', 1)} ELSE 0.0 END AS match_rate,
  count(*) FILTER (WHERE action = 'SELL NOW') AS sell_now_count,
  count(*) FILTER (WHERE action = 'WAIT') AS wait_count,
  count(*) FILTER (WHERE action = 'AVOID') AS avoid_count,
  {S.rnd('coalesce(avg(profit_pct), 0.0)')} AS avg_profit_margin,
  {S.rnd('coalesce(sum(expected_profit), 0.0)', 2, True)} AS total_expected_profit,
  {S.rnd('coalesce(max(expected_profit), 0.0)')} AS max_profit,
  {S.rnd('coalesce(avg(competitiveness_score), 0.0)', 1)} AS avg_competitiveness
FROM selling""", "selling"))
def kpi_summary(spark, d):
    return selling.kpi_summary(base.compute_selling(spark, d))
