"""(legacy) pair family over two syncs: the current one and an earlier one with other
own prices and fewer listings. Both are matched in one pass, priced once and read back from a snapshot."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions.exprs import rnd
from facetwise.operators import matching
from facetwise.operators import pairs as PR
from facetwise.plans import base
from facetwise.plans import sqlparts as S
from facetwise.plans.registry import register
from facetwise.session import shared_path
from facetwise.sources import feeds
from facetwise.sources.snapshots import snapshot
from facetwise.sources.versions import VersionedTable

MK = S.MK
T0, T1 = "2026-01-01 00:00:00", "2026-01-01 12:00:00"


def build_pairs(spark, d):
    """Priced pairs of both syncs. The earlier one lacks every fifth line of the inventory and
    every fourth of the market (so the last listing of some keys was another one) and has
    own prices that include the tax."""
    inv = base.inventory(spark, d).select("stone_id", *dims.MATCH_KEYS, "src_line", *feeds.LISTING_ORDER)
    inv = matching.dedupe_listings(inv, feeds.LISTING_ORDER)
    held = {"new": F.lit(True), "old": F.col("src_line") % 4 != 0}
    p = matching.pair_match_last(inv, base.market(spark, d), feeds.LISTING_ORDER, held)
    old = F.col("sync") == "old"
    p = p.where(~old | (F.col("src_line") % 5 != 0))
    p = p.withColumn("price", F.when(old, rnd(F.col("price") * (F.lit(1.0) + F.col("src_tax")))).otherwise(F.col("price")))
    return PR.pair_pricing(p.withColumn("pair_id", PR.pair_id())).select("sync", *PRICED_COLS, *PAIR_GRADES)


def sync_pairs(spark, d, sync: str):
    return snapshot(spark, d, "pairs", build_pairs).where(F.col("sync") == sync).drop("sync")


def new_pairs(spark, d):
    return sync_pairs(spark, d, "new")


def old_pairs(spark, d):
    return sync_pairs(spark, d, "old")


S.add("inv_last", ["inventory"], f"""SELECT * FROM (SELECT * FROM inventory
  QUALIFY row_number() OVER (PARTITION BY stone_id ORDER BY {S.LISTING_ORDER_DESC}) = 1) t WHERE price > 0""")
LAST_LISTING = f"""SELECT {MK}, stone_id AS market_stone_id, price AS market_price FROM market WHERE price > 0{{}}
  QUALIFY row_number() OVER (PARTITION BY {MK} ORDER BY {S.LISTING_ORDER_DESC}) = 1"""
S.add("mkt_last", ["market"], LAST_LISTING.format(""))
S.add("mkt_last_old", ["market"], LAST_LISTING.format(" AND src_line % 4 <> 0"))
JOINED = f"""SELECT i.*, m.market_stone_id, m.market_price, m.market_stone_id || '|' || i.stone_id AS pair_id
  FROM inv_last i JOIN {{}} m ON {S.eqj('i', 'm', dims.MATCH_KEYS)}"""
S.add("pairs_new", ["inv_last", "mkt_last"], JOINED.format("mkt_last"))
S.add("pairs_old", ["inv_last", "mkt_last_old"], f"""SELECT * REPLACE ({S.rnd('price * (1.0 + src_tax)')} AS price)
  FROM ({JOINED.format('mkt_last_old')}) t WHERE src_line % 5 <> 0""")


def pricing_sql(src: str) -> str:
    ex, vg = "('EX', 'EXCELLENT')", "('VG', 'VERY GOOD')"
    spec = (f"least(greatest(50.0 + CASE WHEN cut IN {ex} THEN 15 WHEN cut IN {vg} THEN 8 ELSE 0 END"
            f" + CASE WHEN polish IN {ex} THEN 10 WHEN polish IN {vg} THEN 5 ELSE 0 END"
            f" + CASE WHEN symmetry IN {ex} THEN 10 WHEN symmetry IN {vg} THEN 5 ELSE 0 END"
            f" + CASE WHEN lab = 'GIA' THEN 10 WHEN lab = 'IGI' THEN 5 ELSE 0 END"
            f" + CASE WHEN fluorescence IN ('NON', 'NONE', 'FNT', 'FAINT') THEN 5 WHEN fluorescence IN ('STG', 'VST', 'STRONG') THEN -10 ELSE 0 END, 0.0), 100.0)")
    hold = ("least(30, greatest(2, CAST(trunc(CASE WHEN shape = 'ROUND' THEN 5.0 WHEN shape IN ('OVAL', 'CUSHION') THEN 8.0 ELSE 12.0 END"
            " * CASE WHEN color IN ('D', 'E', 'F') THEN 0.7 WHEN color IN ('G', 'H') THEN 0.85 WHEN color IN ('I', 'J') THEN 1.0 ELSE 1.4 END"
            " * CASE WHEN clarity IN ('FL', 'IF', 'VVS1', 'VVS2') THEN 0.8 WHEN clarity IN ('VS1', 'VS2') THEN 0.9 WHEN clarity IN ('SI1', 'SI2') THEN 1.1 ELSE 1.5 END"
            " * CASE WHEN lab = 'GIA' THEN 0.9 ELSE 1.1 END) AS INTEGER)))")
    return f"""SELECT *, {S.rnd('price')} AS buy_price, {S.rnd('price + s_ * 0.25')} AS max_buy_price,
    {S.rnd('price + s_ * 0.5')} AS min_sell_price, {S.rnd('price + s_ * 0.75')} AS recommended_sell_price,
    {S.rnd('market_price')} AS premium_sell_price, {S.rnd('s_')} AS expected_profit, {S.rnd('m_')} AS profit_margin_pct,
    {S.rnd('s_ * (confidence_score / 100)')} AS risk_adjusted_profit,
    {S.rnd('least(100.0, m_ * 10) * 0.35 + confidence_score * 0.25 + greatest(0.0, 100.0 - holding_period_days * 3) * 0.20 + least(100.0, carat * 40) * 0.20', 1)} AS composite_buy_score,
    CASE WHEN m_ >= 10 THEN 'STRONG_BUY' WHEN m_ >= 5 THEN 'BUY' WHEN m_ >= 3 THEN 'HOLD' WHEN m_ > 0 THEN 'WAIT' ELSE 'AVOID' END AS recommendation,
    CASE WHEN m_ >= 10 THEN 5 WHEN m_ >= 5 THEN 4 WHEN m_ >= 3 THEN 3 WHEN m_ > 0 THEN 2 ELSE 1 END AS stars
  FROM (SELECT *, {S.rnd('least(greatest(CASE WHEN m_ > 0 THEN least(100.0, m_ * 10) ELSE 0.0 END * 0.40 + 100.0 * 0.25 + 70.0 * 0.20 + spec_premium * 0.15, 0.0), 100.0)', 1)} AS confidence_score
    FROM (SELECT *, market_price - price AS s_, CASE WHEN market_price > 0 THEN (market_price - price) / market_price * 100 ELSE 0.0 END AS m_,
      {spec} AS spec_premium, {hold} AS holding_period_days FROM {src}) a) b"""


S.add("pp_new", ["pairs_new"], pricing_sql("pairs_new"))
S.add("pp_old", ["pairs_old"], pricing_sql("pairs_old"))
PAIR_COLS = ["pair_id", "stone_id", "market_stone_id", "shape", "carat", "color", "clarity", "price", "market_price"]
PRICED_COLS = PAIR_COLS + ["spec_premium", "confidence_score", "holding_period_days", "buy_price", "max_buy_price",
                           "min_sell_price", "recommended_sell_price", "premium_sell_price", "expected_profit",
                           "profit_margin_pct", "risk_adjusted_profit", "composite_buy_score", "recommendation", "stars"]
PAIR_GRADES = ["cut", "polish", "symmetry", "lab", "fluorescence"]


@register("pair_match_last", S.with_ctes(f"SELECT {', '.join(PAIR_COLS)} FROM pairs_new", "pairs_new"))
def pair_match_last(spark, d):
    return new_pairs(spark, d).select(*PAIR_COLS)


@register("pair_pricing", S.with_ctes(f"SELECT {', '.join(PRICED_COLS)} FROM pp_new", "pp_new"))
def pair_pricing(spark, d):
    return new_pairs(spark, d).select(*PRICED_COLS)


@register("spec_premium", S.with_ctes("SELECT pair_id, cut, polish, symmetry, lab, fluorescence, spec_premium FROM pp_new", "pp_new"))
def spec_premium(spark, d):
    return new_pairs(spark, d).select("pair_id", "cut", "polish", "symmetry", "lab", "fluorescence", "spec_premium")


@register("holding_period", S.with_ctes("SELECT pair_id, shape, color, clarity, lab, holding_period_days FROM pp_new", "pp_new"))
def holding_period(spark, d):
    return new_pairs(spark, d).select("pair_id", "shape", "color", "clarity", "lab", "holding_period_days")


@register("negotiation_advice", S.with_ctes("""SELECT pair_id, max_buy_price AS do_not_buy_above, min_sell_price AS do_not_sell_below,
    recommended_sell_price AS ideal_sell_price, premium_sell_price, [min_sell_price, premium_sell_price] AS negotiation_range FROM pp_new""", "pp_new"))
def negotiation_advice(spark, d):
    return PR.negotiation_advice(new_pairs(spark, d))


@register("pair_filter_sort", S.with_ctes(f"""SELECT {', '.join(PRICED_COLS)} FROM pp_new WHERE shape = 'ROUND' AND recommendation IN ('STRONG_BUY', 'BUY')
  AND profit_margin_pct >= 5 AND profit_margin_pct <= 20 ORDER BY profit_margin_pct DESC, pair_id LIMIT 100""", "pp_new"))
def pair_filter_sort(spark, d):
    """shape ROUND, recommendation in (STRONG_BUY, BUY), margin 5..20, by margin desc, first 100."""
    p = new_pairs(spark, d)
    p = p.where((F.col("shape") == "ROUND") & F.col("recommendation").isin("STRONG_BUY", "BUY")
                & (F.col("profit_margin_pct") >= 5) & (F.col("profit_margin_pct") <= 20))
    return p.orderBy(F.col("profit_margin_pct").desc(), "pair_id").limit(100).select(*PRICED_COLS)


@register("pair_top_opportunities", S.with_ctes(f"""SELECT * FROM (SELECT {', '.join(PRICED_COLS)}, 'by_margin' AS list FROM pp_new
  ORDER BY profit_margin_pct DESC, pair_id LIMIT 10) UNION ALL SELECT * FROM (SELECT {', '.join(PRICED_COLS)}, 'by_composite' AS list
  FROM pp_new ORDER BY composite_buy_score DESC, pair_id LIMIT 10)""", "pp_new"))
def pair_top_opportunities(spark, d):
    p = new_pairs(spark, d).select(*PRICED_COLS)
    a = p.orderBy(F.col("profit_margin_pct").desc(), "pair_id").limit(10).withColumn("list", F.lit("by_margin"))
    b = p.orderBy(F.col("composite_buy_score").desc(), "pair_id").limit(10).withColumn("list", F.lit("by_composite"))
    return a.unionByName(b)


@register("pair_recommendation_counts", S.with_ctes(
    "SELECT recommendation, count(*) AS count, sum(count(*)) OVER () AS total FROM pp_new GROUP BY recommendation", "pp_new"))
def pair_recommendation_counts(spark, d):
    p = new_pairs(spark, d)
    total = p.select(F.count(F.lit(1))).scalar()
    return p.groupBy("recommendation").agg(F.count(F.lit(1)).alias("count")).withColumn("total", total.cast("double"))


S.add("alerts", ["pp_new", "pp_old"], """SELECT pair_id, stone_id, market_stone_id, alert_type, title, message, old_value, new_value, false AS is_read FROM (
  SELECT n.pair_id, n.stone_id, n.market_stone_id, 'PRICE_CHANGE' AS alert_type, 'Price Changed' AS title, 'Price for stone changed.' AS message,
    o.price AS old_value, n.price AS new_value FROM pp_new n JOIN pp_old o ON n.stone_id = o.stone_id AND n.market_stone_id = o.market_stone_id
    WHERE abs(n.price - o.price) / CASE WHEN coalesce(o.price, 0.0) <> 0 THEN o.price ELSE 1.0 END > 0.01
  UNION ALL SELECT n.pair_id, n.stone_id, n.market_stone_id, n.recommendation || '_ALERT', 'Recommendation changed to ' || n.recommendation,
    'Stone recommendation is now ' || n.recommendation || '.', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
    FROM pp_new n JOIN pp_old o ON n.stone_id = o.stone_id AND n.market_stone_id = o.market_stone_id WHERE n.recommendation <> o.recommendation
  UNION ALL SELECT n.pair_id, n.stone_id, n.market_stone_id, 'NEW_MATCH', 'New Match Found', 'A new match was found.', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
    FROM pp_new n WHERE NOT EXISTS (SELECT 1 FROM pp_old o WHERE o.stone_id = n.stone_id AND o.market_stone_id = n.market_stone_id)) a""")


def alerts_df(spark, d):
    return PR.alert_diff(new_pairs(spark, d), old_pairs(spark, d))


@register("alert_diff", S.with_ctes("SELECT * FROM alerts", "alerts"))
def alert_diff(spark, d):
    return alerts_df(spark, d)


@register("alert_feed", S.with_ctes("""SELECT *, (SELECT count(*) FROM alerts WHERE NOT is_read) AS unread_count FROM alerts
  WHERE alert_type = 'PRICE_CHANGE' AND NOT is_read ORDER BY pair_id LIMIT 50""", "alerts"))
def alert_feed(spark, d):
    """Type PRICE_CHANGE, unread only, first 50 by pair; with the unread count."""
    a = alerts_df(spark, d)
    unread = a.where(~F.col("is_read")).select(F.count(F.lit(1))).scalar()
    return a.where((F.col("alert_type") == "PRICE_CHANGE") & ~F.col("is_read")).orderBy("pair_id").limit(50) \
        .withColumn("unread_count", unread)


@register("alert_mark_read", S.with_ctes(
    "SELECT pair_id, alert_type, is_read OR alert_type = 'NEW_MATCH' AS is_read FROM alerts", "alerts"))
def alert_mark_read(spark, d):
    """Mark every NEW_MATCH alert read (rewrite with a predicate, no row loop)."""
    a = alerts_df(spark, d)
    return a.select("pair_id", "alert_type", (F.col("is_read") | (F.col("alert_type") == "NEW_MATCH")).alias("is_read"))


UPS = ["price", "market_price", "profit_margin_pct", "recommendation"]


@register("matched_upsert", S.with_ctes(f"""SELECT coalesce(n.market_stone_id, o.market_stone_id) AS market_stone_id, coalesce(n.stone_id, o.stone_id) AS stone_id,
    {', '.join(f'CASE WHEN n.pair_id IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}' for c in UPS)},
    CASE WHEN o.pair_id IS NOT NULL THEN TIMESTAMP '{T0}' ELSE TIMESTAMP '{T1}' END AS matched_at,
    CASE WHEN n.pair_id IS NOT NULL THEN TIMESTAMP '{T1}' ELSE TIMESTAMP '{T0}' END AS updated_at,
    CASE WHEN n.pair_id IS NULL THEN 'retire' WHEN o.pair_id IS NULL THEN 'insert' ELSE 'update' END AS mark
  FROM pp_new n FULL OUTER JOIN pp_old o ON n.stone_id = o.stone_id AND n.market_stone_id = o.market_stone_id""", "pp_new", "pp_old"))
def matched_upsert(spark, d):
    """Two syncs merged into a bucketed table, then what the second one did to each pair."""
    table = VersionedTable(spark, shared_path(spark, "pair-table", uuid.uuid4().hex[:12]))
    for pairs, at in ((old_pairs(spark, d), T0), (new_pairs(spark, d), T1)):
        at = F.to_timestamp(F.lit(at))
        table.merge(pairs.select(*PR.PAIR_KEY, *UPS, at.alias("matched_at"), at.alias("updated_at")), PR.PAIR_KEY, PR.sync_merge)
    return PR.sync_mark(table.load(), F.to_timestamp(F.lit(T1)))


HISTORY = "pair_id, market_stone_id, stone_id, market_price AS vdb_price, price AS diamax_price, expected_profit AS market_difference, profit_margin_pct"
S.add("history", ["pp_new", "pp_old"], f"SELECT {HISTORY}, TIMESTAMP '{T0}' AS recorded_at FROM pp_old UNION ALL SELECT {HISTORY}, TIMESTAMP '{T1}' FROM pp_new")


def history_df(spark, d):
    def snap(df, ts):
        return df.select("pair_id", *PR.PAIR_KEY, F.col("market_price").alias("vdb_price"), F.col("price").alias("diamax_price"),
                         F.col("expected_profit").alias("market_difference"), "profit_margin_pct",
                         F.to_timestamp(F.lit(ts)).alias("recorded_at"))
    return snap(old_pairs(spark, d), T0).unionByName(snap(new_pairs(spark, d), T1))


@register("price_snapshot", S.with_ctes("SELECT * FROM history", "history"))
def price_snapshot(spark, d):
    """Price history appended per sync (two syncs)."""
    return history_df(spark, d)


@register("price_history_window", S.with_ctes(" UNION ALL ".join(
    f"SELECT '{p}' AS period, * FROM history WHERE recorded_at >= TIMESTAMP '{T1}' - INTERVAL {h} HOUR" for p, h in (("1h", 1), ("24h", 24), ("7d", 168), ("30d", 720), ("other", 24))), "history"))
def price_history_window(spark, d):
    """The history of each period before the latest sync; an unknown period is 24 hours."""
    h, as_of = history_df(spark, d), F.to_timestamp(F.lit(T1))
    parts = [PR.in_period(h, as_of, p).select(F.lit(p).alias("period"), "*") for p in (*PR.PERIODS, "other")]
    return reduce(DataFrame.unionByName, parts)


@register("margin_stability", S.with_ctes("""SELECT pair_id, points, CASE WHEN points < 2 THEN 70.0
    ELSE """ + S.rnd("least(greatest(100.0 - v_ * 5, 0.0), 100.0)", 4) + """ END AS stability_score FROM (
  SELECT pair_id, count(*) AS points, var_pop(profit_margin_pct) AS v_ FROM (
    SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY recorded_at DESC) <= 10) t GROUP BY pair_id) g""", "history"))
def margin_stability(spark, d):
    return PR.margin_stability(history_df(spark, d))


@register("pair_dashboard_stats", S.with_ctes(f"""SELECT (SELECT count(*) FROM market) AS market_listings,
    (SELECT count(*) FROM inventory) AS inventory_listings, count(*) AS total_matches,
    count(*) FILTER (WHERE recommendation = 'STRONG_BUY') AS strong_buy, count(*) FILTER (WHERE recommendation = 'BUY') AS buy,
    count(*) FILTER (WHERE recommendation = 'HOLD') AS hold, count(*) FILTER (WHERE recommendation = 'WAIT') AS wait,
    count(*) FILTER (WHERE recommendation = 'AVOID') AS avoid, {S.rnd('coalesce(avg(profit_margin_pct), 0.0)')} AS avg_margin,
    {S.rnd('coalesce(sum(expected_profit), 0.0)', 2, True)} AS total_profit,
    (SELECT count(*) FROM alerts WHERE NOT is_read) AS unread_alerts FROM pp_new""", "pp_new", "market", "inventory", "alerts"))
def pair_dashboard_stats(spark, d):
    p = new_pairs(spark, d)
    m = base.market(spark, d).select(F.count(F.lit(1))).scalar()
    i = base.inventory(spark, d).select(F.count(F.lit(1))).scalar()
    u = alerts_df(spark, d).where(~F.col("is_read")).select(F.count(F.lit(1))).scalar()
    r = F.col("recommendation")
    return p.agg(F.count(F.lit(1)).alias("total_matches"), *[F.count_if(r == x).alias(x.lower()) for x in
                                                             ("STRONG_BUY", "BUY", "HOLD", "WAIT", "AVOID")],
                 F.avg("profit_margin_pct").alias("_m"), F.sum("expected_profit").alias("_p")).select(
        m.alias("market_listings"), i.alias("inventory_listings"), "total_matches", "strong_buy", "buy", "hold", "wait",
        "avoid", rnd(F.coalesce(F.col("_m"), F.lit(0.0))).alias("avg_margin"),
        rnd(F.coalesce(F.col("_p"), F.lit(0.0)), 2, True).alias("total_profit"), u.alias("unread_alerts"))


@register("pair_report", S.with_ctes("""SELECT stone_id AS "Inventory ID", market_stone_id AS "Market ID", shape AS "Shape", carat AS "Carat",
    color AS "Color", clarity AS "Clarity", price AS "Own Price", market_price AS "Market Price",
    profit_margin_pct AS "Margin %", recommendation AS "Recommendation" FROM pp_new""", "pp_new"))
def pair_report(spark, d):
    p = new_pairs(spark, d)
    return p.select(F.col("stone_id").alias("Inventory ID"), F.col("market_stone_id").alias("Market ID"),
                    F.col("shape").alias("Shape"), F.col("carat").alias("Carat"), F.col("color").alias("Color"),
                    F.col("clarity").alias("Clarity"), F.col("price").alias("Own Price"),
                    F.col("market_price").alias("Market Price"), F.col("profit_margin_pct").alias("Margin %"),
                    F.col("recommendation").alias("Recommendation"))
