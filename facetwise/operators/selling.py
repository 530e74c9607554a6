"""Selling intelligence: price ladder, listing target, profit, competitiveness,
recommendation tiers and the negotiation range (one projection, no shuffle)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions.exprs import clamp, rnd

TIER_LABELS = ["PREMIUM SELL OPPORTUNITY", "SELL NOW", "GOOD SELLING OPPORTUNITY", "WAIT", "AVOID"]
TOP1_STATUS = ["NO_EXACT_COMPARABLE", "BELOW_PROFIT_FLOOR", "ELIGIBLE_FOR_VISIBILITY_TEST"]


def rules(config: dict | None = None) -> dict:
    merged = dict(dims.DEFAULT_RULES)
    merged.update({k: float(v) for k, v in (config or {}).items() if k in merged})
    return merged


def recommendation_tier(pct: Column, cfg: dict) -> tuple[Column, Column, Column]:
    rec = (F.when(pct >= cfg["premium_threshold"], F.lit(TIER_LABELS[0]))
           .when(pct >= cfg["sell_now_threshold"], F.lit(TIER_LABELS[1]))
           .when(pct >= cfg["good_opp_threshold"], F.lit(TIER_LABELS[2]))
           .when(pct >= cfg["wait_threshold"], F.lit(TIER_LABELS[3]))
           .otherwise(F.lit(TIER_LABELS[4])))
    stars = (F.when(pct >= cfg["premium_threshold"], F.lit(5)).when(pct >= cfg["sell_now_threshold"], F.lit(4))
             .when(pct >= cfg["good_opp_threshold"], F.lit(3)).when(pct >= cfg["wait_threshold"], F.lit(2))
             .otherwise(F.lit(1)))
    action = (F.when(pct >= cfg["good_opp_threshold"], F.lit("SELL NOW"))
              .when(pct >= cfg["wait_threshold"], F.lit("WAIT")).otherwise(F.lit("AVOID")))
    return rec, stars, action


def selling_intelligence(matched: DataFrame, config: dict | None = None) -> DataFrame:
    cfg = rules(config)
    b, p = F.col("market_bottom_price"), F.col("price")
    has = b.isNotNull()
    diff_abs = F.when(has, b - p).otherwise(p * 0.10)
    diff_pct = F.when(has, (b - p) / p * 100.0).otherwise(F.lit(10.0))
    gain = F.greatest(diff_abs, F.lit(0.0))
    out = matched.withColumns({
        "market_diff_abs": diff_abs,
        "market_diff_pct": diff_pct,
        "min_selling_price": rnd(F.when(has, p + gain * 0.5).otherwise(p * 1.04)),
        "recommended_selling_price": rnd(F.when(has, p + gain * 0.75).otherwise(p * 1.08)),
        "premium_selling_price": rnd(F.when(has, b).otherwise(p * 1.10)),
        "effective_market_price": rnd(F.when(has, b).otherwise(p * 1.10)),
        "top1_candidate_price": rnd(F.col("market_p01_price") * 0.9975),
    })
    cand, floor = F.col("top1_candidate_price"), F.col("min_selling_price")
    rec, stars, action = recommendation_tier(F.col("market_diff_pct"), cfg)
    rec_p = F.col("recommended_selling_price")
    out = out.withColumns({
        "top1_listing_price": F.when(cand.isNotNull() & (cand >= floor), cand),
        "top1_status": (F.when(F.col("market_p01_price").isNull(), F.lit(TOP1_STATUS[0]))
                        .when(cand < floor, F.lit(TOP1_STATUS[1])).otherwise(F.lit(TOP1_STATUS[2]))),
        "expected_profit": rnd(rec_p - p),
        "profit_pct": rnd((rec_p - p) / p * 100.0),
        "competitiveness_score": rnd(clamp(F.lit(100.0) - F.col("market_diff_pct") * 0.4, 50.0, 100.0), 1),
        "recommendation": rec,
        "stars": stars,
        "action": action,
        "negotiation_range": F.concat(F.lit("$"), F.format_string("%.2f", F.col("min_selling_price")),
                                      F.lit(" - $"), F.format_string("%.2f", F.col("premium_selling_price"))),
    })
    return out


# Leaderboards: (name, membership predicate, sort column, descending)
BOARDS = [
    ("top_profitable", None, "expected_profit", True),
    ("top_sell_now", ("action", "SELL NOW"), "market_diff_pct", True),
    ("top_premium_opps", ("recommendation_contains", "PREMIUM"), "market_diff_pct", True),
    ("top_margin", None, "profit_pct", True),
    ("top_wait", ("action", "WAIT"), "market_diff_pct", True),
    ("lowest_margin", None, "profit_pct", False),
]


def leaderboards(selling: DataFrame, k: int = 10, tiebreak: list[str] | None = None) -> DataFrame:
    """Six top-k boards in one scan: every row is exploded into the boards it
    belongs to with a signed sort key, then ``row_number() <= k`` per board.
    Spark plans a partial WindowGroupLimit before the shuffle, so each map task
    forwards at most k rows per board."""
    from pyspark.sql import Window
    tiebreak = tiebreak or ["stone_id"]
    entries = []
    for name, member, sort_col, desc in BOARDS:
        if member is None:
            cond = F.lit(True)
        elif member[0] == "recommendation_contains":
            cond = F.col("recommendation").contains(member[1])
        else:
            cond = F.col(member[0]) == member[1]
        key = F.col(sort_col) if desc else -F.col(sort_col)
        entries.append(F.when(cond, F.struct(F.lit(name).alias("board"), key.alias("sort_key"))))
    exploded = selling.withColumn("_b", F.explode(F.array_compact(F.array(*entries))))
    exploded = exploded.select("*", F.col("_b.board").alias("board"), F.col("_b.sort_key").alias("_sort")).drop("_b")
    w = Window.partitionBy("board").orderBy(F.col("_sort").desc_nulls_last(), *[F.col(c).asc() for c in tiebreak])
    return exploded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_sort")


def kpi_summary(selling: DataFrame) -> DataFrame:
    """Counts, match rate, action counts, mean margin, total/max profit,
    mean competitiveness (one global aggregate)."""
    agg = selling.agg(
        F.count(F.lit(1)).alias("total_inventory"),
        F.count(F.col("market_bottom_price")).alias("total_matches"),
        F.count_if(F.col("action") == "SELL NOW").alias("sell_now_count"),
        F.count_if(F.col("action") == "WAIT").alias("wait_count"),
        F.count_if(F.col("action") == "AVOID").alias("avoid_count"),
        F.avg("profit_pct").alias("_avg_margin"),
        F.sum("expected_profit").alias("_total_profit"),
        F.max("expected_profit").alias("_max_profit"),
        F.avg("competitiveness_score").alias("_avg_comp"),
    )
    return agg.select(
        "total_inventory", "total_matches",
        F.when(F.col("total_inventory") > 0,
               rnd(F.col("total_matches") / F.col("total_inventory") * 100.0, 1)).otherwise(F.lit(0.0)).alias("match_rate"),
        "sell_now_count", "wait_count", "avoid_count",
        rnd(F.coalesce(F.col("_avg_margin"), F.lit(0.0)), 2).alias("avg_profit_margin"),
        rnd(F.coalesce(F.col("_total_profit"), F.lit(0.0)), 2, wide=True).alias("total_expected_profit"),
        rnd(F.coalesce(F.col("_max_profit"), F.lit(0.0)), 2).alias("max_profit"),
        rnd(F.coalesce(F.col("_avg_comp"), F.lit(0.0)), 1).alias("avg_competitiveness"),
    )
