"""(legacy) Matched pairs: inner match where the last market listing per key
wins, pair pricing ladder and scores, negotiation advice, dashboard stats,
alerts between two syncs, upsert, price history and stability."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions.exprs import clamp, rnd

#: A pair is one market and one inventory listing.
PAIR_KEY = ["market_stone_id", "stone_id"]

PAIR_TIERS = [(10, "STRONG_BUY", 5), (5, "BUY", 4), (3, "HOLD", 3)]


def spec_premium(cut: Column, polish: Column, symmetry: Column, lab: Column, fluo: Column) -> Column:
    """50 + grade points (short codes and canonical names both accepted), clamp 0-100."""
    ex, vg = ["EX", "EXCELLENT"], ["VG", "VERY GOOD"]
    s = (F.lit(50.0)
         + F.when(cut.isin(*ex), 15).when(cut.isin(*vg), 8).otherwise(0)
         + F.when(polish.isin(*ex), 10).when(polish.isin(*vg), 5).otherwise(0)
         + F.when(symmetry.isin(*ex), 10).when(symmetry.isin(*vg), 5).otherwise(0)
         + F.when(lab == "GIA", 10).when(lab == "IGI", 5).otherwise(0)
         + F.when(fluo.isin("NON", "NONE", "FNT", "FAINT"), 5).when(fluo.isin("STG", "VST", "STRONG"), -10).otherwise(0))
    return clamp(s, 0.0, 100.0)


def holding_period(shape: Column, color: Column, clarity: Column, lab: Column) -> Column:
    base = F.when(shape == "ROUND", 5.0).when(shape.isin("OVAL", "CUSHION"), 8.0).otherwise(12.0)
    cf = (F.when(color.isin("D", "E", "F"), 0.7).when(color.isin("G", "H"), 0.85).when(color.isin("I", "J"), 1.0)
          .otherwise(1.4))
    kf = (F.when(clarity.isin("FL", "IF", "VVS1", "VVS2"), 0.8).when(clarity.isin("VS1", "VS2"), 0.9)
          .when(clarity.isin("SI1", "SI2"), 1.1).otherwise(1.5))
    lf = F.when(lab == "GIA", 0.9).otherwise(1.1)
    return F.least(F.lit(30), F.greatest(F.lit(2), (base * cf * kf * lf).cast("int")))


def pair_pricing(pairs: DataFrame, stability: Column | None = None, age_minutes: float = 0.0) -> DataFrame:
    v, d = F.col("market_price"), F.col("price")
    spread = v - d
    m = F.when(v > 0, spread / v * 100).otherwise(F.lit(0.0))
    df = pairs.withColumns({"_s": spread, "_m": m})
    rec, stars = None, None
    for bound, label, st in PAIR_TIERS:
        rec = F.when(F.col("_m") >= bound, F.lit(label)) if rec is None else rec.when(F.col("_m") >= bound, F.lit(label))
        stars = F.when(F.col("_m") >= bound, F.lit(st)) if stars is None else stars.when(F.col("_m") >= bound, F.lit(st))
    rec = rec.when(F.col("_m") > 0, F.lit("WAIT")).otherwise(F.lit("AVOID"))
    stars = stars.when(F.col("_m") > 0, F.lit(2)).otherwise(F.lit(1))
    margin_score = F.when(F.col("_m") > 0, F.least(F.lit(100.0), F.col("_m") * 10)).otherwise(F.lit(0.0))
    fresh = F.greatest(F.lit(0.0), F.lit(100.0 - age_minutes * 2))
    stab = stability if stability is not None else F.lit(70.0)
    spec = spec_premium(F.col("cut"), F.col("polish"), F.col("symmetry"), F.col("lab"), F.col("fluorescence"))
    conf = rnd(clamp(margin_score * 0.40 + fresh * 0.25 + stab * 0.20 + spec * 0.15, 0.0, 100.0), 1)
    df = df.withColumns({"spec_premium": spec, "confidence_score": conf,
                         "holding_period_days": holding_period(F.col("shape"), F.col("color"), F.col("clarity"), F.col("lab"))})
    composite = rnd(F.least(F.lit(100.0), F.col("_m") * 10) * 0.35 + F.col("confidence_score") * 0.25
                    + F.greatest(F.lit(0.0), F.lit(100.0) - F.col("holding_period_days") * 3) * 0.20
                    + F.least(F.lit(100.0), F.col("carat") * 40) * 0.20, 1)
    return df.withColumns({
        "buy_price": rnd(d), "max_buy_price": rnd(d + F.col("_s") * 0.25), "min_sell_price": rnd(d + F.col("_s") * 0.5),
        "recommended_sell_price": rnd(d + F.col("_s") * 0.75), "premium_sell_price": rnd(v),
        "expected_profit": rnd(F.col("_s")), "profit_margin_pct": rnd(F.col("_m")),
        "risk_adjusted_profit": rnd(F.col("_s") * (F.col("confidence_score") / 100)),
        "composite_buy_score": composite, "recommendation": rec, "stars": stars,
    }).drop("_s", "_m")


def negotiation_advice(priced: DataFrame) -> DataFrame:
    return priced.select("pair_id", F.col("max_buy_price").alias("do_not_buy_above"),
                         F.col("min_sell_price").alias("do_not_sell_below"),
                         F.col("recommended_sell_price").alias("ideal_sell_price"), "premium_sell_price",
                         F.array("min_sell_price", "premium_sell_price").alias("negotiation_range"))


def pair_id(market_id: Column | str = "market_stone_id", inventory_id: Column | str = "stone_id") -> Column:
    return F.concat_ws("|", market_id, inventory_id)


def alert_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """PRICE_CHANGE when the own price moved > 1% (denominator old price or 1),
    <REC>_ALERT when the recommendation changed, NEW_MATCH when unseen; one
    pair may yield two alerts (explode of the non-null candidates)."""
    o = old.select(*PAIR_KEY, F.col("price").alias("old_price"), F.col("recommendation").alias("old_rec"), F.lit(True).alias("seen"))
    j = new.join(o, PAIR_KEY, "left")
    seen = F.coalesce("seen", F.lit(False))
    denom = F.when(F.coalesce(F.col("old_price"), F.lit(0.0)) != 0, F.col("old_price")).otherwise(F.lit(1.0))
    moved = F.abs(F.col("price") - F.col("old_price")) / denom > dims.ALERT_PRICE_MOVE
    none = F.lit(None).cast("double")

    def alert(kind: str, old_value: Column, new_value: Column) -> Column:
        rec = F.col("recommendation")
        filled = [F.lit(text) if "{}" not in text else F.concat(*[x for part in text.split("{}") for x in (F.lit(part), rec)][:-1])
                  for text in (kind, *dims.ALERT_TEXTS[kind])]
        return F.struct(*[c.alias(n) for c, n in zip(filled, ("alert_type", "title", "message"))], old_value.alias("old_value"), new_value.alias("new_value"))

    found = F.array(F.when(seen & moved, alert("PRICE_CHANGE", F.col("old_price"), F.col("price"))),
                    F.when(seen & (F.col("recommendation") != F.col("old_rec")), alert("{}_ALERT", none, none)),
                    F.when(~seen, alert("NEW_MATCH", none, none)))
    return j.select(pair_id().alias("pair_id"), "stone_id", "market_stone_id", F.explode(F.array_compact(found)).alias("a")).select(
        "pair_id", "stone_id", "market_stone_id", "a.*", F.lit(False).alias("is_read"))


def sync_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """One sync of pairs into those known: the new metrics win, the time of the first
    match stays, ``updated_at`` tells when a pair was last seen."""
    rest = [c for c in new.columns if c not in PAIR_KEY]
    o, n = [side.select(*PAIR_KEY, F.struct(*rest).alias(name)) for side, name in ((old, "_old"), (new, "_new"))]
    value = lambda c: F.coalesce(f"_old.{c}", f"_new.{c}") if c == "matched_at" else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return o.join(n, PAIR_KEY, "full").select(*PAIR_KEY, *[value(c).alias(c) for c in rest]).select(*new.columns)


def sync_mark(pairs: DataFrame, sync_at: Column) -> DataFrame:
    """What the sync of that time did to each pair: insert, update, or retire (a pair it no
    longer holds; the row stays)."""
    return pairs.withColumn("mark", F.when(F.col("updated_at") < sync_at, F.lit("retire"))
                            .when(F.col("matched_at") == sync_at, F.lit("insert")).otherwise(F.lit("update")))


PERIODS = {"1h": "1 HOUR", "24h": "24 HOURS", "7d": "7 DAYS", "30d": "30 DAYS"}


def in_period(history: DataFrame, as_of: Column, period: str = "24h", pair: tuple[str, str] | None = None) -> DataFrame:
    """The price history of a period up to ``as_of`` (an unknown one: 24 hours), of all pairs
    or one (market id, inventory id), in time order."""
    out = history.where(F.col("recorded_at") >= as_of - F.expr(f"INTERVAL {PERIODS.get(period, PERIODS['24h'])}"))
    if pair is not None:
        out = out.where((F.col("market_stone_id") == pair[0]) & (F.col("stone_id") == pair[1]))
    return out.orderBy("recorded_at", *PAIR_KEY)


def margin_stability(history: DataFrame) -> DataFrame:
    """Population variance of the last <= 10 margins per pair; score =
    clamp(100 - 5 var, 0, 100), 70 when fewer than 2 points."""
    w = Window.partitionBy("pair_id").orderBy(F.col("recorded_at").desc())
    last = history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 10)
    g = last.groupBy("pair_id").agg(F.count(F.lit(1)).alias("points"), F.var_pop("profit_margin_pct").alias("_v"))
    return g.select("pair_id", "points", F.when(F.col("points") < 2, F.lit(70.0))
                    .otherwise(rnd(clamp(F.lit(100.0) - F.col("_v") * 5, 0.0, 100.0), 4)).alias("stability_score"))
