"""Stone-level sell-through pricing: every inventory stone joined to its
cohort's stock count, sales and evidence rate; the shared sold-% price band
moves the current per-carat rate.

Cohort figures are per-cohort aggregates joined back (not a window over the
cohort), so a cohort holding a third of all stones is still counted with a
partial aggregate, and the join is between stones and one row per cohort."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions.exprs import price_band, rnd, safe_div, size_range, truthy

COHORT = dims.COHORT_KEYS
STONE_OUT = ["stone_id", "carat", "shape", "size_range", "color", "clarity", "cut", "polish", "symmetry",
             "fluorescence", "lab", "cohort_stock", "cohort_sold", "remaining_stock", "excess_stock", "sales_pct",
             "current_price", "current_rate", "historical_rate", "vdb_price", "vdb_rate", "ev_rate", "ai_price",
             "recommended_rate", "vdb_difference", "market_gap_pct", "market_target_rate", "price_adjustment",
             "action", "recommendation", "top_1pct_target"]


def _r(c: Column, n: int = 2) -> Column:
    """round when truthy, else null (mirrors `round(x) if x else None`)."""
    return F.when(truthy(c), rnd(c, n))


def stone_sell_through(selling: DataFrame, sales_cohorts: DataFrame, ev_rates: DataFrame | None = None) -> DataFrame:
    s = selling.withColumn("size_range", size_range(F.col("carat"))).where(F.col("size_range").isNotNull())
    stock = s.groupBy(*COHORT).agg(F.count(F.lit(1)).alias("cohort_stock"))
    cohorts = stock.join(sales_cohorts, COHORT, "left")
    cohorts = cohorts.join(ev_rates, COHORT, "left") if ev_rates is not None else cohorts.withColumn("ev_rate", F.lit(None).cast("double"))
    j = s.join(F.broadcast(cohorts), COHORT, "left")  # a row per size range, shape and grades: stones stay where they are
    stock_n = F.col("cohort_stock")
    sold = F.coalesce(F.col("sold_stones"), F.lit(0)).cast("long")
    carat = F.coalesce(F.col("carat"), F.lit(0.0))
    current = F.coalesce(F.col("price"), F.lit(0.0))
    current_rate = F.when(carat != 0, current / carat)
    vdb = F.col("market_bottom_price")
    vdb_rate = F.when(vdb.isNotNull() & (carat != 0), vdb / carat)
    hist = safe_div(F.col("sales_value"), F.col("sold_carats"))
    sales_pct = F.when(stock_n > 0, sold / stock_n * 100.0).otherwise(F.lit(0.0))
    j = j.withColumns({"_carat": carat, "_current": current, "_cr": current_rate, "_vr": vdb_rate, "_hr": hist,
                       "_sold": sold, "_pct": sales_pct})
    adj = price_band(F.col("_pct"))
    j = j.withColumn("_adj", adj)
    target_rate = F.when(truthy(F.col("_cr")) & F.col("_adj").isNotNull(), F.col("_cr") * (F.lit(1.0) + F.col("_adj")))
    j = j.withColumn("_tr", target_rate).withColumn("_t", F.col("_tr") * F.col("_carat"))
    move = F.format_string("%d", rnd(F.abs(F.col("_adj")) * 100, 0).cast("int"))
    action = (F.when(F.col("_tr").isNull(), F.lit("Manual review"))
              .when(F.col("_adj") < 0, F.concat(F.lit("Reduce price "), move, F.lit("%")))
              .when(F.col("_adj") > 0, F.concat(F.lit("Increase price "), move, F.lit("%")))
              .otherwise(F.lit("Hold price")))
    pct1 = rnd(F.col("_pct"), 1)
    band = F.concat(F.when(F.col("_adj") > 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%d", rnd(F.col("_adj") * 100, 0).cast("int")))
    recommendation = (F.when(F.col("_tr").isNull(), F.lit("no_rate"))
                      .when(F.col("_adj") == 0, F.format_string("sold_%.1f_hold", pct1))
                      .otherwise(F.format_string("sold_%.1f_band_%s", pct1, band)))
    gap = F.when(truthy(F.col("_cr")) & truthy(F.col("_vr")), (F.col("_cr") - F.col("_vr")) / F.col("_vr") * 100)
    return j.select(
        "stone_id", rnd(F.col("_carat"), 2).alias("carat"), "shape", "size_range", "color", "clarity",
        *[F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(c) for c in
          ("cut", "polish", "symmetry", "fluorescence", "lab")],
        stock_n.alias("cohort_stock"), F.col("_sold").alias("cohort_sold"), stock_n.alias("remaining_stock"),
        (stock_n - F.col("_sold")).alias("excess_stock"), pct1.alias("sales_pct"),
        rnd(F.col("_current"), 2).alias("current_price"), _r(F.col("_cr")).alias("current_rate"),
        _r(F.col("_hr")).alias("historical_rate"), _r(vdb).alias("vdb_price"), _r(F.col("_vr")).alias("vdb_rate"),
        _r(F.col("ev_rate")).alias("ev_rate"), _r(F.col("_t")).alias("ai_price"),
        F.when(truthy(F.col("_t")) & (F.col("_carat") != 0), rnd(F.col("_t") / F.col("_carat"), 2)).alias("recommended_rate"),
        F.when(vdb.isNotNull(), rnd(vdb - F.col("_current"), 2)).alias("vdb_difference"),
        rnd(gap, 1).alias("market_gap_pct"),
        F.when(F.col("_tr").isNotNull(), rnd(F.col("_tr"), 2)).alias("market_target_rate"),
        F.col("_adj").alias("price_adjustment"), action.alias("action"), recommendation.alias("recommendation"),
        _r(F.col("top1_listing_price")).alias("top_1pct_target"),
        *[F.col(c) for c in ("price", "src_part", "src_supp", "src_amount", "src_disc", "src_tax") if c in j.columns],
    )


FACET_ATTRS = ["shape", "color", "clarity", "cut", "polish", "symmetry", "fluorescence", "lab", "action"]


def stone_facets(stones: DataFrame) -> DataFrame:
    """Sorted distinct non-empty values of the facet attributes (one unpivot +
    distinct) plus the 63 size ranges in master order."""
    long = stones.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("facet"), F.col(a).cast("string").alias("value")) for a in FACET_ATTRS])).alias("f")
    ).select("f.*").where(F.coalesce(F.col("value") != "", F.lit(False))).distinct()
    from pyspark.sql import Window
    ranked = long.withColumn("ordinal", F.row_number().over(Window.partitionBy("facet").orderBy("value")))
    spark = stones.sparkSession
    ranges = spark.createDataFrame([("size_range", label, i + 1) for i, (label, _, _) in enumerate(dims.SIZE_MASTER)],
                                   "facet string, value string, ordinal int")
    return ranked.unionByName(ranges)


def facet_search(stones: DataFrame, filters: dict[str, str] | None = None, search: str | None = None,
                 limit: int | None = 500, tiebreak: list[str] | None = None) -> DataFrame:
    """Faceted equality filters + substring search over the concatenated key;
    board order excess desc, sales % asc."""
    df = stones
    for k, v in (filters or {}).items():
        if v:
            df = df.where(F.col(k) == v)
    if search and search.strip():
        hay = F.upper(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
                                         ("stone_id", "shape", "size_range", "color", "clarity", "cut", "polish",
                                          "symmetry", "fluorescence", "lab")]))
        df = df.where(hay.contains(search.strip().upper()))
    ordered = df.orderBy(F.col("excess_stock").desc(), F.col("sales_pct").asc(),
                         *[F.col(c).asc() for c in (tiebreak or ["stone_id"])])
    return ordered.limit(limit) if limit else ordered


SELLING_ROW_COLS = ["stone_id", "shape", "carat", "color", "clarity", "cut", "polish", "symmetry", "fluorescence",
                    "lab", "current_rate", "vdb_rate", "historical_rate", "ev_rate", "recommended_rate",
                    "vdb_difference", "market_gap_pct", "expected_delta", "change_pct", "sales_pct",
                    "top_1pct_target", "recommendation", "action"]


def selling_rows(stones: DataFrame) -> DataFrame:
    """Re-projection of the stone board for the selling page: current rate,
    change % and expected per-carat delta."""
    cr, rr = F.col("current_rate"), F.col("recommended_rate")
    ok = truthy(cr) & truthy(rr)
    return stones.withColumns({
        "change_pct": F.coalesce(F.when(ok, (rr / cr - 1) * 100), F.lit(0.0)),
        "expected_delta": F.when(ok, rr - cr).otherwise(F.lit(0.0)),
    })


SORTABLE = {"current_rate", "vdb_rate", "historical_rate", "ev_rate", "recommended_rate", "change_pct", "sales_pct"}


def selling_page(rows: DataFrame, action: str | None, sort_by: str, sort_dir: str, page: int, page_size: int,
                 tiebreak: list[str]) -> DataFrame:
    """Action substring filter, dynamic sort (nulls as -inf both ways), page."""
    df = rows
    if action and action.upper() != "ALL":
        df = df.where(F.upper(F.col("action")).contains(action.upper()))
    order = []
    if sort_by in SORTABLE:
        order.append(F.col(sort_by).desc_nulls_last() if sort_dir.lower() == "desc" else F.col(sort_by).asc_nulls_first())
    order += [F.col(c).asc() for c in tiebreak]
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def selling_page_summary(page_rows: DataFrame, all_rows: DataFrame, inventory_count: DataFrame) -> DataFrame:
    """Counts by action word and mean/sum/max of deltas over the page; match
    totals over every filtered row (scalar subqueries, no cross join)."""
    total = all_rows.select(F.count(F.lit(1))).scalar()
    inv = inventory_count.select(F.count(F.lit(1))).scalar()
    a = F.upper(F.col("action"))
    agg = page_rows.agg(
        F.count_if(a.contains("REDUCE")).alias("sell_now_count"),
        F.count_if(a.contains("HOLD")).alias("wait_count"),
        F.count_if(a.contains("INCREASE")).alias("increase_count"),
        F.avg("change_pct").alias("_m"), F.sum("expected_delta").alias("_s"), F.max("expected_delta").alias("_x"),
        F.avg("sales_pct").alias("_c"))
    return agg.select(
        inv.alias("total_inventory"), total.alias("total_matches"),
        F.when(inv > 0, rnd(total / inv * 100, 1)).otherwise(F.lit(0.0)).alias("match_rate"),
        "sell_now_count", "wait_count", F.lit(0).cast("long").alias("avoid_count"), "increase_count",
        rnd(F.coalesce(F.col("_m"), F.lit(0.0)), 4).alias("avg_profit_margin"),
        rnd(F.coalesce(F.col("_s"), F.lit(0.0)), 2, True).alias("total_expected_profit"),
        rnd(F.coalesce(F.col("_x"), F.lit(0.0)), 2).alias("max_profit"),
        rnd(F.coalesce(F.col("_c"), F.lit(0.0)), 4).alias("avg_competitiveness"))
