"""Report extracts, display/flag projections and ingest/status operators."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions.exprs import price_band, rnd, truthy
from facetwise.operators import selling
from facetwise.plans import base, fixtures
from facetwise.plans import sqlparts as S
from facetwise.plans.q_core import selling_sql
from facetwise.plans.q_matrix import SHAPED, cells_df, ev_df, from_cells, shape_cells_df, stock_df
from facetwise.plans.q_pairs import new_pairs
from facetwise.plans.q_sales import sales_cohorts_df
from facetwise.plans.registry import ORACLES, register
from facetwise.session import shared_path
from facetwise.sources import feeds
from facetwise.sources.snapshots import load_snapshot, write_snapshot
from facetwise.sources.versions import VersionedTable, files_of, first_available
from facetwise.operators import matrix as MX

FLAT = [("stone_id", "Stone ID"), ("market_stone_id", "Market ID"), ("shape", "Shape"), ("carat", "Carat"), ("color", "Color"), ("clarity", "Clarity"),
        ("cut", "Cut"), ("polish", "Polish"), ("symmetry", "Symmetry"), ("fluorescence", "Fluorescence"), ("lab", "Lab"),
        ("country", "Country"), ("market_bottom_price", "Market Bottom"), ("price", "Own Price"),
        ("market_diff_abs", "Market Diff"), ("market_diff_pct", "Market Diff %"), ("min_selling_price", "Min Sell"),
        ("recommended_selling_price", "Recommended"), ("premium_selling_price", "Premium"),
        ("expected_profit", "Expected Profit"), ("profit_pct", "Profit %"), ("negotiation_range", "Negotiation Range"), ("competitiveness_score", "Competitiveness"), ("recommendation", "Recommendation"),
        ("action", "Action")]


@register("flat_report", S.with_ctes("SELECT " + ", ".join(f'{c} AS "{l}"' for c, l in FLAT) + " FROM selling", "selling"))
def flat_report(spark, d):
    """25 ordered, labelled columns of the selling table (sink-ready)."""
    return base.matched(spark, d).select(*[F.col(c).alias(label) for c, label in FLAT])


PREVIEW = [("shape", "Shape"), ("carat", "Carat"), ("color", "Color"), ("clarity", "Clarity"), ("lab", "Lab"), ("price", "Own $"),
           ("recommended_selling_price", "Rec Sell $"), ("expected_profit", "Profit $"), ("action", "Action")]
WHOLE = {"price", "recommended_selling_price", "expected_profit"}  # shown without cents


@register("report_preview", S.with_ctes("SELECT " + ", ".join(f'{S.rnd(c, 0) if c in WHOLE else c} AS "{l}"' for c, l in PREVIEW) + f"""
  FROM selling WHERE market_bottom_price IS NOT NULL ORDER BY {', '.join(base.TIEBREAK)} LIMIT 15""", "selling"))
def report_preview(spark, d):
    """The first 15 matched stones in the order of the table (by id)."""
    m = base.matched(spark, d).where(F.col("market_bottom_price").isNotNull()).orderBy(*base.TIEBREAK).limit(15)
    return m.select(*[(rnd(F.col(c), 0) if c in WHOLE else F.col(c)).alias(label) for c, label in PREVIEW])


PAIR_PREVIEW = "market_stone_id || ' | ' || stone_id || ' | ' || profit_margin_pct || '% | ' || recommendation"


@register("pair_preview", S.with_ctes(f"SELECT {PAIR_PREVIEW} AS line FROM pp_new ORDER BY market_stone_id, stone_id LIMIT 20", "pp_new"))
def pair_preview(spark, d):
    """(legacy) The first 20 pairs as report lines."""
    p = new_pairs(spark, d).orderBy("market_stone_id", "stone_id").limit(20)
    return p.select(F.concat_ws(" | ", "market_stone_id", "stone_id", F.concat(F.col("profit_margin_pct").cast("string"), F.lit("%")), "recommendation").alias("line"))


KPI_NAMES = ["total_inventory", "total_matches", "match_rate", "sell_now_count", "wait_count", "avoid_count",
             "avg_profit_margin", "total_expected_profit", "max_profit", "avg_competitiveness"]


@register("report_kpis", S.with_ctes(f"""SELECT metric, value FROM (SELECT {', '.join(f'CAST({k} AS DOUBLE) AS {k}' for k in KPI_NAMES)} FROM (
  SELECT count(*) AS total_inventory, count(market_bottom_price) AS total_matches,
    CASE WHEN count(*) > 0 THEN {S.rnd('count(market_bottom_price) / count(*) * 100.0', 1)} ELSE 0.0 END AS match_rate,
    count(*) FILTER (WHERE action = 'SELL NOW') AS sell_now_count, count(*) FILTER (WHERE action = 'WAIT') AS wait_count,
    count(*) FILTER (WHERE action = 'AVOID') AS avoid_count, {S.rnd('coalesce(avg(profit_pct), 0.0)')} AS avg_profit_margin,
    {S.rnd('coalesce(sum(expected_profit), 0.0)', 2, True)} AS total_expected_profit, {S.rnd('coalesce(max(expected_profit), 0.0)')} AS max_profit,
    {S.rnd('coalesce(avg(competitiveness_score), 0.0)', 1)} AS avg_competitiveness FROM selling) k) w
  UNPIVOT (value FOR metric IN ({', '.join(KPI_NAMES)}))""", "selling"))
def report_kpis(spark, d):
    """KPI table as (metric, value) rows — an unpivot of the one-row summary."""
    k = selling.kpi_summary(base.matched(spark, d)).select(*[F.col(c).cast("double").alias(c) for c in KPI_NAMES])
    return k.unpivot([], KPI_NAMES, "metric", "value")


DETAIL = [("size_range", "Size Range"), ("color", "Color"), ("clarity", "Clarity"), ("vdb_pieces", "Market Pcs"),
          ("pieces", "Pcs"), ("sold", "Sold"), ("sales_pct", "Sold %"), ("vdb_price", "Market $/ct"),
          ("diamax_price", "Own $/ct"), ("historical_price", "Historical $/ct"), ("ai_price", "AI $/ct"),
          ("demand_score", "Demand"), ("inventory_status", "Status")]


@register("matrix_detail_report", from_cells([f'{a} AS "{b}"' for a, b in DETAIL]))
def matrix_detail_report(spark, d):
    return cells_df(spark, d).select(*[F.col(a).alias(b) for a, b in DETAIL])


SUMMARY = [("size_range", "Size Range"), ("total_stock", "Stock"), ("total_sold", "Sold"), ("sales_pct", "Sold %"),
           ("current_price", "Current $/ct"), ("historical_selling_price", "Historical $/ct"), ("suggested_price", "AI $/ct")]


@register("range_summary_report", "SELECT " + ", ".join(f'{a} AS "{b}"' for a, b in SUMMARY) + f" FROM ({ORACLES['carat_matrix']})")
def range_summary_report(spark, d):
    r = MX.carat_matrix(spark, stock_df(spark, d), sales_cohorts_df(spark, d), ev_df(spark, d))
    return r.select(*[F.col(a).alias(b) for a, b in SUMMARY])


GRID_SHAPES = [MX.ALL, *dims.PREFERRED_SHAPE_ORDER]
GRID_KEYS = [f"{s} {c}" for s in GRID_SHAPES for c in dims.GRID_CLARITIES]
#: metric -> (market, own, AI) as SQL over a cell; the AI price is whole, its delta a whole percentage of the own price
GRID_METRICS = {
    "Pcs": ("CAST(vdb_pieces AS DOUBLE)", "CAST(pieces AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    "$/ct": ("vdb_price", "coalesce(diamax_price, current_price)", S.rnd("ai_price", 0)),
    "Sold %": ("CAST(NULL AS DOUBLE)", "sales_pct", "CASE WHEN coalesce(diamax_price, current_price) <> 0 THEN "
               + S.rnd("(ai_price - coalesce(diamax_price, current_price)) / coalesce(diamax_price, current_price) * 100", 0) + " END"),
}
GRID_SQL = " UNION ALL ".join(f"SELECT shape_sel || ' ' || clarity AS k, size_range, color, '{m}' AS metric, {a} AS market, {o} AS own, {ai} AS ai FROM {SHAPED}"
                              f" WHERE clarity IN ({', '.join(map(S.q, dims.GRID_CLARITIES))})" for m, (a, o, ai) in GRID_METRICS.items())


@register("matrix_grid", S.with_ctes("SELECT size_range, color, metric, " + ", ".join(
    f"""max({v}) FILTER (WHERE k = '{k}') AS "{k}_{v}\"""" for k in GRID_KEYS for v in ("market", "own", "ai")) + f" FROM ({GRID_SQL}) g GROUP BY ALL", SHAPED))
def matrix_grid(spark, d):
    """Rows size range x color x metric (Pcs, $/ct, Sold % with the AI price's delta); columns
    shape x clarity (VVS1, VVS2, VS1, VS2) x (market, own, AI), shapes in the preferred
    order after ALL: unpivot, then pivot with an explicit value list."""
    c = shape_cells_df(spark, d).where(F.col("clarity").isin(*dims.GRID_CLARITIES))
    own = F.coalesce("diamax_price", "current_price")
    none = F.lit(None).cast("double")
    metric = lambda name, market, mine, ai: F.struct(F.lit(name).alias("metric"), market.cast("double").alias("market"), mine.cast("double").alias("own"), ai.alias("ai"))
    rows = F.array(metric("Pcs", F.col("vdb_pieces"), F.col("pieces"), none), metric("$/ct", F.col("vdb_price"), own, rnd(F.col("ai_price"), 0)),
                   metric("Sold %", none, F.col("sales_pct"), F.when(truthy(own), rnd((F.col("ai_price") - own) / own * 100, 0))))
    long = c.select(F.concat_ws(" ", MX.SHAPES, "clarity").alias("k"), "size_range", "color", F.explode(rows).alias("m")).select("k", "size_range", "color", "m.*")
    return long.groupBy("size_range", "color", "metric").pivot("k", GRID_KEYS).agg(F.max("market").alias("market"), F.max("own").alias("own"), F.max("ai").alias("ai"))


AI_DELTA = "CASE WHEN ai_price IS NOT NULL AND coalesce(current_price <> 0, false) THEN {} END"


@register("price_delta", from_cells([*MX.CELL, "current_price", "ai_price", AI_DELTA.format(S.rnd("ai_price - current_price")) + " AS ai_delta",
                                     AI_DELTA.format(S.rnd("(ai_price - current_price) / current_price * 100", 1)) + " AS ai_delta_pct"]))
def price_delta(spark, d):
    c = cells_df(spark, d)
    ok = F.col("ai_price").isNotNull() & truthy(F.col("current_price"))
    return c.select("size_range", "color", "clarity", "current_price", "ai_price",
                    F.when(ok, rnd(F.col("ai_price") - F.col("current_price"))).alias("ai_delta"),
                    F.when(ok, rnd((F.col("ai_price") - F.col("current_price")) / F.col("current_price") * 100, 1)).alias("ai_delta_pct"))


@register("signal_flags", from_cells([*MX.CELL, "coalesce(sales_pct >= 100, false) AS high_sales", "coalesce(sales_pct <= 20, false) AS low_sales", "pieces <= 10 AS low_stock",
                                      "coalesce(demand_score >= 70, false) AS high_demand", "coalesce(demand_score <= 35, false) AS low_demand",
                                      "coalesce(ai_price < diamax_price, false) AS ai_below_own", "coalesce(ai_price > diamax_price, false) AS ai_above_own"]))
def signal_flags(spark, d):
    c = cells_df(spark, d)
    low = lambda x: F.coalesce(x, F.lit(False))  # noqa: E731 - an empty cell raises no flag
    return c.select("size_range", "color", "clarity",
                    low(F.col("sales_pct") >= 100).alias("high_sales"), low(F.col("sales_pct") <= 20).alias("low_sales"),
                    (F.col("pieces") <= 10).alias("low_stock"), low(F.col("demand_score") >= 70).alias("high_demand"),
                    low(F.col("demand_score") <= 35).alias("low_demand"),
                    low(F.col("ai_price") < F.col("diamax_price")).alias("ai_below_own"),
                    low(F.col("ai_price") > F.col("diamax_price")).alias("ai_above_own"))


@register("display_price", from_cells([*MX.CELL, "coalesce(ai_price, current_price, vdb_price, ev_price) AS display_price",
                                       "CASE WHEN ai_price IS NOT NULL THEN 'AI' WHEN current_price IS NOT NULL THEN 'Current' WHEN vdb_price IS NOT NULL THEN 'Market' WHEN ev_price IS NOT NULL THEN 'Evidence' END AS price_source"]))
def display_price(spark, d):
    c = cells_df(spark, d)
    price = F.coalesce(F.col("ai_price"), F.col("current_price"), F.col("vdb_price"), F.col("ev_price"))
    source = (F.when(F.col("ai_price").isNotNull(), F.lit("AI")).when(F.col("current_price").isNotNull(), F.lit("Current"))
              .when(F.col("vdb_price").isNotNull(), F.lit("Market")).when(F.col("ev_price").isNotNull(), F.lit("Evidence")))
    return c.select("size_range", "color", "clarity", price.alias("display_price"), source.alias("price_source"))


# ------------------------------------------------------------- ingest / status

@register("snapshot_roundtrip", S.with_ctes(f"SELECT {', '.join(base.STONE_COLS)} FROM market", "market"))
def snapshot_roundtrip(spark, d):
    """Two versions of the canonical market, then one whose writer was stopped before its
    manifest and one that lost a file: the second version is read back."""
    table = VersionedTable(spark, shared_path(spark, "roundtrip", uuid.uuid4().hex[:8], "market"))
    market = base.market(spark, d)
    table.replace(market.where(F.col("shape") == "ROUND"))
    table.replace(market)
    _unfinished(table, market.limit(1))
    return table.load().select(*base.STONE_COLS)


def _unfinished(table, rows):
    """What a stopped writer and a lost file leave behind, above the newest version."""
    rows.write.parquet(f"{table.root}/data/stopped")
    table._commit(max(table.versions(), default=0) + 1, {"all": ["data/stopped", {"part-lost.parquet": 1}]}, {})


@register("current_else_history", S.with_ctes("""SELECT 'current' AS source, shape, count(*) AS stones FROM market GROUP BY shape
  UNION ALL SELECT s.source, shape, count(*) FROM market, (VALUES ('damaged'), ('absent')) s(source) WHERE src_line % 2 = 0 GROUP BY ALL""", "market"))
def current_else_history(spark, d):
    """The current snapshot if it has a complete version, else the kept history: with a
    whole current one, with one that is damaged, and with none."""
    root = shared_path(spark, "current", uuid.uuid4().hex[:8])
    current, damaged, absent, history = (VersionedTable(spark, f"{root}/{x}") for x in ("market_current", "market_damaged", "market_absent", "market"))
    market = base.market(spark, d)
    history.replace(market.where(F.col("src_line") % 2 == 0))
    current.replace(market)
    _unfinished(damaged, market.limit(1))
    found = [first_available(t, history).groupBy("shape").agg(F.count(F.lit(1)).alias("stones")).select(F.lit(name).alias("source"), "shape", "stones")
             for name, t in (("current", current), ("damaged", damaged), ("absent", absent))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("snapshot_tolerant", S.with_ctes(f"SELECT {', '.join(base.STONE_COLS)} FROM matched", "matched"))
def snapshot_tolerant(spark, d):
    """Three loads: an intact snapshot gives all its rows; one with an unreadable
    part and a missing one are absent as a whole and give none."""
    path = shared_path(spark, "tolerant", uuid.uuid4().hex[:8], "matched")
    stones = base.matched(spark, d).select(*base.STONE_COLS)
    schema = stones.schema.simpleString()[7:-1].replace(":", " ")
    for p in (path, f"{path}-damaged"):
        write_snapshot(stones, p)
    stones.limit(1).select(F.lit("not a parquet file").alias("value")).write.mode("append").text(f"{path}-damaged")
    loads = [load_snapshot(spark, f"{path}{x}", schema) for x in ("", "-damaged", "-absent")]
    return loads[0].unionByName(loads[1]).unionByName(loads[2])


CSV_SQL = ", ".join(f'CAST({c} AS VARCHAR) AS "{n}"' for c, n in [
    ("stone_id", "Unique Stone ID"), ("shape_raw", "Shape"), ("carat_raw", "Weight"), ("color_raw", "Color"), ("clarity_raw", "Clarity"), ("cut_raw", "Cut"),
    ("polish_raw", "Polish"), ("symmetry_raw", "Symmetry"), ("fluorescence_raw", "Fluorescence"), ("lab_raw", "Lab"), ("country_raw", "Stone Location"),
    ("price_raw", "Total"), ("status", "Status"), *[(c, c) for c in base.SRC_COLS]])


@register("csv_feed_scan", S.with_ctes(f"SELECT {CSV_SQL} FROM market_raw", "market_raw"))
def csv_feed_scan(spark, d):
    """Market export as CSV: every column read as a string, malformed rows tolerated."""
    path = shared_path(spark, "csv", uuid.uuid4().hex[:8], "market")
    raw = feeds.market_feed(spark, d)
    raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns]).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return spark.read.options(header=True, inferSchema=False, mode="PERMISSIVE", **kept).csv(path)


EV_COLS = ["Shape", "EV_Size_Bucket", "Color", "Clarity", "EV_Stock", "EV_Sold", "Stock_Metric", "Diamax_Sold",
           "Demand_Category", "Data_Confidence", "Recommendation", "Reason"]


@register("evidence_load", S.with_ctes(f"SELECT {', '.join(chr(34) + c + chr(34) for c in EV_COLS)} FROM evidence", "evidence"))
def evidence_load(spark, d):
    """Prepared evidence file (JSON lines) read with an explicit schema; an
    absent file yields an empty frame with that schema."""
    from facetwise.operators.evidence import EVIDENCE_SCHEMA
    path = shared_path(spark, "evidence-json", uuid.uuid4().hex[:8])
    fixtures.evidence(spark, d).write.json(path)
    if files_of(spark, path) is None:
        return spark.createDataFrame([], EVIDENCE_SCHEMA)
    return spark.read.schema(EVIDENCE_SCHEMA).json(path)


RULES = {"premium_threshold": 12.0, "sell_now_threshold": 8.0, "good_opp_threshold": 4.0, "wait_threshold": 2.0}
selling_sql(RULES, "selling_r")
S.CTES["selling_r"] = (["selling1"], S.CTES["selling_r"][1])


@register("rules_recompute", S.with_ctes("""SELECT recommendation, action, count(*) AS n FROM selling_r GROUP BY ALL""", "selling_r"))
def rules_recompute(spark, d):
    """Saved thresholds overlay the defaults; the match and pricing are
    recomputed with them (tier histogram of the result)."""
    cfg = selling.rules(RULES)
    s = selling.selling_intelligence(base.compute_matched(spark, d), cfg)
    return s.groupBy("recommendation", "action").agg(F.count(F.lit(1)).alias("n"))


@register("source_status", S.with_ctes("""SELECT 'market' AS source, count(*) AS rows, count(*) > 0 AS loaded FROM market
  UNION ALL SELECT 'inventory', count(*), count(*) > 0 FROM inventory
  UNION ALL SELECT 'sales', count(*), count(*) > 0 FROM sales
  UNION ALL SELECT 'sales_deduped', count(*), count(*) > 0 FROM sales_d
  UNION ALL SELECT 'matched', count(*), count(*) > 0 FROM matched""", "market", "inventory", "sales", "sales_d", "matched"))
def source_status(spark, d):
    from facetwise.plans.q_sales import sales_deduped
    parts = [("market", base.market(spark, d)), ("inventory", base.inventory(spark, d)), ("sales", base.sales(spark, d)),
             ("sales_deduped", sales_deduped(spark, d)), ("matched", base.matched(spark, d))]
    out = None
    for name, df in parts:
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows",
                                                             (F.col("rows") > 0).alias("loaded"))
        out = row if out is None else out.unionByName(row)
    return out


@register("listing_page", S.with_ctes(f"""SELECT {', '.join(base.STONE_COLS)}, count(*) OVER () AS total FROM market
  WHERE shape = 'ROUND' AND color = 'G' QUALIFY true ORDER BY stone_id, {', '.join(feeds.LISTING_ORDER)} LIMIT 25 OFFSET 25""", "market"))
def listing_page(spark, d):
    """Market listings filtered by shape/color; page 2 of 25 ordered by id,
    with the total of the filtered rows."""
    m = base.market(spark, d).where((F.col("shape") == "ROUND") & (F.col("color") == "G"))
    total = m.select(F.count(F.lit(1))).scalar()
    return m.orderBy("stone_id", *feeds.LISTING_ORDER).offset(25).limit(25).select(*base.STONE_COLS).withColumn("total", total)


# ---------------------------------------------------- selling projections

@register("listing_target", S.with_ctes(
    "SELECT stone_id, price, min_selling_price, market_p01_price, top1_candidate_price, top1_listing_price, top1_status FROM selling",
    "selling"))
def listing_target(spark, d):
    """Top-1% listing target 0.9975 x q01, only when at or above the profit floor."""
    return base.compute_selling(spark, d).select("stone_id", "price", "min_selling_price", "market_p01_price",
                                                 "top1_candidate_price", "top1_listing_price", "top1_status")


@register("negotiation_range", S.with_ctes("SELECT stone_id, min_selling_price, premium_selling_price, negotiation_range FROM selling",
                                           "selling"))
def negotiation_range(spark, d):
    return base.compute_selling(spark, d).select("stone_id", "min_selling_price", "premium_selling_price",
                                                 "negotiation_range")


@register("recommendation_tiers", S.with_ctes(
    "SELECT recommendation, stars, action, count(*) AS n FROM selling GROUP BY ALL", "selling"))
def recommendation_tiers(spark, d):
    """5-tier recommendation / 3-state action histogram at the default thresholds."""
    return base.compute_selling(spark, d).groupBy("recommendation", "stars", "action").agg(F.count(F.lit(1)).alias("n"))


def _fold(col, folds):
    expr = None
    for label, members in folds:
        cond = F.col(col).isin(*members)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.col(col))


COLOR_FOLDS = [("K-M", ["K", "L", "M"])]
CLARITY_FOLDS = [("FL/IF", ["FL", "IF"]), ("I1-I3", ["I1", "I2", "I3"])]


def _fold_sql(col, folds):
    return "CASE " + " ".join(f"WHEN {col} IN ({', '.join(repr(m) for m in ms)}) THEN '{lbl}'" for lbl, ms in folds) + f" ELSE {col} END"


@register("color_distribution", S.with_ctes(f"""SELECT {_fold_sql('color', COLOR_FOLDS)} AS grade, count(*) AS stones,
    {S.rnd('avg(profit_pct)')} AS avg_margin FROM selling GROUP BY ALL""", "selling"))
def color_distribution(spark, d):
    """Count and mean margin per color grade (tail grades K-M folded)."""
    s = base.matched(spark, d).withColumn("grade", _fold("color", COLOR_FOLDS))
    return s.groupBy("grade").agg(F.count(F.lit(1)).alias("stones"), rnd(F.avg("profit_pct")).alias("avg_margin"))


@register("clarity_distribution", S.with_ctes(f"""SELECT {_fold_sql('clarity', CLARITY_FOLDS)} AS grade, count(*) AS stones,
    {S.rnd('avg(profit_pct)')} AS avg_margin FROM selling GROUP BY ALL""", "selling"))
def clarity_distribution(spark, d):
    """Count and mean margin per clarity grade (FL/IF and I1-I3 folded)."""
    s = base.matched(spark, d).withColumn("grade", _fold("clarity", CLARITY_FOLDS))
    return s.groupBy("grade").agg(F.count(F.lit(1)).alias("stones"), rnd(F.avg("profit_pct")).alias("avg_margin"))
