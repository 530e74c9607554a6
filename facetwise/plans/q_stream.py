"""Streaming queries: uploads are staged one after another and the stream is driven to
completion (and so restarted from its checkpoint) after each; the result must equal the
batch form."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.operators.pairs import PAIR_KEY
from facetwise.plans import base
from facetwise.plans import sqlparts as S
from facetwise.plans.q_pairs import T0, T1, new_pairs, old_pairs
from facetwise.plans.q_sales import sales_deduped
from facetwise.plans.registry import register
from facetwise.session import shared_path
from facetwise.streaming import alerts, streams

KEYS = streams.COMPACT_KEYS
COMPACT_SQL = S.with_ctes(f"""SELECT {', '.join(KEYS)}, count(*) AS piece_count, min(price) AS min_price,
    min({{'p': price, 'i': stone_id}}).i AS first_id FROM market WHERE price > 0 GROUP BY {', '.join(KEYS)}""", "market")


@register("market_compaction", COMPACT_SQL)
def market_compaction(spark, d):
    """Batched ingest compaction in one aggregate: groups are combined within each map
    task before the shuffle (a sort-based aggregate, as the cheapest id is a string)."""
    m = base.market(spark, d).where(F.col("price") > 0)
    return m.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("piece_count"), F.min("price").alias("min_price"),
                                F.min(F.struct("price", "stone_id")).getField("stone_id").alias("first_id"))


def _new_source(spark, name):
    return shared_path(spark, "stream-src", f"{name}-{uuid.uuid4().hex[:8]}")


def _upload(df, folder):
    df.write.mode("append").parquet(folder)


def _schema(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


@register("stream_market_compaction", COMPACT_SQL)
def stream_market_compaction(spark, d):
    """Three uploads of listings, merged group by group into a bucketed table."""
    m = base.market(spark, d).select("stone_id", *dims.MATCH_KEYS, "price", "status")
    src = _new_source(spark, "market")
    name = src.rsplit("/", 1)[1]
    third = F.pmod(F.xxhash64("stone_id"), F.lit(3))
    for upload in range(3):
        _upload(m.where(third == upload), src)
        streams.run_available(spark, streams.market_compaction_stream(spark, src, _schema(m)), name, KEYS)
    return streams.merged(spark, name)


@register("stream_trailing_sales", S.with_ctes(f"""SELECT CAST(w AS TIMESTAMP) AS window_start, CAST(w + INTERVAL 30 DAY AS TIMESTAMP) AS window_end,
    size_range, shape, color, clarity, count(*) AS sales
  FROM (SELECT *, {S.size_range('carat')} AS size_range,
      unnest(generate_series(sale_date - INTERVAL 29 DAY, CAST(sale_date AS TIMESTAMP), INTERVAL 1 DAY)) AS w
    FROM sales_d WHERE sale_date IS NOT NULL) t
  WHERE size_range IS NOT NULL GROUP BY ALL""", "sales_d"))
def stream_trailing_sales(spark, d):
    """Uploads of three spans of sale dates; daily panes are merged by day and cohort and
    the trailing windows are sums of panes."""
    s = sales_deduped(spark, d).select("sale_date", "shape", "color", "clarity", "carat")
    first, days = s.agg(F.min("sale_date"), F.datediff(F.max("sale_date"), F.min("sale_date"))).first()
    src = _new_source(spark, "sales")
    name = src.rsplit("/", 1)[1]
    span = F.floor(F.datediff("sale_date", F.lit(first)) * 3 / ((days or 0) + 1))
    for upload in range(3):
        _upload(s.where(span == upload), src)
        streams.run_available(spark, streams.sale_panes_stream(spark, src, _schema(s)), name, streams.PANE_KEYS)
    return streams.trailing_windows(streams.merged(spark, name))


HISTORY_COLS = [*PAIR_KEY, "vdb_price", "own_price", "market_difference", "profit_margin_pct", "recorded_at"]


@register("stream_price_history", S.with_ctes(" UNION ALL ".join(
    f"SELECT market_stone_id, stone_id, market_price AS vdb_price, price AS own_price, expected_profit AS market_difference, profit_margin_pct, "
    f"TIMESTAMP '{at}' AS recorded_at FROM {pairs}" for pairs, at in (("pp_old", T0), ("pp_new", T1))), "pp_old", "pp_new"))
def stream_price_history(spark, d):
    """Price snapshots of two syncs; every row arrives twice, within an upload or again in
    the next."""
    src = _new_source(spark, "history")
    name = src.rsplit("/", 1)[1]
    sent = None
    for pairs, at in ((old_pairs(spark, d), T0), (new_pairs(spark, d), T1)):
        rows = pairs.select(*PAIR_KEY, F.col("market_price").alias("vdb_price"), F.col("price").alias("own_price"), F.col("expected_profit").alias("market_difference"),
                            "profit_margin_pct", F.to_timestamp(F.lit(at)).alias("recorded_at"))
        _upload(rows.unionByName(rows if sent is None else sent), src)
        streams.run_available(spark, streams.price_history_stream(spark, src, _schema(rows)), name)
        sent = rows
    return streams.appended(spark, name).select(*HISTORY_COLS)


@register("stream_alerts", S.with_ctes("SELECT * FROM alerts", "alerts"))
def stream_alerts(spark, d):
    """Alerts of the second of two syncs, from state that the first one left; the query is
    stopped and restarted between them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.ROCKS)  # keyed state with timers needs it
    src = _new_source(spark, "pairs")
    name = src.rsplit("/", 1)[1]
    for pairs, at in ((old_pairs(spark, d), T0), (new_pairs(spark, d), T1)):
        _upload(pairs.select(*PAIR_KEY, "price", "recommendation", F.to_timestamp(F.lit(at)).alias("recorded_at")), src)
        streams.run_available(spark, alerts.pair_alert_stream(spark, src), name)
    return streams.appended(spark, name).where(F.col("recorded_at") == F.to_timestamp(F.lit(T1))).drop("recorded_at")
