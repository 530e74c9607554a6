"""Shapes of the plans behind the larger reports: narrow rows, one pass, one join."""
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions import stats as ST
from facetwise.operators import matching
from facetwise.operators import matrix as MX
from facetwise.operators import pairs as PR
from facetwise.operators import sellthrough
from facetwise.plans import base, q_sales
from facetwise.sources import feeds

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def static(spark):
    """Plans without adaptive changes and without joins broadcast by size."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def listings(spark, rows):
    """(stone_id, carat, price, src_line) as listings that agree in all other attributes."""
    df = spark.createDataFrame(rows, "stone_id string, carat double, price double, src_line int")
    for k in dims.MATCH_KEYS:
        df = df if k == "carat" else df.withColumn(k, F.lit("X"))
    none = [F.lit(0.0).alias("src_amount"), F.lit(1).alias("src_part"), F.lit(1).alias("src_supp"), F.lit(0.0).alias("src_disc"), F.lit(0.1).alias("src_tax")]
    return df.select("*", *none, F.lit("ON HAND").alias("status"), F.lit("?").alias("remark"))


def test_cells_shuffle_no_column_they_do_not_read(static):
    df = listings(static, [("a", 1.0, 10.0, 1), ("a", 1.0, 20.0, 2), ("b", 1.0, 30.0, 3)])
    cells = MX.live_market_cells(MX.with_shapes(df), feeds.LISTING_ORDER)
    assert "remark" not in plan(cells) and "src_part" in plan(cells)
    assert sorted((r[MX.SHAPES], r["pieces"], r["market_ppc"]) for r in cells.collect()) == [("ALL", 2, 20.0), ("X", 2, 20.0)]


def test_last_row_is_held_once(static):
    df = static.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", None, "c"), (None, 1, "d")], "k string, seq int, v string")
    last = ST.keep_last(df, ["k"], ["seq"])
    assert "max_by" not in plan(last)
    assert sorted(map(tuple, last.collect()), key=str) == [("k", 2, "b"), (None, 1, "d")]


def test_quantile_counts_are_shuffled_once(static):
    rows = static.range(300).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    found = ST.nearest_rank_by_key(rows, ["k"], "v", 0.1, "q")
    assert "ReusedExchange" in plan(found)
    assert sorted(map(tuple, found.collect())) == [(0, 30.0), (1, 31.0), (2, 32.0)]


def test_both_syncs_are_matched_in_one_join(static):
    inv = listings(static, [("i", 1.0, 5.0, 1), ("j", 2.0, 5.0, 2)])
    market = listings(static, [("m", 1.0, 10.0, 1), ("n", 1.0, 20.0, 4), ("o", 2.0, 30.0, 8)])
    held = {"new": F.lit(True), "old": F.col("src_line") % 4 != 0}
    pairs = matching.pair_match_last(inv, market, feeds.LISTING_ORDER, held)
    assert plan(pairs).count("SortMergeJoin") == 1
    assert sorted(map(tuple, pairs.select("sync", "stone_id", "market_stone_id", "market_price").collect())) == [
        ("new", "i", "n", 20.0), ("new", "j", "o", 30.0), ("old", "i", "m", 10.0)]
    one = matching.pair_match_last(inv, market, feeds.LISTING_ORDER)
    assert "sync" not in one.columns
    assert sorted(map(tuple, one.select("stone_id", "market_stone_id").collect())) == [("i", "n"), ("j", "o")]


def test_a_sync_is_merged_by_one_join(static):
    t0, t1 = datetime(2026, 1, 1), datetime(2026, 1, 2)
    schema = "market_stone_id string, stone_id string, price double, matched_at timestamp, updated_at timestamp"
    old = static.createDataFrame([("m", "a", 1.0, t0, t0), ("m", "b", 2.0, t0, t0), (None, "c", 3.0, t0, t0)], schema)
    new = static.createDataFrame([("m", "a", None, t1, t1), ("m", "d", 4.0, t1, t1), (None, "c", 5.0, t1, t1)], schema)
    merged = PR.sync_merge(old, new)
    assert plan(merged).count("SortMergeJoin") == 1
    assert merged.columns == new.columns
    assert sorted(map(tuple, merged.collect()), key=str) == sorted([
        ("m", "a", None, t0, t1), ("m", "b", 2.0, t0, t0), ("m", "d", 4.0, t1, t1), (None, "c", 3.0, t0, t0), (None, "c", 5.0, t1, t1)], key=str)


def test_sales_are_deduplicated_once(spark, monkeypatch, tmp_path):
    calls = []

    def lines(s, d):
        calls.append(d)
        return s.createDataFrame([("1", "a", 1, 1, 1.0, 0.0, 0.0), ("1", "a", 2, 1, 1.0, 0.0, 0.0), ("1", None, 1, 1, 1.0, 0.0, 0.0)],
                                 "invoice string, stone string, src_line int, src_supp long, src_amount double, src_disc double, src_tax double")
    monkeypatch.setattr(base, "sales", lines)
    for _ in range(2):
        assert sorted((r["invoice"], str(r["stone"]), r["src_line"]) for r in q_sales.sales_deduped(spark, str(tmp_path)).collect()) == [("1", "None", 1), ("1", "a", 2)]
    assert len(calls) == 1


def test_stones_stay_where_they_are_when_cohorts_are_joined(static):
    stones = listings(static, [("a", 1.0, 10.0, 1), ("b", 1.0, 20.0, 2)]).withColumns(
        {"market_bottom_price": F.lit(12.0), "top1_listing_price": F.lit(None).cast("double")})
    cohorts = static.createDataFrame([("1.00-1.10", "X", "X", "X", 3, 3.0, 30.0)], "size_range string, shape string, color string, clarity string, sold_stones long, sold_carats double, sales_value double")
    found = sellthrough.stone_sell_through(stones, cohorts)
    assert "BroadcastHashJoin" in plan(found)
    assert sorted(map(tuple, found.select("stone_id", "cohort_stock").collect())) == [("a", 2), ("b", 2)]
