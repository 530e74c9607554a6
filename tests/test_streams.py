"""Streams on small uploads: state, restarts, replays, and the batch forms they equal."""
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from facetwise.operators import pairs as PR
from facetwise.streaming import alerts, streams

DAY0 = date(2024, 1, 1)


@pytest.fixture
def name():
    return f"test-{uuid.uuid4().hex[:8]}"


def test_state_of_sale_panes_stays_flat(spark, tmp_path, name):
    schema = "sale_date date, shape string, color string, clarity string, carat double"
    rows = [(DAY0 + timedelta(days=i // 2), "ROUND" if i % 3 else "OVAL", "D", "IF", 1.0 + (i % 2)) for i in range(1460)]
    src, states = f"{tmp_path}/sales", []
    for upload in range(6):
        part = rows[len(rows) * upload // 6:len(rows) * (upload + 1) // 6]
        spark.createDataFrame(part + ([(None, "ROUND", "D", "IF", 1.0), (part[0][0], "ROUND", "D", "IF", 0.1)]), schema).write.mode("append").parquet(src)
        q = streams.run_available(spark, streams.sale_panes_stream(spark, src, schema), name, streams.PANE_KEYS)
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    panes = streams.merged(spark, name)
    assert panes.agg(F.sum("sales")).first()[0] == len(rows)
    # 30 days and the last upload's may still change; what is older has left the state
    assert max(states[2:]) <= states[1] * 1.1 and states[-1] < panes.count() / 2
    got = {tuple(r) for r in streams.trailing_windows(panes).select(F.to_date("window_start"), "shape", "size_range", "sales").collect()}
    want = {}
    for d, shape, _, _, carat in rows:
        for back in range(30):
            key = (d - timedelta(days=back), shape, "1.00-1.10" if carat == 1.0 else "2.00-2.10")
            want[key] = want.get(key, 0) + 1
    assert got == {(*k, n) for k, n in want.items()}


def test_a_replayed_batch_is_merged_once(spark, name):
    frame = lambda n: spark.createDataFrame([("a", n)], "k string, n int")
    sink = streams._merge_sink(spark, streams.sink_path(spark, name), ["k"])
    sink(frame(1), 0)
    sink(frame(2), 1)
    sink(frame(99), 1)
    assert [tuple(r) for r in streams.merged(spark, name).collect()] == [("a", 2)]


def pairs_of(spark, rows, at):
    schema = "market_stone_id string, stone_id string, price double, recommendation string"
    return spark.createDataFrame(rows, schema).withColumn("recorded_at", F.lit(at).cast("timestamp"))


SYNCS = [
    (datetime(2026, 1, 1), [("m1", "i1", 100.0, "BUY"), ("m2", "i2", 50.0, "HOLD"), ("m3", "i3", None, "WAIT"), ("m9", "i9", 5.0, "BUY"), ("m5", "i5", 0.0, "BUY")]),
    # i2's last market listing is another one: a new pair, and the old one is seen no more
    (datetime(2026, 1, 2), [("m1", "i1", 101.5, "HOLD"), ("m7", "i2", 50.0, "HOLD"), ("m3", "i3", 7.0, "WAIT"), ("m9", "i9", 5.04, "BUY"), ("m5", "i5", 0.02, "BUY")]),
]


def test_alert_stream_equals_alert_diff_after_a_restart(spark, tmp_path, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.ROCKS)
    src = f"{tmp_path}/pairs"
    frames = [pairs_of(spark, rows, at) for at, rows in SYNCS]
    for f in frames:
        f.write.mode("append").parquet(src)
        streams.run_available(spark, alerts.pair_alert_stream(spark, src, keep_days=90), name)
    found = streams.appended(spark, name)
    cols = ["pair_id", "stone_id", "market_stone_id", "alert_type", "title", "message", "old_value", "new_value", "is_read"]
    key = lambda r: str(tuple(r))
    last = sorted(found.where(F.col("recorded_at") == F.lit(SYNCS[1][0])).select(*cols).collect(), key=key)
    assert last == sorted(PR.alert_diff(frames[1], frames[0]).select(*cols).collect(), key=key)
    assert [(r["pair_id"], r["alert_type"]) for r in last] == [("m1|i1", "HOLD_ALERT"), ("m1|i1", "PRICE_CHANGE"), ("m5|i5", "PRICE_CHANGE"), ("m7|i2", "NEW_MATCH")]
    assert found.where(F.col("recorded_at") == F.lit(SYNCS[0][0])).select("alert_type").distinct().collect()[0][0] == "NEW_MATCH"
    # half a year later the timers have forgotten the pairs, so an old one is new again
    for at in (datetime(2026, 7, 1), datetime(2026, 7, 2)):
        pairs_of(spark, [("m8", "i8", 1.0, "BUY")] + ([("m1", "i1", 101.5, "HOLD")] if at.day == 2 else []), at).write.mode("append").parquet(src)
        streams.run_available(spark, alerts.pair_alert_stream(spark, src, keep_days=90), name)
    late = streams.appended(spark, name).where("recorded_at >= '2026-07-01'")
    assert sorted((r["pair_id"], r["alert_type"]) for r in late.collect()) == [("m1|i1", "NEW_MATCH"), ("m8|i8", "NEW_MATCH")]


def test_pairs_of_one_bucket_share_a_state_and_are_forgotten_one_by_one(spark, tmp_path, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.ROCKS)
    src = f"{tmp_path}/pairs"
    held = []
    for at, rows in ((datetime(2026, 1, 1), [(f"m{n}", f"i{n}", float(n), "BUY") for n in range(40)]), (datetime(2026, 2, 1), [("m1", "i1", 2.0, "BUY")]),
                     (datetime(2026, 4, 20), [("m1", "i1", 2.0, "HOLD")]), (datetime(2026, 4, 21), [("m1", "i1", 2.0, "HOLD"), ("m3", "i3", 3.0, "BUY")])):
        pairs_of(spark, rows, at).write.mode("append").parquet(src)
        q = streams.run_available(spark, alerts.pair_alert_stream(spark, src, keep_days=90, buckets=1), name)
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    found = [(r["pair_id"], r["alert_type"], r["recorded_at"].day) for r in streams.appended(spark, name).where("recorded_at > '2026-01-01'").collect()]
    # on 20 April the pairs of January are forgotten, the one seen in February is not
    assert sorted(found) == [("m1|i1", "HOLD_ALERT", 20), ("m1|i1", "PRICE_CHANGE", 1), ("m3|i3", "NEW_MATCH", 21)]
    assert max(held) < 40  # 40 pairs, one state


def test_sync_marks(spark):
    t = [datetime(2026, 1, 1), datetime(2026, 1, 2)]
    sync = lambda rows, at: spark.createDataFrame(rows, "market_stone_id string, stone_id string, price double").withColumns({"matched_at": F.lit(at), "updated_at": F.lit(at)})
    old = sync([("m1", "i1", 1.0), ("m2", "i2", 2.0)], t[0])
    new = sync([("m1", "i1", 1.5), ("m7", "i2", 2.5)], t[1])
    rows = {(r["market_stone_id"], r["stone_id"]): (r["price"], r["matched_at"], r["mark"]) for r in PR.sync_mark(PR.sync_merge(old, new), F.lit(t[1])).collect()}
    assert rows == {("m1", "i1"): (1.5, t[0], "update"), ("m2", "i2"): (2.0, t[0], "retire"), ("m7", "i2"): (2.5, t[1], "insert")}
