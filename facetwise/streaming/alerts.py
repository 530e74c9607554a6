"""Pair alerts as a stream: keyed state holds the last price and recommendation of a pair.

Each sync's pairs arrive as rows with the sync's time. A pair's rows are taken in time
order and each is compared with the state before it, by the rules of the batch
``alert_diff``. A pair that no sync has held for ``keep_days`` of event time is forgotten
by a timer, so state follows the live pairs, not all that ever were; if it comes back it is
a new match. Pairs share their state by bucket (a hash of the pair), so the calls to the
state store follow the buckets, not the pairs.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from facetwise.functions import dims
from facetwise.operators.pairs import PAIR_KEY, pair_id

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the library

PAIR_SCHEMA = "market_stone_id string, stone_id string, price double, recommendation string, recorded_at timestamp"
ALERT_SCHEMA = "market_stone_id string, stone_id string, alert_type string, title string, message string, old_value double, new_value double, recorded_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 4096  # groups of pairs that share a state
_COLUMNS = [c.split()[0] for c in ALERT_SCHEMA.split(", ")]


class PairAlerts(StatefulProcessor):
    """State of one bucket of pairs: parallel arrays, read once and written once a batch, and
    one timer at the earliest time a pair of the bucket is to be forgotten."""

    def __init__(self, keep_days: int, texts: dict, move: float):
        self.keep_ms, self.texts, self.move = keep_days * 86_400_000, texts, move

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "market_stone_id array<string>, stone_id array<string>, price array<double>, recommendation array<string>, due array<long>, timer long")

    def _alert(self, kind: str, rec: str, old: float | None = None, new: float | None = None) -> tuple:
        return (*[t.replace("{}", rec or "") for t in (kind, *self.texts[kind])], old, new)

    def _read(self) -> tuple[dict, int | None]:
        state = self.last.get()
        if state is None:
            return {}, None
        return {(m, i): (price, rec, due) for m, i, price, rec, due in zip(*state[:5])}, state[5]

    def _write(self, pairs: dict, timer: int | None, fired: bool = False) -> None:
        if not pairs:
            self.last.clear()
            return
        first = min(due for _, _, due in pairs.values())
        if timer != first or fired:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        markets, stones = zip(*pairs)
        prices, recs, dues = zip(*pairs.values())
        self.last.update((list(markets), list(stones), list(prices), list(recs), list(dues), first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("recorded_at", kind="stable")
        pairs, timer = self._read()
        out = []
        for market, stone, price, rec, at in zip(*(seen[c].tolist() for c in ("market_stone_id", "stone_id", "price", "recommendation", "recorded_at"))):
            price = None if pd.isna(price) else price
            before = pairs.get((market, stone))
            found = []
            if before is None:
                found.append(self._alert("NEW_MATCH", rec))
            else:
                old, old_rec, _ = before
                if None not in (old, price) and abs(price - old) / (old or 1.0) > self.move:
                    found.append(self._alert("PRICE_CHANGE", rec, old, price))
                if None not in (rec, old_rec) and rec != old_rec:
                    found.append(self._alert("{}_ALERT", rec))
            out += [(market, stone, *a, at) for a in found]
            pairs[market, stone] = (price, rec, int(at.timestamp() * 1000) + self.keep_ms)
        self._write(pairs, timer)
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"old_value": float, "new_value": float, "recorded_at": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pairs, timer = self._read()
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        self._write({pair: held for pair, held in pairs.items() if held[2] > over}, timer, fired=True)
        yield pd.DataFrame([], columns=_COLUMNS)

    def close(self) -> None:
        pass


def pair_alert_stream(spark: SparkSession, source_dir: str, keep_days: int = 90, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Alerts of all syncs whose pairs arrive as files (``PAIR_SCHEMA``) in a folder. A task
    holds one bucket at a time; a checkpoint keeps the number of buckets it began with."""
    pairs = spark.readStream.schema(PAIR_SCHEMA).parquet(source_dir).withWatermark("recorded_at", late)
    pairs = pairs.withColumn("bucket", F.pmod(F.xxhash64(*PAIR_KEY), F.lit(buckets)))
    alerts = pairs.groupBy("bucket").transformWithStateInPandas(
        PairAlerts(keep_days, dims.ALERT_TEXTS, dims.ALERT_PRICE_MOVE), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="EventTime")
    return alerts.select(pair_id().alias("pair_id"), "stone_id", "market_stone_id", "alert_type", "title", "message", "old_value", "new_value", F.lit(False).alias("is_read"), "recorded_at")
