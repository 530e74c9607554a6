"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are linked when their texts are equal. Every document starts in the shard its
row hash gives; in each round the members of a group vote for the shard most of them are
in and ask to move there, and each shard accepts groups, in hash order, as long as its
capacity lasts. What is not accepted asks again in the next round, for the best shard that
still has room, or without a vote for such a one for any with room, drawn by hash and
weighted by the room, until a round moves nothing: then no group left fits anywhere. Those
are spread by row, and their number is logged. Unlinked documents then fill the shards to
the row.

Law ``rows``: the sizes of any two shards differ by one row at most. Only a group of more
than the largest shard is first cut, by rank in hash order, into parts of the smallest
shard's size and one of what is left, which are placed on their own; so a group of a third
of all rows never meets in one task. Groups and parts of more than 1/``LARGE`` of a shard,
a number that does not grow with the table, are placed on the driver before the rounds,
the largest first, so that they find shards with room. Besides their sizes and votes only
counts for each shard reach the driver; ranks come from sums over ``BUCKETS`` hash buckets
a shard or group, a table of fixed size, and a window inside a bucket.

Defined results: size is the text's UTF-8 bytes plus 8 (null: 8), text_crc32 that of its
UTF-8 bytes (null: of none). Null texts are not linked. Repeated rows are documents of
their own. Extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetwise.llm.tables import written

SHARDS = 24
LARGE = 16
BUCKETS = 1024


def _before(frame: DataFrame, part: str, order: str, value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same ``part`` (few values) that come
    earlier in the order of the long column ``order``."""
    bucketed = frame.withColumn("_v", value).withColumn("_b", F.pmod(F.shiftrightunsigned(order, 20), F.lit(BUCKETS)))
    sums = bucketed.groupBy(part, "_b").agg(F.sum("_v").alias("_s"))
    # at most BUCKETS rows for each part
    above = F.sum("_s").over(Window.partitionBy(part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(part, "_b", F.coalesce(above, F.lit(0)).alias("_above"))
    inside = F.sum("_v").over(Window.partitionBy(part, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    joined = bucketed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(sums), [part, "_b"])
    return joined.withColumn(out, F.col("_above") + F.col("_inside")).drop("_v", "_b", "_above", "_inside")


def _by_shard(values: list[int], shard: str = "shard") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col(shard) + 1)


def _counts(frame: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in frame.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _packed(units: dict[int, dict[int, int]], room: list[int]) -> dict[int, int]:
    """The shard of each unit (its votes for each shard), the largest units first: the one
    with most votes of those with room, else the fullest of them. Units that fit nowhere
    are left out. If fewer rows are left out when all take the fullest shard, they do."""
    plans = []
    for voted in (1, 0):
        left, plan, out = list(room), {}, 0
        for unit, votes in sorted(units.items(), key=lambda u: (-sum(u[1].values()), u[0])):
            members = sum(votes.values())
            fits = [s for s in range(len(left)) if left[s] >= members]
            if fits:
                plan[unit] = max(fits, key=lambda s: (voted * votes.get(s, 0), -left[s], -s))
                left[plan[unit]] -= members
            else:
                out += members
        plans.append((out, plan))
    return min(plans, key=lambda p: p[0])[1]


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, and
    linked (whether the row's text is there more than once)."""
    text = docs["text"].cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"),
                       text.isNull().alias("none"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"))
    base = written(spark, base.withColumn("rid", F.monotonically_increasing_id()), "shard-base")
    n = base.count()
    cap = [n // shards + (s < n % shards) for s in range(shards)]
    part_rows = max(1, cap[-1])

    mix = F.xxhash64("rid", F.lit("order"))
    groups = base.where("not none").groupBy("h1", "h2").agg(F.count("*").alias("members")).where("members > 1")
    groups = groups.select("h1", "h2", "members", F.xxhash64("h1", "h2").alias("group"))
    member = (base.where("not none").join(groups, ["h1", "h2"])
              .select("rid", "group", "members", mix.alias("order"), F.pmod(mix, F.lit(shards)).cast("int").alias("shard")))
    member = written(spark, member, "shard-linked")
    # fewer groups than shards are larger than a shard
    ranked = _before(member.where(F.col("members") > cap[0]), "group", "order", F.lit(1).cast("long"), "rank")
    parts = ranked.select("rid", F.xxhash64("group", F.floor(F.col("rank") / part_rows)).alias("unit"), "shard")
    linked = member.where(F.col("members") <= cap[0]).select("rid", F.col("group").alias("unit"), "shard").unionByName(parts)
    state = written(spark, linked, "shard-state")

    votes = state.groupBy("unit", "shard").agg(F.count("*").alias("votes"))
    large = votes.groupBy("unit").agg(F.sum("votes").alias("members")).where(F.col("members") * LARGE > cap[0]).select("unit")
    units: dict[int, dict[int, int]] = {}
    for r in votes.join(large, "unit").collect():  # at most LARGE * shards units
        units.setdefault(r["unit"], {})[r["shard"]] = r["votes"]
    settled = None
    if plan := _packed(units, cap):
        to = F.inline(F.array(*[F.struct(F.lit(u).cast("long").alias("unit"), F.lit(s).alias("to")) for u, s in plan.items()]))
        moved = written(spark, state.join(F.broadcast(spark.range(1).select(to)), "unit", "left"), "shard-state")
        settled = moved.where("to is not null").select("rid", F.col("to").alias("shard"))
        state = moved.where("to is null").select("rid", "unit", "shard")
    salt = 0
    while state.limit(1).count():
        used = _counts(settled, shards) if settled is not None else [0] * shards
        room = [c - u for c, u in zip(cap, used)]
        votes = state.groupBy("unit", "shard").agg(F.count("*").alias("votes"))
        votes = votes.join(votes.groupBy("unit").agg(F.sum("votes").alias("members")), "unit")
        # votes for a shard without room for the unit do not count
        best = F.struct(F.when(_by_shard(room) >= F.col("members"), F.col("votes")).otherwise(0).alias("votes"), F.xxhash64("unit", "shard").alias("tie"), "shard")
        asked = votes.groupBy("unit").agg(F.max(best).alias("best"), F.max("members").alias("members"))
        draw = [(F.pmod(F.xxhash64("unit", F.lit(salt), F.lit(s)), F.lit(1 << 31)) + 1) / ((1 << 31) + 1) for s in range(shards)]
        drawn = F.array_max(F.array(*[F.struct(F.when(F.col("members") <= r, F.log(u) / max(r, 1)).alias("o"), F.lit(s).alias("s")) for s, (r, u) in enumerate(zip(room, draw))]))
        asked = asked.select("unit", "members", F.when(F.col("best.votes") > 0, F.col("best.shard")).otherwise(drawn["s"]).alias("shard"))
        asked = asked.where(F.col("members") <= _by_shard(room))  # else it would stand in the way of smaller ones
        ranked = _before(asked.withColumn("order", F.xxhash64("unit", F.lit("unit"))), "shard", "order", F.col("members"), "ahead")
        moves = ranked.where(F.col("ahead") + F.col("members") <= _by_shard(room)).select("unit", F.col("shard").alias("to"))
        moved = written(spark, state.join(moves, "unit", "left"), "shard-state")
        done = moved.where("to is not null").select("rid", F.col("to").alias("shard"))
        settled = done if settled is None else settled.unionByName(done)
        state = moved.where("to is null").select("rid", "unit", "shard")
        salt += 1
        if not done.limit(1).count():
            logging.getLogger(__name__).warning("%d groups or parts of equal texts fit no shard and are spread by row", state.select("unit").distinct().count())
            break

    settled = base.select("rid", F.lit(0).alias("shard")).where("false") if settled is None else settled
    used = _counts(settled, shards)
    room = [c - u for c, u in zip(cap, used)]
    rest = base.select("rid").join(settled.select("rid"), "rid", "left_anti").withColumn("order", mix).withColumn("shard", F.pmod(mix, F.lit(shards)).cast("int"))
    rest = written(spark, _before(rest, "shard", "order", F.lit(1).cast("long"), "ahead"), "shard-rest")
    stays = rest.where(F.col("ahead") < _by_shard(room)).select("rid", "shard")
    kept = _counts(stays, shards)
    holes, total = [], 0
    for s in range(shards):  # the place of an overflowing row decides which hole it fills
        total += room[s] - kept[s]
        holes.append(total)
    spare = _before(rest.where(F.col("ahead") >= _by_shard(room)).select("rid", "order", F.lit(0).alias("all")), "all", "order", F.lit(1).cast("long"), "place")
    target = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        target = F.when(F.col("place") < holes[s], s).otherwise(target)
    spare = spare.select("rid", target.alias("shard"))

    placed = settled.unionByName(stays).unionByName(spare).withColumn("order", mix)
    slots = _before(placed, "shard", "order", F.lit(1).cast("long"), "slot").select("rid", F.col("shard").cast("int").alias("shard"), "slot")
    return (base.join(slots, "rid").join(member.select("rid", F.lit(True).alias("linked")), "rid", "left")
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.coalesce("linked", F.lit(False)).alias("linked")))
