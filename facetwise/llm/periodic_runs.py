"""Periodic runs of words by seeds on diagonals.

A run is a stretch of consecutive words of one text with smallest period q (words q apart
are identical) of at least ``max(MIN_WORDS, MIN_PERIODS * q)`` words that neither neighbour
extends. Lags are handled in classes [2^j, 2^(j+1)). A run of a class repeats every gram of
k = 3 * 2^j words, as that is what a run of at least four periods surely holds twice; and
as k >= q, the next occurrence of such a gram inside the run is exactly q words on
(Fine and Wilf). So the index of a class needs only each gram's next occurrence in the same
document, never all pairs of its occurrences.

Grams are told apart exactly: the rank of a gram of 2k words is that of the pair of its two
halves' ranks, and only grams whose halves both repeat in their document go on to the next
class, which leaves few words of ordinary text. Seeds that lie next to each other on a
diagonal are one; a seed inside the stretch last extended at its lag (the table of furthest
covered words) is passed over; every other one is extended word by word to both sides.

Defined results: null, empty and blank texts have no words and no runs. Texts are never
cut; work is n log n in the words of a text. Rows are independent, so copies, repeated and
null ids get equal results of their own; an empty table gives an empty one. Runs that
overlap are all reported, by start, then period. Extra columns are ignored.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwise.llm import textkit as K

MIN_WORDS = 6
MIN_PERIODS = 4


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, index of the first word of each text and their number) of large_strings."""
    lists = pc.ascii_split_whitespace(texts)
    words, text_of = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.greater(pc.binary_length(words), 0)
    words, text_of = words.filter(there), text_of.filter(there).to_numpy(zero_copy_only=False)
    return words, np.searchsorted(text_of, np.arange(len(texts) + 1))


def _repeats(key: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys at ascending places: ranks by place (-1: the key occurs once), and all
    (place, next place with the same key)."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = key[1:] == key[:-1]
    many = np.zeros(len(key), bool)
    many[1:] = same
    many[:-1] |= same
    rank = np.full(n, -1, np.int64)
    rank[at[many]] = np.cumsum(np.append(True, ~same))[many] if len(key) else 0
    return rank, at[:-1][same], at[1:][same]


def _longer(left: np.ndarray, right: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats of grams made of a left and, ``gap`` words on, a right part."""
    n = len(left)
    at = np.flatnonzero((left[:n - gap] >= 0) & (right[gap:] >= 0)) if gap < n else np.zeros(0, np.int64)
    return _repeats(left[at] * np.int64(n + 1) + right[at + gap], at, n)


def _agree(ids: np.ndarray, at: int, lag: int, end: int) -> int:
    """The first place from ``at`` whose word differs from that ``lag`` on (below end)."""
    step = 64
    while at + lag < end:
        stop = min(at + step, end - lag)
        differ = ids[at:stop] != ids[at + lag:stop + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, step = stop, step * 2
    return at


def _agree_back(ids: np.ndarray, at: int, lag: int, start: int) -> int:
    """The first place of the words before ``at`` that agree with those ``lag`` on."""
    step = 64
    while at > start:
        stop = max(at - step, start)
        differ = ids[stop:at] != ids[stop + lag:at + lag]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = stop, step * 2
    return at


def find_runs(ids: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (text, start in the slice, length, period) by text, start, period; ``ids`` are
    word ids, ``first`` the index of each text's first word and their number."""
    n, found = len(ids), []
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    one, _, _ = _repeats(text_of * np.int64(ids.max(initial=0) + 1) + ids, np.arange(n), n)
    two, _, _ = _longer(one, one, 1)
    rank, here, there = _longer(two, one, 2)
    lag_low, covered = 1, {}
    while len(here):
        lag = there - here
        seeds = (lag >= lag_low) & (lag < 2 * lag_low)
        lag, seed = lag[seeds], here[seeds]
        order = np.lexsort((seed, lag))
        lag, seed = lag[order], seed[order]
        alone = np.ones(len(seed), bool)
        alone[1:] = (lag[1:] != lag[:-1]) | (seed[1:] != seed[:-1] + 1)
        for q, at in zip(lag[alone].tolist(), seed[alone].tolist()):
            if at < covered.get(q, 0):
                continue
            text = int(text_of[at])
            start = _agree_back(ids, at, q, int(first[text]))
            covered[q] = _agree(ids, at, q, int(first[text + 1]))
            length = covered[q] + q - start
            if length >= max(min_words, MIN_PERIODS * q):
                found.append((text, start, length, q))
        rank, here, there = _longer(rank, rank, 3 * lag_low)
        lag_low *= 2
    return np.array(sorted(found), np.int64).reshape(-1, 4)


def _runs(rewrite, min_words: int, schema: pa.Schema):
    def run(batches):
        for rows, texts in K.slices(batches):
            words, first = split_words(texts)
            count, place = np.diff(first), np.arange(len(words))
            ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc_ids = rows.column(rows.schema.get_field_index("doc_id"))
            if rewrite:
                for i, doc_id in enumerate(doc_ids.to_pylist()):
                    change = rewrite(doc_id, int(count[i]))
                    if change:
                        a, p = change
                        place[first[i] + a:first[i + 1]] = first[i] + a + np.arange(count[i] - a) % p
                ids = ids[place]
            runs = find_runs(ids, first, min_words)
            cover = np.zeros(len(ids) + 1, np.int64)
            np.add.at(cover, runs[:, 1] + runs[:, 3], 1)
            np.add.at(cover, runs[:, 1] + runs[:, 2], -1)
            kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, first).astype(np.int32)), words.take(pa.array(place[kept])))
            offsets = pa.array(np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32))
            parts = [pa.array(c) for c in (runs[:, 1] - first[runs[:, 0]], runs[:, 2], runs[:, 3])]
            yield K.batch_of(schema, doc_id=doc_ids, n_words=pa.array(count.astype(np.int64)),
                             runs=pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["start", "length", "period"])),
                             collapsed=pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()))
    return run


def periodic_runs(docs: DataFrame, rewrite=None, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array of start, length, period),
    collapsed (the words joined by a blank, without those that a run holds after its first
    period). ``rewrite(doc_id, n_words)`` may give (a, p): the words from a on then repeat
    the p words there before runs are sought."""
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
    return base.mapInArrow(_runs(rewrite, min_words, schema), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def tenth_repeats(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The rewriting of the registered query: a tenth of the documents, by the checksum of
    their id, repeat a part of their words."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the run of most periods (ties: smallest start, then period) and checksums."""
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"),
                       lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(best.length * 1000) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
