"""Benchmark decontamination with an FM-index of each training shard.

Words are runs of ``[0-9a-z]`` and non-ASCII bytes after lower-casing A-Z. A benchmark
item's test phrases are its windows of ``WINDOW`` words (an item with fewer words, but not
none, is one phrase). Each shard of documents (``SHARD_BYTES`` of text, whole texts) is
indexed: words that occur in no test phrase become separators, runs of the others too
short for any phrase are left out, and the remaining word sequence gets a suffix order,
its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All
phrases are searched backwards at once, occurrences are located by walking to a sample,
and the occurrences of a document are merged into removal spans.

The benchmark is read in blocks of ``BLOCK_WORDS`` words, each block one pass over the
documents; what a pass broadcasts is thus bounded by the block, not by the benchmark.

Defined results: null or wordless text has n_words 0 and no hit. Benchmark rows without
words have no phrase; a null item_id counts as the empty string; rows that repeat an
item_id belong to one item. Each input row has its own result; copies have equal ones.
Extra columns are carried untouched in ``row``. Empty tables give an empty result, an
empty benchmark gives clean documents.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetwise.llm import textkit as K
from facetwise.llm.tables import with_row_id, written

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_WORDS = 500_000
SAMPLE = 16


class FMIndex:
    """FM-index of a sequence of symbols 1..size, where 0 separates runs. Each separator
    counts as a symbol of its own, so no suffix is compared beyond its run."""

    def __init__(self, seq: np.ndarray, size: int):
        self.n, self.bits = len(seq), max(1, int(size).bit_length())
        cuts = seq == 0
        n_cuts = int(cuts.sum())
        rank = np.where(cuts, np.cumsum(cuts) - 1, seq.astype(np.int64) + n_cuts - 1)
        width, order = 1, np.argsort(rank, kind="stable")
        while True:  # prefix doubling: ranks by the first `width` symbols
            sorted_rank = rank[order]
            new = np.append(True, sorted_rank[1:] != sorted_rank[:-1])
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all():
                break
            after = np.zeros(self.n, np.int64)
            after[:-width] = rank[width:] + 1
            rank = rank * (self.n + 1) + after
            order = np.argsort(rank, kind="stable")
            width *= 2
        before = seq[order - 1]  # order 0 wraps to the last symbol, a separator
        self.less = np.append(0, np.cumsum(np.bincount(seq, minlength=size + 1)))[:size + 1]
        self._levels, level = [], before
        for bit in range(self.bits - 1, -1, -1):
            ones = (level >> bit & 1).astype(np.int32)
            self._levels.append((bit, np.append(0, np.cumsum(ones, dtype=np.int32))))
            level = np.concatenate([level[ones == 0], level[ones == 1]])
        self._origin = self._descend(np.arange(size + 1), np.zeros(size + 1, np.int64))
        self.before = before
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.sample = sampled, np.where(sampled, order, -1)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, ones in self._levels:
            up = ones[at]
            at = np.where(symbol >> bit & 1, self.n - ones[-1] + up, at - up)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each place."""
        return self._descend(symbol, at) - self._origin[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long phrases: (found phrases, low, high) ranges."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, j]
            low = self.less[symbol] + self.rank(symbol, low)
            high = self.less[symbol] + self.rank(symbol, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: steps back until a sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.sample[rows[done]] + steps
            todo, rows = todo[~done], rows[~done]
            symbol = self.before[rows]
            rows = self.less[symbol] + self.rank(symbol, rows)
            steps += 1
        return out


class Phrases:
    """Test phrases of one block of benchmark items, as symbols of their own vocabulary."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.items = sorted({i for i, h in items if len(h)})
        number = {name: k for k, name in enumerate(self.items)}
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [h for _, h in items]))
        by_length: dict[int, dict[bytes, set[int]]] = {}
        for name, h in items:
            symbols = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int64)
            size = min(window, len(h))
            for at in range(len(h) - size + 1 if size else 0):
                by_length.setdefault(size, {}).setdefault(symbols[at:at + size].tobytes(), set()).add(number[name])
        self.groups = [(size, np.frombuffer(b"".join(found), np.int64).reshape(-1, size), [np.array(sorted(x)) for x in found.values()]) for size, found in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)

    @classmethod
    def again(cls, state: dict) -> Phrases:
        """From a broadcast ``__dict__``."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def occurrences(self, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length) of every occurrence, and the distinct (text, item) pairs."""
        none = np.zeros(0, np.int64)
        if not self.groups or not len(words):
            return none, none, none, none
        h, doc = words.hashes, words.text_of
        spot = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[spot] == h
        run_start = known & np.append(True, ~known[:-1] | (doc[1:] != doc[:-1]))
        begin = np.flatnonzero(run_start)
        if not len(begin):
            return none, none, none, none
        run = np.cumsum(run_start) - 1
        length = np.bincount(run[known], minlength=len(begin))
        keep = known & (length[run] >= self.shortest)
        at = np.flatnonzero(keep)
        if not len(at):
            return none, none, none, none
        head = run_start[at]
        place = np.arange(len(at)) + np.cumsum(head) - 1  # one separator after each run
        seq = np.zeros(len(at) + int(head.sum()), np.int64)
        seq[place] = spot[at] + 1
        word = np.zeros(len(seq), np.int64)
        word[place] = at
        index = FMIndex(seq, len(self.vocabulary))
        starts, sizes, pairs = [], [], []
        for size, phrases, items in self.groups:
            found, low, high = index.search(phrases)
            if not len(found):
                continue
            n = high - low
            rows = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            first = word[index.locate(rows)]
            starts.append(first)
            sizes.append(np.full(len(first), size))
            per = np.array([len(items[p]) for p in found])
            flat = np.concatenate([items[p] for p in found])
            row_of = np.repeat(np.arange(len(found)), n)
            k = per[row_of]
            which = np.repeat((np.cumsum(per) - per)[row_of], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            pairs.append(np.unique(np.stack([np.repeat(doc[first], k), flat[which]], 1), axis=0))
        if not starts:
            return none, none, none, none
        pairs = np.unique(np.concatenate(pairs), axis=0)
        return np.concatenate(starts), np.concatenate(sizes), pairs[:, 0], pairs[:, 1]


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Phrases]:
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        words = K.Words(pa.array([row.t or ""], pa.large_string()), K.NOT_ALNUM, lower=True)
        held.append((row.i or "", words.hashes))
        size += len(words)
        if size >= block_words:
            yield Phrases(held, window)
            held, size = [], 0
    yield Phrases(held, window)


def _merged(gone: np.ndarray, first: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    own = gone[first[i]:first[i + 1]].astype(np.int8)
    step = np.diff(np.concatenate([[0], own, [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _scan(phrases, cleaned: bool):
    """One pass: n_words, removal spans in words, items, and (if wanted) the cleaned text."""
    def run(batches):
        block = Phrases.again(phrases.value)
        for rows, texts in K.slices(batches, limit=SHARD_BYTES):
            words = K.Words(texts, K.NOT_ALNUM, lower=True)
            starts, sizes, docs, items = block.occurrences(words)
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + sizes, -1)
            gone = np.cumsum(step[:-1]) > 0
            names: list[list[str]] = [[] for _ in range(words.n_texts)]
            for d, k in zip(docs.tolist(), items.tolist()):
                names[d].append(block.items[k])
            spans: list[list[dict]] = [[] for _ in range(words.n_texts)]
            for d in np.unique(docs).tolist():
                a, b = _merged(gone, words.first, d)
                spans[d] = [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())]
            out = rows.select([n for n in rows.schema.names if n != "text"])
            arrays = [*out.columns, pa.array(words.counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(names, pa.list_(pa.string()))]
            heads = [*out.schema.names, "n_words", "spans", "items"]
            if cleaned:
                arrays.append(pa.array(_clean(texts, words, spans), pa.string()))
                heads.append("clean_text")
            yield pa.RecordBatch.from_arrays(arrays, heads)
    return run


def _clean(texts: pa.Array, words: K.Words, spans: list[list[dict]]) -> list[str]:
    out = texts.to_pylist()
    raw, _ = K.buffer_of(texts)
    for i, own in enumerate(spans):
        if own:
            at, parts, f = int(words.offsets[i]), [], int(words.first[i])
            for s in own:
                parts.append(raw[at:words.starts[f + s["a"]]].tobytes())
                at = int(words.ends[f + s["b"] - 1])
            parts.append(raw[at:words.offsets[i + 1]].tobytes())
            out[i] = b"".join(parts).decode()
    return out


def _apply(batches):
    """Cleans texts by spans that were found earlier."""
    for rows, texts in K.slices(batches):
        spans = rows.column(rows.schema.get_field_index("spans")).to_pylist()
        clean = _clean(texts, K.Words(texts, K.NOT_ALNUM, lower=True), spans)
        out = rows.select([n for n in rows.schema.names if n != "text"])
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(clean, pa.string())], [*out.schema.names, "clean_text"])


def _joined(spans: Iterator[list], n: int) -> list[dict]:
    gone = np.zeros(n + 1, np.int64)
    for s in spans:
        gone[s["a"]] += 1
        gone[s["b"]] -= 1
    a, b = _merged(np.cumsum(gone[:-1]) > 0, np.array([0, n]), 0)
    return [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())]


_SPANS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cleaned: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (first word, word after the last) of
    hit words, items (ids with an occurring phrase), ``row`` (the input row as a struct)
    and, if ``cleaned``, clean_text: the text without the hit spans."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row") if cleaned else F.lit(None).cast("struct<x:int>").alias("row")
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), whole)
    found = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    more = [T.StructField("clean_text", T.StringType())] if cleaned else []

    blocks = _blocks(benchmark, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        schema = T.StructType([f for f in base.schema if f.name != "text"] + found.fields + more)
        return base.mapInArrow(_scan(spark.sparkContext.broadcast(vars(first)), cleaned), schema)

    full = with_row_id(spark, docs, "_row_id")
    tagged = full.select("_row_id", full["text"].cast("string").alias("text"))
    tables = []
    for block in (b for part in ((first, second), blocks) for b in part):
        schema = T.StructType([f for f in tagged.schema if f.name != "text"] + found.fields)
        held = spark.sparkContext.broadcast(vars(block))
        tables.append(written(spark, tagged.mapInArrow(_scan(held, False), schema), "decontaminate-block"))
        held.unpersist()
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    merge = F.udf(_joined_udf, _SPANS)
    merged = (union.groupBy("_row_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
              .select("_row_id", "n_words", merge("s", "n_words").alias("spans"), "items"))
    full = full.select("_row_id", full["doc_id"].cast("long").alias("doc_id"), full["text"].cast("string").alias("text"), whole if not cleaned else F.struct(*[full[c] for c in docs.columns]).alias("row"))
    out = full.join(merged, "_row_id").drop("_row_id")
    if not cleaned:
        return out.drop("text")
    schema = T.StructType([f for f in out.schema if f.name != "text"] + more)
    return out.mapInArrow(_apply, schema)


def _joined_udf(spans, n):
    return _joined(({"a": s["a"], "b": s["b"]} for s in spans), int(n)) if n else []


def digest(found: DataFrame) -> DataFrame:
    """The report columns of ``decontaminate``'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]).cast("long"))
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
