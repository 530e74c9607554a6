"""Substring dedup by prefix-partitioned suffix trees over words.

A word is removed when some window of ``WINDOW`` words that covers it also starts
earlier: in a document of smaller id, or earlier in the same document.

* Every window is a suffix cut at ``WINDOW`` words. It is filed under a short prefix of
  one of its own suffixes: the smallest-hash ``SEED``-word run inside it (its anchor).
  Equal windows choose the same anchor at the same offset, so they meet. Neighbouring
  windows mostly share an anchor and travel as one row.
* Anchors seen at one place only are dropped after a pre-aggregated count; no window
  under them can repeat.
* A prefix group that fits in memory becomes one suffix tree: its suffixes sorted word by
  word; runs of neighbours that agree on all ``WINDOW`` words are the deep internal nodes.
  A larger group gets longer prefixes: each suffix is filed under all its words, where the
  group is a single deep node whose earliest place is a pre-aggregated minimum. Thus no
  task needs an unbounded group in memory.

Defined results: null or blank text has no words and keeps the empty string. Rows with
equal doc_id and equal words are the same document and get equal results; rows with equal
doc_id but other words are ordered by a digest of the words. A null doc_id sorts last.
Extra columns of the input are ignored. An empty table gives an empty result. A text is
read whole, however long: its words and windows are in one task's memory at once.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm import textkit as K
from facetwise.llm.tables import id_and_text, written

WINDOW = 20
SEED = 6
#: Rows of one prefix group that are sorted in one tree.
GROUP_ROWS = 20_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_DOC = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_words", pa.int64()), ("n_own", pa.int64()), ("sha_own", pa.string())])
_ANCHOR = pa.schema([("prefix", pa.int64()), ("t1", pa.int64()), ("s0", pa.int32()), ("m", pa.int32())])
_TEXT = pa.schema([("t1", pa.int64()), ("z", pa.binary())])
_SUFFIX = pa.schema([("prefix", pa.int64()), ("long", pa.bool_()), ("doc_id", pa.int64()), ("t1", pa.int64()), ("s0", pa.int32()), ("words", pa.binary())])
_MASK = pa.schema([("t1", pa.int64()), ("s0", pa.int32()), ("mask", pa.int32())])
_RESULT = pa.schema([("t1", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "bigint", "int32": "int", "string": "string", "binary": "binary", "bool": "boolean"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def _word_digests(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    h, f = words.hashes, words.first
    return K.digests([h[f[i]:f[i + 1]].tobytes() for i in range(words.n_texts)])


def _windows(words: K.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows, whether an equal window starts earlier in the same text)."""
    grams, ok = words.grams(size)
    at = np.flatnonzero(ok)
    if not len(at):
        return at, np.zeros(0, bool)
    key = K.mix(grams[at], words.text_of[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(at), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return at, again


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, n), -1)
    return np.cumsum(step[:-1]) > 0


def _kept_bytes(texts: pa.Array, words: K.Words, removed: np.ndarray) -> Iterator[bytes]:
    f, raw = words.first, words.raw.tobytes()
    for i in range(words.n_texts):
        own = raw[words.offsets[i]:words.offsets[i + 1]].split()  # bytes.split cuts at the same six bytes
        gone = removed[f[i]:f[i + 1]]
        yield b" ".join(compress(own, ~gone) if gone.any() else own)


def _scan_documents(size: int):
    """Per row: the digest of its words, and the result if nothing repeats across documents."""
    def run(batches):
        for rows, texts in K.slices(batches):
            words = K.Words(texts)
            t1, t2 = _word_digests(words)
            at, again = _windows(words, size)
            gone = _covered(at[again], len(words), size)
            own = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (words.counts > 0)
            sha = [hashlib.sha256(b).hexdigest() for b in _kept_bytes(texts, words, gone)]
            yield K.batch_of(_DOC, doc_id=rows.column(0), t1=t1, t2=t2, n_words=words.counts, n_own=own, sha_own=sha)
    return run


def _leftmost_smallest(values: np.ndarray, span: int) -> np.ndarray:
    """For each stretch of ``span`` values, where its smallest is; of equal ones the first."""
    lower = lambda a, b: np.where(values[b] < values[a], b, a)
    width, best = 1, np.arange(len(values))
    while width * 2 <= span:
        best = lower(best[:-width], best[width:])
        width *= 2
    return lower(best[:len(best) - (span - width)], best[span - width:]) if width < span else best


def _scan_anchors(size: int, seed: int):
    """Runs of windows that share an anchor; windows that repeat within a text only once."""
    span = size - seed + 1

    def run(batches):
        for _, texts in K.slices(batches):
            words = K.Words(texts)
            at, again = _windows(words, size)
            at = at[~again]
            if not len(at):
                continue
            seeds, _ = words.grams(seed)
            anchor = _leftmost_smallest(seeds, span)[at]
            doc = words.text_of[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            t1, _ = _word_digests(words)
            yield K.batch_of(_ANCHOR, prefix=K.long_column(seeds[anchor[first]]), t1=t1[doc[first]],
                             s0=(at[first] - words.first[doc[first]]).astype(np.int32), m=np.diff(np.append(first, len(at))).astype(np.int32))
    return run


def _pack_texts(batches):
    """One compressed text for each distinct word sequence of a task."""
    seen: set[int] = set()
    pack = zstandard.ZstdCompressor(level=3)
    for _, texts in K.slices(batches):
        words = K.Words(texts)
        t1, _ = _word_digests(words)
        raw, out = words.raw.tobytes(), {}
        for i, t in enumerate(t1.tolist()):
            if t not in seen and words.counts[i]:
                seen.add(t)
                out[t] = pack.compress(raw[words.offsets[i]:words.offsets[i + 1]])
        yield K.batch_of(_TEXT, t1=np.array(list(out), np.int64), z=list(out.values()))


def _unpacked(batch: pa.RecordBatch) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(z) for z in batch.column("z").to_pylist()], pa.large_binary()).cast(pa.large_string())


def _small(batches, rows: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _emit_suffixes(size: int):
    """Rows of suffixes: under the anchor's prefix, or one by one under all their words."""
    def run(batches):
        for batch in _small(batches):
            texts = _unpacked(batch)
            words = K.Words(texts)
            short = (words.hashes >> np.uint64(32)).astype("<u4")
            full, _ = words.grams(size)
            doc_id, t1, f = batch.column("doc_id").to_pylist(), batch.column("t1").to_pylist(), words.first
            out = {n: [] for n in _SUFFIX.names}
            for i, places in enumerate(batch.column("places").to_pylist()):
                for p in places:
                    s, m = int(f[i]) + p["s0"], p["m"]
                    for prefix, at, n in [(int(full[s + k].astype(np.int64)), k, 1) for k in range(m)] if p["long"] else [(p["prefix"], 0, m)]:
                        for name, value in zip(_SUFFIX.names, (prefix, p["long"], doc_id[i], t1[i], p["s0"] + at, short[s + at:s + at + n + size - 1].tobytes())):
                            out[name].append(value)
            yield K.batch_of(_SUFFIX, **out)
    return run


def _order_columns(t: pa.Table, rows: np.ndarray) -> list[np.ndarray]:
    """Keys of 'earlier', the least significant first as lexsort wants them (without the start)."""
    ids = t.column("doc_id")
    return [t.column("t1").to_numpy()[rows], ids.fill_null(0).to_numpy()[rows], ids.is_null().to_numpy()[rows]]


def _tree(t: pa.Table, size: int) -> pa.RecordBatch:
    """Suffix trees of whole prefix groups: repeats below nodes of depth ``size``."""
    payload = t.column("words").combine_chunks()
    payload = payload.cast(pa.large_binary()) if not isinstance(payload, pa.ChunkedArray) else pa.concat_arrays([c.cast(pa.large_binary()) for c in payload.chunks])
    raw, offsets = K.buffer_of(payload)
    flat = np.frombuffer(raw.tobytes(), "<u4")
    begin = offsets[:-1] // 4
    m = np.diff(offsets) // 4 - size + 1
    row = np.repeat(np.arange(len(m)), m)
    k = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
    at = begin[row] + k
    pairs = [(flat[at + j].astype(np.uint64) << np.uint64(32)) | flat[at + j + 1] for j in range(0, size - 1, 2)] + ([flat[at + size - 1].astype(np.uint64)] if size % 2 else [])
    group = t.column("prefix").to_numpy()[row]
    start = t.column("s0").to_numpy()[row].astype(np.int64) + k
    order_keys = _order_columns(t, row)
    order = np.lexsort([start, *order_keys, *pairs[::-1], group])
    same = np.ones(len(order) - 1, bool)  # the common prefix of neighbours reaches the node's depth
    for key in (group, *pairs):
        same &= key[order[1:]] == key[order[:-1]]
    node = np.cumsum(np.append(True, ~same)) - 1
    head = order[np.flatnonzero(np.append(True, ~same))][node]
    t1 = order_keys[0]
    later = (t1[order] != t1[head]) | (start[order] != start[head])
    hit = np.zeros(len(row), bool)
    hit[order[later]] = True
    mask = np.zeros(len(m), np.int64)
    np.bitwise_or.at(mask, row[hit], np.int64(1) << k[hit])
    some = np.flatnonzero(mask)
    return K.batch_of(_MASK, t1=t.column("t1").to_numpy()[some], s0=t.column("s0").to_numpy()[some], mask=mask[some].astype(np.int32))


def _trees(size: int, limit: int = 50_000):
    """Groups come one after another, sorted by prefix; whole groups are put together up
    to ``limit`` rows for one pass (one group has GROUP_ROWS rows at most)."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < limit:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            prefix = t.column("prefix").to_numpy()
            cut = int(np.searchsorted(prefix, prefix[-1]))
            if cut:
                yield _tree(t.slice(0, cut).combine_chunks(), size)
            held, count = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if held:
            yield _tree(pa.Table.from_batches(held).combine_chunks(), size)
    return run


def _remove(size: int):
    def run(batches):
        for batch in _small(batches):
            texts = _unpacked(batch)
            words = K.Words(texts)
            at, again = _windows(words, size)
            gone = [at[again]]
            for i, marks in enumerate(batch.column("marks").to_pylist()):
                for p in marks:
                    bits = [k for k in range(size) if p["mask"] >> k & 1]
                    gone.append(np.array(bits, np.int64) + int(words.first[i]) + p["s0"])
            removed = _covered(np.concatenate(gone), len(words), size)
            n = np.add.reduceat(np.append(removed, False).astype(np.int64), words.first[:-1]) * (words.counts > 0)
            kept = list(_kept_bytes(texts, words, removed))
            yield K.batch_of(_RESULT, t1=batch.column("t1"), n_removed=n, kept_sha256=[hashlib.sha256(b).hexdigest() for b in kept], kept=[b.decode() for b in kept])
    return run


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, seed: int = SEED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256."""
    source = id_and_text(docs)
    rows = written(spark, source.mapInArrow(_scan_documents(window), _ddl(_DOC)), "substring-rows")
    heads = rows.groupBy("t1").agg(F.min("doc_id").alias("head"), F.max("n_words").alias("n"), F.min("t2").alias("lo"), F.max("t2").alias("hi"))
    if heads.where("lo <> hi").limit(1).count():
        raise RuntimeError("two word sequences share a 64-bit digest; give the hash in textkit another constant")
    heads = heads.select("t1", "head", "n")

    anchors = source.mapInArrow(_scan_anchors(window, seed), _ddl(_ANCHOR))
    place = F.xxhash64("t1", "s0")
    # a place has one row for each copy of its document, so places are compared, not counted; the count only sizes groups
    seen = anchors.groupBy("prefix").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("rows"))
    seen = seen.where("lo <> hi").select("prefix", (F.col("rows") > group_rows).alias("long"))
    places = (anchors.join(seen, "prefix").select("prefix", "long", "t1", "s0", "m").distinct()
              .groupBy("t1").agg(F.collect_list(F.struct("s0", "m", "prefix", "long")).alias("places")))
    packed = id_and_text(docs).mapInArrow(_pack_texts, _ddl(_TEXT))
    suffixes = (packed.join(places.join(heads, "t1"), "t1").select("t1", "z", F.col("head").alias("doc_id"), "places")
                .mapInArrow(_emit_suffixes(window), _ddl(_SUFFIX)))
    suffixes = written(spark, suffixes, "substring-suffixes")
    trees = (suffixes.where("not long").select("prefix", "doc_id", "t1", "s0", "words").repartition("prefix").sortWithinPartitions("prefix")
             .mapInArrow(_trees(window), _ddl(_MASK)))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "s0")
    deep = suffixes.where("long").select("prefix", order.alias("o"))
    nodes = deep.groupBy("prefix").agg(F.min("o").alias("head"))
    longer = deep.join(nodes, "prefix").where("o <> head").select("o.t1", "o.s0", F.lit(1).alias("mask"))
    marks = trees.unionByName(longer).groupBy("t1").agg(F.collect_set(F.struct("s0", "mask")).alias("marks"))
    cut = packed.join(marks, "t1").mapInArrow(_remove(window), _ddl(_RESULT)).dropDuplicates(["t1"]).drop("kept")

    out = rows.join(heads.select("t1", "head"), "t1").join(cut, "t1", "left")
    copy = ~F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("n_words") >= window)
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", "n_own")).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha_own")).alias("kept_sha256"))
