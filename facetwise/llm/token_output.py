"""Token ids in a binary file format: patched frame-of-reference blocks.

A file is a Parquet table of segments, written and committed by Spark, so it works on any
store and survives lost executors. A segment's blob holds whole documents in order:

    "PFR1" | documents, ids, blocks: u32 | doc_id: i64 x documents | null flag: u8 x documents
    | ids of each document: u32 x documents | start of each block in the payload: u32 x blocks
    | payload

A block holds ``BLOCK`` ids (the last one is filled up with its minimum):

    minimum: u32 | width: u8 | exceptions: u16 | packed | position: u16, value: u32 of each exception

Ids less the block's minimum are packed at the width that ``PERCENTILE`` percent of them
need, as ``width`` 64-bit words for each 64 ids; larger ones are packed as 0 and stored as
exceptions. The index of block starts lets a reader unpack any range of ids alone.

Tokenising uses the tokenizers library. The tokenizer drops white space and looks at no
character beyond it, so a text's ids are those of its words in a row; each worker keeps a
bounded table of words it has met.

Defined results: null is the empty text, whose ids are the end id alone. Order is by
doc_id, nulls first, rows with equal doc_id by text. Extra columns are ignored. An empty
table gives no segment and no row.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm import textkit as K
from facetwise.llm.tables import id_and_text, new_folder
from facetwise.llm.word_cache import worker_cache, worker_value

END_ID = 1
BLOCK = 1024
PERCENTILE = 98
SEGMENT_IDS = 1 << 20
CACHE_WORDS = 300_000
#: Words that one call of the tokenizer gets as one text.
JOINED_WORDS = 2000
MAGIC = b"PFR1"

_SEGMENT = "part int, start_in_part bigint, n_ids bigint, blob binary"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


# ---- the format

def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(k, BLOCK) values below 2 ** width as (k, BLOCK // 64 * width) 64-bit words."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T)
    out = np.zeros((max(width, 1), lanes.shape[1]), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word if width else 0] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)[:, :width].reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """The reverse, for n blocks."""
    if not width:
        return np.zeros((n, BLOCK), np.uint64)
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, lanes.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (lanes[word + 1] << np.uint64(64 - shift))
        out[j] = x & mask
    return np.ascontiguousarray(out.T).reshape(n, BLOCK)


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The blob of some whole documents (``ids``: unsigned 32-bit, end ids included)."""
    n_blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(n_blocks * BLOCK, np.uint64)
    grid[:len(ids)] = ids
    if len(ids) % BLOCK:
        grid[len(ids):] = ids[(n_blocks - 1) * BLOCK:].min()
    grid = grid.reshape(n_blocks, BLOCK)
    low = grid.min(1)
    delta = grid - low[:, None]
    bits = np.frexp(delta.astype(np.float64))[1].astype(np.uint8)  # 0 for 0
    rank = -(-PERCENTILE * BLOCK // 100) - 1
    width = np.partition(bits, rank, axis=1)[:, rank]
    over = bits > width[:, None]
    packed = np.where(over, np.uint64(0), delta)
    blocks: list[bytes] = [b""] * n_blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for r, body in zip(rows.tolist(), _pack(packed[rows], w)):
            at = np.flatnonzero(over[r])
            patch = np.zeros(len(at), [("at", "<u2"), ("value", "<u4")])
            patch["at"], patch["value"] = at, delta[r, at]
            blocks[r] = struct.pack("<IBH", int(low[r]), w, len(at)) + body.astype("<u8").tobytes() + patch.tobytes()
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u4")
    return b"".join([MAGIC, struct.pack("<III", len(doc_ids), len(ids), n_blocks), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                     bytes(d is None for d in doc_ids), np.array(lengths, "<u4").tobytes(), starts.tobytes(), *blocks])


class Segment:
    """Reader of one blob."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        n_docs, self.n_ids, self.n_blocks = struct.unpack_from("<III", blob, 4)
        at = 16
        ids = np.frombuffer(blob, "<i8", n_docs, at)
        null = np.frombuffer(blob, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if x else d for d, x in zip(ids.tolist(), null.tolist())]
        self.lengths = np.frombuffer(blob, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
        self.starts = np.frombuffer(blob, "<u4", self.n_blocks, at + 13 * n_docs)
        self.payload = memoryview(blob)[at + 13 * n_docs + 4 * self.n_blocks:]

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """Ids first to end, unpacking only their blocks."""
        end = self.n_ids if end is None else end
        b0, b1 = first // BLOCK, -(-end // BLOCK)
        out = np.empty((max(0, b1 - b0), BLOCK), np.uint32)
        heads = [struct.unpack_from("<IBH", self.payload, self.starts[b]) for b in range(b0, b1)]
        width = np.array([h[1] for h in heads], np.int64)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            size = BLOCK // 8 * w
            words = np.stack([np.frombuffer(self.payload, "<u8", size // 8, self.starts[b0 + r] + 7) for r in rows])
            out[rows] = _unpack(words, w, len(rows)).astype(np.uint32)
        for r, (low, w, n) in enumerate(heads):
            if n:
                patch = np.frombuffer(self.payload, [("at", "<u2"), ("value", "<u4")], n, self.starts[b0 + r] + 7 + BLOCK // 8 * w)
                out[r, patch["at"]] = patch["value"]
            out[r] += np.uint32(low)
        return out.reshape(-1)[first - b0 * BLOCK:end - b0 * BLOCK]


# ---- tokenising

def _tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    for piece, i in tokenizer.get_vocab().items():
        ends[i] = piece.endswith("</w>")
    return tokenizer, ends


def _plain(word: str) -> bool:
    """Latin letters that no normaliser takes apart: one run of letters for the tokenizer."""
    return word.isalpha() and (word.isascii() or (max(word) < "ɐ" and "İ" not in word))


def _learn(words: list[str], table: dict[str, bytes], tokenizer, ends: np.ndarray) -> None:
    """Adds the ids of some words. Plain words are encoded as one text, whose ids part
    after each token that ends a word; a full stop or comma after one is a word of its
    own for the tokenizer. All others are encoded one by one."""
    split, odd, plain = [], [], {}
    for w in words:
        core, tail = (w[:-1], w[-1]) if w[-1:] in (".", ",") else (w, "")
        if _plain(core):
            plain[core] = b""
            split.append((w, core, tail))
        else:
            odd.append(w)
    todo = [w for w in plain if w not in table]
    for k in range(0, len(todo), JOINED_WORDS):
        part = todo[k:k + JOINED_WORDS]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(ends[ids]) + 1
        if len(cut) == len(part):
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, (4 * cut).tolist()):
                table[w] = raw[at:end]
                at = end
        else:
            odd += part
    for w, e in zip(odd, tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
        table[w] = np.array(e.ids, "<u4").tobytes()
    for mark in (".", ","):
        if mark not in table:
            table[mark] = np.array(tokenizer.encode(mark, add_special_tokens=False).ids, "<u4").tobytes()
    for w, core, tail in split:
        if tail:
            table[w] = table[core] + table[tail]


def token_ids(texts: list[str], path: str) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text, without special tokens."""
    tokenizer, ends = worker_value(("tokenizer", path), lambda: _tokenizer(path))
    cache = worker_cache(("words", path), CACHE_WORDS)
    split = [t.replace("\n", " ").split(" ") for t in texts]
    new = cache.missing({w for words in split for w in words})
    _learn(new, cache.young, tokenizer, ends)
    cache.young[""] = b""
    for words in split:
        yield b"".join(map(cache.young.__getitem__, words))
    for w in new:
        if len(w) > 64:
            cache.young.pop(w, None)
    cache.settle()


def _write_segments(path: str, segment_ids: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        docs, lengths, held, count = [], [], [], 0

        def segment():
            blob = encode_segment(docs, lengths, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "start_in_part": [start], "n_ids": [count], "blob": pa.array([blob], pa.binary())})

        for rows, texts in K.slices(batches):
            for doc, ids in zip(rows.column(0).to_pylist(), token_ids(texts.to_pylist(), path)):
                docs.append(doc)
                held.append(ids + end)
                lengths.append(len(ids) // 4 + 1)
                count += lengths[-1]
                if count >= segment_ids:
                    yield segment()
                    start += count
                    docs, lengths, held, count = [], [], [], 0
        if docs:
            yield segment()
    return run


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, out: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes all documents and writes their ids in ascending doc_id order to ``out``."""
    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write_segments(tokenizer_path, segment_ids), _SEGMENT).write.parquet(out)


def _read_segments(batches):
    for batch in batches:
        for offset, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            seg = Segment(blob.as_py())
            raw = seg.ids().astype("<u4").tobytes()
            begin = np.cumsum(seg.lengths) - seg.lengths
            crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(begin.tolist(), seg.lengths.tolist())]
            yield K.batch_of(_DOCS, doc_id=seg.doc_ids, start=begin + offset, n_tokens=seg.lengths, ids_crc32=crc)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(_SEGMENT).parquet(path)
    total, starts = 0, []
    for part, n in sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_ids")).collect()):  # one row for each writing task
        starts.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, before bigint"))
    segments = files.join(offsets, "part").select((F.col("before") + F.col("start_in_part")).alias("offset"), "blob")
    return segments.mapInArrow(_read_segments, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the files to a new shared folder and reads them back."""
    out = new_folder(spark, "tokens")
    write_tokens(spark, docs, tokenizer_path, out)
    return read_tokens(spark, out)
