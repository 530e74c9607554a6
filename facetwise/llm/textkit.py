"""Numpy kernels over Arrow text columns, shared by the operators of this folder.

A text column of an Arrow batch is one byte buffer plus offsets, so words of all
its documents are found and hashed in a few array passes, with no Python string
per word. Batches are cut into slices of bounded bytes, so memory does not follow
the number of rows in a batch (one text is never cut).
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xD6E8FEB86659FD93)
_S29, _S32 = np.uint64(29), np.uint64(32)
_LONG_WORD = 256

#: Bytes that separate words: blank and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside [0-9a-z] and the non-ASCII range (used after lower-casing).
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit combination of two hash arrays."""
    x = a * _C1 + b
    x ^= x >> _S29
    x *= _C2
    x ^= x >> _S32
    return x


def texts_of(column: pa.Array) -> pa.Array:
    """The column as 64-bit-offset strings without nulls (null: empty)."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large_string array."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their texts) pieces of at most ``limit`` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = texts_of(batch.column(batch.schema.get_field_index(column)))
        _, offsets = buffer_of(texts)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), texts.slice(at, end - at)
            at = end


class Words:
    """Words of a slice of texts: byte spans, the first word of each text (``first``,
    one entry more than texts) and, on demand, 64-bit hashes."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = False):
        raw, self.offsets = buffer_of(texts)
        self.n_texts = len(texts)
        self.raw = LOWER[raw] if lower else raw
        inside = ~separators[self.raw]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        here = np.zeros(n + 1, bool)
        here[:n] = inside
        self.starts = np.flatnonzero(here & (~before | edge))
        self.ends = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.starts, self.offsets)
        self._hash = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(self.n_texts), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.raw, self.starts, self.ends)
        return self._hash

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, and which of them lie within one text."""
        h, n = self.hashes, len(self)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out, have, power, width = None, 0, h, 1
        while True:
            if k & width:
                out = power[:n - k + 1] if out is None else mix(out, power[have:have + n - k + 1])
                have += width
            if have == k:
                break
            power = mix(power[:-width], power[width:]) if len(power) > width else power[:0]
            width *= 2
        doc = self.text_of
        return out.copy() if out.base is not None else out, doc[:n - k + 1] == doc[k - 1:]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time; equal bytes, equal hash."""
    size = (ends - starts).astype(np.int64)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
    out = mix(size.astype(np.uint64), np.full(len(size), 7, np.uint64))
    left, at, rows = size, starts, np.arange(len(size))
    rows = rows[size <= _LONG_WORD]
    left, at, step = size[rows], starts[rows], 0
    while len(rows):
        chunk = eight[at + step] & masks[np.minimum(left, 8)]
        out[rows] = mix(out[rows], chunk)
        more = left > 8
        rows, at, left = rows[more], at[more], left[more] - 8
        step += 8
    for i in np.flatnonzero(size > _LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def digests(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit halves of a 128-bit digest of each byte string."""
    both = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in parts), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)
