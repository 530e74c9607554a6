"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers encode a text; both sides' tokens, joined, must give the text with a blank
before it. Per batch, keyed by document (places run on from one document to the next),
``pandas.merge_asof`` finds for each token start the covering token of the other side; the
union of both directions are the overlaps, and overlaps with equal ends cut the tokens into
groups. All pairs of an A and a B token of one group are linked.

A text is cut before blanks that neither tokenizer's tokens can span (a blank behind
something other than a blank or ``▁``, before something other than white space), and each
distinct cut is encoded by the libraries once per worker (a bounded table), many in a call.

Links are never listed one by one: a group's distinct ids and their numbers give distinct
id pairs and how often they are linked, a document holds each pair once, and a block of
documents (see ``blocks``) sends each pair once to the shuffle that counts, over the whole
corpus, the documents that hold it and the highest count of each A id.

Defined results: a text that is null or empty, or that a side does not give back byte for
byte (one with ``▁``), has no tokens: zeros and an empty groups text. Texts are never cut
short; memory follows the longest text and the distinct pairs of its groups. Each row is a
document of its own: copies, repeated and null ids all count. Ties for an A id's highest
count all are highest. An empty table gives an empty one; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm import textkit as K
from facetwise.llm.blocks import numbered, with_values
from facetwise.llm.tables import id_and_text, written
from facetwise.llm.word_cache import worker_cache, worker_value

BLOCK_BYTES = 8 << 20
BATCH_BYTES = 2 << 20
CACHE_CUTS = 150_000
PAIRS_AT_ONCE = 4_000_000
LONG_CUT = 64
CUTS_AT_ONCE = 2000
CUTS_JOINED = 50

_IRREGULAR = re.compile(r" [\s▁]|▁ |^ | $")
_CUT = re.compile(r"(?<=[^ ▁]) (?=[^\s▁])")


def cuts(text: str) -> list[str]:
    """What follows the blanks at which a text with a blank before it is cut."""
    return _CUT.split(text) if _IRREGULAR.search(text) else text.split(" ")


def distinct_cuts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct cuts, which of them each cut is, its text's number) of all texts in a row.
    Texts that are cut at every blank are split and told apart as one Arrow column."""
    plain, odd = [], []
    for i, t in enumerate(texts):
        if t:
            (odd if _IRREGULAR.search(t) else plain).append(i)
    parts, sizes = [], []
    if plain:
        split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        parts.append(split.flatten())
        sizes.append(pc.list_value_length(split).to_numpy())
    if odd:
        split = [_CUT.split(texts[i]) for i in odd]
        parts.append(pa.array(chain.from_iterable(split), pa.large_string()))
        sizes.append(np.array(list(map(len, split)), np.int64))
    if not parts:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = pa.concat_arrays(parts).dictionary_encode()
    place = coded.indices.to_numpy().astype(np.int64)
    text_of = np.repeat(np.array(plain + odd), np.concatenate(sizes))
    if plain and odd:
        order = np.argsort(text_of, kind="stable")
        place, text_of = place[order], text_of[order]
    return coded.dictionary.to_pylist(), place, text_of


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable bytes stand for
    themselves, the others take the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both tokenizers: ids of cuts, bytes of ids, and texts of ids with what follows."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would start a thread for each of the machine's
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, entry)) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.texts = [f"{i}{s}" for top, signs in ((n, ",|"), (m, ",;")) for s in signs for i in range(top)]
        self.a_in, self.a_last, self.b_in, self.b_last = 0, n, 2 * n, 2 * n + m  # where the texts of each kind start

    def encoded(self, new: list[str]) -> Iterator[tuple[list[str], Iterator[tuple[bytes, bytes, bool]]]]:
        """(cuts, (A ids, B ids, whether both sides give its bytes) of each), some distinct
        cuts at a time."""
        for at in range(0, len(new), CUTS_AT_ONCE):
            some = new[at:at + CUTS_AT_ONCE]
            yield some, self._joined(some) or self._single(some)

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        return [e.ids for e in encode([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def _joined(self, some: list[str]):
        """Both sides of cuts that are encoded with the blanks at which texts are cut between
        them, as a call costs more than a cut; None if a side does not give all bytes back."""
        parts = []
        for i in range(0, len(some), CUTS_JOINED):
            joined = " ".join(some[i:i + CUTS_JOINED])
            parts += some[i:i + CUTS_JOINED] if _IRREGULAR.search(joined) else [joined]
        raw = [" " + c for c in some]
        whole = "".join(raw).encode()
        wanted = np.cumsum([len(r) if r.isascii() else len(r.encode()) for r in raw])
        out = []
        for ids, names, size in zip(self._ids(parts), (self.a_bytes, self.b_bytes), (self.a_size, self.b_size)):
            flat = np.fromiter(chain.from_iterable(ids), "<u4")
            ends = np.cumsum(size[flat])
            last = np.searchsorted(ends, wanted)
            if not len(ends) or ends[-1] != wanted[-1] or (ends[last] != wanted).any() or b"".join(map(names.__getitem__, flat.tolist())) != whole:
                return None
            packed, until = flat.tobytes(), ((last + 1) * 4).tolist()
            out.append([packed[a:b] for a, b in zip([0, *until[:-1]], until)])
        return zip(out[0], out[1], repeat(True))

    def _single(self, some: list[str]):
        """Both sides of cuts that are encoded one by one."""
        ids = self._ids(some)
        if "" in some:  # the library gives no token for an empty text; it is a lone blank here
            ids[1][some.index("")] = [self.b.piece_to_id("▁")]
        raw = [(" " + c).encode() for c in some]
        sides = [_side(x, raw, names, size) for x, names, size in zip(ids, (self.a_bytes, self.b_bytes), (self.a_size, self.b_size))]
        return zip(sides[0][0], sides[1][0], (sides[0][1] & sides[1][1]).tolist())

    def encode(self, texts: list[str], cache) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, their numbers in each text, B ids, their numbers); texts without tokens
        have none."""
        names, place, text_of = distinct_cuts(texts)
        new = cache.missing(names)
        young = cache.young
        for some, sides in self.encoded(new):
            young.update(zip(some, sides))
        found = list(map(young.__getitem__, names))
        odd = np.array([not f[2] for f in found], bool)
        spoilt = np.zeros(len(texts), bool)
        spoilt[text_of[odd[place]]] = True
        place, text_of = place[~spoilt[text_of]], text_of[~spoilt[text_of]]
        for c in new:
            if len(c) > LONG_CUT:
                del young[c]
        cache.settle()
        out = []
        for side in (0, 1):
            flat = np.frombuffer(b"".join([f[side] for f in found]), "<u4").astype(np.int64)
            until = np.cumsum([len(f[side]) // 4 for f in found], dtype=np.int64)
            n = np.diff(until, prepend=0)[place]
            shift = until[place] - np.cumsum(n)
            out += [flat[np.arange(n.sum()) + np.repeat(shift, n)], np.bincount(text_of, n, minlength=len(texts)).astype(np.int64)]
        return tuple(out)


def _side(ids: list[list[int]], raw: list[bytes], names: list[bytes], size: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(packed ids, whether their bytes are those wanted) of each cut."""
    until = np.cumsum([len(x) for x in ids])
    flat = np.fromiter(chain.from_iterable(ids), "<u4", until[-1])
    packed, ends = flat.tobytes(), (until * 4).tolist()
    cut = [packed[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    same = np.diff(np.cumsum(size[flat])[until - 1], prepend=0) == np.array(list(map(len, raw)))
    if not same.all() or b"".join(map(names.__getitem__, flat.tolist())) != b"".join(raw):
        same = np.array([b"".join(map(names.__getitem__, x)) == r for x, r in zip(ids, raw)])
    return cut, same


def groups(a_end: np.ndarray, a_size: np.ndarray, b_end: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number of each token of both sides, from ends and sizes in bytes. Ends run
    on over the documents, so a place names its document too."""
    a = pd.DataFrame({"start": a_end - a_size, "a": np.arange(len(a_end))})
    b = pd.DataFrame({"start": b_end - b_size, "b": np.arange(len(b_end))})
    covering_b = pd.merge_asof(a, b, on="start")
    covering_a = pd.merge_asof(b, a, on="start")
    left = np.concatenate([covering_b["a"].to_numpy(), covering_a["a"].to_numpy()])
    right = np.concatenate([covering_b["b"].to_numpy(), covering_a["b"].to_numpy()])
    equal = a_end[left] == b_end[right]
    out = []
    for n, tokens in ((len(a_end), left), (len(b_end), right)):
        last = np.zeros(n, bool)
        last[tokens[equal]] = True
        out.append(np.cumsum(last) - last)
    return out[0], out[1]


def _distinct(group: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n = np.unique(group * width + ids, return_counts=True)
    return key // width, key % width, n


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


def linked_pairs(a_group, a_ids, b_group, b_ids, doc_of_group, widths: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """((document, A id, B id) as one number, how often linked) of all groups."""
    n = len(doc_of_group)
    sizes = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    simple = (sizes[0] == 1) & (sizes[1] == 1)
    one_a, one_b = simple[a_group], simple[b_group]
    pair = widths[0] * widths[1]
    keys = [doc_of_group[a_group[one_a]] * pair + a_ids[one_a] * widths[1] + b_ids[one_b]]
    times = [np.ones(len(keys[0]), np.int64)]
    ga, ia, na = _distinct(a_group[~one_a], a_ids[~one_a], widths[0])
    gb, ib, nb = _distinct(b_group[~one_b], b_ids[~one_b], widths[1])
    first_b, last_b = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right")
    fan = last_b - first_b
    until = np.cumsum(fan)
    at = 0
    while at < len(ga):  # some A ids at a time, each with all B ids of its group
        end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        a = np.repeat(np.arange(at, end), fan[at:end])
        b = np.arange(len(a)) - np.repeat(until[at:end] - fan[at:end] - (until[at - 1] if at else 0), fan[at:end]) + first_b[a]
        key, n_of = _summed(doc_of_group[ga[a]] * pair + ia[a] * widths[1] + ib[b], na[a] * nb[b])
        keys.append(key)
        times.append(n_of)
        at = end
    return _summed(np.concatenate(keys), np.concatenate(times))


def _batch(sides: Sides, cache, texts: list[str], first_doc: int, keep: bool):
    """(n_a, n_b, n_groups, n_links, checksum, groups text or None) per text, and the
    linked pairs with documents numbered from ``first_doc``."""
    a, n_a, b, n_b = sides.encode(texts, cache)
    docs = np.arange(len(texts))
    a_doc = np.repeat(docs, n_a)
    a_size, b_size = sides.a_size[a], sides.b_size[b]
    ga, gb = groups(np.cumsum(a_size), a_size, np.cumsum(b_size), b_size)
    n = int(ga[-1]) + 1 if len(ga) else 0
    first_a, first_b = np.searchsorted(ga, np.arange(n + 1)), np.searchsorted(gb, np.arange(n + 1))
    doc_of = a_doc[first_a[:-1]]
    links = np.diff(first_a) * np.diff(first_b)
    n_groups = np.bincount(doc_of, minlength=len(texts))
    n_links = np.bincount(doc_of, links, minlength=len(texts)).astype(np.int64)
    last_a, last_b = np.append(ga[1:] != ga[:-1], True)[:len(a)], np.append(gb[1:] != gb[:-1], True)[:len(b)]
    codes = np.zeros(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + first_b[ga]] = a + np.where(last_a, sides.a_last, sides.a_in)
    codes[np.arange(len(b)) + first_a[gb + 1]] = b + np.where(last_b, sides.b_last, sides.b_in)
    names, at, shown = sides.texts, 0, []
    for size in (n_a + n_b).tolist():
        text = "".join(map(names.__getitem__, codes[at:at + size].tolist()))[:-1]
        shown.append((hashlib.sha256(text.encode()).hexdigest() if size else "", text if keep else None))
        at += size
    pairs = linked_pairs(ga, a, gb, b, doc_of + first_doc, (len(sides.a_bytes), len(sides.b_bytes)))
    return n_a, n_b, n_groups, n_links, shown, pairs


_PARTS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()),
                    ("bag", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("place", pa.int32()), ("held", pa.int64())])
_DOC = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "bag"]


def _parts(a_path: str, b_path: str, keep: bool):
    """Documents with bags of pairs (places in the block's list of pairs and how often
    linked), and the block's pairs with the number of its documents that hold them."""
    def run(batches):
        sides = worker_value(("sides", a_path, b_path), lambda: Sides(a_path, b_path))
        cache = worker_cache(("sides", a_path, b_path), CACHE_CUTS)
        width_b = len(sides.b_bytes)
        pair = len(sides.a_bytes) * width_b
        none = lambda n: {f.name: pa.nulls(n, f.type) for f in _PARTS}
        for block, rows, texts in numbered(batches, BLOCK_BYTES):
            found, keys, times, at = [], [], [], 0
            for _, some in K.slices(iter([pa.record_batch([texts], ["text"])]), limit=BATCH_BYTES):
                *sizes, shown, (key, n) = _batch(sides, cache, some.to_pylist(), at, keep)
                found.append((*sizes, shown))
                keys.append(key)
                times.append(n)
                at += len(some)
            key, n = np.concatenate(keys), np.concatenate(times)
            names, place, held = np.unique(key % pair, return_inverse=True, return_counts=True)
            ends = np.searchsorted(key, np.arange(len(texts) + 1) * pair).tolist()
            steps = np.diff(place, prepend=0)
            starts = np.array(ends[:-1])[np.diff(ends) > 0]
            steps[starts] = place[starts]
            planes = np.stack([steps.astype("<u4"), n.astype("<u4")], 1).view(np.uint8)
            bag = [planes[i:j].T.tobytes() for i, j in zip(ends[:-1], ends[1:])]
            n_a, n_b, n_groups, n_links = (np.concatenate([f[c] for f in found]).astype(np.int64) for c in range(4))
            sha, text = zip(*[s for f in found for s in f[4]])
            yield K.batch_of(_PARTS, **{**none(len(texts)), "block": pa.array(np.full(len(texts), block)), "doc_id": rows.column(rows.schema.get_field_index("doc_id")), "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups),
                                        "n_links": pa.array(n_links), "groups_sha256": pa.array(sha), "groups": pa.array(text, pa.string()), "bag": pa.array(bag, pa.binary())})
            size = len(names)
            if size:
                yield K.batch_of(_PARTS, **{**none(size), "block": pa.array(np.full(size, block)), "a": pa.array((names // width_b).astype(np.int32)), "b": pa.array((names % width_b).astype(np.int32)),
                                            "place": pa.array(np.arange(size, dtype=np.int32)), "held": pa.array(held.astype(np.int64))})
    return run


def _counted(docs: pa.Table, values: pa.Table) -> pa.Table:
    count, best = np.zeros(values.num_rows, np.int64), np.zeros(values.num_rows, bool)
    at = values.column("place").to_numpy()
    count[at], best[at] = values.column("count").to_numpy(), values.column("best").to_numpy(zero_copy_only=False)
    n_best, total = [], []
    for bag in docs.column("bag").to_pylist():
        steps, times = np.ascontiguousarray(np.frombuffer(bag, np.uint8).reshape(8, -1).T).view("<u4").T
        here, times = np.cumsum(steps, dtype=np.int64), times.astype(np.int64)
        n_best.append(int(times[best[here]].sum()))
        total.append(int(times @ count[here]))
    out = docs.drop_columns(["block", "bag"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best) of (a, b, held): documents that hold a pair linked, and whether
    no pair of its A id has more."""
    counts = pairs.groupBy("a", "b").agg(F.sum("held").alias("count"))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def cross_align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 and, if wanted, groups: ``a1,a2|b1;a3|b2,b3`` in text order. ``a_path`` is a
    byte-level BPE of the tokenizers library, ``b_path`` a SentencePiece model."""
    fields = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, bag binary, a int, b int, place int, held long"
    parts = written(spark, id_and_text(docs).mapInArrow(_parts(a_path, b_path, keep_groups), fields), "align-parts")
    pairs = parts.where("a is not null").select("block", "a", "b", "place", "held")
    counts = written(spark, pair_counts(pairs), "align-counts")
    values = pairs.select("block", "a", "b", "place").join(counts, ["a", "b"]).select("block", "place", "count", "best")
    shown = [c for c in _DOC if c != "groups" or keep_groups]
    texts = "groups_sha256 string, groups string" if keep_groups else "groups_sha256 string"
    return with_values(parts.where("a is null").select(*shown), values, _counted, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, {texts}, n_best long, count_sum long")
