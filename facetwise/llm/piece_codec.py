"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes ``▁`` + text with blanks as ``▁`` and is cut into marked words: a run of
``▁`` and what follows up to the next one. No piece of the model has a ``▁`` behind another
character, so the best segmentation of a text is that of its marked words in a row. New
words are sorted, which puts them in the depth-first order of their trie, and forward
scores are kept along the current path: a word only computes what lies beyond the prefix
it shares with the word before.

The score of a segmentation is the sum of the model file's piece scores; of equal sums the
one whose last piece is longest wins, position by position. A character that no piece of
its own covers costs ``UNKNOWN`` below the lowest score and is encoded as its UTF-8 bytes'
pieces. (The public model's scores are merge ranks, by which the library merges greedily;
its ids can differ from the best-scoring ones, which Viterbi finds. Either way they decode
to the same text.)

Decoding joins the pieces' bytes, turns ``▁`` into blanks and drops the first one; it
restores any text that has no ``▁`` of its own.

Defined results: null, like the empty text, has no ids and decodes to the empty text.
Rows are independent; copies get equal results. Extra columns are carried in ``row``.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetwise.llm import textkit as K
from facetwise.llm.word_cache import worker_cache, worker_value

MARK = "▁"
UNKNOWN = 10.0
CACHE_WORDS = 250_000


class PieceModel:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        bytes_of = {i: int(model.id_to_piece(i)[3:5], 16) for i in range(size) if model.is_byte(i)}
        self.byte_id = {v: k for k, v in bytes_of.items()}
        normal = [i for i in range(size) if i not in special and i not in bytes_of]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.ids = {model.id_to_piece(i): i for i in normal}
        self.unknown = min(self.score.values()) - UNKNOWN
        self.longest: dict[str, int] = {}
        for piece in self.score:
            self.longest[piece[-1]] = max(len(piece), self.longest.get(piece[-1], 0))
        self.raw = [b""] * size
        for i in normal:
            self.raw[i] = model.id_to_piece(i).replace(MARK, " ").encode()
        for i, b in bytes_of.items():
            self.raw[i] = bytes([b])

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct marked words, in sorted order."""
        score_of, ids_of, longest, unknown, byte_id = self.score.get, self.ids, self.longest.get, self.unknown, self.byte_id
        best, cut, before = [0.0], [0], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1:], cut[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, at = None, end - 1
                for start in range(max(0, end - longest(word[end - 1], 1)), end):  # the longest piece first
                    s = score_of(word[start:end])
                    if s is not None and (top is None or best[start] + s > top):
                        top, at = best[start] + s, start
                if word[end - 1] not in ids_of and (top is None or best[end - 1] + unknown > top):
                    top, at = best[end - 1] + unknown, end - 1
                best.append(top)
                cut.append(at)
            ids, end = [], len(word)
            while end:
                start = cut[end]
                piece = word[start:end]
                if piece in ids_of:
                    ids.append(ids_of[piece])
                else:
                    ids += [byte_id[b] for b in reversed(piece.encode())]
                end = start
            ids.reverse()
            before = word
            yield word, ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode("utf-8", "replace")


def marked_words(text: str) -> list[str]:
    """The marked words of a text, without their first ``▁``."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
    return text.split(" ")


def encode_texts(texts: list[str], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text."""
    model = worker_value(("pieces", path), lambda: PieceModel(path))
    cache = worker_cache(("pieces", path), CACHE_WORDS)
    split = [marked_words(t) for t in texts]
    new = cache.missing({w for words in split for w in words})
    young = cache.young
    for word, ids in model.segment([MARK + w for w in new]):
        young[word[1:]] = np.array(ids, "<i4").tobytes()
    for words in split:
        yield b"".join(map(young.__getitem__, words))
    for w in new:
        if len(w) > 64:
            del young[w]
    cache.settle()


def decode_ids(ids: list[int], path: str) -> str:
    return worker_value(("pieces", path), lambda: PieceModel(path)).decode(ids)


def _codec(path: str):
    def run(batches):
        for rows, texts in K.slices(batches):
            strings = texts.to_pylist()
            raw = list(encode_texts(strings, path))
            flat = np.frombuffer(b"".join(raw), "<i4")
            size = np.array([len(r) // 4 for r in raw], np.int64)
            offsets = np.append(0, np.cumsum(size)).astype(np.int32)
            model = worker_value(("pieces", path), lambda: PieceModel(path))
            ids = flat.tolist()
            back = [model.decode(ids[a:b]) == t for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strings)]
            out = rows.select([n for n in rows.schema.names if n != "text"])
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(size), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), pa.array(back, pa.bool_())],
                [*out.schema.names, "n_pieces", "ids_crc32", "ids", "round_trip"])
    return run


def piece_codec(docs: DataFrame, model_path: str, keep_rows: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids_crc32 (of the ids as little-endian
    32-bit integers), ids, round_trip (decoding the ids gives the text again), and the
    input row as a struct ``row`` if wanted."""
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep_rows else []
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *row)
    schema = base.drop("text").schema.add("n_pieces", "long").add("ids_crc32", "long").add("ids", T.ArrayType(T.IntegerType())).add("round_trip", "boolean")
    return base.mapInArrow(_codec(model_path), schema)


def decode(frame: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of an ids column (null ids: null); replaces a column of
    that name."""
    frame = frame.drop("decoded")

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decode_ids(x, model_path) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField("decoded", T.StringType())]))
