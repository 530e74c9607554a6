"""Language-model scoring by subword lattices.

The model is a unigram model over an existing vocabulary of pieces and an end sign. A text
is its lower-cased words, each marked by a leading ``▁``; its probability is the sum over
all ways of cutting it into pieces of the product of their probabilities, times that of
the end. No piece has a ``▁`` behind another character, so the sum is the product of the
words' own sums, and the forward recursion (in log space: the sums of all paths to each
character) runs once per distinct word of the corpus, in sorted order, keeping what
is shared with the word before.

The vocabulary's scores are merge ranks: a piece of rank r weighs 1 / (1 + r) beforehand.
That prior, with ``SMOOTH`` pseudo-counts a piece, is sharpened by the number of times each
piece occurs in the training words as the vocabulary's own library cuts them. A character
that is no piece is spelt by its UTF-8 bytes' pieces.

Beside it stands a base score: the unigram model over whole words with additive smoothing,
its counts from all training documents. Words of a block of documents are one row each
(see ``blocks``), counted and scored by a shuffle on the word, so the vocabulary is never
in one place; only the counts of the pieces (as many as the vocabulary has) and three
totals reach the driver.

Defined results: null, empty and blank texts have no word and score the end alone. Texts
are never cut, however long. Each row is a document: copies and repeated ids count and
are scored one by one; a null doc_id is neither held out nor learnt from. Nothing to learn
from gives counts of 0 and the smoothed scores; an empty table gives an empty one. Extra
columns are ignored.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm import textkit as K
from facetwise.llm.blocks import numbered, with_values
from facetwise.llm.periodic_runs import split_words
from facetwise.llm.piece_codec import MARK, PieceModel
from facetwise.llm.tables import id_and_text, written
from facetwise.llm.word_cache import worker_value

SMOOTH = 0.1
FOLDS = 10
BLOCK_BYTES = 8 << 20

_PARTS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("train", pa.bool_()), ("n_words", pa.int64()), ("bag", pa.binary()),
                    ("word", pa.string()), ("place", pa.int32()), ("times", pa.int64())])


def fold(doc_id: int | None) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def _parts(batches):
    """Documents with their bags of words, and the block's words with their number in
    training documents. A bag holds the steps between the words' places in the block's list
    and how often each occurs, both as planes of bytes, which the shuffle compresses well."""
    for block, rows, texts in numbered(batches, BLOCK_BYTES):
        words, first = split_words(pc.ascii_lower(texts))
        coded = words.dictionary_encode()
        names, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.diff(first)
        doc_ids = rows.column(rows.schema.get_field_index("doc_id"))
        folds = [fold(i) for i in doc_ids.to_pylist()]
        train = np.array([f is not None and f > 0 for f in folds], bool)
        text_of = np.repeat(np.arange(len(texts)), size)
        width = max(1, len(names))
        bags, often = np.unique(text_of * width + place, return_counts=True)
        ends = np.searchsorted(bags, np.arange(len(texts) + 1) * width).tolist()
        here = np.diff(bags, prepend=0)  # steps from one place to the next; a document's first is its place
        starts = np.array(ends[:-1])[np.diff(ends) > 0]
        here[starts] = bags[starts] % width
        planes = np.stack([here.astype("<u4"), often.astype("<u4")], 1).view(np.uint8)
        bag = [planes[a:b].T.tobytes() for a, b in zip(ends[:-1], ends[1:])]
        times = np.bincount(place[train[text_of]], minlength=len(names))
        none = lambda n: {f.name: pa.nulls(n, f.type) for f in _PARTS}
        n = len(texts)
        yield K.batch_of(_PARTS, **{**none(n), "block": pa.array(np.full(n, block)), "doc_id": doc_ids, "held_out": pa.array([f == 0 for f in folds]), "train": pa.array(train), "n_words": pa.array(size.astype(np.int64)), "bag": pa.array(bag, pa.binary())})
        n = len(names)
        yield K.batch_of(_PARTS, **{**none(n), "block": pa.array(np.full(n, block)), "word": names.cast(pa.string()), "place": pa.array(np.arange(n, dtype=np.int32)), "times": pa.array(times.astype(np.int64))})


def _piece_counts(model_path: str):
    def run(batches):
        model = worker_value(("library", model_path), lambda: _library(model_path))
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = model.encode(words, num_threads=1)
            of = np.repeat(batch.column(1).to_numpy(), [len(x) for x in ids])
            np.add.at(total, np.fromiter((i for x in ids for i in x), np.int64, len(of)), of)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])
    return run


def _library(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """Log probabilities (natural) of pieces, and of words over all their segmentations."""

    def __init__(self, model: PieceModel, counts: dict[int, int], ends: int):
        lowest = min(model.score.values()) - 1
        weight = {i: 1 / (1 - model.score[p]) for p, i in model.ids.items()} | {i: 1 / (1 - lowest) for i in model.byte_id.values()}
        mass = SMOOTH * len(weight)
        scale = mass / sum(weight.values())
        all_of = math.log(sum(counts.get(i, 0) for i in weight) + ends + SMOOTH + mass)
        log_p = {i: math.log(counts.get(i, 0) + scale * w) - all_of for i, w in weight.items()}
        self.end = math.log(ends + SMOOTH) - all_of
        self.piece = {p: log_p[i] for p, i in model.ids.items()}
        self.byte = {b: log_p[i] for b, i in model.byte_id.items()}
        self.longest = model.longest

    def words(self, words: list[str]) -> dict[str, float]:
        """Natural log probabilities of distinct marked words."""
        piece, longest, exp, log, out = self.piece.get, self.longest.get, math.exp, math.log, {}
        paths, before = [0.0], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del paths[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                last = word[end - 1]
                into = [paths[start] + p for start in range(max(0, end - longest(last, 1)), end) if (p := piece(word[start:end])) is not None]
                if last not in self.piece:
                    into.append(paths[end - 1] + sum(self.byte[b] for b in last.encode()))
                top = max(into)
                paths.append(top + log(sum([exp(x - top) for x in into])) if len(into) > 1 else top)
            out[word], before = paths[-1], word
        return out


def _word_scores(model_path: str, counts: dict[int, int], ends: int):
    def run(batches):
        lattice = Lattice(worker_value(("pieces", model_path), lambda: PieceModel(model_path)), counts, ends)
        for batch in batches:
            words = [MARK + w for w in batch.column(0).to_pylist()]
            score = lattice.words(words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([score[w] / math.log(10) for w in words], pa.float64())], ["word", "times", "log_p"])
    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(train_tokens: int, distinct: int, ends: int, end_score: float):
    below = train_tokens + SMOOTH * (distinct + 1)
    base = lambda n: np.log10((n + SMOOTH) / below)

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        n = values.num_rows
        known, word_base, log_p = np.zeros(n, bool), np.zeros(n), np.zeros(n)
        at, times = (values.column(c).to_numpy() for c in ("place", "times"))
        known[at], word_base[at], log_p[at] = times > 0, base(times), values.column("log_p").to_numpy()
        found = []
        for bag in docs.column("bag").to_pylist():
            steps, often = np.ascontiguousarray(np.frombuffer(bag, np.uint8).reshape(8, -1).T).view("<u4").T
            here = np.cumsum(steps, dtype=np.int64)
            found.append((int(often[known[here]].sum()) + (ends > 0), float(word_base[here] @ often + base(ends)), float(log_p[here] @ often + end_score)))
        n_known, base_score, score = zip(*found)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pc.add(docs.column("n_words"), 1),
                         "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([train_tokens] * len(found), pa.int64()), "base_score": pa.array(base_score), "score": pa.array(score)})
    return run


def lm_scoring(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    and score (the lattice model's log10 probability of the text)."""
    fields = "block long, doc_id long, held_out boolean, train boolean, n_words long, bag binary, word string, place int, times long"
    parts = written(spark, id_and_text(docs).mapInArrow(_parts, fields), "lm-parts")
    words = parts.where("word is not null")
    counted = written(spark, words.groupBy("word").agg(F.sum("times").alias("times")), "lm-words")
    bags = parts.where("word is null")
    ends = bags.where("train").count()
    tokens, distinct = counted.where("times > 0").agg(F.coalesce(F.sum("times"), F.lit(0)), F.count(F.lit(1))).first()
    pieces = counted.where("times > 0").mapInArrow(_piece_counts(model_path), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = {r["piece"]: r["n"] for r in pieces.collect()}  # at most the vocabulary
    scored = counted.mapInArrow(_word_scores(model_path, counts, ends), "word string, times long, log_p double")
    values = words.select("block", "place", "word").join(scored, "word").select("block", "place", "times", "log_p")
    end_score = Lattice(PieceModel(model_path), counts, ends).end / math.log(10)
    return with_values(bags.select("block", "doc_id", "held_out", "n_words", "bag"), values, _scored(tokens + ends, distinct + (ends > 0), ends, end_score), _SCORES)
