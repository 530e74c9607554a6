"""Lattice scores against sums over all listed segmentations, base scores against plain counting."""
import math
import re
import zlib
from collections import Counter

import pytest

from facetwise.llm import lm_scoring as L
from facetwise.llm.piece_codec import PieceModel
from facetwise.llm.queries import TOKENIZERS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def tokens(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def segmentations(word, pieces):
    """All ways to cut a word into pieces, or single characters that are none."""
    if not word:
        yield []
    for end in range(1, len(word) + 1):
        if word[:end] in pieces or (end == 1 and word[0] not in pieces):
            for rest in segmentations(word[end:], pieces):
                yield [word[:end], *rest]


def by_listing(lattice, word):
    def log_p(p):
        return lattice.piece[p] if p in lattice.piece else sum(lattice.byte[b] for b in p.encode())
    return math.log(math.fsum(math.exp(sum(map(log_p, s))) for s in segmentations(word, lattice.piece)))


def test_lattice_sums_all_segmentations():
    lattice = L.Lattice(PieceModel(PIECES), {i: i % 97 for i in range(3, 32000)}, 10)
    words = ["▁the", "▁there", "▁therefore", "▁", "▁x", "▁日本", "▁zq😀x", "▁a▁the", "▁12345", "▁international"]
    got = lattice.words(words)
    assert all(got[w] == pytest.approx(by_listing(lattice, w), rel=1e-12) for w in words)
    everything = math.fsum(map(math.exp, [*lattice.piece.values(), *lattice.byte.values(), lattice.end]))
    assert everything == pytest.approx(1, rel=1e-9)


def test_long_words_do_not_underflow():
    lattice = L.Lattice(PieceModel(PIECES), {}, 0)
    score = lattice.words(["▁" + "ab" * 50_000, "▁" + "ab" * 50_001])
    a, b = sorted(score.values())
    assert -math.inf < a < b < -10_000


def expected(rows):
    train = Counter()
    for doc_id, text in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10:
            train.update([*tokens(text), None])  # None is the end
    n, v = sum(train.values()), len(train)
    for doc_id, text in rows:
        t = [*tokens(text), None]
        yield (doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0, len(t), sum(train[x] > 0 for x in t), n,
               math.fsum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))


def test_scores_of_all_documents(spark, docs, odd_docs):
    frame = docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    found = L.lm_scoring(spark, frame, PIECES).collect()
    key = lambda r: tuple((x is None, x) if not isinstance(x, float) else round(x, 6) for x in r)
    got = sorted((key(tuple(r)[:6]) for r in found), key=str)
    assert got == sorted(map(key, expected(rows)), key=str)
    # the model's counts, from the library's pieces of the training words
    library = L._library(PIECES)
    counts, ends = Counter(), 0
    for doc_id, text in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10:
            ends += 1
            for w in tokens(text):
                counts.update(library.encode(w))
    lattice = L.Lattice(PieceModel(PIECES), counts, ends)
    words = lattice.words(list({"▁" + w for _, t in rows for w in tokens(t)}))
    want = sorted((str(i), (sum(words["▁" + w] for w in tokens(t)) + lattice.end) / math.log(10)) for i, t in rows)
    assert [s for _, s in sorted((str(r["doc_id"]), r["score"]) for r in found)] == pytest.approx([s for _, s in want], rel=1e-9)
    # held-out text is likelier than the same words with their letters turned round
    held = [(t, r["score"]) for r, (i, t) in zip(sorted(found, key=lambda r: str(r["doc_id"])), sorted(rows, key=lambda x: str(x[0]))) if r["held_out"] and t and len(t) > 200]
    back = [(sum(lattice.words(["▁" + w[::-1]])["▁" + w[::-1]] for w in tokens(t)) + lattice.end) / math.log(10) for t, _ in held]
    assert len(held) > 5 and sum(s > b for (_, s), b in zip(held, back)) > 0.9 * len(held)


def test_nothing_to_learn_from(spark, docs):
    assert L.lm_scoring(spark, docs.where("false"), PIECES).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = L.lm_scoring(spark, spark.createDataFrame([(held, "Some words", 1.5)], "doc_id int, text string, score double"), PIECES).collect()[0]
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0) and row["score"] < 0
