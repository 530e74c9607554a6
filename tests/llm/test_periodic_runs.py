"""Periodic runs against a brute-force search over all periods."""
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from facetwise.llm import periodic_runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e + q - i >= max(6, 4 * q):
                out.setdefault((i, e + q - i), q)  # the smallest period of a stretch comes first
            i = e
    return sorted((s, n, q) for (s, n), q in out.items())


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_runs_of_random_words(letters):
    rnd = random.Random(len(letters))
    texts = [[rnd.choice(letters) for _ in range(rnd.randint(0, 60))] for _ in range(150)]
    texts += [list((("".join(rnd.choice("abcdxyz") for _ in range(q)) * 9)[:rnd.randint(3 * q, 8 * q)]) + "qab") for q in range(1, 40)]
    texts += [list("aab" * 7 + "c" * 6 + "aab" * 5), list("abcabcabd" * 6), list("xy" * 3 + "xy" * 3 + "x"), ["a"] * 5, ["a"] * 6]
    first = np.append(0, np.cumsum([len(t) for t in texts]))
    ids = np.array([ord(x) for t in texts for x in t], np.int64)
    found = R.find_runs(ids, first)
    got = [[(int(s - first[i]), int(n), int(q)) for t, s, n, q in found if t == i] for i in range(len(texts))]
    assert got == [brute(t) for t in texts]


def test_runs_of_a_long_text_are_linear():
    block = np.arange(50_000) * 7919 % 50_000
    ids = np.concatenate([np.tile(block, 4), np.full(300_000, 60_000), np.tile(np.array([60_001, 60_002]), 100_000)])
    assert R.find_runs(ids, np.array([0, len(ids)])).tolist() == [[0, 0, 200_000, 50_000], [0, 200_000, 300_000, 1], [0, 500_000, 200_000, 2]]


def test_split_words_equals_the_pattern():
    texts = ["a  b\t\n\x0b\x0c\rc", "", " x ", "\x1c y z", "\x85"]
    words, first = R.split_words(pa.array(texts, pa.large_string()))
    assert [words.to_pylist()[a:b] for a, b in zip(first[:-1], first[1:])] == [WORD.findall(t) for t in texts]


def test_query_equals_brute_force(spark, docs, odd_docs):
    extra = spark.createDataFrame([(200000 + i, t) for i, t in enumerate(["go " * 9, "a b " * 40 + "c", "one two three " * 5 + "one", "x " * 5])], "doc_id bigint, text string")
    frame = docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(extra)
    rows = R.digest(R.periodic_runs(frame, R.tenth_repeats)).collect()
    want = sorted(((r["doc_id"], *expected(r["doc_id"], r["text"])) for r in frame.collect()), key=str)
    assert sorted(((r["doc_id"], *[r[c] for c in COLUMNS]) for r in rows), key=str) == want
    assert sum(r["n_runs"] > 0 for r in rows) > 20
    assert R.digest(R.periodic_runs(docs.where("false"))).count() == 0


def test_operator_gives_runs_and_texts(spark):
    frame = spark.createDataFrame([(1, "b a a a a a a c", "clash", 3)], "doc_id int, text string, runs string, n_words int")
    row = R.periodic_runs(frame).collect()[0]
    assert row.asDict(True) == {"doc_id": 1, "n_words": 8, "runs": [{"start": 1, "length": 6, "period": 1}], "collapsed": "b a c"}
