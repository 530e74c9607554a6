"""Token alignment against plain Python over whole-text encodings by the libraries."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from facetwise.llm import cross_align as C
from facetwise.llm.queries import TOKENIZERS
from facetwise.llm.word_cache import WordCache

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
SIGNS = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "a", "The", "don't", "it's", "123", "?!", "é", "ß", "日本", "😀", " ", "　", " ", "\x85", "\x1c", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "\x00", "-", "_", "'", "ll", "▁", "word", "x" * 30]


@pytest.fixture(scope="module")
def sides():
    return C.Sides(A, B)


def whole(sides, text):
    """(A ids, B ids) of the whole text by the libraries; none if a side gives other bytes."""
    if not text:
        return [], []
    a = sides.a.encode(" " + text, add_special_tokens=False).ids
    b = sides.b.encode(text, num_threads=1)
    raw = (" " + text).encode()
    if not b"".join(sides.a_bytes[i] for i in a) == raw == b"".join(sides.b_bytes[i] for i in b):
        return [], []
    return a, b


def brute(sides, text):
    a, b = whole(sides, text)
    cut = lambda ids, raw: list(np.cumsum([len(raw[i]) for i in ids]))
    ends_a, ends_b = cut(a, sides.a_bytes), cut(b, sides.b_bytes)
    both, out, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for e in both:
        ni, nj = ends_a.index(e) + 1, ends_b.index(e) + 1
        out.append((a[i:ni], b[j:nj]))
        i, j = ni, nj
    return a, b, out


def hostile(n, seed, sides=SIGNS):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(sides) for _ in range(rnd.randint(1, 14))) for _ in range(n)]


def test_cuts_are_encoded_as_in_the_whole_text(sides):
    texts = hostile(6000, 1) + hostile(3000, 2, [s for s in SIGNS if s != "▁"]) + ["", " ", "  ", "\n ", " a", "a ", "a  b ", "a" * 3000, "x" * 70 + " y"]
    a, n_a, b, n_b = sides.encode(texts, WordCache(1000))
    at, bt = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    kept = 0
    for k, t in enumerate(texts):
        want = whole(sides, t)
        assert (a[at[k]:at[k + 1]].tolist(), b[bt[k]:bt[k + 1]].tolist()) == want, repr(t)
        kept += bool(want[0])
    assert kept > 6000


def test_cuts_are_encoded_together(sides, monkeypatch):
    """Many cuts a call, on the task's own core; cuts that no blank may join go one by one."""
    texts = [f"word{i} don't, naïve-{i} 日本{i}" for i in range(900)]
    calls, own = [], sides._ids
    monkeypatch.setattr(sides, "_ids", lambda some: calls.append(len(some)) or own(some))
    for some in (texts, [*texts, "", "\n x", "a ▁b", " y"]):
        calls.clear()
        a, n_a, b, n_b = sides.encode(some, WordCache(10))
        at, bt = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        for k, t in enumerate(some):
            assert (a[at[k]:at[k + 1]].tolist(), b[bt[k]:bt[k + 1]].tolist()) == whole(sides, t), repr(t)
        assert len(some) > len(texts) or sum(calls) < 100
    assert C.os.environ["TOKENIZERS_PARALLELISM"] == "false"


def expected(sides, rows):
    found = [(i, *brute(sides, t)) for i, t in rows]
    held = Counter(p for _, _, _, gs in found for p in {(x, y) for ga, gb in gs for x in ga for y in gb})
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    for i, a, b, gs in found:
        links = [(x, y) for ga, gb in gs for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in gs)
        yield (i, len(a), len(b), len(gs), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else "", text)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def test_alignment_equals_brute_force(spark, sides, docs, odd_docs, monkeypatch):
    extra = [(500000 + i, t) for i, t in enumerate(hostile(300, 3) + ["▁ b", "日本語" * 50, "ab" * 400, "x1y2z3" * 60])]
    frame = docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = C.cross_align(spark, frame, A, B, keep_groups=True).collect()
    assert sorted(([r[c] for c in COLUMNS] for r in got), key=str) == sorted((list(x) for x in expected(sides, rows)), key=str)
    plain = C.cross_align(spark, frame, A, B)
    assert "groups" not in plain.columns and plain.where("n_links > n_groups").count() > 20
    assert C.cross_align(spark, docs.where("false"), A, B).count() == 0


def test_pairs_of_large_groups_are_counted_in_pieces(monkeypatch):
    rnd = np.random.default_rng(5)
    ga, gb = np.sort(rnd.integers(0, 6, 200)), np.sort(rnd.integers(0, 6, 150))
    ia, ib = rnd.integers(0, 9, 200), rnd.integers(0, 7, 150)
    doc = np.array([0, 0, 1, 1, 1, 2])
    want = Counter((doc[g] * 63 + a * 7 + b) for g in range(6) for a in ia[ga == g] for b in ib[gb == g])
    for limit in (1, 10, 10**6):
        monkeypatch.setattr(C, "PAIRS_AT_ONCE", limit)
        key, n = C.linked_pairs(ga, ia, gb, ib, doc, (9, 7))
        assert dict(zip(key.tolist(), n.tolist())) == want
