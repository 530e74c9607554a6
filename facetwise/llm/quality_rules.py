"""Quality rules: counted base rules, then a linear-chain CRF over a document's lines.

Every line gets bucketed features (symbols, capitals, digits, words, neighbouring repeats,
list marks, word length, whether it repeats an earlier line). A
conditional random field with the states boilerplate and content is decoded by Viterbi; a
document stays if it passes the base rules and at least ``CONTENT_SHARE`` of its words lie
in content lines.

The field is trained on the lines of at most ``TRAIN_DOCS`` labelled documents of each
quality (those of smallest id hash), each line under its document's label, by gradient
ascent on the conditional likelihood with forward-backward and an L2 penalty. Only line
features of these documents reach the driver. Everything else covers all rows.

Defined results: null text has no words and counts 0; a document with fewer than
``MIN_WORDS`` words fails. Without labels of both kinds all lines are content. Rows are
independent; extra columns are carried in ``row``.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetwise.llm import textkit as K
from facetwise.llm.word_cache import release

TRAIN_DOCS = 600
CONTENT_SHARE = 0.5
MIN_WORDS = 50
L2 = 0.02
STEPS = 200

#: Bucket bounds of each feature of a line; a feature has one bucket more than bounds.
BOUNDS = {
    "symbols per word": [1e-9, 0.05, 0.2, 0.5, 1.5],
    "capitals per letter": [0.02, 0.1, 0.3, 0.6],
    "digits per byte": [0.01, 0.1, 0.3],
    "words": [1, 3, 6, 12, 30],
    "neighbouring repeats per word": [1e-9, 0.1, 0.3, 0.6],
    "exclamation and list marks per word": [1e-9, 0.1, 0.4, 0.8],
    "bytes per word": [2, 4, 6, 9, 15],
    "repeats an earlier line": [1],
}
WIDTH = max(len(b) for b in BOUNDS.values()) + 1

_FLAGS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {
    "symbol": b"#*$%&|<>", "capital": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "small": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "mark": b"!|"}.items()}


class Lines:
    """Counts of a slice of texts, by text and by line."""

    def __init__(self, texts: pa.Array):
        w = self.words = K.Words(texts)
        raw, off, n = w.raw, w.offsets, w.n_texts
        breaks = np.flatnonzero(raw == 10)
        owner = np.concatenate([np.arange(n), np.searchsorted(off, breaks, "right") - 1])
        begin = np.concatenate([off[:-1], breaks + 1])
        order = np.lexsort([begin, owner])
        self.owner, self.begin = owner[order], begin[order]
        last = np.append(self.owner[1:] != self.owner[:-1], True) if len(owner) else np.zeros(0, bool)
        self.end = np.where(last, off[self.owner + 1], np.append(self.begin[1:], 0) - 1)
        self.first_line = np.searchsorted(self.owner, np.arange(n + 1))
        self.word0, self.word1 = np.searchsorted(w.starts, self.begin), np.searchsorted(w.starts, self.end)
        self.n_words = self.word1 - self.word0
        key = K.mix(K.hash_spans(raw, self.begin, self.end), self.owner.astype(np.uint64))
        by = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[by[1:]] = key[by[1:]] == key[by[:-1]]
        self.again = again & (self.n_words > 0)
        self._sums = {}

    def count(self, flag: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if flag not in self._sums:
            self._sums[flag] = np.append(0, np.cumsum(_FLAGS[flag][self.words.raw], dtype=np.int32))
        return (self._sums[flag][end] - self._sums[flag][begin]).astype(np.int64)

    def base(self) -> dict[str, np.ndarray]:
        w = self.words
        doc, f = w.text_of, w.first
        per_doc = lambda x: np.append(0, np.cumsum(x, dtype=np.int64))
        points = np.append(0, np.cumsum((w.raw & 0xC0) != 0x80, dtype=np.int64))
        chars = per_doc(points[w.ends] - points[w.starts])
        grams, ok = w.grams(3)
        at = np.flatnonzero(ok)
        repeated = np.zeros(len(w), bool)
        if len(at):
            key = K.mix(grams[at], doc[at].astype(np.uint64))
            by = np.argsort(key, kind="stable")
            same = key[by[1:]] == key[by[:-1]]
            twice = np.zeros(len(at), bool)
            twice[by[1:]] |= same
            twice[by[:-1]] |= same
            for k in range(3):
                repeated[at[twice] + k] = True
        total = per_doc(repeated)
        dup = per_doc(self.again)
        n, rep = w.counts, total[f[1:]] - total[f[:-1]]
        return {"n_words": n, "word_chars": chars[f[1:]] - chars[f[:-1]], "n_symbols": self.count("symbol", w.offsets[:-1], w.offsets[1:]),
                "n_dup_lines": dup[self.first_line[1:]] - dup[self.first_line[:-1]], "n_repeat_words": rep, "base_failed": (n < MIN_WORDS) | (100 * rep > 50 * n)}

    def features(self) -> np.ndarray:
        """(lines, features) bucket numbers."""
        w, b, e = self.words, self.begin, self.end
        n = np.maximum(self.n_words, 1)
        letters = np.maximum(self.count("capital", b, e) + self.count("small", b, e), 1)
        near = np.append(0, np.cumsum(np.append(False, w.hashes[1:] == w.hashes[:-1]), dtype=np.int64))
        inner = np.minimum(self.word0 + 1, self.word1)
        size = np.append(0, np.cumsum(w.ends - w.starts))
        values = [self.count("symbol", b, e) / n, self.count("capital", b, e) / letters, self.count("digit", b, e) / np.maximum(e - b, 1), self.n_words, (near[self.word1] - near[inner]) / n,
                  self.count("mark", b, e) / n, (size[self.word1] - size[self.word0]) / n, self.again.astype(np.int64)]
        return np.stack([np.digitize(v, edges) for v, edges in zip(values, BOUNDS.values())], 1).astype(np.uint8)


class LineField:
    """Linear-chain CRF with two states: 0 boilerplate, 1 content."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((len(BOUNDS), WIDTH, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum(self.emit[k][features[:, k]] for k in range(len(BOUNDS))) if len(features) else np.zeros((0, 2))

    def viterbi(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best states of all lines; sequence i holds lines first[i] to first[i + 1]. Ties: content."""
        state = np.ones(len(scores), np.int64)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        start, size = first[:-1][order], size[order]
        back = np.zeros((len(scores), 2), np.int8)
        longest = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
        best = np.zeros((len(size), 2))
        for t in range(longest):
            n = alive[t]
            here = scores[start[:n] + t]
            if t:
                way = best[:n, :, None] + self.move[None]
                up = way[:, 1] >= way[:, 0]
                back[start[:n] + t] = up
                here = here + np.where(up, way[:, 1], way[:, 0])
            best[:n] = here
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            at = start[:n] + t
            final = size[:n] == t + 1
            after = np.where(final, 0, np.minimum(at + 1, len(scores) - 1))
            state[at] = np.where(final, best[:n, 1] >= best[:n, 0], back[after, state[after]])
        return state

    def train(self, documents: list[tuple[int, np.ndarray]], steps: int = STEPS, rate: float = 0.5) -> LineField:
        """Documents: (label, features of the lines); equal weight for both labels."""
        labels = np.array([y for y, x in documents if len(x)])
        if len(set(labels.tolist())) < 2:
            return self
        feats = [x for _, x in documents if len(x)]
        longest = max(map(len, feats))
        order = sorted(range(len(feats)), key=lambda i: -len(feats[i]))
        feats, labels = [feats[i] for i in order], labels[order]
        size = np.array([len(x) for x in feats])
        flat = np.concatenate(feats)
        first = np.cumsum(size) - size
        weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) / size
        alive = [int((size > t).sum()) for t in range(longest)]
        target = np.repeat(labels, size)
        per_line = np.repeat(weight, size)
        seen_move = np.zeros((2, 2))
        for y in (0, 1):
            seen_move[y, y] = (weight * (size - 1))[labels == y].sum()
        m_emit, m_move = np.zeros_like(self.emit), np.zeros_like(self.move)
        for _ in range(steps):
            s = self.scores(flat)
            ahead, behind = np.zeros((len(flat), 2)), np.zeros((len(flat), 2))
            for t in range(longest):
                at = first[:alive[t]] + t
                ahead[at] = s[at] if not t else s[at] + np.logaddexp.reduce(ahead[at - 1][:, :, None] + self.move[None], axis=1)
            for t in range(longest - 2, -1, -1):
                at = first[:alive[t + 1]] + t
                behind[at] = np.logaddexp.reduce(self.move[None] + (s[at + 1] + behind[at + 1])[:, None, :], axis=2)
            total = np.repeat(np.logaddexp.reduce(ahead[first + size - 1], axis=1), size)
            p = np.exp(ahead + behind - total[:, None])
            slope = (np.eye(2)[target] - p) * per_line[:, None]
            g_emit = np.zeros_like(self.emit)
            for k in range(len(BOUNDS)):
                np.add.at(g_emit[k], flat[:, k], slope)
            inner = np.ones(len(flat), bool)
            inner[first] = False
            at = np.flatnonzero(inner)
            pair = np.exp(ahead[at - 1][:, :, None] + self.move[None] + (s[at] + behind[at])[:, None, :] - total[at][:, None, None])
            g_move = seen_move - (pair * per_line[at][:, None, None]).sum(0)
            m_emit = 0.9 * m_emit + g_emit - L2 * 0.05 * self.emit
            m_move = 0.9 * m_move + g_move - L2 * self.move
            self.emit, self.move = self.emit + rate * m_emit, self.move + rate * m_move
        return self


def _line_features(batches):
    release()
    for rows, texts in K.slices(batches):
        lines = Lines(texts)
        x, f = lines.features(), lines.first_line
        yield pa.RecordBatch.from_pydict({"quality": rows.column(0), "x": pa.array([x[a:b][lines.n_words[a:b] > 0].tobytes() for a, b in zip(f[:-1], f[1:])], pa.binary())})


def train_field(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS) -> LineField:
    """A field fitted on at most ``n_docs`` labelled documents of each quality."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").distinct()
    rank = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.withColumn("rank", rank).where(F.col("rank") <= n_docs).select("doc_id", "quality")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = text.join(F.broadcast(chosen), "doc_id").select("quality", "text").mapInArrow(_line_features, "quality int, x binary").collect()
    found = sorted((r["quality"], bytes(r["x"])) for r in sample)
    return LineField().train([(y, np.frombuffer(x, np.uint8).reshape(-1, len(BOUNDS))) for y, x in found])


def _judge(field, share: float):
    def run(batches):
        release()
        emit, move = field.value
        crf = LineField(emit, move)
        for rows, texts in K.slices(batches):
            lines = Lines(texts)
            base = lines.base()
            worded = lines.n_words > 0
            at = np.flatnonzero(worded)
            first = np.searchsorted(lines.owner[at], np.arange(lines.words.n_texts + 1))
            state = crf.viterbi(crf.scores(lines.features()[at]), first)
            total = np.append(0, np.cumsum(lines.n_words[at] * state))
            content = total[first[1:]] - total[first[:-1]]
            kept = ~base["base_failed"] & (content >= share * base["n_words"])
            out = rows.select([n for n in rows.schema.names if n != "text"])
            more = {**base, "n_content_words": content, "kept": kept}
            yield pa.RecordBatch.from_arrays([*out.columns, *[pa.array(v, pa.bool_() if v.dtype == bool else pa.int64()) for v in more.values()]], [*out.schema.names, *more])
    return run


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE, keep_rows: bool = False) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, n_content_words, kept,
    and the input row as a struct ``row`` if wanted."""
    crf = train_field(docs, labels)
    held = spark.sparkContext.broadcast((crf.emit, crf.move))
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep_rows else []
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *row)
    schema = base.drop("text").schema
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("n_content_words", "long").add("kept", "boolean")
    return base.mapInArrow(_judge(held, share), schema)
