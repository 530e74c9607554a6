"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a word's bytes forwards and backwards with one gated recurrent layer
each; a softmax over both states labels every byte position. A document's language is the
one with the largest sum of log-probabilities over all positions of all its words, its
score that language's mean probability. A word longer than ``PIECE`` bytes is read in
pieces, so every byte is labelled and pooled, also in languages that write no blanks. Only
a word that mixes in digits or symbols, as keys and addresses do, weighs as ``LONGEST``
positions at most, so one long key does not outvote the prose; words without letters do
not vote. Words of a document are read with a blank before and
after; each distinct word is labelled once per worker (a bounded table) and counted with
its frequency, as the network starts afresh at every word.

The network is trained in numpy by backpropagation through time (Adam) on the words of at
most ``TRAIN_DOCS`` documents of each language, at most ``TRAIN_WORDS`` distinct words a
language, chosen by hash among rows with a language for which crc32(doc_id) mod 4 is not
2. Only these words reach the driver. Nothing but text enters a prediction.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if no row
can be learnt from; a null doc_id is not held out and is not learnt from. Ties go to the
language that sorts first. Extra columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetwise.llm import textkit as K
from facetwise.llm.word_cache import worker_cache

TRAIN_DOCS = 200
TRAIN_WORDS = 3000
PIECE = 48
LONGEST = 16
#: Digits and symbols that keys, addresses and markup have, prose between blanks has not.
KEY_BYTES = frozenset(b"0123456789#$%&*+/<=>@[\\]^_`{|}~")
EMBED, HIDDEN = 12, 12
EPOCHS, BATCH, RATE = 6, 256, 0.01
CACHE_WORDS = 250_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteNetwork:
    """Bidirectional GRU with a softmax at every position. ``w`` maps names to arrays; the
    gates are in the order update, reset, candidate."""

    def __init__(self, n_classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.w = {"e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "o": draw(2 * HIDDEN, n_classes), "c": np.zeros(n_classes, np.float32)}
        for side in "fb":
            self.w |= {f"x{side}": draw(EMBED, 3 * HIDDEN), f"h{side}": draw(HIDDEN, 3 * HIDDEN), f"g{side}": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) over byte columns x (T, B), in reading order of the side."""
        w, h = self.w, HIDDEN
        table = w["e"] @ w[f"x{side}"] + w[f"g{side}"]
        u_gate, u_new = np.ascontiguousarray(w[f"h{side}"][:, :2 * h]), np.ascontiguousarray(w[f"h{side}"][:, 2 * h:])
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((len(x), x.shape[1], h), np.float32)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            a = table[x[t]]
            gates = _sigmoid(a[:, :2 * h] + state @ u_gate)
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h:] + (r * state) @ u_new)
            if keep is not None:
                keep.append((t, state, z, r, new))
            state = state + z * (new - state)
            out[t] = state
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, B, classes) of equally long byte strings x (B, T)."""
        x = np.ascontiguousarray(x.T)
        both = np.concatenate([self._run(x, "f"), self._run(x, "b")], 2)
        logits = both @ self.w["o"] + self.w["c"]
        logits -= logits.max(2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(2, keepdims=True))

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean loss over all positions, by backpropagation through time."""
        w, h, x = self.w, HIDDEN, np.ascontiguousarray(x.T)
        tapes = {"f": [], "b": []}
        states = {s: self._run(x, s, tapes[s]) for s in "fb"}
        both = np.concatenate([states["f"], states["b"]], 2)
        logits = both @ w["o"] + w["c"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p *= (weight / len(x))[None, :, None]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["o"] = np.einsum("tbh,tbc->hc", both, p)
        g["c"] = p.sum((0, 1))
        d_both = p @ w["o"].T
        for s in "fb":
            d_out = d_both[:, :, :h] if s == "f" else d_both[:, :, h:]
            d_state = np.zeros((x.shape[1], h), np.float32)
            by_byte = np.zeros((256, 3 * h), np.float32)
            u_gate, u_new = w[f"h{s}"][:, :2 * h], w[f"h{s}"][:, 2 * h:]
            for t, before, z, r, new in reversed(tapes[s]):
                d = d_state + d_out[t]
                d_new = d * z * (1 - new * new)
                d_reset = d_new @ u_new.T
                d_gates = np.concatenate([d * (new - before) * z * (1 - z), d_reset * before * r * (1 - r)], 1)
                g[f"h{s}"][:, 2 * h:] += (r * before).T @ d_new
                g[f"h{s}"][:, :2 * h] += before.T @ d_gates
                np.add.at(by_byte, x[t], np.concatenate([d_gates, d_new], 1))
                d_state = d * (1 - z) + d_reset * r + d_gates @ u_gate.T
            g[f"x{s}"] = w["e"].T @ by_byte
            g[f"g{s}"] = by_byte.sum(0)
            g["e"] += by_byte @ w[f"x{s}"].T
        return g

    def fit(self, words: list[tuple[bytes, int, float]], seed: int = 11) -> ByteNetwork:
        """Words with their class and weight; batches hold words of one length."""
        rng = np.random.default_rng(seed)
        by_length: dict[int, list[int]] = {}
        for i, (piece, _, _) in enumerate(words):
            by_length.setdefault(len(piece), []).append(i)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(EPOCHS):
            batches = []
            for _, own in sorted(by_length.items()):
                own = rng.permutation(own)
                batches += [own[a:a + BATCH] for a in range(0, len(own), BATCH)]
            for k in rng.permutation(len(batches)):
                part = [words[i] for i in batches[k]]
                x = np.frombuffer(b"".join(p for p, _, _ in part), np.uint8).reshape(len(part), -1)
                weight = np.array([v for _, _, v in part], np.float32)
                g = self.gradient(x, np.array([c for _, c, _ in part]), weight / BATCH)
                step += 1
                for name in self.w:
                    mean[name] = 0.9 * mean[name] + 0.1 * g[name]
                    square[name] = 0.999 * square[name] + 0.001 * g[name] ** 2
                    rate = RATE * (1 - epoch / EPOCHS) ** 0.5
                    self.w[name] = (self.w[name] - rate * (mean[name] / (1 - 0.9 ** step)) / (np.sqrt(square[name] / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32)
        return self


def pieces_of(word: bytes) -> list[bytes]:
    read = b" " + word + b" "
    return [read[a:a + PIECE] for a in range(0, len(read), PIECE)]


def _sample_words(batches):
    for rows, texts in K.slices(batches):
        words = K.Words(texts)
        raw = words.raw.tobytes()
        lang = rows.column(0).to_pylist()
        names = [lang[d] for d in words.text_of]
        yield pa.RecordBatch.from_pydict({"lang": pa.array(names, pa.string()), "word": pa.array([raw[a:b] for a, b in zip(words.starts, words.ends)], pa.binary())})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, n_docs: int = TRAIN_DOCS, n_words: int = TRAIN_WORDS) -> tuple[list[str], ByteNetwork] | None:
    """(languages, network), or None if there is nothing to learn from."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    known = plain.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= n_docs).select("doc_id", "lang").distinct()
    words = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").mapInArrow(_sample_words, "lang string, word binary")
    counted = words.groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("word"), "word"))
    found = sorted((r["lang"], bytes(r["word"]), r["count"]) for r in counted.withColumn("rank", rank).where(F.col("rank") <= n_words).collect())
    languages = sorted({lang for lang, _, _ in found})
    if not languages:
        return None
    # a word's weight grows with its frequency; languages weigh the same
    data = [(piece, languages.index(lang), float(np.sqrt(n))) for lang, word, n in found for piece in pieces_of(word)]
    total = np.zeros(len(languages))
    for _, c, v in data:
        total[c] += v
    data = [(p, c, v * len(data) / len(languages) / total[c]) for p, c, v in data]
    return languages, ByteNetwork(len(languages)).fit(data)


def _label(network: ByteNetwork, words: list[bytes]) -> np.ndarray:
    """(words, 2 * classes + 1): summed log-probabilities, summed probabilities, positions.
    A word that mixes in digits or symbols counts as ``LONGEST`` positions at most, one
    without a letter not at all."""
    n_classes = network.w["c"].shape[0]
    out = np.zeros((len(words), 2 * n_classes + 1))
    pieces = [(len(p), i, p) for i, w in enumerate(words) for p in pieces_of(w)]
    pieces.sort(key=lambda x: x[0])
    sizes = np.array([n for n, _, _ in pieces])
    for size in np.unique(sizes).tolist():
        own = pieces[np.searchsorted(sizes, size):np.searchsorted(sizes, size, "right")]
        for at in range(0, len(own), 4096):
            part = own[at:at + 4096]
            logs = network.log_probabilities(np.frombuffer(b"".join(p for _, _, p in part), np.uint8).reshape(len(part), size))
            np.add.at(out, [i for _, i, _ in part], np.concatenate([logs.sum(0), np.exp(logs).sum(0), np.full((len(part), 1), size)], 1))
    weight = np.ones(len(words))
    keys = np.array([bool(KEY_BYTES.intersection(w)) for w in words], bool)
    weight[keys] = np.minimum(out[keys, -1], LONGEST) / out[keys, -1]
    return out * (weight * [any(b >= 0x80 or 0x61 <= b | 0x20 <= 0x7A for b in w) for w in words])[:, None]


def _predict(model):
    def run(batches):
        languages, weights, digest = model.value
        network = ByteNetwork(len(languages)) if languages else None
        if network:
            network.w = weights
        cache = worker_cache(("language", digest), CACHE_WORDS)
        n = len(languages)
        for rows, texts in K.slices(batches, limit=8 << 20):
            words = K.Words(texts)
            lettered = _has_letter(texts, words)
            pooled = np.zeros((words.n_texts, 2 * n + 1))
            if network and len(words):
                distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
                keys = distinct.tolist()
                new = set(cache.missing(keys))
                todo = [k for k, h in enumerate(keys) if h in new]
                raw = words.raw.tobytes()
                rows_new = _label(network, [raw[words.starts[i]:words.ends[i]] for i in first[todo].tolist()])
                for k, r in zip(todo, rows_new):
                    cache.young[keys[k]] = r.astype(np.float32).tobytes()
                table = np.frombuffer(b"".join(map(cache.young.__getitem__, keys)), np.float32).reshape(len(keys), -1)
                cache.settle()
                some = words.counts > 0
                pooled[some] = np.add.reduceat(table[which].astype(np.float64), words.first[:-1][some], axis=0)
            best = pooled[:, :n].argmax(1) if n else np.zeros(words.n_texts, np.int64)
            known = lettered & (pooled[:, 2 * n] > 0)
            score = np.where(known, pooled[np.arange(words.n_texts), n + best] / np.maximum(pooled[:, 2 * n], 1) if n else 0.0, 0.0)
            pred = [languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.clip(score, 0.0, 1.0))})
    return run


def _has_letter(texts: pa.Array, words: K.Words) -> np.ndarray:
    ascii_letter = np.append(0, np.cumsum(((words.raw | 0x20) >= 0x61) & ((words.raw | 0x20) <= 0x7A)))
    has = ascii_letter[words.offsets[1:]] > ascii_letter[words.offsets[:-1]]
    for i in np.flatnonzero(~has).tolist():
        has[i] = any(c.isalpha() for c in texts[i].as_py())
    return has


def language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score."""
    found = train(docs)
    languages, network = found if found else ([], None)
    digest = hashlib.sha256(b"".join(v.tobytes() for v in network.w.values())).hexdigest() if network else ""
    held = spark.sparkContext.broadcast((languages, network.w if network else {}, digest))
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = plain.mapInArrow(_predict(held), "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
