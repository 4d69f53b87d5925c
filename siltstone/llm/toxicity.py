"""Toxicity with subword-bag embeddings.

A word is the bag of its character n-grams (3 to 5, with word borders) and itself, hashed into a
table of embeddings; a word's embeddings are averaged, a text averages its words, and a linear softmax
gives the class. Both are trained together in numpy. A misspelling that training never
saw shares most of its n-grams with the word it comes from.

A word that occurs c times in a text weighs sqrt(c), so that repetition doesn't fill the bag; PRIOR further words of no
meaning are averaged in, so that a text of few words isn't judged by chance. The whole text counts, whatever its length.

Plain gradient descent would first learn frequent n-grams, which tell little, and steps of equal size for all n-grams
would learn rare ones, which know single documents by heart. So an n-gram's gradient is divided by the number of
documents that have it and a few more, which holds back those that only tell single documents apart: what moves first is what
goes with the class, and no n-gram is left out.

What is averaged and then mapped linearly can be mapped first, so scoring a word is a sum of one number
for each n-gram, done once for each distinct word of a batch.

Defined results: null and empty texts score 0 and aren't toxic; if the labels have no example of either class,
every score is 0; a document labelled both ways counts as toxic; labels of unknown documents are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import byte_buffer, coded_words, identified, offsets_of, slices

#: The fit's bounded sample: labelled documents of either class.
TOXIC_DOCS, OTHER_DOCS = 1000, 2000
#: Longer documents, in bytes, aren't used for the fit. All are scored, whole.
FIT_BYTES = 1 << 20
#: Documents, as a share of the fit's, that are added to the number of those that have an n-gram.
FEW = 0.007
#: What a share of clean documents above the threshold costs, against an equal share of toxic ones below it.
FALSE_COST = 3
BUCKETS, DIMS, PRIOR, GAIN = 1 << 17, 4, 60, 30.0
EPOCHS, RATE, HEAD_RATE, DECAY = 36, 1.0, 0.05, 1e-3
NGRAMS = (3, 4, 5)


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word and of the word itself, one word after the other, and how many each has."""
    data, offsets = byte_buffer(words)
    size = np.diff(offsets)
    n = len(size)
    wide = size + 2
    at = offsets_of(wide)
    flat = np.full(int(at[-1]), ord("<"), np.uint32)
    inside = np.repeat(at[:-1] + 1 - offsets_of(size)[:-1], size) + np.arange(int(size.sum()))
    flat[inside] = data[offsets[0] : offsets[-1]]
    flat[at[1:] - 1] = ord(">")
    end = np.repeat(at[1:], wide)
    owner = np.repeat(np.arange(n), wide)
    place = np.arange(len(flat))
    h, found, who = np.zeros(len(flat), np.uint32), [], []
    padded = np.concatenate((flat, np.zeros(max(NGRAMS), np.uint32)))
    for k in range(max(NGRAMS)):
        h = h * np.uint32(0x01000193) ^ padded[k : k + len(flat)]
        if k + 1 in NGRAMS:
            fits = place + k + 1 <= end
            x = h[fits]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(k)
            found.append((x ^ (x >> np.uint32(13))) % np.uint32(BUCKETS))
            who.append(owner[fits])
    powers = (np.uint64(0x100000001B3) ** (place - np.repeat(at[:-1], wide)).astype(np.uint64)) if n else np.zeros(0, np.uint64)
    whole = np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * powers, at[:-1]) if n else np.zeros(0, np.uint64)
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    found.append(((whole >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.uint32))
    who.append(np.arange(n))
    bucket, owner = np.concatenate(found), np.concatenate(who)
    order = np.argsort(owner, kind="stable")
    return bucket[order].astype(np.int64), np.bincount(owner, minlength=n)


def bags(codes: np.ndarray, counts: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, words, weights): each text's distinct words, text by text, and what part of the bag each is."""
    key, n = np.unique(np.repeat(np.arange(len(counts)), counts) * n_words + codes, return_counts=True)
    text, word, weight = key // max(n_words, 1), key % max(n_words, 1), np.sqrt(n)
    return text, word, weight / (np.bincount(text, weights=weight, minlength=len(counts)) + PRIOR)[text]


@dataclass
class Model:
    """weight[bucket]: how far an n-gram's embedding lies to the toxic side of the softmax; bias; the threshold on the score."""

    weight: np.ndarray
    bias: float
    threshold: float
    fitted: bool = True

    def score(self, texts: pa.Array) -> np.ndarray:
        codes, words, counts = coded_words(texts)
        if not self.fitted or not len(codes):
            return np.zeros(len(counts))
        bucket, each = features(words)
        value = np.add.reduceat(self.weight[bucket].astype(np.float64), offsets_of(each)[:-1]) / each
        text, word, weight = bags(codes, counts, len(words))
        logit = GAIN * np.bincount(text, weights=value[word] * weight, minlength=len(counts)) + self.bias
        return np.where(counts > 0, 1 / (1 + np.exp(-np.clip(logit, -50, 50))), 0.0)


def _sums(index: np.ndarray, rows: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weighted sums of the rows with each index."""
    return np.stack([np.bincount(index, weights=column * weight, minlength=n) for column in rows.T], axis=1)


def train(texts: list[str], toxic: list[int], seed: int = 5) -> Model:
    """Embeddings and softmax, jointly, by gradient descent with momentum over all documents at once; a fifth of them
    is held out and sets the threshold."""
    y = np.asarray(toxic, np.int64)
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, False)
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    held[np.flatnonzero(y == 1)[0]] = held[np.flatnonzero(y == 0)[0]] = False
    fit = np.flatnonzero(~held)
    codes, words, counts = coded_words(pa.array([texts[i] for i in fit], pa.string()))
    if not len(codes):
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, False)
    parts = [features(words.slice(at, 1 << 15)) for at in range(0, len(words), 1 << 15)]
    bucket, each = np.concatenate([x.astype(np.int32) for x, _ in parts]), np.concatenate([n for _, n in parts])
    del parts
    text, word, weight = bags(codes, counts, len(words))
    weight *= GAIN
    first, text_at, support = offsets_of(each)[:-1], np.searchsorted(text, np.arange(len(fit) + 1)), np.zeros(BUCKETS, np.int64)
    for i in range(len(fit)):
        own = word[text_at[i] : text_at[i + 1]]
        n = each[own]
        support[np.unique(bucket[np.repeat(first[own] - offsets_of(n)[:-1], n) + np.arange(int(n.sum()))])] += 1
    used = np.flatnonzero(support)
    dense = np.zeros(BUCKETS, np.int32)
    dense[used] = np.arange(len(used))
    word_of, bucket = np.repeat(np.arange(len(words), dtype=np.int32), each), dense[bucket]
    near = (support[used] + FEW * len(fit))[:, None]
    inv, n_words = (1 / each)[word_of], len(words)
    label = y[fit]
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    e, w, b = rng.normal(0, 0.01, (len(used), DIMS)), rng.normal(0, 0.5, (DIMS, 2)), np.zeros((1, 2))
    state = [[np.zeros_like(x), 0.0] for x in (e, w, b)]
    for step in range(1, EPOCHS + 1):
        mean = _sums(text, _sums(word_of, e[bucket], inv, n_words)[word], weight, len(fit))
        logit = mean @ w + b
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        d = p * share[:, None]
        d_e = _sums(bucket, _sums(word, (d @ w.T)[text], weight, n_words)[word_of], inv, len(used)) / near
        for x, g, rate, s, size in zip((e, w, b), (d_e, mean.T @ d + DECAY * w, d.sum(axis=0, keepdims=True)), (RATE, HEAD_RATE, HEAD_RATE), state, (np.max, np.mean, np.mean)):
            # one step length for a whole table, by its recent gradients
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.95 * s[1] + 0.05 * float(size(g * g))
            x -= rate * s[0] / (1 - 0.9**step) / np.sqrt(s[1] / (1 - 0.95**step) + 1e-20)
    table = np.zeros(BUCKETS, np.float32)
    table[used] = e @ (w[:, 1] - w[:, 0])
    model = Model(table, float(b[0, 1] - b[0, 0]), 0.5)
    if held.any():
        score, truth = model.score(pa.array([texts[i] for i in np.flatnonzero(held)], pa.string())), y[held]
        if 0 < truth.sum() < len(truth):
            # the middle of the range of thresholds that part the held-out documents best
            cuts = np.linspace(0.02, 0.98, 193)
            right = np.array([(score[truth == 1] >= c).mean() - FALSE_COST * (score[truth == 0] >= c).mean() for c in cuts])
            model.threshold = float(np.median(cuts[right >= right.max() - 1e-9]))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_docs: int = TOXIC_DOCS, other_docs: int = OTHER_DOCS) -> Model:
    """Trains on the driver, on the `toxic_docs` and `other_docs` labelled documents of the two classes with the lowest hash of the id, but for those beyond FIT_BYTES."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    # only what a class needs moves: each task's first ones
    sample = reduce(DataFrame.union, (known.where(F.col("y") == y).orderBy("h", "doc_id").limit(n).select("doc_id", "y") for y, n in ((1, toxic_docs), (0, other_docs))))
    texts = identified(docs, id_col, text_col).where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(sample), "doc_id")
    rows = sorted((r["doc_id"], r["text"], r["y"]) for r in texts.toLocalIterator())
    return train([t for _, t, _ in rows], [y for *_, y in rows])


def scored(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, toxicity (0 to 1), toxic. One scan, no shuffle; the model has a fixed size."""
    model = fit(docs, labels, id_col, text_col, label_col) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text"):
            score = m.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(score >= m.threshold)], ["doc_id", "toxicity", "toxic"])

    return identified(docs, id_col, text_col).mapInArrow(run, "doc_id long, toxicity double, toxic boolean")
