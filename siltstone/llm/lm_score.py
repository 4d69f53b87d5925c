"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts a word's vector linearly from those of the CONTEXT words before it, and scores a word by
the product of the prediction with the word's own vector, plus a bias. The vocabulary follows the corpus: every word
that occurs LEAST times and makes up SHARE of all tokens has vectors of its own, which bounds it by 1 / SHARE. Any other word is the class 0 as a
context; as a target it has the class's probability times that of its spelling, by a model of bytes without the listed words' share.

Words beyond the HEAD most frequent are leaves of a tree of three levels: neighbours by frequency form groups, neighbouring groups form
sections, each with about the cube root of the number of such words. A word's probability is its section's among
head words and sections, times its group's in the section, times its own in the group, so a normaliser costs three cube roots.

The vocabulary comes from counts over all documents. Training goes over every token: each task makes its own
pass over its part of the corpus in numpy, from the same start, and what the parameters moved is averaged (parameter mixing), a word's
weighted by its tokens in each task. A task sends the vectors of the words it saw, so what is gathered grows with the corpus.

Noise-contrastive training needs no normaliser, scoring does: log-probabilities are normalised exactly, so exp(log_prob) adds up to
one over all texts of a length. Normalisers are batched matrix products: of all tokens with the top level, and of the tokens below each section and group with its children.

Defined results: null and empty texts have 0 tokens, log_prob 0 and a null mean; a text's first words are predicted
from a start mark; repeated rows score alike; an empty corpus gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import binary_array, byte_buffer, coded_words, identified, offsets_of, slices, split_words, written
from siltstone.llm.token_ids import token_counts

#: A word with vectors of its own occurs so often, and is that part of all tokens. Two more ids are the other words (0) and the start mark (1), which never follows anything.
LEAST, SHARE = 5, 1e-7
#: So many words are in no group.
HEAD = 62
DIMS, CONTEXT, NOISE, BATCH, RATE, SEED = 16, 3, 20, 8192, 0.15, 11
#: Rows of a parameter that travel together. Tokens scored at once, and rows of a matrix product.
BLOCK, TOKENS, ROWS = 4096, 1 << 20, 512
#: Tasks whose parameters are mixed at once.
FAN = 64
#: The symbol before and after a word's bytes; weight of the shorter context in a spelling.
EDGE, PRIOR = 256, 20.0


def _trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word, and its end: two symbols before it and itself as one number; how many each word has."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, offsets = byte_buffer(words)
    size = np.diff(offsets)
    at = offsets_of(size + 3)
    inner = np.arange(int(size.sum())) - np.repeat(offsets_of(size)[:-1], size)
    symbols = np.full(int(at[-1]), EDGE, np.int64)
    symbols[np.repeat(at[:-1] + 2, size) + inner] = data[np.repeat(offsets[:-1], size) + inner]
    here = np.flatnonzero(np.arange(len(symbols)) - np.repeat(at[:-1], size + 3) >= 2)
    return (symbols[here - 2] * 257 + symbols[here - 1]) * 257 + symbols[here], size + 1


class Speller:
    """Probabilities of words that aren't listed: each byte from the two before it. keys, n: trigrams by number, and how often they occur."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, listed: pa.Array):
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order].astype(np.float64)
        self.pair = np.bincount(self.keys // 257, weights=self.n, minlength=257 * 257)
        two = np.bincount(self.keys % (257 * 257), weights=self.n, minlength=257 * 257).reshape(257, 257)
        even = np.full((257, 257), 1 / 257)
        even[EDGE], even[EDGE, EDGE] = 1 / 256, 0  # no word is empty
        self.one = (two + PRIOR * even) / (two.sum(axis=1, keepdims=True) + PRIOR)
        self.log_rest = 0.0
        self.log_rest = math.log1p(-float(np.exp(self.log_probs(listed)).sum()))

    def probs(self, key: np.ndarray) -> np.ndarray:
        """Of the last symbol of each trigram after the two before it."""
        seen = np.zeros(len(key))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            seen = np.where(self.keys[at] == key, self.n[at], 0.0)
        return (seen + PRIOR * self.one[key // 257 % 257, key % 257]) / (self.pair[key // 257] + PRIOR)

    def log_probs(self, words: pa.Array) -> np.ndarray:
        key, each = _trigrams(words)
        total = np.concatenate(([0.0], np.cumsum(np.log(self.probs(key)))))
        at = offsets_of(each)
        return total[at[1:]] - total[at[:-1]] - self.log_rest


@dataclass
class Model:
    """words: ids from 2 on; context vectors r, the maps c of the CONTEXT words before (the nearest first, one below the other), target vectors q,
    biases b, log frequencies. q, b and log_noise have a row for each id, then for each group, then for each section; those of words in groups are
    among all such words, those of groups among all groups."""

    words: pa.Array
    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray
    log_noise: np.ndarray
    speller: Speller | None = None

    @property
    def ids(self) -> int:
        return len(self.words) + 2

    @property
    def head(self) -> int:
        """The first id in a group."""
        return min(len(self.words), HEAD) + 2

    @property
    def width(self) -> int:
        """Words in a group, and groups in a section; the last has fewer."""
        return max(1, math.ceil((self.ids - self.head) ** (1 / 3) - 1e-9))

    @property
    def groups(self) -> int:
        return -(-(self.ids - self.head) // self.width)

    @property
    def sections(self) -> int:
        return -(-self.groups // self.width)

    def outcomes(self) -> np.ndarray:
        """Rows of q of head words and sections."""
        return np.concatenate((np.arange(self.head), np.arange(self.ids + self.groups, self.ids + self.groups + self.sections)))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where the words, or their sections, are among outcomes()."""
        return np.where(ids < self.head, ids, self.head + (ids - self.head) // self.width**2)


def start(words: pa.Array, counts: np.ndarray, seed: int = SEED) -> Model:
    """Small random vectors; the biases are log frequencies, so the start is the unigram model. counts: of other words, the start mark, words."""
    rng = np.random.default_rng(seed)
    p = counts.astype(np.float64)
    p = np.maximum(p, 0.5)
    p[1] = 1e-30
    near = np.concatenate([np.eye(DIMS, dtype=np.float32) / (k + 1) for k in range(CONTEXT)])
    model = Model(words, rng.normal(0, 0.1, (len(p), DIMS)).astype(np.float32), near, np.zeros(0), np.zeros(0), np.zeros(0))
    tail = p[model.head :]
    group = np.add.reduceat(tail, np.arange(model.groups) * model.width) if len(tail) else tail
    section = np.add.reduceat(group, np.arange(model.sections) * model.width) if len(tail) else tail
    rest = max(tail.sum(), 0.5)
    log_noise = np.log(np.concatenate((p[: model.head] / p.sum(), tail / rest, group / rest, section / p.sum()))).astype(np.float32)
    return replace(model, q=rng.normal(0, 0.1, (len(log_noise), DIMS)).astype(np.float32), b=log_noise.copy(), log_noise=log_noise)


def ids_of(texts: pa.Array, words: pa.Array, speller: Speller) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, how many each text has, and the log-probability of the spelling of each text's other words."""
    codes, distinct, counts = coded_words(texts)
    distinct = distinct.cast(pa.binary())
    known = pc.fill_null(pc.add(pc.index_in(distinct, value_set=words), 2), 0).to_numpy(zero_copy_only=False)
    spelled = np.zeros(len(distinct))
    other = np.flatnonzero(known == 0)
    if len(other):
        spelled[other] = speller.log_probs(distinct.take(pa.array(other)))
    doc = np.repeat(np.arange(len(counts)), counts)
    return known[codes].astype(np.uint32), counts, np.bincount(doc, weights=spelled[codes], minlength=len(counts))


def places_of(counts: np.ndarray) -> np.ndarray:
    """The place of each word in its text."""
    return np.arange(int(counts.sum())) - np.repeat(offsets_of(counts)[:-1], counts)


def contexts(r: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """[words, CONTEXT * DIMS]: the vectors of the word before each of the last `len(place)` of the ids (CONTEXT more come first), of the one before that,
    and so on, that of the start mark (1) where there is none; and for each of these where there is none."""
    n, vectors, missing = len(place), r.take(ids, axis=0), []
    out = np.empty((n, CONTEXT * DIMS), r.dtype)
    for k in range(1, CONTEXT + 1):
        own = out[:, (k - 1) * DIMS : k * DIMS]
        own[:] = vectors[CONTEXT - k : CONTEXT - k + n]
        none = np.flatnonzero(place < k)
        own[none] = r[1]
        missing.append(none)
    return out, missing


def led(ids: np.ndarray) -> np.ndarray:
    """With CONTEXT start marks before the first."""
    return np.concatenate((np.ones(CONTEXT, ids.dtype), ids))


def _summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices, and the sum of each one's rows."""
    key = index.astype(np.int64) << 20 | np.arange(len(index))  # sorting numbers is much faster than sorting their places
    key.sort()
    at = key >> 20
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[new], np.add.reduceat(rows.take(key & (1 << 20) - 1, axis=0), new, axis=0)


class Trainer:
    """One pass of noise-contrastive training with AdaGrad, whose steps are a row's. hits: how often each row was trained on, other than as noise."""

    def __init__(self, model: Model, seed: int):
        self.qb = np.column_stack((model.q, model.b))
        self.m = replace(model, r=model.r.copy(), c=model.c.copy(), q=self.qb[:, :-1], b=self.qb[:, -1])
        self.rng = np.random.default_rng(seed)
        self.seen = {"r": np.full(len(model.r), 1e-3, np.float32), "q": np.full(len(model.q), 1e-3, np.float32), "b": np.full(len(model.b), 1e-3, np.float32), "c": np.full(len(model.c), 1e-3, np.float32)}
        among = model.outcomes(), np.arange(model.ids, model.ids + model.groups), np.arange(model.head, model.ids)
        self.noise = [(rows, np.cumsum(np.exp(model.log_noise[rows].astype(np.float64)))) for rows in among]
        self.hits = {"r": np.zeros(model.ids, np.int64), "q": np.zeros(len(model.b), np.int64)}
        self.tokens = 0

    def levels(self, word: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
        """For each level of the tree: which of the words have an outcome there (None: all), and its row in q."""
        m = self.m
        rare = np.flatnonzero(word >= m.head)
        own = word[rare]
        return [(None, self.noise[0][0].take(m.places(word))), (rare, m.ids + (own - m.head) // m.width), (rare, own)]

    def contrast(self, h: np.ndarray, true: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of q in `noise` are noise for all. h: with a last column of ones, for the bias. The gradients of h, and of the rows of q and b: first the true ones, then the noise."""
        log_noise, log_k = self.m.log_noise, np.float32(np.log(len(noise)))
        q, qn = self.qb.take(true, axis=0), self.qb.take(noise, axis=0)
        right = np.einsum("ij,ij->i", h, q) - (log_noise.take(true) + log_k)
        dt = -1 / (1 + np.exp(right))
        qn_less = qn.copy()
        qn_less[:, -1] -= log_noise[noise] + log_k
        df = h @ -qn_less.T
        np.exp(df, out=df)  # of a score far below zero this is infinite, and the share below 0
        df += 1
        np.reciprocal(df, out=df)
        rows = np.empty((len(true) + len(noise), h.shape[1]), h.dtype)
        np.multiply(dt[:, None], h, out=rows[: len(true)])
        np.matmul(df.T, h, out=rows[len(true) :])
        q *= dt[:, None]
        q += df @ qn
        return q[:, :-1], rows

    def gradients(self, ids: np.ndarray, place: np.ndarray, noise: list[np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Of the loss over the last `len(place)` of the ids, by parameter (qb: q with b as its last column): which rows, and their gradients. noise: rows of q for each level."""
        m, n, word = self.m, len(place), ids[CONTEXT:]
        r, missing = contexts(m.r, ids, place)
        h = np.ones((n, DIMS + 1), r.dtype)
        np.matmul(r, m.c, out=h[:, :DIMS])
        dh, index, rows = np.zeros((n, DIMS), r.dtype), [], []
        for (which, true), among in zip(self.levels(word), noise):
            if len(true):
                d, g = self.contrast(h if which is None else h.take(which, axis=0), true, among)
                if which is None:
                    dh += d
                else:
                    dh[which] += d
                index += [true, among]
                rows.append(g)
        at, g = _summed(np.concatenate(index), np.concatenate(rows))
        # a word is in the context of several: what they say of it is added up first
        before, dr, of_start = dh @ m.c.T, np.zeros((len(ids) + 1, DIMS), h.dtype), np.zeros(DIMS, h.dtype)
        for k, none in enumerate(missing, 1):
            own = before[:, (k - 1) * DIMS : k * DIMS]
            of_start += own[none].sum(axis=0)
            own[none] = 0
            dr[CONTEXT - k : CONTEXT - k + n] += own
        dr[-1] = of_start
        return {"qb": (at, g), "c": (np.arange(len(m.c)), r.T @ dh), "r": _summed(np.append(ids, 1), dr)}

    def _rate(self, name: str, at: np.ndarray, square: np.ndarray) -> np.ndarray:
        seen = self.seen[name].take(at) + square
        self.seen[name][at] = seen
        return np.float32(RATE) / np.sqrt(seen)

    def step(self, ids: np.ndarray, place: np.ndarray) -> None:
        noise = [rows[np.minimum(np.searchsorted(shares, self.rng.random(NOISE) * shares[-1]), len(rows) - 1)] if len(rows) else rows for rows, shares in self.noise]
        with np.errstate(over="ignore"):
            found = self.gradients(ids, place, noise)
        for name, (at, g) in found.items():
            g = g if len(place) == BATCH else g * np.float32(BATCH / len(place))
            own = self.qb if name == "qb" else getattr(self.m, name)
            if name == "qb":
                step = np.empty_like(g)
                np.multiply(g[:, :-1], self._rate("q", at, np.einsum("ij,ij->i", g[:, :-1], g[:, :-1]) / DIMS)[:, None], out=step[:, :-1])
                np.multiply(g[:, -1], self._rate("b", at, g[:, -1] ** 2), out=step[:, -1])
            else:
                step = g * self._rate(name, at, np.einsum("ij,ij->i", g, g) / DIMS)[:, None]
            own[at] = own.take(at, axis=0) - step
        self.tokens += len(place)

    def run(self, ids: np.ndarray, counts: np.ndarray) -> None:
        place, all_ids = places_of(counts), led(ids)
        for at in range(0, len(ids), BATCH):
            self.step(all_ids[at : at + BATCH + CONTEXT], place[at : at + BATCH])
        self.hits["r"] += np.bincount(ids, minlength=self.m.ids)
        self.hits["r"][1] += (counts > 0).sum()
        for _, true in self.levels(ids):
            self.hits["q"] += np.bincount(true, minlength=len(self.m.b))


class Scorer:
    """Normalised log-probabilities."""

    def __init__(self, model: Model):
        self.m = model
        self.q = np.column_stack((model.q, model.b))
        self.top = self.q[model.outcomes()]
        self.top[1, -1] = -1e30

        self.ones = np.ones(max(len(self.top), model.width), np.float32)
        b, w = model.b, model.width
        highest = [np.delete(self.top[:, -1], 1).max(keepdims=True)]  # biases of each softmax
        highest += [np.maximum.reduceat(x, np.arange(0, len(x), w)) for x in (b[model.ids : model.ids + model.groups], b[model.head : model.ids]) if len(x)]
        self.longest, self.bias = float(np.sqrt(np.einsum("ij,ij->i", model.q, model.q).max())), float(np.abs(np.concatenate(highest)).max())

    def _log_z(self, h: np.ndarray, logit: np.ndarray) -> np.ndarray:
        """Of the logits of the vectors h, which it overwrites."""
        if math.sqrt(float(np.einsum("ij,ij->i", h, h).max())) * self.longest + self.bias < 80:  # the greatest logit is well within a float's range
            return np.log(np.exp(logit, out=logit) @ self.ones[: logit.shape[1]])
        top = logit.max(axis=1)
        logit -= top[:, None]
        return top + np.log(np.exp(logit, out=logit).sum(axis=1))

    def _under(self, h: np.ndarray, child: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Log-probabilities of the children, which come in order, among their parents' `width` children each; q: the level's rows."""
        w = self.m.width
        out, bounds = np.empty(len(child), np.float32), np.searchsorted(child, np.arange(0, len(q) + w, w))
        for p in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
            own = q[p * w : (p + 1) * w]
            for at in range(bounds[p], bounds[p + 1], ROWS):
                stop = min(at + ROWS, bounds[p + 1])
                logit = h[at:stop] @ own.T
                true = logit[np.arange(stop - at), child[at:stop] - p * w]
                out[at:stop] = true - self._log_z(h[at:stop], logit)
        return out

    def _some(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        m, word = self.m, ids[CONTEXT:]
        among, n = m.places(word), len(word)
        h, out = np.empty((n, DIMS + 1), np.float32), np.empty(n, np.float32)
        h[:, DIMS] = 1
        for at in range(0, n, BATCH):
            h[at : at + BATCH, :DIMS] = contexts(m.r, ids[at : at + BATCH + CONTEXT], place[at : at + BATCH])[0] @ m.c
        for at in range(0, n, ROWS):
            own = slice(at, at + ROWS)
            logit = h[own] @ self.top.T
            true = logit[np.arange(len(logit)), among[own]]
            out[own] = true - self._log_z(h[own], logit)
        rare = np.flatnonzero(word >= m.head)
        if len(rare):
            rare = rare[np.argsort(word[rare])]
            child, below = word[rare] - m.head, h.take(rare, axis=0)
            out[rare] += self._under(below, child // m.width, self.q[m.ids : m.ids + m.groups]) + self._under(below, child, self.q[m.head : m.ids])
        return out.astype(np.float64)

    def log_probs(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of head words and class 0, and of words in groups; an other word's spelling comes on top. ids: as of led(); place: of each but the first CONTEXT."""
        return np.concatenate([self._some(ids[at : at + TOKENS + CONTEXT], place[at : at + TOKENS]) for at in range(0, len(place), TOKENS)])


def coded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (four bytes a word), spelled (log-probability), as a scratch table, since training and scoring both read it."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.speller))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, speller = shared.value
        for batch in slices(batches, "text", 16 << 20):
            ids, counts, spelled = ids_of(batch.column("text"), known, speller)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), binary_array(ids.view(np.uint8), 4 * offsets_of(counts)), pa.array(spelled)], ["doc_id", "ids", "spelled"])

    out = written(identified(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, spelled double"), "word-ids")
    shared.destroy()
    return out


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("ids")
    counts = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).astype(np.int64), counts


_MIXED = "part string, block long, rows binary, weight binary, vectors binary"


def _packed(part: str, block: int, rows: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    data = [x.astype(kind).tobytes() for x, kind in ((rows, np.uint16), (weight, np.float32), (vectors, np.float16))]
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block]), *(pa.array([x], pa.binary()) for x in data)], ["part", "block", "rows", "weight", "vectors"])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows within the block, weights, vectors."""
    rows = np.frombuffer(row["rows"], np.uint16)
    return rows, np.frombuffer(row["weight"], np.float32), np.frombuffer(row["vectors"], np.float16).reshape(len(rows), -1)


def trained(ids: DataFrame, model: Model, counts: np.ndarray) -> Model:
    """One round of parameter mixing over all tokens. A row that no task trained stays as at the start, which each task makes by itself from the
    words' counts. What travels is how far each row moved."""
    shared = ids.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = old = None
        for batch in slices(batches, "ids", 8 << 20):
            words, sizes = _ids(batch)
            if trainer is None:
                old = start(pa.nulls(len(shared.value) - 2, pa.binary()), shared.value)
                trainer = Trainer(old, SEED)  # the same for a task that is run again
            trainer.run(words, sizes)
        if trainer is not None and trainer.tokens:
            m = trainer.m
            hits = trainer.hits | {"c": np.full(len(m.c), trainer.tokens)}
            for part in ("r", "q", "c"):
                for at in range(0, len(hits[part]), BLOCK):
                    rows = np.flatnonzero(hits[part][at : at + BLOCK])
                    if len(rows):
                        own = at + rows
                        moved = getattr(m, part)[own] - getattr(old, part)[own]
                        yield _packed(part, at // BLOCK, rows, hits[part][own], np.column_stack((moved, m.b[own] - old.b[own])) if part == "q" else moved)

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                rows, weight, vectors = _unpacked(row)
                total, sum_ = sums.setdefault((row["by"], row["part"], row["block"]), (np.zeros(BLOCK), np.zeros((BLOCK, vectors.shape[1]))))
                total[rows] += weight
                sum_[rows] += weight[:, None] * vectors.astype(np.float32)
        for (by, part, block), (total, sum_) in sums.items():
            rows = np.flatnonzero(total)
            found = _packed(part, block, rows, total[rows], sum_[rows] / total[rows, None])
            yield pa.RecordBatch.from_arrays([pa.array([by], pa.int32()), *found.columns], ["by", *found.schema.names])

    # a tree: no task mixes more than FAN of them for a block, however many tasks there were
    parts = ids.mapInArrow(run, _MIXED).select(F.spark_partition_id().alias("by"), "*")
    tasks = ids.rdd.getNumPartitions()
    while tasks > FAN:
        parts = parts.withColumn("by", F.floor(F.col("by") / FAN).cast("int")).repartition("part", "block", "by").mapInArrow(mixed, "by int, " + _MIXED)
        tasks = -(-tasks // FAN)
    parts = parts.withColumn("by", F.lit(0)).repartition("part", "block").mapInArrow(mixed, "by int, " + _MIXED).drop("by")
    out = replace(model, **{n: getattr(model, n).copy() for n in ("r", "c", "q", "b")})
    for batch in parts.toArrow().to_batches(max_chunksize=16):
        for row in batch.to_pylist():
            rows, _, moved = _unpacked(row)
            at = row["block"] * BLOCK + rows.astype(np.int64)
            if row["part"] == "q":
                out.b[at] += moved[:, -1]
                moved = moved[:, :-1]
            getattr(out, row["part"])[at] += moved
    shared.destroy()
    return out


def spelling(counts: DataFrame, listed: pa.Array) -> Speller:
    """counts: of the words that aren't listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, each = _trigrams(batch.column("token"))
            keys, place = np.unique(np.concatenate((keys, key)), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate((n, np.repeat(batch.column("n").to_numpy(), each))), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    found = counts.select("token", "n").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return Speller(found["key"].to_numpy(), found["n"].to_numpy(), listed)


def fit(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model and the coded corpus."""
    counts = written(token_counts(docs, split_words, id_col, text_col), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(least, math.ceil(total * SHARE))
    top = counts.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("token", "ascending")])
    words, n = top["token"].combine_chunks().cast(pa.binary()), top["n"].to_numpy()
    n = np.concatenate(([total - n.sum(), 0], n)).astype(np.float64)
    model = start(words, n)
    model.speller = spelling(counts.where(F.col("n") < least), words)
    ids = coded(docs, model, id_col, text_col)
    return trained(ids, model, n), ids


def scored(docs: DataFrame, model: Model | None = None, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob (natural, the sum over the text), mean_log_prob."""
    if model is None:
        model, ids = fit(docs, least, id_col, text_col)
    else:
        ids = coded(docs, model, id_col, text_col)
    # in half precision, which changes the model by less than training's noise does; what it gives is normalised all the same
    half = {n: getattr(model, n).astype(np.float16) for n in ("r", "q")} | {"words": pa.nulls(len(model.words), pa.binary()), "log_noise": None, "speller": None}
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, **half))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(replace(m, r=m.r.astype(np.float32), q=m.q.astype(np.float32)))
        for batch in slices(batches, "ids", 4 << 20):
            words, counts = _ids(batch)
            p = scorer.log_probs(led(words), places_of(counts)) if len(words) else np.zeros(0)
            total = np.concatenate(([0.0], np.cumsum(p)))
            at = offsets_of(counts)
            out = total[at[1:]] - total[at[:-1]] + batch.column("spelled").to_numpy()
            mean = pa.array(np.divide(out, counts, out=np.zeros_like(out), where=counts > 0), mask=counts == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(out), mean], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return ids.mapInArrow(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
