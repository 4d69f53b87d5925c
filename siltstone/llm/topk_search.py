"""Exact top-k search by BM25 over an inverted index with block-max WAND.

The whole corpus is indexed once, every term of it, in shards of bounded text that a task makes of what it reads. A shard's postings are in order of
documents, in blocks of BLOCK neighbouring documents; for each block that a list touches the index holds the greatest count of
the term and the least length of a document there, from which any statistics give a bound on what the list adds to a score. A list of up to SHORT
postings has no such table, which would be larger than itself: its blocks' bounds are found from its postings when it is asked for.

Statistics (number of documents, their mean length, document frequencies) are summed over all shards before
any is searched, so scores are those of one index over everything, and merging the shards' best k is exact.

A shard is searched with a cursor for each list of the query, on the next block that it touches. With the cursors in order of their blocks, the pivot is the first list at
which the lists' greatest bounds add up to the k-th score so far: no document before the pivot's block can be among the best, so the lists before it skip
there. If the bounds of the block itself fall short, it is passed over too; else its documents are bounded one by one by the lists that hold them, and only
those that can still be among the best are scored. Postings that are skipped are never read or scored.

Scores are rounded to six digits; ties go to the smaller id.

Defined results: null and empty documents match nothing but count as documents; a query without known
terms has no rows; a term repeated in a query counts once for each time; a document row repeated with its id
is another document; with fewer than k matches there are fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import byte_buffer, coded_words, identified, offsets_of, slices, split_words, written

K, K1, B = 10, 1.2, 0.75
BLOCK = 64
#: Postings up to which a list has no table of its blocks.
SHORT = 64
#: Text in a shard at most; a task with more makes several shards.
SHARD_BYTES = 12 << 20
#: Text of the queries that are broadcast at a time.
QUERY_BYTES = 16 << 20
#: What rounding may add to a score.
SLACK = 2e-6
COLUMNS = ("docs", "lengths", "terms", "term_ends", "ends", "places", "counts", "long", "list_ends", "blocks", "block_ends", "most", "shortest")
INDEX = ", ".join(f"{c} binary" for c in COLUMNS)


def _narrow(x: np.ndarray) -> np.ndarray:
    """In as few bytes as its greatest number needs."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


class Builder:
    """Of one shard."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, texts: pa.Array) -> None:
        codes, distinct, lengths = coded_words(texts)
        key, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * max(1, len(distinct)) + codes, return_counts=True)
        self.parts.append((ids, lengths, distinct.cast(pa.binary()), *(x.astype(np.int32) for x in (key % max(1, len(distinct)), key // max(1, len(distinct)), n))))
        self.held += pc.sum(pc.binary_length(texts)).as_py() or 0

    def row(self) -> pa.RecordBatch:
        """ids and lengths of the documents in order of ids; the terms in order, where each one's postings end, and the postings: places of documents
        and counts; the numbers of the long lists, where the blocks of each end, the blocks' numbers, where their postings end, the greatest count and least length in each."""
        ids, lengths = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])
        base = offsets_of(np.array([len(p[0]) for p in self.parts]))
        first = offsets_of(np.array([len(p[2]) for p in self.parts]))
        coded = pa.concat_arrays([p[2] for p in self.parts]).dictionary_encode()
        by = pc.sort_indices(coded.dictionary).to_numpy()
        number = np.empty(len(by), np.int32)
        number[by] = np.arange(len(by))
        term_of = number[coded.indices.to_numpy(zero_copy_only=False)] if len(by) else number
        term = np.concatenate([term_of[p[3] + f] for p, f in zip(self.parts, first)])
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        doc, n = np.concatenate([rank[p[4] + b] for p, b in zip(self.parts, base)]), np.concatenate([p[5] for p in self.parts])
        self.parts = []
        sort = np.argsort(term.astype(np.int64) << 32 | doc)
        term, doc, n = term[sort], doc[sort], n[sort]
        ids, lengths = ids[order], lengths[order]
        size = np.bincount(term, minlength=len(by))
        ends, long = np.cumsum(size), np.flatnonzero(size > SHORT)
        own = np.flatnonzero((size > SHORT)[term])  # the long lists' postings
        of, block = term[own], doc[own] // BLOCK
        at = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (block[1:] != block[:-1])))) if len(own) else np.zeros(0, np.int64)
        most, shortest = (f.reduceat(x, at) if len(at) else at for f, x in ((np.maximum, n[own]), (np.minimum, lengths[doc[own]])))
        block_ends = own[np.append(at[1:], len(own)) - 1] + 1 if len(at) else at
        terms = coded.dictionary.take(pa.array(by))
        data, offsets = byte_buffer(terms)
        data = data[offsets[0] : offsets[-1]] if len(terms) else np.zeros(0, np.uint8)
        columns = [ids.astype(np.int64), _narrow(lengths), data, _narrow(offsets[1:] - offsets[0]), _narrow(ends), _narrow(doc), _narrow(n)]
        columns += [long.astype(np.int32), _narrow(np.searchsorted(of[at], long, side="right")), _narrow(block[at]), _narrow(block_ends), _narrow(most), _narrow(shortest)]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], list(COLUMNS))


def index_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a shard, as of Builder.row(). One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Builder()
        for batch in slices(batches, "text"):
            shard.add(batch.column("doc_id").to_numpy(), batch.column("text"))
            if shard.held >= SHARD_BYTES:
                yield shard.row()
                shard = Builder()
        if shard.parts:
            yield shard.row()

    return identified(docs, id_col, text_col).mapInArrow(run, INDEX)


@dataclass
class Statistics:
    """Over all shards. frequency: in how many documents each term of the queries occurs."""

    documents: int
    mean_length: float
    frequency: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log(1 + (self.documents - self.frequency + 0.5) / (self.frequency + 0.5))


def _terms(row: dict) -> pa.Array:
    ends = _wide(row["term_ends"], _count(row["term_ends"], row["terms"]))
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets_of(np.diff(ends, prepend=0))), pa.py_buffer(row["terms"])]).cast(pa.binary())


def _count(ends: bytes, data: bytes) -> int:
    """How many ends there are: the last is the data's length, in as few bytes as that needs."""
    return len(ends) // _narrow(np.array([len(data)])).itemsize


class Shard:
    """scored: how many postings were scored so far."""

    def __init__(self, row: dict, asked: pa.Array, stats: Statistics):
        self.ids = np.frombuffer(row["docs"], np.int64)
        terms = _terms(row)
        n = len(terms)
        ends = _wide(row["ends"], n)
        postings = int(ends[-1]) if n else 0
        self.lengths = _wide(row["lengths"], len(self.ids))
        self.place, self.n = (np.frombuffer(row[c], f"u{len(row[c]) // postings}") if postings else np.zeros(0, np.uint8) for c in ("places", "counts"))
        long = np.frombuffer(row["long"], np.int32)
        list_ends = _wide(row["list_ends"], len(long))
        blocks = int(list_ends[-1]) if len(long) else 0
        self.block, self.end, most, shortest = (_wide(row[c], blocks) for c in ("blocks", "block_ends", "most", "shortest"))
        self.mean = stats.mean_length
        self.bound = self._gain(most, shortest)  # of a block of a long list, before the term's weight
        # which list each of the queries' terms has here, where its postings are, and its blocks if it is long
        at = pc.index_in(asked, value_set=terms)
        here = at.is_valid().to_numpy(zero_copy_only=False)
        own = pc.fill_null(at, 0).to_numpy()
        self.from_, self.to = np.where(here, np.concatenate(([0], ends))[own], 0), np.where(here, np.append(ends, 0)[own], 0)
        which = np.minimum(np.searchsorted(long, own), max(0, len(long) - 1))
        is_long = here & (long[which] == own) if len(long) else np.zeros(len(own), bool)
        self.first = np.where(is_long, np.concatenate(([0], list_ends))[which], 0)
        self.last = np.where(is_long, np.append(list_ends, 0)[which], 0)
        self.idf = stats.idf()
        self.scored = 0

    def _gain(self, n: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a count in a document of that length adds to a score, before the term's weight: more with more, and the shorter the more."""
        n = n.astype(np.float64)
        return n * (K1 + 1) / (n + K1 * (1 - B + B * length / self.mean)) if self.mean else n * (K1 + 1) / (n + K1)

    def _blocks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the lists' blocks, list by list: which of the terms, number, where the postings begin and end, bound before the term's weight."""
        long = self.last[terms] > 0
        size = (self.last - self.first)[terms]
        which = np.repeat(np.arange(len(terms)), size)
        own = np.repeat(self.first[terms] - offsets_of(size)[:-1], size) + np.arange(int(size.sum()))
        begin = np.where(own == self.first[terms][which], self.from_[terms][which], self.end[own - 1])
        parts = [(which, self.block[own], begin, self.end[own], self.bound[own])]
        span = np.where(long, 0, (self.to - self.from_)[terms])
        if span.any():
            posting = np.repeat(self.from_[terms] - offsets_of(span)[:-1], span) + np.arange(int(span.sum()))
            place, which = self.place[posting].astype(np.int64), np.repeat(np.arange(len(terms)), span)
            block = place // BLOCK
            at = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (block[1:] != block[:-1]))))
            parts.append((which[at], block[at], posting[at], posting[np.append(at[1:], len(posting)) - 1] + 1, np.maximum.reduceat(self._gain(self.n[posting], self.lengths[place]), at)))
        which, *rest = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(which, kind="stable")
        return which[order], *(x[order] for x in rest)

    def search(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the query's terms, and how often each occurs in it -> ids and scores of the best k, exactly."""
        here = self.to[terms] > 0
        terms, times = terms[here], times[here]
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms):
            return ids, scores
        weight = self.idf[terms] * times
        of, block, first, last, bound = self._blocks(terms)
        bound = bound * weight[of]
        size = np.bincount(of, minlength=len(terms))
        begin, end = offsets_of(size)[:-1], offsets_of(size)[1:]
        key = of << 32 | block  # for cursors that skip
        most = np.maximum.reduceat(bound, begin)
        cursor, past, floor = begin.copy(), 1 << 31, -np.inf
        number = np.arange(len(terms)) << 32
        while True:
            now = np.where(cursor < end, block[np.minimum(cursor, len(block) - 1)], past)
            order = np.argsort(now, kind="stable")
            enough = np.cumsum(most[order]) >= floor - SLACK
            pivot = int(enough.argmax())
            if not enough[pivot] or (at := int(now[order[pivot]])) == past:
                return ids, scores
            behind = now < at
            if behind.any():
                cursor[behind] = np.minimum(np.searchsorted(key, number[behind] | at), end[behind])
                now = np.where(cursor < end, block[np.minimum(cursor, len(block) - 1)], past)
            there = np.flatnonzero(now == at)
            cells = cursor[there]
            cursor[there] += 1
            if bound[cells].sum() < floor - SLACK:
                continue
            a, span = first[cells], last[cells] - first[cells]
            posting = np.repeat(a - offsets_of(span)[:-1], span) + np.arange(int(span.sum()))
            which = np.repeat(np.arange(len(there)), span)
            inside = self.place[posting].astype(np.int64) - at * BLOCK
            can = np.bincount(inside, weights=bound[cells][which], minlength=BLOCK)
            fits = can[inside] >= floor - SLACK if floor > -np.inf else slice(None)
            posting, inside, which = posting[fits], inside[fits], which[fits]
            if not len(posting):
                continue
            self.scored += len(posting)
            score = np.bincount(inside, weights=weight[there][which] * self._gain(self.n[posting], self.lengths[at * BLOCK + inside]), minlength=BLOCK)
            found = np.unique(inside)
            ids, scores = np.concatenate((ids, self.ids[at * BLOCK + found])), np.concatenate((scores, np.round(score[found], 6)))
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(scores) == k:
                floor = float(scores.min())


def search(docs: DataFrame, queries: DataFrame, k: int = K, query_id: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every query."""
    return searched(written(index_shards(docs, id_col, text_col), "index"), queries, k, query_id, text_col)


def searched(index: DataFrame, queries: DataFrame, k: int = K, query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """The same over an index that is there already. What is broadcast are queries, QUERY_BYTES of text at a time; more of them go round in several batches."""
    asked = identified(queries, query_id, text_col)
    size = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rounds = max(1, -(-size // QUERY_BYTES))
    batches = [asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r) if rounds > 1 else asked for r in range(rounds)]
    return reduce(DataFrame.unionByName, (_searched(index, batch, k) for batch in batches))


def _searched(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = index.sparkSession
    asked: dict[int, dict[bytes, int]] = {}
    for row in queries.toLocalIterator():
        own = asked.setdefault(row["doc_id"], {})
        for w in split_words(pa.array([row["text"]], pa.string()))[0].cast(pa.binary()).to_pylist():
            own[w] = own.get(w, 0) + 1
    terms = pa.array(sorted({w for own in asked.values() for w in own}), pa.binary())
    number = {w: i for i, w in enumerate(terms.to_pylist())}
    wanted = [(q, np.array([number[w] for w in sorted(own)], np.int64), np.array([own[w] for w in sorted(own)], np.float64)) for q, own in sorted(asked.items())]
    shared_terms = spark.sparkContext.broadcast(terms)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared_terms.value) + 2, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                own = _terms(row)
                at = pc.index_in(shared_terms.value, value_set=own)
                here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                total[here] += np.diff(_wide(row["ends"], len(own)), prepend=0)[at.drop_null().to_numpy()]
                lengths = _wide(row["lengths"], len(row["docs"]) // 8)
                total[-2:] += len(lengths), lengths.sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["what", "n"])

    total = np.zeros(len(terms) + 2, np.int64)
    for row in index.select("docs", "lengths", "terms", "term_ends", "ends").mapInArrow(sums, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).toLocalIterator():
        total[row["what"]] = row["n"]
    stats = Statistics(int(total[-2]), float(total[-1] / total[-2]) if total[-2] else 0.0, total[:-2])
    shared = spark.sparkContext.broadcast((stats, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, wanted = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.slice(row, 1).to_pylist()[0], shared_terms.value, stats)
                for q, own, times in wanted:
                    ids, scores = shard.search(own, times, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(scores)], ["item_id", "doc_id", "score"])

    best = index.mapInArrow(run, "item_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
