"""Chunks of text, their vectors, and exact search by cosine."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, OVERLAP = 1000, 100
TOP = 5
#: Characters of chunks that leave together.
CHUNK_BYTES = 8 << 20
#: Texts that are embedded together.
EMBEDDED = 512
#: Vectors in a block of the search of all by all. Digits of its scores, which are equal beyond them.
BLOCK, DIGITS = 2048, 6
#: White space, as SQL's patterns have it.
_BLANKS = " \t\n\x0b\f\r"


def _cut(text: str, size: int, step: int) -> Iterator[tuple[int, int, str]]:
    """(chunk index, start, chunk)."""
    text = text.strip(_BLANKS)
    last = 0 if len(text) <= size else -(-(len(text) - size) // step)
    for k in range(last + 1 if text else 0):
        chunk = text[k * step : k * step + size].strip(_BLANKS)
        if chunk:
            yield k, k * step, chunk


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP, embedder: Embedder | None = None) -> DataFrame:
    """doc_id, chunk_index, start, text: windows of `size` characters that overlap. White space at the ends of texts and chunks goes, and
    empty chunks with it (their numbers are then missing). One scan, no shuffle. The JVM's substring counts characters from a text's beginning for
    each chunk; here the time follows the text's length. With an embedder there is a column embedding too, as embedded() adds it, from the worker that
    cuts the chunks: a second one for each task would hold its own batches of them."""
    step = size - overlap
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, held = [], [], 0
            for i, t in enumerate(batch.column("text")):
                for chunk in _cut(t.as_py() or "", size, step):
                    rows.append(i)
                    found.append(chunk)
                    held += len(chunk[2])
                    if held > CHUNK_BYTES or embedder is not None and len(found) == EMBEDDED:
                        yield out(batch, rows, found)
                        rows, found, held = [], [], 0
            if found:
                yield out(batch, rows, found)

    def out(batch: pa.RecordBatch, rows: list[int], found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        index, begin, chunks = zip(*found)
        columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array(begin, pa.int64()), pa.array(chunks, pa.string())]
        return pa.RecordBatch.from_arrays(columns + ([_vectors(embedder, list(chunks))] if embedder is not None else []), kinds.names)

    kinds = T.StructType([own.schema["doc_id"], T.StructField("chunk_index", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("text", T.StringType())])
    if embedder is not None:
        kinds = kinds.add("embedding", T.ArrayType(T.FloatType()))
    return own.where(F.col("text").isNotNull()).mapInArrow(run, kinds)


class Embedder(Protocol):
    """Vectors for texts, in the same order. Instances must be picklable: they run on executors."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in that needs no model: words hashed into `dims` signed counts, then scaled to length 1. The hash is one that
    any SQL engine has."""

    def __init__(self, dims: int = 768):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.matrix(texts).tolist()

    def matrix(self, texts: list[str]) -> np.ndarray:
        """The vectors as rows, without an object for each number."""
        out = np.zeros((len(texts), self.dims))
        for v, t in zip(out, texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.strip(".,;:!?").encode()).digest()[:8], "big")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
        norm = np.sqrt((out * out).sum(axis=1))
        norm[norm == 0] = 1.0
        out /= norm[:, None]
        return out


def _vectors(embedder: Embedder, texts: list[str]) -> pa.Array:
    if hasattr(embedder, "matrix"):
        x = embedder.matrix(texts).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
    return pa.array(embedder.embed(texts), pa.list_(pa.float32()))


def embedded(chunks: DataFrame, embedder: Embedder, text_col: str = "text") -> DataFrame:
    """The chunks with a column embedding. The embedder gets EMBEDDED texts at a time, and what it returned leaves at once: a worker holds the vectors of
    so many, however many rows a batch of Spark's has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, EMBEDDED):
                part = batch.slice(at, EMBEDDED)
                yield pa.RecordBatch.from_arrays([*part.columns, _vectors(embedder, part.column(text_col).to_pylist())], [*part.schema.names, "embedding"])

    chunks = chunks.drop("embedding")
    return chunks.mapInArrow(run, T.StructType([*chunks.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def _doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In doubles, whatever the arrays hold; null if a vector has length 0."""
    a, b = _doubles(a), _doubles(b)
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm)


def nearest(vectors: DataFrame, query: list[float], k: int = TOP, vector_col: str = "embedding", ties: list[str] | None = None) -> DataFrame:
    """The k rows with the highest cosine, exactly, with a column score. Each partition keeps its own k; those are all that moves."""
    scored = vectors.withColumn("score", cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query))))
    return scored.where("score IS NOT NULL").orderBy(F.desc("score"), *(ties or [])).limit(k)


def _best(queries: pa.Table, others: pa.Table, k: int) -> pa.Table:
    """query_id, id, score: the k best of the others for each query, by score and then id."""

    def scaled(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists = t["vector"].combine_chunks()
        ids, flat = t["id"].to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(ids), -1)
        norm = np.sqrt((x * x).sum(axis=1))
        ok = norm > 0  # not where an element is null
        return ids[ok], x[ok] / norm[ok, None]

    (a, x), (b, y) = scaled(queries), scaled(others)
    if len(a) and len(b):
        score = np.round(x @ y.T, DIGITS) + 0.0
        least = np.partition(score, len(b) - k, axis=1)[:, len(b) - k] if k < len(b) else np.full(len(a), -np.inf)
        row, col = np.nonzero(score >= least[:, None])
        order = np.lexsort((b[col], -score[row, col], row))
        row, col = row[order], col[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[keep], col[keep]
        found = a[row], b[col], score[row, col]
    else:
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return pa.table(dict(zip(("query_id", "id", "score"), found)))


def nearest_of_each(vectors: DataFrame, queries: DataFrame | None = None, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: for every query (by default every vector) the k vectors with the highest cosine, exactly. Vectors of length 0 have no
    cosine. Matrix products over pairs of blocks, each pair a task's group; the blocks' best are merged for each query."""

    def blocked(df: DataFrame) -> tuple[DataFrame, int]:
        own = df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        blocks = max(1, math.ceil(own.count() / BLOCK))
        return own.withColumn("block", F.pmod(F.hash("id"), F.lit(blocks))), blocks

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    right, n_right = blocked(vectors)
    left, n_left = blocked(vectors if queries is None else queries)
    left = left.select("id", "vector", F.col("block").alias("i"), every(n_right).alias("j")).groupBy("i", "j")
    right = right.select("id", "vector", every(n_left).alias("i"), F.col("block").alias("j")).groupBy("i", "j")
    found = left.cogroup(right).applyInArrow(lambda a, b: _best(a, b, k), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
