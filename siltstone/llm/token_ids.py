"""Token ids in a byte-aligned binary form.

Texts are cut at blanks; a line break is a token by itself. Every token of the whole corpus has an id, its rank by frequency, so that
frequent ones are small. The ranks come from a distributed sort and meet the texts by a join on tokens, so that no
task and no driver ever holds the vocabulary, however large: texts are cut into pieces of bounded size; what is counted and joined are the
distinct tokens of each piece; and a piece's texts, as numbers of the piece's own tokens, are then translated by its table.

A document's ids are written in variable-length coding whose control bytes stand apart from the data:
two control bits an id say how many bytes it takes (1, 2, 3 or 5), four ids a control byte. Decoding looks all
control bytes' lengths up in a table and gathers the ids at once in numpy. Each document's coding is decoded again and compared.

Defined results: null and empty texts have no ids; tokens of equal frequency rank by their bytes; repeated rows
count and encode like any other; an empty table gives an empty vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import binary_array, identified, in_order, offsets_of, slices, written

#: Text in a piece. Bits of a number that say which of a piece's tokens it is, and those before them which of a task's pieces.
PIECE_BYTES, LOCAL_BITS, PIECE_BITS = 32 << 20, 28, 12
#: Bytes of an id for each two control bits; and for each control byte those of its four ids.
SIZES = np.array([1, 2, 3, 5], np.int64)
LENGTHS = np.array([[SIZES[c >> 2 * k & 3] for k in range(4)] for c in range(256)], np.int64)


def encode_ids(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of documents one after the other, below 2 ** 40 -> control bytes and where each document's begin, data bytes and where each document's begin."""
    ids = ids.astype(np.uint64)
    code = (ids > 0xFF).astype(np.uint8) + (ids > 0xFFFF) + (ids > 0xFFFFFF)
    quads = -(-counts // 4)
    control_at = offsets_of(quads)
    place = np.arange(len(ids)) - np.repeat(offsets_of(counts)[:-1], counts)
    codes = np.zeros(int(control_at[-1]) * 4, np.uint8)
    codes[np.repeat(control_at[:-1] * 4, counts) + place] = code
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = offsets_of(SIZES[code])
    data = np.zeros(int(at[-1]), np.uint8)
    for k in range(5):
        some = np.flatnonzero(code >= min(k, 3)) if k else slice(None)
        data[at[:-1][some] + k] = (ids[some] >> np.uint64(8 * k)).astype(np.uint8)
    return control, control_at, data, at[offsets_of(counts)]


def decode_ids(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of documents one after the other, `counts` of them each."""
    begin = offsets_of(-(-counts // 4))[:-1] * 4
    slot = np.repeat(begin - offsets_of(counts)[:-1], counts) + np.arange(int(counts.sum()))
    size = LENGTHS[control].ravel()[slot]
    at = offsets_of(size)[:-1]
    raw = np.concatenate((data, np.zeros(4, np.uint8)))
    out = raw[at].astype(np.int64)
    for k in range(1, 5):
        some = np.flatnonzero(size > k)
        out[some] |= raw[at[some] + k].astype(np.int64) << (8 * k)
    return out


def blank_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of all texts, one after the other, and how many each has."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, empty = lists.flatten(), pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pa.array(~np.repeat(empty, counts)))
        counts = np.where(empty, 0, counts)
    return flat, counts


def joined_tokens(tokens: list[bytes]) -> bytes:
    return b" ".join(tokens).replace(b" \n ", b"\n")


def token_counts(docs: DataFrame, split: Callable[[pa.Array], tuple[pa.Array, np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token (binary), n over all documents. Each task adds up its own first, so what is shuffled is a task's distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])

        for batch in slices(batches, "text"):
            flat, _ = split(batch.column("text"))
            if len(flat):
                found = flat.value_counts()
                held.append(pa.table({"token": found.field("values").cast(pa.binary()), "n": found.field("counts")}))
                rows += len(found)
            if rows > 2_000_000:
                held = [added()]
                if held[0].num_rows > 1_000_000:  # bounds the worker's memory
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held = []
                rows = sum(t.num_rows for t in held)
        if held:
            yield from added().to_batches(max_chunksize=100_000)

    return identified(docs, id_col, text_col).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


_PIECES = "piece long, doc_id long, n long, control binary, data binary, token binary"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document (piece, doc_id, n, control, data: numbers of the piece's tokens, coded) and for each distinct token of a piece (piece, with
    the token's number in its last LOCAL_BITS; token, n: how often it occurs there), as a scratch table. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "text", PIECE_BYTES)):
            flat, counts = blank_tokens(batch.column("text"))
            coded = flat.dictionary_encode()
            local, tokens = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary())
            n, piece = np.bincount(local, minlength=len(tokens)), piece_of(part, k, len(tokens))
            by = np.argsort(-n, kind="stable")  # frequent ones have small numbers here too
            number = np.empty(len(by), np.int64)
            number[by] = np.arange(len(by))
            control, control_at, data, data_at = encode_ids(number[local], counts)
            yield rows(piece=np.full(len(counts), piece), doc_id=batch.column("doc_id"), n=counts, control=binary_array(control, control_at), data=binary_array(data, data_at))
            for at in range(0, len(tokens), 100_000):
                own = by[at : at + 100_000]
                yield rows(piece=piece + at + np.arange(len(own)), token=tokens.take(pa.array(own)), n=n[own])

    def rows(**columns: pa.Array | np.ndarray) -> pa.RecordBatch:
        kinds = {"piece": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "control": pa.binary(), "data": pa.binary(), "token": pa.binary()}
        columns = {c: x if isinstance(x, pa.Array) else pa.array(x) for c, x in columns.items()}
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(len(columns["piece"]), t)) for c, t in kinds.items()], list(kinds))

    return written(identified(docs, id_col, text_col).mapInArrow(run, _PIECES), "pieces")


def piece_of(part: int, k: int, tokens: int) -> int:
    """The number of a task's k-th piece, with room for those of its tokens."""
    if k >> PIECE_BITS or tokens >> LOCAL_BITS:
        raise ValueError("a task has too many pieces, or a piece too many different tokens")
    return (part << PIECE_BITS | k) << LOCAL_BITS


def ranked(found: DataFrame) -> DataFrame:
    """token, n, id of what pieces() gives."""
    counts = found.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    return in_order(counts, F.desc("n"), F.asc("token")).withColumnRenamed("place", "id")


def _of(at: str) -> Column:
    """The piece of a token's number."""
    return F.shiftright(at, LOCAL_BITS) * (1 << LOCAL_BITS)


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counts, control bytes, data bytes of a piece's documents."""
    control, data = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint8) for c in ("control", "data"))
    return table["n"].to_numpy().astype(np.int64), control, data


def _translate(table: pa.Table, tokens: pa.Table) -> pa.Table:
    """A piece's documents, from numbers of its tokens to ids."""
    counts, control, data = _documents(table)
    ids = np.zeros(tokens.num_rows, np.int64)
    ids[tokens["at"].to_numpy() & (1 << LOCAL_BITS) - 1] = tokens["id"].to_numpy()
    out = ids[decode_ids(control, data, counts)]
    control, control_at, data, data_at = encode_ids(out, counts)
    wrong = np.flatnonzero(decode_ids(control, data, counts) != out)
    same = np.ones(len(counts), bool)
    same[np.searchsorted(offsets_of(counts), wrong, side="right") - 1] = False
    return pa.table([table["doc_id"], pa.array(counts), binary_array(control, control_at), binary_array(data, data_at), pa.array(same)], ["doc_id", "n_ids", "control", "data", "round_trip"])


def encoded_with(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """doc_id, n_ids, control, data, round_trip (whether they decode to the same ids); and the vocabulary: token, n, id. Shuffled are the distinct tokens of each
    piece, and the coded documents once."""
    found = pieces(docs, id_col, text_col)
    vocabulary = ranked(found)
    # a token is at most once in a piece, so no key is hot; the hash table is of a partition's part of the vocabulary
    tokens = found.where("token IS NOT NULL").select("token", "piece").join(vocabulary.select("token", "id").hint("shuffle_hash"), "token").select(F.col("piece").alias("at"), "id")
    texts = found.where("doc_id IS NOT NULL").select("piece", "doc_id", "n", "control", "data")
    out = texts.groupBy("piece").cogroup(tokens.groupBy(_of("at"))).applyInArrow(_translate, "doc_id long, n_ids long, control binary, data binary, round_trip boolean")
    return out, vocabulary


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return encoded_with(docs, id_col, text_col)[0]


def decoded(coded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, text from what encoded_with() gives, the same way back: by the distinct ids of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "data", PIECE_BYTES // 4)):
            counts, control, data = _documents(pa.Table.from_batches([batch]).rename_columns(["doc_id", "n", "control", "data"]))
            ids, local = np.unique(decode_ids(control, data, counts), return_inverse=True)
            piece = piece_of(part, k, len(ids))
            places = binary_array(local.astype(np.uint32).view(np.uint8), 4 * offsets_of(counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), piece)), batch.column("doc_id"), places, pa.nulls(len(counts), pa.int64())], ["piece", "doc_id", "places", "id"])
            yield pa.RecordBatch.from_arrays([pa.array(piece + np.arange(len(ids))), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary()), pa.array(ids)], ["piece", "doc_id", "places", "id"])

    def spelled(table: pa.Table, tokens: pa.Table) -> pa.Table:
        words = [None] * tokens.num_rows
        for at, t in zip(tokens["at"].to_pylist(), tokens["token"].to_pylist()):
            words[at & (1 << LOCAL_BITS) - 1] = t
        texts = [joined_tokens([words[k] for k in np.frombuffer(p, np.uint32).tolist()]).decode("utf-8", "replace") for p in table["places"].to_pylist()]
        return pa.table([table["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    found = written(coded.select("doc_id", "n_ids", "control", "data").mapInArrow(run, "piece long, doc_id long, places binary, id long"), "coded")
    tokens = found.where("id IS NOT NULL").select("id", "piece").join(vocabulary.select("id", "token"), "id").select(F.col("piece").alias("at"), "token")
    texts = found.where("doc_id IS NOT NULL").select("piece", "doc_id", "places")
    return texts.groupBy("piece").cogroup(tokens.groupBy(_of("at"))).applyInArrow(spelled, "doc_id long, text string")
