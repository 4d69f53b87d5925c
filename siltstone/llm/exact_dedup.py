"""Exact deduplication with a minimal perfect hash over the historical digests.

The table is taken as a history and what came in after it, parted at an id. The distinct SHA-256
digests of the history are indexed: a shard of the digest space at a time gets a minimal perfect
hash (levels of collision-free positions, ranked), whose n slots hold n full digests and their
winners' ids. An incoming digest goes to one slot; all 32 bytes are compared there. Equal, it repeats the slot's
winner, to which its copies are added; a digest that isn't in the history is known as such and groups with its own equals.

The smallest id of equal texts wins, which makes the outcome that of one pass over everything.

Defined results: null and empty texts are equal to each other, so one of them stays; a row that is
repeated with its id stays once; rows with a null id go; further columns are handed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bounded, identified, written

#: Digests in a shard of the index. The number of shards grows with the history.
SHARD_KEYS = 1 << 15
GAMMA = 2.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of rows of 32-byte digests: at each level, keys alone at their position
    stay there; the rest go on. A key's slot is the rank of its position among all occupied ones."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, n = [], 0
        for bits in levels:
            self.ranks.append(n + np.cumsum(bits, dtype=np.int64) - 1)
            n += int(bits.sum())
        self.n = n

    @staticmethod
    def _at(words: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
        return (_mix(words[:, level % 4] + seed) + _mix(words[:, (level + 1) % 4] ^ seed)) % np.uint64(size)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        """`digests`: uint8[n, 32], distinct."""
        if len(np.unique(np.ascontiguousarray(digests).view("V32"))) < len(digests):
            raise ValueError("a digest is repeated")
        words, levels = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4), []
        while len(words):
            size = max(8, int(GAMMA * len(words)))
            at = cls._at(words, len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            words = words[~alone[at]]
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot below n for each digest, -1 for some that aren't keys."""
        words = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = self._at(words[left], k, len(bits)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.levels], b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, sizes: list[int], raw: bytes) -> PerfectHash:
        data, at, levels = np.frombuffer(raw, np.uint8), 0, []
        for size in sizes:
            width = -(-size // 8)
            levels.append(np.unpackbits(data[at : at + width])[:size].astype(bool))
            at += width
        return cls(levels)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _build(table: pa.Table) -> pa.Table:
    digests, winners = _matrix(table["digest"]), table["doc_id"].to_numpy()
    perfect = PerfectHash.build(digests)
    slot = perfect.slots(digests)
    held, ids = np.empty_like(digests), np.empty_like(winners)
    held[slot], ids[slot] = digests, winners
    sizes, bits = perfect.to_bytes()
    return pa.table({"shard": table["shard"][:1], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()), "digests": pa.array([held.tobytes()], pa.binary()), "winners": pa.array([ids.tobytes()], pa.binary())})


def lookup(digests: np.ndarray, sizes: list[int], bits: bytes, held: bytes, winners: bytes) -> np.ndarray:
    """The winner's id for each digest that the shard holds, byte for byte; -1 where it doesn't, which `found` tells apart."""
    slot = PerfectHash.from_bytes(sizes, bits).slots(digests)
    there = np.frombuffer(held, np.uint8).reshape(-1, 32)
    found = (slot >= 0) & (there[np.maximum(slot, 0)] == digests).all(axis=1)
    return np.where(found, np.frombuffer(winners, np.int64)[np.maximum(slot, 0)], np.int64(-1)), found


def _probe(incoming: pa.Table, index: pa.Table) -> pa.Table:
    """A shard's incoming digests with their winners in the history; null for those that it lacks."""
    out = incoming.select(["doc_id", "digest", "n"])
    winner, found = np.zeros(out.num_rows, np.int64), np.zeros(out.num_rows, bool)
    if index.num_rows and incoming.num_rows:
        row = index.to_pylist()[0]
        winner, found = lookup(_matrix(incoming["digest"]), row["sizes"], row["bits"], row["digests"], row["winners"])
    return out.append_column("winner", pa.array(winner, mask=~found))


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return identified(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """doc_id, digest with distinct digests -> a row for each shard: the hash, its slots' digests and winners."""
    return _sharded(history, shards).groupBy("shard").applyInArrow(_build, "shard int, sizes array<long>, bits binary, digests binary, winners binary")


def looked_up(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """doc_id, digest, n of the distinct incoming digests, with winner: the id that the index holds for the digest, null if it lacks it."""
    return _sharded(incoming, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, "doc_id long, digest binary, n long, winner long")


def _kept(rows: DataFrame, history_until: int | None) -> DataFrame:
    """doc_id, digest, n (rows) -> doc_id, digest, origin, copies."""
    if history_until is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        history_until = (low + high) // 2 if low is not None else 0
    groups = rows.withColumn("new", F.col("doc_id") > history_until).groupBy("digest", "new").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n"))
    groups = written(groups, "digests")
    history, incoming = groups.where(~F.col("new")).select("doc_id", "digest", "n"), groups.where("new").select("doc_id", "digest", "n")
    shards = max(1, -(-history.count() // SHARD_KEYS))
    index = written(build_index(history.select("doc_id", "digest"), shards), "digest-index")
    found = written(looked_up(incoming, index, shards), "looked-up")
    # an id may win with several texts
    repeats = found.where("winner IS NOT NULL").select("digest", F.col("winner").alias("doc_id"), F.col("n").alias("more"))
    old = history.join(repeats, ["doc_id", "digest"], "left").select("doc_id", "digest", F.lit("history").alias("origin"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("copies"))
    return old.unionByName(found.where("winner IS NULL").select("doc_id", "digest", F.lit("incoming").alias("origin"), F.col("n").alias("copies")))


def kept(docs: DataFrame, history_until: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, origin (history or incoming), copies: the one document that stays of each text, and how many rows have it.
    Ids up to `history_until` are the history; by default the lower half of the range of ids."""
    if history_until is None:
        low, high = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
        history_until = (low + high) // 2 if low is not None else 0
    return _kept(digested(docs, id_col, text_col).withColumn("n", F.lit(1).cast("long")), history_until)


def winners(docs: DataFrame, history_until: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, winner: for every document the one that stays of its text, itself or another."""
    stay = kept(docs, history_until, id_col, text_col).select(F.col("digest").alias("of"), F.col("doc_id").alias("winner"))
    return digested(docs, id_col, text_col).join(stay, F.col("digest") == F.col("of")).select("doc_id", "winner")


def deduplicated(docs: DataFrame, history_until: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all columns unchanged. Decided by ids and digests alone; texts are shuffled only where the documents that go are too many to be broadcast."""
    rows = written(digested(docs, id_col, text_col).groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "rows")
    stay = written(_kept(rows, history_until).select("doc_id", "digest"), "stay")
    gone = rows.join(stay, ["doc_id", "digest"], "left_anti").select("doc_id", "digest")
    again = rows.where("n > 1").join(stay, ["doc_id", "digest"], "left_semi").select("doc_id", "digest")  # rows repeated with their id
    again = written(again.select(F.col("doc_id").alias("_id2"), F.col("digest").alias("_digest2")), "again")
    out, _ = bounded(written(gone.union(again).select(F.col("doc_id").alias("_id2"), F.col("digest").alias("_digest2")), "gone"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    own = docs.where(F.col(id_col).isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).cast("long").alias("_id"), digest.alias("_digest"))
    same = (F.col("_id") == F.col("_id2")) & (F.col("_digest") == F.col("_digest2"))
    once = own.join(out, same, "left_anti").select("_row.*")
    if again.isEmpty():
        return once
    first = F.row_number().over(Window.partitionBy("_id", "_digest").orderBy(F.lit(0)))
    return once.unionByName(own.join(bounded(again)[0], same, "left_semi").withColumn("_n", first).where("_n = 1").select("_row.*"))
