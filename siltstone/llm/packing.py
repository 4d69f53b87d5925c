"""Sharding by best-fit-decreasing bin packing.

Groups of documents that must stay together (by default: copies of one text) are sorted by size, the
largest first, and each goes to the shard whose remaining capacity is the tightest that holds it, found
in a balanced tree; a shard is opened only if none holds it.

Best fit treats groups of equal size alike, so it is run on the histogram of sizes: where n groups have
size s and the tightest shards have r left, each of those takes floor(r / s) of them in turn. The tree
holds runs of like shards. The result is that of the one-by-one algorithm.

The groups have places in the order by decreasing size and then least id, which come from a distributed sort; the plan says which
places go to which shard. The driver reads the histogram as a stream, from the largest size down, and writes the plan in pieces of PIECE rows,
so it holds neither, only the tree: at most one node for each different remaining capacity. Groups beyond the capacity, of however many sizes, are shards by their place alone.

Defined results: a group larger than the capacity is a shard by itself; groups of size 0 join the
tightest shard; null and empty texts are equal texts; ties go by the smallest id; a repeated row gets
its document's shard, once for each row, and counts twice; an empty table has no shards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import identified, in_order, written

#: Bytes of text in a shard, in the registered query.
CAPACITY = 16 << 20
#: Rows of the plan that the driver holds at once; places that are joined with the plan together.
PIECE, BUCKET = 200_000, 1024


class Node:
    __slots__ = ("key", "runs", "left", "right", "height")

    def __init__(self, key: int, run: tuple[int, int]):
        self.key, self.runs, self.left, self.right, self.height = key, [run], None, None, 1


def _height(t: Node | None) -> int:
    return t.height if t else 0


def _set(t: Node) -> Node:
    t.height = 1 + max(_height(t.left), _height(t.right))
    return t


def _turn_right(t: Node) -> Node:
    x = t.left
    t.left, x.right = x.right, t
    _set(t)
    return _set(x)


def _turn_left(t: Node) -> Node:
    x = t.right
    t.right, x.left = x.left, t
    _set(t)
    return _set(x)


def _balanced(t: Node) -> Node:
    _set(t)
    lean = _height(t.left) - _height(t.right)
    if lean > 1:
        if _height(t.left.left) < _height(t.left.right):
            t.left = _turn_left(t.left)
        return _turn_right(t)
    if lean < -1:
        if _height(t.right.right) < _height(t.right.left):
            t.right = _turn_right(t.right)
        return _turn_left(t)
    return t


class Remaining:
    """AVL tree of remaining capacities, each with the runs (first shard, how many) that have it."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def add(self, key: int, run: tuple[int, int]) -> None:
        def go(t: Node | None) -> Node:
            if t is None:
                return Node(key, run)
            if key == t.key:
                t.runs.append(run)
                return t
            if key < t.key:
                t.left = go(t.left)
            else:
                t.right = go(t.right)
            return _balanced(t)

        if run[1]:
            self.root = go(self.root)

    def tightest(self, size: int) -> Node | None:
        t, best = self.root, None
        while t:
            if t.key >= size:
                best, t = t, t.left
            else:
                t = t.right
        return best

    def remove(self, key: int) -> None:
        def least(t: Node) -> Node:
            while t.left:
                t = t.left
            return t

        def go(t: Node | None, k: int) -> Node | None:
            if t is None:
                return None
            if k < t.key:
                t.left = go(t.left, k)
            elif k > t.key:
                t.right = go(t.right, k)
            elif not t.left or not t.right:
                return t.left or t.right
            else:
                x = least(t.right)
                t.key, t.runs = x.key, x.runs
                t.right = go(t.right, x.key)
            return _balanced(t)

        self.root = go(self.root, key)


def plan(histogram: Iterable[tuple[int, int]], capacity: int, place: int = 0, shards: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(size, groups) from the largest size down, none beyond the capacity -> rows (from place, to place, first shard, groups a shard), in order."""
    tree = Remaining()
    for size, left in histogram:
        while left:
            node = tree.tightest(size)
            if node is None:
                each = capacity // size if size else left
                full, more = divmod(left, each)
                room, run, rest = capacity, (shards, full + bool(more)), 0
                shards += full + bool(more)
            else:
                room, run = node.key, node.runs.pop()
                if not node.runs:
                    tree.remove(room)
                each = room // size if size else left
                full = min(run[1], left // each)
                more = min(left - full * each, each) if full < run[1] else 0
                rest = run[1] - full - bool(more)
            if full:
                yield place, place + full * each, run[0], each
                tree.add(room - each * size, (run[0], full))
                place, left = place + full * each, left - full * each
            if more:
                yield place, place + more, run[0] + full, each
                tree.add(room - more * size, (run[0] + full, 1))
                place, left = place + more, left - more
            if rest:
                tree.add(room, (run[0] + full + bool(more), rest))


def packed(docs: DataFrame, capacity: int = CAPACITY, group_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, shard: a row for each document. `group_col` names what keeps documents together; null is a group of its own."""
    spark = docs.sparkSession
    if group_col is None:
        own = identified(docs, id_col, text_col).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("g"), F.octet_length("text").cast("long").alias("size"))
    else:
        own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).alias("g"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("size"))
    own = written(own, "sizes")
    groups = written(own.groupBy("g").agg(F.sum("size").alias("size"), F.min("doc_id").alias("least")), "groups")
    large = groups.where(F.col("size") > capacity).count()
    counts = written(groups.where(F.col("size") <= capacity).groupBy("size").agg(F.count("*").alias("n")), "histogram").orderBy(F.desc("size"))
    rows, pieces = plan(((r["size"], r["n"]) for r in counts.toLocalIterator()), capacity, large, large), []
    while piece := list(islice(rows, PIECE)):
        table = pa.table([pa.array(c, pa.int64()) for c in zip(*piece)], ["low", "high", "first", "each"])
        pieces.append(written(spark.createDataFrame(table), "plan"))
    ordered = written(in_order(groups, F.desc("size"), F.asc("least"), F.asc("g")).select("g", "place"), "places")
    alone = ordered.where(F.col("place") < large).select(F.col("g").alias("of"), F.col("place").alias("shard"))
    placed = alone
    if pieces:
        steps = reduce(DataFrame.union, pieces)
        steps = steps.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / BUCKET), F.floor((F.col("high") - 1) / BUCKET))))
        found = ordered.withColumn("bucket", F.floor(F.col("place") / BUCKET)).join(steps, "bucket").where("place >= low AND place < high")
        placed = alone.union(found.select(F.col("g").alias("of"), (F.col("first") + F.floor((F.col("place") - F.col("low")) / F.col("each"))).cast("long").alias("shard")))
    return own.join(placed, F.col("g").eqNullSafe(F.col("of"))).select("doc_id", "shard")
