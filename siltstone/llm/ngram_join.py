"""N-gram Jaccard join with MinHash banding.

Documents are sets of word n-grams (lower case, split at white space). Signatures are cut into
bands of r rows; the least r whose false candidates stay few, and as many bands as the target recall
at the threshold asks for. Only band hashes are shuffled to find candidates; each candidate pair is
then verified on the two full n-gram sets, by 64-bit hashes of the n-grams.

Equal sets (equal in 128 bits, sums of two mixes of the hashes) are collapsed first into one node, which stands for
all their documents and keeps copies by the thousand from pairing with each other.

Every candidate pair is verified somewhere, whatever the size of its bucket, and no bucket is ever a row, a list or a task: nodes lie in blocks
of bounded size, near ones together; a bucket says which blocks meet in it; and a task gets the texts and band hashes of those members of two blocks
that share a bucket, and finds the pairs among them itself. So neither pairs nor buckets are shuffled, and a text travels once for each block that it meets.

Defined results: null and empty texts have no n-grams and no link; a text of fewer than n words
is one n-gram; equal sets have similarity 1; a row repeated with its id is one document; two texts
under one id are two documents with that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bounded, coded_words, identified, offsets_of, release, slices, written

N, THRESHOLD, RECALL = 3, 0.5, 0.95
#: Nodes in a block: the texts of two blocks are in a task's memory at once.
BLOCK_DOCS = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows, hence fewest false candidates, with which `recall` at the threshold needs no more than `most` hashes.
    Where even one row needs more, it gets them."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("the threshold must be above 0 and at most 1, the recall between them")
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-p)))
        if best and bands * rows > most:
            break
        best = (max(1, bands), rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def ngram_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of each text, one after the other, and how many each has."""
    codes, words, counts = coded_words(texts)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))[codes] if len(codes) else np.zeros(0, np.uint64)
    grams = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    begin = offsets_of(counts)[:-1]
    at = np.repeat(begin - offsets_of(grams)[:-1], grams) + np.arange(int(grams.sum()))
    last = np.repeat(begin + counts, grams)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        there = at + k < last
        word = np.where(there, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))], np.uint64(k)) if len(hashes) else out
        out = _mix(out * _ODD + word)
    return out, grams


def signatures(hashes: np.ndarray, grams: np.ndarray, n_hashes: int, seed: int = 1) -> np.ndarray:
    """uint32[texts that have n-grams, n_hashes]: the least value of each hash function."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    begin = offsets_of(grams[grams > 0])[:-1]
    rng = np.random.default_rng(seed)
    out = np.empty((len(begin), n_hashes), np.uint32)
    if not len(begin):
        return out
    buffer = np.empty_like(x)
    for k, (a, b) in enumerate(rng.integers(0, 1 << 32, (n_hashes, 2), dtype=np.uint64)):
        np.multiply(x, np.uint32(a | np.uint64(1)), out=buffer)
        np.add(buffer, np.uint32(b), out=buffer)
        np.bitwise_xor(buffer, buffer >> np.uint32(15), out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, begin)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64[texts, bands]; a band's number is part of its key."""
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for k in range(rows):
            h = _mix(h * _ODD + signature[:, b * rows + k])
        out[:, b] = h
    return out.view(np.int64)


def set_keys(hashes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """int64[texts that have n-grams, 2]: 128 bits of the set, by sums of two mixes of its distinct hashes."""
    doc = np.repeat(np.arange(len(grams)), grams)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    full = np.flatnonzero(grams > 0)
    if not len(full):
        return np.zeros((0, 2), np.int64)
    begin = np.searchsorted(d, full)
    out = np.stack([np.add.reduceat(_mix(h + np.uint64(0x1234567)), begin), np.add.reduceat(_mix(_mix(h ^ _ODD)), begin)], axis=1)
    return out.view(np.int64)


def sketches(docs: DataFrame, n: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text, to tell texts under one id apart), set (key of the n-gram set), keys; the last two are null without n-grams. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, grams = ngram_hashes(batch.column("text"), n)
            sets = set_keys(hashes, grams)
            keys = band_keys(signatures(hashes, grams, bands * rows), bands, rows)
            none = pa.array(grams == 0)
            at = pa.array(offsets_of(grams > 0).astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(at.to_numpy() * width), pa.array(x.ravel())) for x, width in ((sets, 2), (keys, bands))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *(pc.if_else(none, pa.scalar(None, x.type), x) for x in lists)], ["doc_id", "h", "set", "keys"])

    source = identified(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    return source.mapInArrow(run, "doc_id long, h long, set array<long>, keys array<long>")


def _sets(texts: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For a task's texts: dense numbers of the distinct n-grams of each, where each begins, how many n-grams there are."""
    parts, counts = [], []
    for batch in slices(texts.select(["text"]).combine_chunks().to_batches(), "text", tidy=False):
        hashes, grams = ngram_hashes(batch.column("text"), n)
        at = offsets_of(grams)
        for i in range(len(grams)):
            u = np.unique(hashes[at[i] : at[i + 1]])
            parts.append(u)
            counts.append(len(u))
    everything = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    values, dense = np.unique(everything, return_inverse=True)
    return dense, offsets_of(np.array(counts, np.int64)), len(values)


def candidates(node: np.ndarray, key: np.ndarray, side: np.ndarray, n: int) -> np.ndarray:
    """Distinct pairs i * n + j, i < j, of the n nodes that share a key: those of side 0 with those of side 1, those of side 2 with each other."""
    order = np.lexsort((side, key))
    node, key, side = node[order], key[order], side[order]
    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
    held, size, out = [], 0, np.zeros(0, np.int64)
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if z - a < 2:
            continue
        own = node[a:z]
        one, two = a + np.searchsorted(side[a:z], (1, 2))
        if two == z:
            x, y = np.repeat(node[a:one], z - one), np.tile(node[one:z], one - a)
        else:
            i, j = np.triu_indices(z - two, 1)
            x, y = own[two - a :][i], own[two - a :][j]
        held.append(np.minimum(x, y) * n + np.maximum(x, y))
        size += len(x)
        if size > 1 << 22:
            out, held, size = np.unique(np.concatenate((out, *held))), [], 0
    return np.unique(np.concatenate((out, *held)))


#: What a task finds: pairs u, v with their similarity, or as rows without v the links of a node to documents of other nodes.
_FOUND = "u long, v long, jaccard double, links long"
PAIRS, LINKS, FOREST = "pairs", "links", "forest"


def _verify(texts: pa.Table, entries: pa.Table, n: int, threshold: float, what: str) -> pa.Table:
    """texts: node, weight, text. entries: node, key, side, root. All similar pairs; or with LINKS just as many of them as connect the nodes, and
    each node's links; or with FOREST the same without links, and pairs that others already connect are left out
    unverified (a group of m near copies costs about m comparisons, not m * m). Nodes of one root are connected from the start."""
    names = texts["node"].to_numpy()
    order = np.argsort(names)
    names, weight = names[order], texts["weight"].to_numpy()[order]
    place = np.searchsorted(names, entries["node"].to_numpy())
    pairs = candidates(place, entries["key"].to_numpy(), entries["side"].to_numpy(), len(names))
    first, second = pairs // max(1, len(names)), pairs % max(1, len(names))
    dense, at, many = _sets(texts.take(pa.array(order)), n)
    size = np.diff(at)
    mark, root, out, links = np.zeros(many, bool), list(range(len(names))), [], np.zeros(len(names), np.int64)
    known: dict[int, int] = {}
    for i, r in zip(place.tolist(), entries["root"].to_pylist()):
        if r is not None:
            root[i] = known.setdefault(r, i)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    begin = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1], [True]))) if len(pairs) else np.zeros(1, np.int64)
    for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
        i, others = int(first[a]), second[a:z]
        own = dense[at[i] : at[i + 1]]
        mark[own] = True
        while len(others):
            later = []
            if what == FOREST:
                # one candidate of each group that i isn't in; the rest of that group only if it fails
                seen, now, mine = set(), [], find(i)
                for j in others.tolist():
                    r = find(j)
                    if r != mine:
                        (later if r in seen else now).append(j)
                        seen.add(r)
                if not now:
                    break
                others = np.array(now)
            span = size[others]
            flat = dense[np.repeat(at[others] - offsets_of(span)[:-1], span) + np.arange(int(span.sum()))]
            both = np.add.reduceat(mark[flat].astype(np.int64), offsets_of(span)[:-1])
            score = both / (size[i] + span - both)
            similar = np.flatnonzero(score >= threshold)
            if what == LINKS:
                links[i] += weight[others[similar]].sum()
                links[others[similar]] += weight[i]
            for k in similar.tolist():
                j = int(others[k])
                x, y = find(i), find(j)
                if what == PAIRS or x != y:
                    out.append((int(names[i]), int(names[j]), float(score[k]), None))
                    root[y] = x
            others = np.array(later, np.int64)
        mark[own] = False
    out += [(int(names[i]), None, None, int(links[i])) for i in np.flatnonzero(links)]
    columns = list(zip(*out)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["u", "v", "jaccard", "links"])


class _Join:
    """What the joins share. members: doc_id, h, set, a row for each document. nodes: set, node, a and ha (the document whose text stands for the set), weight
    (documents), keys. buckets: key, node, least (node) of all buckets with more than one node."""

    def __init__(self, docs: DataFrame, n: int, threshold: float, recall: float, id_col: str, text_col: str):
        self.docs, self.n, self.threshold, self.columns = docs, n, threshold, (id_col, text_col)
        bands, rows = banding(threshold, recall)
        sketch = written(sketches(docs, n, bands, rows, id_col, text_col), "sketches")
        self.members = sketch.select("doc_id", "h", "set").distinct()
        live = sketch.where("set IS NOT NULL")
        first = live.groupBy("set").agg(F.min(F.struct("doc_id", "h", "keys")).alias("first"))
        weight = self.members.where("set IS NOT NULL").groupBy("set").agg(F.count("*").alias("weight"))
        nodes = first.join(weight, "set").select("set", F.monotonically_increasing_id().alias("node"), F.col("first.doc_id").alias("a"), F.col("first.h").alias("ha"), "weight", F.col("first.keys").alias("keys"))
        self.nodes = written(nodes, "nodes")  # which also settles the nodes' numbers
        keyed = self.nodes.select("node", F.explode("keys").alias("key"))
        shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
        self.buckets = written(keyed.join(shared, "key"), "buckets")

    def blocks(self, homes: DataFrame) -> DataFrame:
        """node, home -> node, block. Nodes of one home are together, unless they are too many; those of small homes share blocks."""
        homes = written(homes, "homes")
        sizes = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("blocks"))
        few = max(1, -(-homes.count() // BLOCK_DOCS))
        block = F.when(F.col("blocks") > 1, F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("blocks")))).otherwise(F.pmod(F.xxhash64("home"), F.lit(few)))
        return homes.join(sizes, "home").select("node", block.alias("block"))

    def meeting(self, entries: DataFrame, unlike: bool) -> DataFrame:
        """key, node, block, root -> task, node, key, side, root: a task for each two blocks that share a key, and for a block alone. unlike: only
        for keys under which the two have different roots."""
        entries = written(entries, "entries")
        who = ["key", "block", *(["root"] if unlike else [])]
        here = entries.select(*who).distinct()
        there = here.select("key", *(F.col(c).alias(f"other_{c}") for c in who[1:]))
        met = here.join(there, "key").where("block <= other_block")
        met = met.where("root <> other_root") if unlike else met
        met = met.select("key", "block", "other_block").distinct()
        task = F.xxhash64("block", "other_block").alias("task")
        left = met.select("key", "block", task, F.when(F.col("block") == F.col("other_block"), 2).otherwise(0).alias("side"))
        right = met.where("block <> other_block").select("key", F.col("other_block").alias("block"), task, F.lit(1).alias("side"))
        return entries.join(left.union(right), ["key", "block"]).select("task", "node", "key", "side", "root")

    def verified(self, entries: DataFrame, what: str) -> DataFrame:
        """task, node, key, side, root -> what _verify() finds in each task."""
        n, threshold = self.n, self.threshold
        entries = written(entries, "tasks")
        needed = entries.select("task", "node").distinct().join(self.nodes.select("node", "weight", F.col("a").alias("doc_id"), F.col("ha").alias("h")), "node")
        needed, _ = bounded(written(needed, "needed"))
        texts = identified(self.docs, *self.columns).withColumn("h", F.xxhash64("text")).join(needed, ["doc_id", "h"])
        # a row repeated with its id comes more than once
        texts = texts.groupBy("task", "node").agg(F.first("weight").alias("weight"), F.first("text").alias("text"))

        def verify(left: pa.Table, right: pa.Table) -> pa.Table:
            out = _verify(left, right, n, threshold, what)
            if left.nbytes > 4 << 20:
                release()
            return out

        of = entries.select(F.col("task").alias("of"), *(F.col(c).alias(c) for c in ("node", "key", "side", "root")))
        return written(texts.groupBy("task").cogroup(of.groupBy("of")).applyInArrow(verify, _FOUND), "found")

    def homes(self) -> DataFrame:
        return self.buckets.groupBy("node").agg(F.min("least").alias("home"))

    def everything(self, what: str) -> DataFrame:
        """Every pair that shares a bucket is verified."""
        entries = self.buckets.join(self.blocks(self.homes()), "node").select("key", "node", "block", F.lit(None).cast("long").alias("root"))
        return self.verified(self.meeting(entries, False), what)

    def forest(self) -> DataFrame:
        """node, root: what is connected. First every node of a bucket is held against its least one, which connects most; then only
        nodes of a bucket that aren't connected yet are held against each other."""
        stars = self.buckets.where("node <> least").select("node", "least").distinct().join(self.blocks(self.homes()), "node")
        none = F.lit(None).cast("long").alias("root")
        ends = stars.select(F.col("block").alias("task"), F.col("least").alias("node"), F.col("least").alias("key"), F.lit(1).alias("side"), none).distinct()
        stars = stars.select(F.col("block").alias("task"), "node", F.col("least").alias("key"), F.lit(0).alias("side"), none).union(ends)
        found = self.verified(stars, FOREST).select("u", "v")
        root = components(found)
        rooted = self.buckets.select("key", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        unlike = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        rooted = written(rooted.join(unlike, "key", "left_semi"), "unlike")
        entries = rooted.join(self.blocks(rooted.select("node", F.col("root").alias("home")).distinct()), "node")
        more = self.verified(self.meeting(entries.select("key", "node", "block", "root"), True), FOREST).select("u", "v")
        return components(found.union(more))


def joined(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links: a row for each document, with the least id that a chain of similar documents connects it with, its own if none, and
    the number of documents that are similar to it, all of them counted."""
    own = _Join(docs, n, threshold, recall, id_col, text_col)
    found = own.everything(LINKS)
    root = components(found.where("v IS NOT NULL").select("u", "v"))
    links = found.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    root = written(root.union(root.select(F.col("root").alias("node"), "root").distinct()).join(own.nodes.select("node", "a"), "node"), "rooted")
    classes = root.join(root.groupBy("root").agg(F.min("a").alias("class_id")), "root").select("node", "class_id")
    of = own.nodes.select("set", "node", "a", "weight").join(classes, "node", "left").join(links, "node", "left")
    of = of.select(F.col("set").alias("of"), F.coalesce("class_id", "a").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = own.members.join(of, F.col("set") == F.col("of"), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id_a, doc_id_b, jaccard: a row for each two different n-gram sets that are similar, by the documents that stand for them (the least ids).
    A group of m near copies that all differ is up to m * m / 2 rows; joined() says the same without them."""
    own = _Join(docs, n, threshold, recall, id_col, text_col)
    name = own.nodes.select("node", "a")
    found = own.everything(PAIRS).join(name.withColumnRenamed("node", "u").withColumnRenamed("a", "x"), "u").join(name.withColumnRenamed("node", "v").withColumnRenamed("a", "y"), "v")
    return found.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """u, v (any orderable type) -> node, root: the least node that each node is connected with, for all but the roots.
    Every round hangs all of a node's smaller neighbours under the least of them, and then each node under
    its parent's parent; it ends when parents have no parents. Rounds grow with the logarithm of the longest chain."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root")).distinct()
    e = written(e, "edges")
    while True:
        least = e.groupBy("node").agg(F.min("root").alias("m"), F.collect_set("root").alias("roots"))
        hung = least.select("node", F.col("m").alias("root")).union(least.select(F.explode("roots").alias("node"), "m").where("node <> m"))
        parent = hung.groupBy("node").agg(F.min("root").alias("root"))
        # the least parent's own parent, if it has one; the other parents keep their edge to it
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        nxt = hung.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).union(hung.join(up, "root").select("root", "above")).where("node <> root").distinct()
        nxt = written(nxt, "edges")
        roots = nxt.select(F.col("root").alias("node")).distinct()
        if nxt.groupBy("node").count().where("count > 1").isEmpty() and nxt.join(roots, "node", "left_semi").isEmpty():
            return nxt
        e = nxt


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that a chain of similar ones connects with a smaller id; all columns unchanged.
    Documents without n-grams stay."""
    own = _Join(docs, n, threshold, recall, id_col, text_col)
    root = own.forest()
    root = written(root.union(root.select(F.col("root").alias("node"), "root").distinct()).join(own.nodes.select("node", "a"), "node"), "rooted")
    kept = root.join(root.groupBy("root").agg(F.min("a").alias("least")), "root").select("node", "least")
    least = own.nodes.select("set", "node", "a", "weight").join(kept, "node", "left").where("weight > 1 OR least < a").select(F.col("set").alias("of"), F.coalesce("least", "a").alias("least"))
    gone = own.members.join(least, F.col("set") == F.col("of")).where("doc_id > least").select(F.col("doc_id").alias("gone"), F.col("h").alias("gone_h")).distinct()
    gone, _ = bounded(written(gone, "gone"))
    stay = docs.where(F.col(id_col).isNotNull()).alias("stay")
    h = F.xxhash64(F.coalesce(F.col(f"stay.{text_col}"), F.lit("")))
    return stay.join(gone.alias("left"), (F.col(f"stay.{id_col}").cast("long") == F.col("left.gone")) & (h == F.col("left.gone_h")), "left_anti")
