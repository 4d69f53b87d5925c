"""BPE encoding and decoding with a tokenization automaton.

The merges of a rank file are compiled into a deterministic automaton over tokens that accepts
exactly the sequences which byte pair encoding yields. It starts as one state with an arc for each
byte. Each merge (u, v) -> uv, in rank order, changes it by a gadget: wherever an arc u leads to a
state with an arc v, that arc u leads instead to a copy of the state without the arc v, and a new
arc uv leads where v led from there.

Where an arc leads depends on its label alone, so a state is that of a token. What a state lacks is
a union of subtrees: a token that was made from v after v's arc was removed is missing too. With the
tokens numbered in preorder of the tree "begins with", younger children first, each removal is one
interval of numbers, and the transition table is a sorted array of interval bounds.

A word's tokenization is the automaton's only path whose labels spell it. Every prefix has its own
only path, so one table-driven pass from left to right finds for each position the last token and
the state; the distinct words of a batch advance together in numpy. Decoding emits the arcs' labels.

Defined results: null and empty texts have no tokens; any bytes can be encoded, so nothing is ever
unknown; repeated rows encode alike; text is never cut, whatever its length.
"""

from __future__ import annotations

import base64
import bisect
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import byte_buffer, identified, list_array, offsets_of, slices

#: The rank file that the registered query uses, and the session's setting that names another. It is a parameter of every function here.
VOCABULARY, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.siltstone.bpe.vocabulary"
#: Longer words take a path that goes byte by byte, and whose time is linear too.
LONG_WORD = 96
WIDTH = 1 << 20

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def char_classes() -> np.ndarray:
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = _LETTER
        elif k == "N":
            kinds[c] = _NUMBER
    kinds[_WHITE] = _SPACE
    return kinds


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which characters begin, and the characters' numbers. A stray byte of broken text counts with the character before it."""
    lead = (data & 0xC0) != 0x80
    if len(lead):
        lead[0] = True
    at = np.flatnonzero(lead)
    cp = data[at].astype(np.int32)
    wide = np.flatnonzero(cp >= 0xC0)
    if len(wide):
        b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
        p, c = at[wide], cp[wide]
        one, two, three = b[p + 1] & 0x3F, b[p + 2] & 0x3F, b[p + 3] & 0x3F
        cp[wide] = np.where(c < 0xE0, (c & 0x1F) << 6 | one, np.where(c < 0xF0, (c & 0x0F) << 12 | one << 6 | two, (c & 0x07) << 18 | one << 12 | two << 6 | three))
    return at, np.minimum(cp, 0x10FFFF)


def pre_split(data: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Byte positions at which the words of texts begin that lie one after the other in `data`; `starts`: where the texts begin.
    The words are those of the pattern of the rank files: contractions; letters, numbers or others, with one
    blank before them; white space, all but its last character if something follows."""
    if not len(data):
        return np.zeros(0, np.int64)
    at, cp = code_points(data)
    n = len(at)
    kind = kinds[cp]
    text_start = np.zeros(n + 2, bool)
    text_start[np.searchsorted(at, starts[starts < len(data)])] = True
    text_start[n] = True
    start = text_start[: n + 2].copy()
    start[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~text_start[1:n]) + 1
    start[after - 1] = True
    start[after[cp[after - 1] == 0x20]] = False
    quote = np.flatnonzero(cp == 0x27)
    quote = quote[start[quote] & (quote + 1 < n)]
    quote = quote[(kind[np.minimum(quote + 1, n - 1)] == _LETTER) & ~text_start[quote + 1]]
    if len(quote):
        cp2 = np.concatenate((cp, [0, 0, 0]))
        a, b = cp2[quote + 1], np.where(text_start[quote + 2], 0, cp2[quote + 2])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        for hit, k in ((one, 1), (two & ~one, 2)):
            q = quote[hit]
            start[q + 1] = False
            end = q + 1 + k
            inside = end[(end < n)]
            inside = inside[(kind[inside] == _LETTER) & ~text_start[inside]]
            start[inside] = True
    return at[np.flatnonzero(start[:n])]


def _path(spark: SparkSession, vocabulary: str | None) -> str:
    return vocabulary or spark.conf.get(SETTING, VOCABULARY)


def read_ranks(path: str) -> list[bytes]:
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no rank file {path}: pass its path, or set {SETTING}")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return sorted(ranks, key=ranks.__getitem__)


def merges_of(tokens: list[bytes]) -> list[tuple[int, int, int]]:
    """(left, right, made) in rank order: the last merge by which each token of more than one byte comes about."""
    rank, out = {t: i for i, t in enumerate(tokens)}, []
    for made, token in enumerate(tokens):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: r if (r := rank.get(parts[i] + parts[i + 1], made)) < made else WIDTH)
            if rank.get(parts[best] + parts[best + 1], made) >= made:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((rank[parts[0]], rank[parts[1]], made))
    return out


class Automaton:
    """Compiled tables. Their size depends on the vocabulary alone."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]):
        n = len(tokens)
        self.lengths = np.array([len(t) for t in tokens], np.int32)
        self.label_data = np.frombuffer(b"".join(tokens), np.uint8)
        self.label_at = offsets_of(self.lengths)
        self.kinds = char_classes()
        self._number(n, merges)
        self._gadgets(n, tokens, merges)
        self._arcs(tokens)
        self._edge_map: dict[int, int] | None = None

    def _number(self, n: int, merges: list[tuple[int, int, int]]) -> None:
        """Preorder numbers in the tree "begins with", younger children first, and the end of each child's subtree."""
        children: list[list[int]] = [[] for _ in range(n)]
        child = np.zeros(n, bool)
        for left, _, made in merges:
            children[left].append(made)
            child[made] = True
        self.number, self.end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        count, stack = 0, [(t, False) for t in range(n - 1, -1, -1) if not child[t]]
        while stack:
            t, done = stack.pop()
            if done:
                self.end[t] = count
                continue
            self.number[t] = count
            count += 1
            stack.append((t, True))
            stack.extend((c, False) for c in children[t])  # appended in age order, so the youngest is popped first
        self._children = children

    def _gadgets(self, n: int, tokens: list[bytes], merges: list[tuple[int, int, int]]) -> None:
        """state_of: where a token's arc leads. A state is the tuple of what it lacks, as a linked list (rest, begin, end)."""
        state: list = [None] * n
        dead = {t for t in range(n) if len(tokens[t]) > 1} - {made for *_, made in merges}  # no merge makes them
        for left, right, made in merges:
            came = state[right]  # where the arc `right` leads before this merge
            if left in dead or right in dead or self._lacks(state[left], self.number[right]):
                dead.add(made)  # the two never meet
                continue
            younger = [c for c in self._children[right] if c >= made]
            end = self.number[right] + 1 if not younger else self.end[min(younger)]
            state[left] = (state[left], int(self.number[right]), int(end))
            state[made] = came
        alive = [t for t in range(n) if t not in dead]
        keys: dict[tuple, int] = {}
        self.state_of, bounds = np.zeros(n, np.int64), []
        memo: dict[int, tuple] = {}
        for t in alive:
            node = state[t]
            row = memo.get(id(node))
            if row is None:
                spans, x = [], node
                while x is not None:
                    spans.append((x[1], x[2]))
                    x = x[0]
                row, hi = [], -1
                for a, b in sorted(spans):
                    if a > hi:
                        row += [a, b]
                        hi = b
                    elif b > hi:
                        row[-1] = hi = b
                row = memo[id(node)] = tuple(row)
            at = keys.setdefault(row, len(keys))
            if at == len(keys) - 1 and len(bounds) <= at:
                bounds.append(row)
            self.state_of[t] = at
        self.start = keys.setdefault((), len(keys))
        if len(bounds) <= self.start:
            bounds.append(())
        self.bounds = np.array([s * WIDTH + x for s, row in enumerate(bounds) for x in row], np.int64)
        self.usable = np.ones(n, bool)
        self.usable[list(dead)] = False
        self._children = None

    @staticmethod
    def _lacks(node: tuple | None, number: int) -> bool:
        while node is not None:
            if node[1] <= number < node[2]:
                return True
            node = node[0]
        return False

    def _arcs(self, tokens: list[bytes]) -> None:
        """Byte tree of the labels: sorted edges (node, byte) -> node, the first two levels as dense tables."""
        nodes: dict[bytes, int] = {b"": 0}
        for t in tokens:
            for k in range(1, len(t) + 1):
                nodes.setdefault(t[:k], len(nodes))
        self.label = np.full(len(nodes), -1, np.int64)
        for i, t in enumerate(tokens):
            if self.usable[i]:
                self.label[nodes[t]] = i
        edges = sorted((nodes[p[:-1]] << 8 | p[-1], x) for p, x in nodes.items() if p)
        self.edge = np.array([a for a, _ in edges], np.int64)
        self.edge_to = np.array([b for _, b in edges], np.int64)
        self.first = np.full(256, -1, np.int64)
        self.second = np.full(65536, -1, np.int64)
        for p, x in nodes.items():
            if len(p) == 1:
                self.first[p[0]] = x
            elif len(p) == 2:
                self.second[p[0] << 8 | p[1]] = x

    @classmethod
    def from_file(cls, path: str = VOCABULARY) -> Automaton:
        tokens = read_ranks(os.fspath(path))
        if {t[0] for t in tokens if len(t) == 1} != set(range(256)):
            raise ValueError("the vocabulary must have all single bytes")
        return cls(tokens, merges_of(tokens))

    def has_arc(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, states * WIDTH + self.number[tokens], side="right") & 1 == 0

    def _step(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = nodes << 8 | byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.edge_to[at], -1)

    def encode_word(self, word: bytes) -> list[int]:
        """One word, byte by byte."""
        if self._edge_map is None:
            self._edge_map = dict(zip(self.edge.tolist(), self.edge_to.tolist()))
            self._bounds_list = self.bounds.tolist()
        n = len(word)
        last, state = [-1] * (n + 1), [-1] * (n + 1)
        state[0] = self.start
        for j in range(n):
            if state[j] < 0:
                continue
            node, base = 0, state[j] * WIDTH
            for k in range(j, n):
                node = self._edge_map.get(node << 8 | word[k], -1)
                if node < 0:
                    break
                t = int(self.label[node])
                if t >= 0 and last[k + 1] < 0 and not bisect.bisect_right(self._bounds_list, base + int(self.number[t])) & 1:
                    last[k + 1], state[k + 1] = t, int(self.state_of[t])
        out, k = [], n
        while k:
            out.append(last[k])
            k -= int(self.lengths[last[k]])
        return out[::-1]

    def _encode_block(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of similar length -> tokens one after the other, tokens in each word."""
        n, width = len(at), int(size.max())
        inside = np.arange(width)[None, :] < size[:, None]
        m = np.zeros((n, width), np.int64)
        m[inside] = data[(at[:, None] + np.arange(width))[inside]]
        last = np.full((n, width + 1), -1, np.int64)
        state = np.full((n, width + 1), -1, np.int64)
        state[:, 0] = self.start
        for j in range(width):
            w = np.flatnonzero((size > j) & (state[:, j] >= 0))
            if not len(w):
                continue
            node = self.first[m[w, j]]
            for k in range(j, width):
                if k > j:
                    go = size[w] > k
                    w, node = w[go], node[go]
                    if not len(w):
                        break
                    node = self.second[m[w, j] << 8 | m[w, k]] if k == j + 1 else self._step(node, m[w, k])
                    go = node >= 0
                    w, node = w[go], node[go]
                    if not len(w):
                        break
                t = self.label[node]
                hit = np.flatnonzero(t >= 0)
                hit = hit[self.has_arc(state[w[hit], j], t[hit])]
                last[w[hit], k + 1] = t[hit]
                state[w[hit], k + 1] = self.state_of[t[hit]]
        end, back, rows = size.astype(np.int64).copy(), [], np.arange(n)
        counts = np.zeros(n, np.int64)
        while len(rows):
            t = last[rows, end[rows]]
            back.append((rows, t))
            counts[rows] += 1
            end[rows] -= self.lengths[t]
            rows = rows[end[rows] > 0]
        out, stop = np.empty(int(counts.sum()), np.int32), np.cumsum(counts)
        for k, (rows, t) in enumerate(back):
            out[stop[rows] - 1 - k] = t
        return out, counts

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words -> tokens one after the other, and how many each word has."""
        size = np.diff(offsets)
        counts, found = np.zeros(len(size), np.int64), []
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        short = order[size[order] <= LONG_WORD]
        at = 0
        while at < len(short):
            width = int(size[short[at]]) + 4
            stop = min(int(np.searchsorted(size[short], width, side="right")), at + max(1, (1 << 20) // width))
            rows = short[at:stop]
            tokens, c = self._encode_block(data, offsets[rows], size[rows])
            counts[rows] = c
            found.append((rows, tokens, c))
            at = stop
        for row in order[len(short) :]:
            tokens = np.array(self.encode_word(data[offsets[row] : offsets[row + 1]].tobytes()), np.int32)
            counts[row] = len(tokens)
            found.append((np.array([row]), tokens, np.array([len(tokens)])))
        where, out = offsets_of(counts), np.empty(int(counts.sum()), np.int32)
        for rows, tokens, c in found:
            out[np.repeat(where[rows] - offsets_of(c)[:-1], c) + np.arange(len(tokens))] = tokens
        return out, counts

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after the other, and how many each text has."""
        data, offsets = byte_buffer(texts)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        words = pre_split(data, offsets[:-1], self.kinds)
        spans = np.concatenate((words, [len(data)])).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        tokens, counts = self.encode_words(*byte_buffer(coded.dictionary))
        begin, each = offsets_of(counts)[:-1][which], counts[which]
        total = offsets_of(each)
        out = tokens[np.repeat(begin - total[:-1], each) + np.arange(total[-1])]
        return out, np.diff(total[np.searchsorted(words, offsets)])

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The labels' bytes."""
        size = self.lengths[tokens].astype(np.int64)
        return self.label_data[np.repeat(self.label_at[tokens] - offsets_of(size)[:-1], size) + np.arange(int(size.sum()))]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_edge_map": None, "_bounds_list": None}


def encoded(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """doc_id, n_tokens, tokens, and with `check` round_trip: whether decoding gives the text's own bytes.
    One scan, no shuffle; the automaton is broadcast, at a size set by the vocabulary."""
    spark = docs.sparkSession
    automaton = spark.sparkContext.broadcast(Automaton.from_file(_path(spark, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            tokens, counts = a.encode_texts(texts)
            columns, names = [batch.column("doc_id"), pa.array(counts, pa.int64()), list_array(tokens, counts)], ["doc_id", "n_tokens", "tokens"]
            if check:
                data, offsets = byte_buffer(texts)
                spelled = a.decode(tokens)
                same = np.diff(offsets) == np.diff(offsets_of(a.lengths[tokens].astype(np.int64))[offsets_of(counts)])
                if same.all():
                    bad = np.flatnonzero(data[offsets[0] : offsets[-1]] != spelled) + offsets[0]
                    same[np.searchsorted(offsets, bad, side="right") - 1] = False
                columns.append(pa.array(same))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names)

    return identified(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>" + ", round_trip boolean" * check)


def decoded(coded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """doc_id, text. Null tokens give the empty text; bytes that aren't UTF-8 are replaced."""
    spark = coded.sparkSession
    automaton = spark.sparkContext.broadcast(Automaton.from_file(_path(spark, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for batch in batches:
            texts = [a.decode(np.array(t, np.int64)).tobytes().decode("utf-8", "replace") if t else "" for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).alias("tokens")).mapInArrow(run, "doc_id long, text string")
