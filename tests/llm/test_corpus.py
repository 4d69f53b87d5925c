"""Exact dedup, n-gram join, mixing, sharding."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, mixing, ngram_join, packing
from tests.llm.conftest import ODD

LIVE = [r for r in ODD if r[0] is not None]


def clashing(df):
    """Further columns, named like what operators use inside."""
    return df.withColumn("digest", F.lit(1)).withColumn("_row", F.lit("x")).withColumn("times", F.lit(2)).withColumn("a", F.lit(None).cast("int")).withColumn("size", F.lit(3)).withColumn("node", F.lit(5)).withColumn("g", F.lit(7)).withColumn("gone", F.lit(8)).withColumn("h", F.lit(9)).withColumn("_id2", F.lit(1))


# --- exact dedup ---


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 50_000])
def test_perfect_hash(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    h = exact_dedup.PerfectHash.build(digests)
    again = exact_dedup.PerfectHash.from_bytes(*h.to_bytes())
    assert sorted(h.slots(digests).tolist()) == list(range(n)) == sorted(again.slots(digests).tolist())
    other = np.frombuffer(b"".join(hashlib.sha256(b"x%d" % i).digest() for i in range(500)), np.uint8).reshape(-1, 32)
    assert (h.slots(other) < max(n, 1)).all()


def test_a_lookup_compares_all_bytes():
    keys = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(100)), np.uint8).reshape(-1, 32)
    row = exact_dedup._build(pa.table({"shard": [0] * 100, "digest": [k.tobytes() for k in keys], "doc_id": list(range(100))})).to_pylist()[0]
    near = keys.copy()
    near[:, 31] ^= 1
    both = np.concatenate((keys, near))
    winner, found = exact_dedup.lookup(both, row["sizes"], row["bits"], row["digests"], row["winners"])
    assert found.tolist() == [True] * 100 + [False] * 100
    assert winner[:100].tolist() == list(range(100))


def least_of_equals(rows):
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = min(best.get(t or "", i), i)
    return sorted(best.values())


@pytest.mark.parametrize("until", [None, -100, 0, 5, 1000])
def test_one_of_equal_texts_stays(odd, until):
    assert sorted(r["doc_id"] for r in exact_dedup.kept(odd, until).collect()) == least_of_equals(LIVE)
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicated(odd, until).collect()) == least_of_equals(LIVE)


def test_repeated_digests_are_an_error():
    digest = np.frombuffer(hashlib.sha256(b"x").digest() * 2, np.uint8).reshape(-1, 32)
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.build(digest)


@pytest.mark.parametrize("until", [None, -100, 5, 1000])
def test_winners_and_copies_by_force(odd, until):
    best = {}
    for i, t, *_ in LIVE:
        best[t or ""] = min(best.get(t or "", i), i)
    assert sorted(map(tuple, exact_dedup.winners(clashing(odd), until).collect())) == sorted((i, best[t or ""]) for i, t, *_ in LIVE)
    assert {r["doc_id"]: r["copies"] for r in exact_dedup.kept(odd, until).collect()} == Counter(best[t or ""] for _, t, *_ in LIVE)


def test_dedup_with_and_without_broadcast(odd, monkeypatch):
    from siltstone.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicated(odd).collect()) == least_of_equals(LIVE)
    assert Counter(r["doc_id"] for r in ngram_join.one_of_each(odd).collect())[5] == 1
    sorted_links = sorted(map(tuple, ngram_join.joined(odd).collect()))
    monkeypatch.undo()
    assert sorted(map(tuple, ngram_join.joined(odd).collect())) == sorted_links


def test_dedup_keeps_columns_and_works_on_nothing(odd, empty):
    wide = clashing(odd)
    out = exact_dedup.deduplicated(wide)
    assert out.columns == wide.columns and out.count() == len(least_of_equals(LIVE))
    assert exact_dedup.kept(empty).count() == exact_dedup.deduplicated(empty).count() == 0


def test_dedup_of_the_test_table(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert sorted(r["doc_id"] for r in exact_dedup.kept(small).collect()) == least_of_equals(rows)


# --- n-gram join ---


def grams(text, n=ngram_join.N):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def pairs_by_force(rows, threshold=ngram_join.THRESHOLD):
    docs = sorted({(i, t or "") for i, t in rows if i is not None})
    sets = [(i, grams(t)) for i, t in docs]
    out = {}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and a != b and (s := len(x & y) / len(x | y)) >= threshold:
            out[min(a, b), max(a, b)] = s
    return out


def pairs_found(docs, **more):
    """Pairs of documents, from the pairs of those that stand for equal sets."""
    same = defaultdict(set)
    for r in docs.select("doc_id", "text").collect():
        if r["doc_id"] is not None and (g := frozenset(grams(r["text"]))):
            same[g].add(r["doc_id"])
    group = {min(ids): ids for ids in same.values()}
    out = {p: 1.0 for ids in same.values() for p in itertools.combinations(sorted(ids), 2)}
    for r in ngram_join.similar_pairs(docs, **more).collect():
        assert r["doc_id_a"] < r["doc_id_b"]
        out |= {(min(a, b), max(a, b)): r["jaccard"] for a in group[r["doc_id_a"]] for b in group[r["doc_id_b"]]}
    return out


def classes_and_links(rows, pairs):
    """What joined() should give for these pairs of documents."""
    ids = {(i, t or "") for i, t in rows if i is not None}
    root, links = components_by_force(pairs), Counter(x for p in pairs for x in p)
    return sorted((i, root.get(i, i), links[i]) for i, _ in ids)


def test_bands_reach_the_recall():
    for t in (0.005, 0.01, 0.3, 0.5, 0.7, 0.9, 1.0):
        bands, rows = ngram_join.banding(t, 0.95)
        assert 1 - (1 - t**rows) ** bands >= 0.95
    with pytest.raises(ValueError):
        ngram_join.banding(0, 0.95)


@pytest.mark.parametrize("seed", range(5))
def test_candidates_by_force(seed):
    rng = np.random.default_rng(seed)
    node, key = rng.integers(0, 12, 60), rng.integers(0, 9, 60)
    side = np.where(key % 2 == 0, 2, node % 2)  # a key's nodes are all of side 2, or none is
    _, once = np.unique(node * 100 + key, return_index=True)
    node, key, side = node[once], key[once], side[once]
    want = {(min(a, b), max(a, b)) for (a, k, s), (b, l, t) in itertools.combinations(zip(node.tolist(), key.tolist(), side.tolist()), 2) if k == l and (s == t == 2 or {s, t} == {0, 1})}
    got = ngram_join.candidates(node, key, side, 12).tolist()
    assert got == sorted(a * 12 + b for a, b in want)


def test_join_against_all_pairs(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    want = pairs_by_force(rows)
    got = pairs_found(small)
    assert want and set(got) <= set(want)
    assert len(got) >= 0.95 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert sorted(map(tuple, ngram_join.joined(small).collect())) == classes_and_links(rows, got)


def test_join_of_odd_rows(odd, empty):
    rows = [(i, t) for i, t, *_ in ODD]
    want = pairs_by_force(rows)
    assert pairs_found(odd) == pytest.approx(want)
    assert sorted(map(tuple, ngram_join.joined(clashing(odd)).collect())) == classes_and_links(rows, want)
    assert ngram_join.joined(empty).count() == ngram_join.similar_pairs(empty).count() == 0


def test_two_texts_under_one_id(table):
    text = " ".join(f"w{k}" for k in range(40))
    docs = table([(1, text, "en", "s"), (1, text.upper(), "en", "s"), (2, text + " w40", "en", "s"), (1, "quite another one", "en", "s"), (1, "quite another one", "en", "s")])
    assert sorted(map(tuple, ngram_join.joined(docs).collect())) == [(1, 1, 0), (1, 1, 2), (1, 1, 2), (2, 1, 2)]
    docs = docs.union(table([(0, text, "en", "s")]))
    assert [r["text"] for r in ngram_join.one_of_each(docs).orderBy("doc_id").collect()] == [text, "quite another one", "quite another one"]


@pytest.fixture
def many_near(spark):
    """300 copies that differ by a word each, with as many others; more than fit a block when BLOCK_DOCS is small."""
    base = [f"w{k}" for k in range(60)]
    near = [(k, " ".join(base[:k % 60] + [f"z{k}"] + base[k % 60 + 1 :])) for k in range(300)]
    other = [(1000 + k, " ".join(f"o{k}x{j}" for j in range(30))) for k in range(100)]
    return spark.createDataFrame(near + other, "doc_id long, text string")


def test_a_large_group_over_several_blocks(many_near, monkeypatch):
    want = pairs_by_force([tuple(r) for r in many_near.collect()])
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 32)
    got = pairs_found(many_near)
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert sorted(map(tuple, ngram_join.joined(many_near).collect())) == classes_and_links([tuple(r) for r in many_near.collect()], got)
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(many_near).collect()) == [0, *range(1000, 1100)]


def components_by_force(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 130)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == components_by_force(edges)


def test_one_of_each_group_stays(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    gone = set(components_by_force(pairs_found(small)))
    wide = clashing(small)
    out = ngram_join.one_of_each(wide)
    assert out.columns == wide.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in rows} - gone


def test_one_of_each_of_odd_rows(odd, empty):
    got = Counter(r["doc_id"] for r in ngram_join.one_of_each(odd).collect())
    assert got == Counter({-12: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 2, 10: 1, 11: 1})
    assert ngram_join.one_of_each(empty).count() == 0


# --- mixing ---


def shares_by_force(sizes, weights, budget, epochs):
    """Clamp what exceeds its cap, share the excess among the others in proportion, again and again."""
    live = {s for s in sizes if sizes[s] > 0 and weights[s] > 0}
    share, clamped = dict.fromkeys(sizes, 0.0), set()
    while live - clamped:
        left = budget - sum(share[s] for s in clamped)
        total = sum(weights[s] for s in live - clamped)
        for s in live - clamped:
            share[s] = max(0.0, left) * weights[s] / total
        over = {s for s in live - clamped if share[s] > epochs * sizes[s]}
        if not over:
            break
        for s in over:
            share[s] = epochs * sizes[s]
        clamped |= over
    return share


@pytest.mark.parametrize("seed", range(8))
def test_water_filling(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 8))
    sizes = {f"s{k}": float(rng.integers(0, 50)) for k in range(n)}
    weights = {s: float(rng.choice([0, 0.1, 1, 5, 40])) for s in sizes}
    budget = float(rng.choice([sum(sizes.values()), 10.0, 1e6]))
    want = shares_by_force(sizes, weights, budget, 3.0)
    df = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, size double, weight double")
    got = {r["source"]: r["repeats"] * sizes[r["source"]] for r in mixing.allocate(df, budget, 3.0).collect()}
    assert got == pytest.approx(want)


def test_copies_by_force(small):
    rows = small.select("doc_id", "source", "n_chars").collect()
    weights = {"src0": 3.0, "src1": 40.0}
    sizes = defaultdict(float)
    for r in rows:
        sizes[r["source"]] += r["n_chars"]
    share = shares_by_force(dict(sizes), {s: weights.get(s, 1.0) for s in sizes}, sum(sizes.values()), mixing.MAX_EPOCHS)
    want = Counter()
    for r in rows:
        repeats = share[r["source"]] / sizes[r["source"]]
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
        want[r["doc_id"]] = int(repeats) + (u < repeats - int(repeats))
    got = Counter(r["doc_id"] for r in mixing.copies(small, weights).collect())
    assert got == +want
    assert Counter(r["doc_id"] for r in mixing.mixed(small, weights).collect()) == got


def test_mixing_of_odd_rows(odd, empty, monkeypatch):
    wide = clashing(odd)
    first = mixing.mixed(wide, {None: 2.0, "s2": 0.0})
    assert first.columns == wide.columns
    rows = Counter(r["doc_id"] for r in first.collect())
    assert not {3, 4, 6} & set(rows) and 7 in rows
    monkeypatch.setattr(mixing, "MAP_SOURCES", 0)  # joined instead of a literal map
    assert Counter(r["doc_id"] for r in mixing.mixed(wide, {None: 2.0, "s2": 0.0}).collect()) == rows
    assert mixing.copies(empty).count() == mixing.mixed(empty).count() == 0


# --- sharding ---


def best_fit_by_force(sizes, capacity):
    """Sizes in decreasing order, one by one, into the tightest bin."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= s]
        if s > capacity:
            room.append(-1)
        elif fits:
            k = min(fits, key=lambda k: room[k])
            room[k] -= s
        else:
            room.append(capacity - s)
    return len(room), sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 25))
def test_plan_is_best_fit_decreasing(sizes, capacity):
    order = sorted(sizes, reverse=True)
    large = sum(s > capacity for s in sizes)
    rows = list(packing.plan(sorted(Counter(order[large:]).items(), reverse=True), capacity, large, large))
    load = {k: [order[k]] for k in range(large)}
    ends = [large, *(high for _, high, *_ in rows)]
    assert [low for low, *_ in rows] == ends[:-1] and ends[-1] == len(sizes)
    for low, high, first, each in rows:
        for k in range(low, high):
            load.setdefault(first + (k - low) // each, []).append(order[k])
    assert sorted(x for own in load.values() for x in own) == sorted(sizes) and set(load) == set(range(len(load)))
    room = sorted(-1 if sum(x) > capacity else capacity - sum(x) for x in load.values())
    assert all(sum(x) <= capacity or len([s for s in x if s]) == 1 for x in load.values())
    assert (len(load), room) == best_fit_by_force(sizes, capacity)


@pytest.mark.parametrize("piece", [3, 200_000])
def test_packing_of_the_test_table_by_force(small, monkeypatch, piece):
    """As many shards, as full, as one by one; groups of equal texts stay together."""
    monkeypatch.setattr(packing, "PIECE", piece)
    monkeypatch.setattr(packing, "BUCKET", 7)
    size, text = Counter(), {}
    for r in small.select("doc_id", "text").collect():
        text[r["doc_id"]] = r["text"]
        size[r["text"]] += len(r["text"].encode())
    shard = {r["doc_id"]: r["shard"] for r in packing.packed(small, 20_000).collect()}
    assert set(shard) == set(text)
    of = defaultdict(set)
    for i, t in text.items():
        of[t].add(shard[i])
    assert all(len(s) == 1 for s in of.values())
    load = Counter()
    for t, (s,) in of.items():
        load[s] += size[t]
    shards, room = best_fit_by_force(list(size.values()), 20_000)
    assert len(load) == shards and sorted(-1 if n > 20_000 else 20_000 - n for n in load.values()) == room


def test_the_tree_is_balanced():
    tree = packing.Remaining()
    for k in range(1000):
        tree.add(k, (k, 1))
    assert tree.root.height <= 15 and tree.tightest(500).key == 500
    for k in range(0, 1000, 2):
        tree.remove(k)
    assert tree.root.height <= 14 and tree.tightest(500).key == 501 and tree.tightest(1000) is None


def test_packing(odd, empty, small):
    got = packing.packed(clashing(odd), 100).collect()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["shard"])
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, *_ in LIVE)
    assert by[5] == by[6] == by[7] and by[1] == by[2] and all(len(s) == 1 for s in by.values())
    assert by[11].isdisjoint(by[-12])
    assert packing.packed(empty).count() == 0
    rows = small.select("doc_id", F.octet_length("text").alias("n"), "source").collect()
    size, shard = {r["doc_id"]: r["n"] for r in rows}, {r["doc_id"]: r["shard"] for r in packing.packed(small, 50_000).collect()}
    load = Counter()
    for i, s in shard.items():
        load[s] += size[i]
    assert set(shard) == set(size)
    whole = packing.packed(small, 1 << 40, "source").select("shard").distinct().count()
    assert whole == 1
    assert max(load.values()) <= max(50_000, max(size.values()) * 10)
