"""Token ids, language-model scoring, top-k search, BPE, toxicity, language ID."""

import base64
import dataclasses
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import bpe, language_id, lm_score, token_ids, topk_search, toxicity
from tests.llm.conftest import ODD

LIVE = [r for r in ODD if r[0] is not None]


def wide(df):
    return df.withColumn("h", F.lit(1)).withColumn("token", F.lit("x")).withColumn("ids", F.lit(2)).withColumn("n", F.lit(None).cast("int")).withColumn("y", F.lit(0))


# --- token ids ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 40) - 1), st.sampled_from([255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24])), max_size=20), max_size=8))
def test_variable_length_coding(docs):
    counts = np.array([len(d) for d in docs], np.int64)
    control, control_at, data, data_at = token_ids.encode_ids(np.array([i for d in docs for i in d], np.int64), counts)
    assert token_ids.decode_ids(control, data, counts).tolist() == [i for d in docs for i in d]
    for k, d in enumerate(docs):
        own, bits = data[data_at[k] : data_at[k + 1]], control[control_at[k] : control_at[k + 1]]
        assert len(bits) == -(-len(d) // 4) and len(own) == sum(1 if i < 1 << 8 else 2 if i < 1 << 16 else 3 if i < 1 << 24 else 5 for i in d)
        assert token_ids.decode_ids(bits, own, counts[k : k + 1]).tolist() == d


def tokens_by_force(text):
    out = []
    for line in (text or "").split("\n"):
        out += [*line.split(" "), "\n"]
    return out[:-1] if text else []


@pytest.mark.parametrize("piece", [400, token_ids.PIECE_BYTES])
def test_token_round_trip(small, odd, empty, monkeypatch, piece):
    monkeypatch.setattr(token_ids, "PIECE_BYTES", piece)
    for docs in (small.where("doc_id < 60"), odd, empty):
        coded, vocabulary = token_ids.encoded_with(wide(docs))
        rows = coded.collect()
        assert all(r["round_trip"] for r in rows)
        want = sorted((r["doc_id"], r["text"] or "") for r in docs.where("doc_id IS NOT NULL").collect())
        assert sorted(map(tuple, token_ids.decoded(coded, vocabulary).collect())) == want
        assert sorted((r["doc_id"], r["n_ids"]) for r in rows) == sorted((i, len(tokens_by_force(t))) for i, t in want)


@pytest.mark.parametrize("piece", [2_000, token_ids.PIECE_BYTES])
def test_ids_are_ranks_by_frequency(small, monkeypatch, piece):
    """Of all tokens of all documents."""
    monkeypatch.setattr(token_ids, "PIECE_BYTES", piece)
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    n = Counter(t for text in texts.values() for t in tokens_by_force(text))
    rank = {t: i for i, t in enumerate(sorted(n, key=lambda t: (-n[t], t.encode())))}
    coded, vocabulary = token_ids.encoded_with(small)
    assert {bytes(r["token"]).decode(): (r["n"], r["id"]) for r in vocabulary.collect()} == {t: (n[t], rank[t]) for t in n}
    for r in coded.collect():
        ids = token_ids.decode_ids(np.frombuffer(r["control"], np.uint8), np.frombuffer(r["data"], np.uint8), np.array([r["n_ids"]]))
        assert ids.tolist() == [rank[t] for t in tokens_by_force(texts[r["doc_id"]])]


# --- language model ---


def random_model(n, seed):
    """A tree with n words, and random parameters."""
    rng = np.random.default_rng(seed)
    m = lm_score.start(pa.array([b"%d" % k for k in range(n)], pa.binary()), np.array([50, 0, *range(2 * n, n, -1)], float))
    for x in (m.r, m.c, m.q, m.b):
        x += rng.normal(0, 0.3, x.shape).astype(np.float32)
    return m


def log_softmax(x):
    return x - np.log(np.exp(x).sum())


def of_one(m, before, words):
    """Log-probabilities of the words, each after the same context, the nearest word first."""
    scorer = lm_score.Scorer(m)
    return np.array([scorer.log_probs(np.array([*before[::-1], w]), np.array([lm_score.CONTEXT]))[0] for w in words])


def test_probabilities_without_a_tree():
    m = random_model(4, 0)
    for before in itertools.product(range(6), repeat=3):
        ids = [k for k in range(6) if k != 1]
        p = of_one(m, before, ids)
        h = sum(m.r[w] @ m.c[k * lm_score.DIMS : (k + 1) * lm_score.DIMS] for k, w in enumerate(before))
        assert abs(np.exp(p).sum() - 1) < 1e-4 and np.allclose(p, log_softmax(m.q[ids] @ h + m.b[ids]), atol=1e-4)


@pytest.mark.parametrize("scale", [1, 300])
def test_scores_of_a_sequence_are_those_of_its_words(scale):
    """Over two texts; large parameters exceed a float's range."""
    m = random_model(lm_score.HEAD + 40, 4)
    m.b[:] *= scale
    ids, counts = np.array([5, 0, 90, 100, 2, 7, 80]), np.array([5, 0, 2])
    p = lm_score.Scorer(m).log_probs(lm_score.led(ids), lm_score.places_of(counts))
    assert np.isfinite(p).all()
    for text, at in ((ids[:5], 0), (ids[5:], 5)):
        for k, w in enumerate(text):
            before = [*text[max(0, k - 3) : k][::-1], 1, 1, 1][:3]
            assert p[at + k] == pytest.approx(of_one(m, before, [w])[0], abs=1e-3 * scale)


@pytest.mark.parametrize("words", [lm_score.HEAD + 1, lm_score.HEAD + 500])
def test_probabilities_in_a_tree_by_force(words):
    """Every word's: its section's among head words and sections, its group's in the section, its own in the group."""
    m = random_model(words, 1)
    ids = [k for k in range(words + 2) if k != 1]
    assert m.head == lm_score.HEAD + 2 and m.width**3 >= words - lm_score.HEAD > (m.width - 1) ** 3
    for before in ((1, 1, 1), (0, 7, 1), (words, words + 1, 3)):
        p = of_one(m, before, ids)
        assert abs(np.exp(p).sum() - 1) < 1e-3
        h = sum(m.r[w] @ m.c[k * lm_score.DIMS : (k + 1) * lm_score.DIMS] for k, w in enumerate(before))
        logit = m.q @ h + m.b
        top = log_softmax(np.concatenate((logit[:1], logit[2 : m.head], logit[m.ids + m.groups :])))
        want = dict(zip([0, *range(2, m.head)], top))
        for s in range(m.sections):
            groups = range(s * m.width, min((s + 1) * m.width, m.groups))
            mid = log_softmax(logit[[m.ids + g for g in groups]])
            for g, share in zip(groups, mid):
                own = range(m.head + g * m.width, min(m.head + (g + 1) * m.width, m.ids))
                want |= {w: top[m.head - 1 + s] + share + x for w, x in zip(own, log_softmax(logit[list(own)]))}
        assert np.allclose(p, [want[k] for k in ids], atol=1e-3)


def test_contrastive_gradients_are_finite_differences(monkeypatch):
    """Of the loss as the definition has it: sigmoids of the score less the logarithm of the noise's expected number."""
    m = random_model(lm_score.HEAD + 60, 2)
    m = dataclasses.replace(m, **{n: getattr(m, n).astype(np.float64) for n in ("r", "c", "q", "b", "log_noise")})
    rng = np.random.default_rng(3)
    ids, place = np.array([9, 4, 70, 0, 5, 5, 100, 110, 111, 2]), np.array([5, 6, 7, 0, 1, 2, 3])
    word = ids[3:]
    before = [[ids[i + 2 - k] if k < place[i] else 1 for k in range(3)] for i in range(7)]
    t = lm_score.Trainer(m, 0)
    noise = [rng.choice(rows, 6) for rows, _ in t.noise]

    def loss(x):
        total = 0.0
        for which, (level, true) in enumerate(t.levels(word)):
            for i, row in zip(range(len(word)) if level is None else level, true):
                h = sum(x.r[w] @ x.c[k * lm_score.DIMS : (k + 1) * lm_score.DIMS] for k, w in enumerate(before[i]))
                score = lambda row: x.q[row] @ h + x.b[row] - x.log_noise[row] - math.log(6)
                total += np.log1p(np.exp(-score(row))) + sum(np.log1p(np.exp(score(k))) for k in noise[which])
        return total

    found = t.gradients(ids, place, noise)
    at, g = found.pop("qb")
    for name, (at, g) in (found | {"q": (at, g[:, :-1]), "b": (at, g[:, -1])}).items():
        full = np.zeros_like(getattr(m, name))
        full[at] = g
        entries = np.argwhere(full != 0)
        assert len(entries) > 10
        for entry in map(tuple, entries[rng.choice(len(entries), 12)]):
            moved = []
            for step in (1e-5, -1e-5):
                value = getattr(m, name).copy()
                value[entry] += step
                moved.append(loss(dataclasses.replace(m, **{name: value})))
            assert (moved[0] - moved[1]) / 2e-5 == pytest.approx(full[entry], rel=1e-3, abs=1e-6), name


def test_contexts():
    r = np.repeat(np.arange(10.0)[:, None], lm_score.DIMS, axis=1)
    counts = np.array([4, 0, 1, 1])
    got, missing = lm_score.contexts(r, lm_score.led(np.array([7, 8, 9, 4, 5, 6])), lm_score.places_of(counts))
    assert got[:, :: lm_score.DIMS].tolist() == [[1, 1, 1], [7, 1, 1], [8, 7, 1], [9, 8, 7], [1, 1, 1], [1, 1, 1]]
    assert [x.tolist() for x in missing] == [[0, 4, 5], [0, 1, 4, 5], [0, 1, 2, 4, 5]]


def test_training_beats_word_frequencies(spark):
    """Texts in which each word follows from the one before."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(30)]

    def text():
        k, out = int(rng.integers(30)), []
        for _ in range(60):
            out.append(words[k])
            k = (3 * k + 1) % 30 if rng.random() < 0.9 else int(rng.integers(30))
        return " ".join(out)

    docs = spark.createDataFrame([(k, text()) for k in range(3000)], "doc_id long, text string").repartition(2)
    fresh = spark.createDataFrame([(k, text()) for k in range(100)], "doc_id long, text string")
    shuffled = fresh.select("doc_id", F.array_join(F.shuffle(F.split("text", " ")), " ").alias("text"))
    model, _ = lm_score.fit(docs)
    total = lambda df: df.agg(F.sum("log_prob") / F.sum("n_tokens")).first()[0]
    trained = total(lm_score.scored(fresh, model))
    assert trained > -math.log(30) + 0.3  # the frequencies alone give the logarithm of 30
    assert trained > total(lm_score.scored(shuffled, model)) + 0.5


def test_mixing_in_a_tree_is_the_weighted_mean(spark, monkeypatch):
    """With many tasks, of which two at a time are mixed."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 40}" for j in range(1, 30))) for k in range(200)], "doc_id long, text string").repartition(7)
    flat, ids = lm_score.fit(docs)
    counts = np.concatenate(([0, 0], np.sort(np.bincount([(k * j) % 40 for k in range(200) for j in range(1, 30)])[:])[::-1])).astype(float)
    counts = counts[: len(flat.words) + 2]
    once = lm_score.trained(ids, lm_score.start(flat.words, counts), counts)
    monkeypatch.setattr(lm_score, "FAN", 2)
    tree = lm_score.trained(ids, lm_score.start(flat.words, counts), counts)
    assert ids.rdd.getNumPartitions() > 1
    for n in ("r", "c", "q", "b"):
        assert np.allclose(getattr(once, n), getattr(tree, n), atol=5e-3)
    assert np.abs(once.r - lm_score.start(flat.words, counts).r).max() > 0.05


def test_scores_of_odd_rows(odd, empty):
    got = defaultdict(list)
    for r in lm_score.scored(wide(odd)).collect():
        got[r["doc_id"]].append((r["n_tokens"], r["log_prob"], r["mean_log_prob"]))
    assert sorted(k for k, v in got.items() for _ in v) == sorted(i for i, *_ in LIVE)
    assert got[1] == got[2] == got[3] == [(0, 0.0, None)]
    assert got[9][0] == got[9][1] and got[5] == got[6]
    assert got[11][0][0] == 120_000
    assert all(p < 0 and abs(m * n - p) < 1e-6 * abs(p) for v in got.values() for n, p, m in v if n)
    assert lm_score.scored(empty).count() == 0


def test_spellings_add_up_to_one():
    words = [b"ab", b"abc", b"b", "é".encode()]
    key, each = lm_score._trigrams(pa.array(words, pa.binary()))
    assert each.tolist() == [3, 4, 2, 3]
    listed = pa.array([b"a", b"ab"], pa.binary())
    s = lm_score.Speller(*np.unique(key, return_counts=True), listed)
    for before in [(256, 256), (256, 97), (97, 98), (120, 121), (256, 195)]:
        p = s.probs((before[0] * 257 + before[1]) * 257 + np.arange(257))
        assert abs(p.sum() - 1) < 1e-9 and (p[:256] > 0).all() and (p[256] > 0) == (before != (256, 256))
    full = lm_score.Speller(*np.unique(key, return_counts=True), pa.array([], pa.binary()))
    share = np.exp(full.log_probs(listed)).sum()
    assert np.allclose(s.log_probs(pa.array([b"abc", b"zz"], pa.binary())), full.log_probs(pa.array([b"abc", b"zz"], pa.binary())) - math.log(1 - share))


def test_rare_words_are_modelled_and_junk_is_unlikely(spark):
    """Two languages with many more words than HEAD, in texts that stay within one; held-out texts, and junk of words that occur nowhere."""
    rng = np.random.default_rng(5)
    syllables = ["ba", "re", "ti", "lo", "mu", "sa", "ne", "ki", "do", "vu"], ["sch", "eit", "ung", "och", "ben", "zur", "wer", "all", "mit", "fen"]
    words = [["".join(rng.choice(s, 5)) for _ in range(3000)] for s in syllables]
    text = lambda lang: " ".join(rng.choice(words[lang], 60))
    junk = lambda: " ".join("".join(rng.choice(list("qxzjwvkp0123456789"), 10)) for _ in range(60))
    rows = [(k, text(k % 2)) for k in range(4000)] + [(k, junk()) for k in range(4000, 5500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model, _ = lm_score.fit(docs)
    assert len(model.words) >= 0.9 * len(set(words[0] + words[1])) > 4 * lm_score.HEAD
    held = spark.createDataFrame([(k, text(k % 2)) for k in range(100)] + [(k, junk()) for k in range(100, 200)], "doc_id long, text string")
    mean = {r["doc_id"]: r["mean_log_prob"] for r in lm_score.scored(held, model).collect()}
    clean, bad = [mean[k] for k in range(100)], [mean[k] for k in range(100, 200)]
    assert min(clean) > max(bad) + 3
    n = Counter(w for _, t in rows for w in t.split())
    total = sum(n.values())
    tokens = [w for r in held.where("doc_id < 100").collect() for w in r["text"].split()]
    assert np.mean(clean) > np.mean([math.log(n[w] / total) for w in tokens])  # frequencies alone
    mixed = spark.createDataFrame([(k, " ".join(x for pair in zip(text(0).split(), text(1).split()) for x in pair)) for k in range(100)], "doc_id long, text string")
    assert np.mean([r["mean_log_prob"] for r in lm_score.scored(mixed, model).collect()]) < np.mean(clean)


# --- search ---


def ranked_by_force(rows, queries, k):
    docs = [(i, Counter((t or "").lower().split())) for i, t in rows if i is not None]
    df = Counter(w for _, c in docs for w in c)
    mean = sum(sum(c.values()) for _, c in docs) / len(docs) if docs else 0
    out = []
    for q, text in queries:
        found = []
        for i, c in docs:
            n = sum(c.values())
            terms = [(w, m) for w, m in Counter((text or "").lower().split()).items() if w in c]
            if terms:
                s = sum(m * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (topk_search.K1 + 1) / (c[w] + topk_search.K1 * (1 - topk_search.B + topk_search.B * n / mean)) for w, m in terms)
                found.append((-round(s, 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize(("shard_bytes", "query_bytes", "short"), [(1, 1 << 20, 0), (20_000, 800, 2), (topk_search.SHARD_BYTES, topk_search.QUERY_BYTES, topk_search.SHORT)])
def test_search_is_exact(spark, small, shard_bytes, query_bytes, short, monkeypatch):
    monkeypatch.setattr(topk_search, "SHORT", short)
    monkeypatch.setattr(topk_search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(topk_search, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    queries = [(k, " ".join(t.split()[3:11])) for k, (_, t) in enumerate(rows[:40])] + [(90, ""), (91, "zzzz"), (92, "the the the")]
    got = topk_search.search(small, spark.createDataFrame(queries, "item_id long, text string"), 5).collect()
    want = ranked_by_force(rows, queries, 5)
    assert len(got) == len(want)
    scores = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got}
    everything = {(q, i): s for q, _, i, s in ranked_by_force(rows, queries, len(rows))}
    for q, r, i, s in want:
        assert abs(scores[q, r][1] - s) < 2e-6
        # another document only where the sixth digit depends on the order of the sum
        assert scores[q, r][0] == i or abs(everything[q, scores[q, r][0]] - s) < 2e-6
    tied = sorted((r["item_id"], r["rank"], r["score"], r["doc_id"]) for r in got)
    assert all(a[3] < b[3] for a, b in itertools.pairwise(tied) if a[0] == b[0] and a[2] == b[2])


@pytest.mark.parametrize("short", [0, 64, 10_000])
def test_search_skips_postings(monkeypatch, short):
    """A few documents match a rare word; the lists of common words are hardly read. The results are those of the whole."""
    monkeypatch.setattr(topk_search, "SHORT", short)
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["the", "of", "and", "to", *(f"w{k}" for k in range(400))], 40, p=[0.1] * 4 + [0.6 / 400] * 400)) for _ in range(4000)]
    for k in range(0, 4000, 300):
        texts[k] += " rare rare word"
    b = topk_search.Builder()
    for at in range(0, 4000, 700):
        b.add(np.arange(at, min(at + 700, 4000)) * 3, pa.array(texts[at : at + 700]))
    row, asked = b.row().to_pylist()[0], pa.array(sorted(x.encode() for x in ("the", "of", "rare", "word", "w7", "nowhere")), pa.binary())
    df = Counter(w for t in texts for w in set(t.split()))
    stats = topk_search.Statistics(4000, np.mean([len(t.split()) for t in texts]), np.array([df[w.decode()] for w in asked.to_pylist()]))
    shard = topk_search.Shard(row, asked, stats)
    ids, scores = shard.search(np.arange(len(asked)), np.ones(len(asked)), 5)
    query = " ".join(w.decode() for w in asked.to_pylist())
    want = ranked_by_force([(3 * k, t) for k, t in enumerate(texts)], [(0, query)], 5)
    assert ids[np.lexsort((ids, -scores))].tolist() == [i for *_, i, _ in want] and sorted(-scores) == pytest.approx(sorted(-s for *_, s in want), abs=2e-6)
    assert 0 < shard.scored < 0.25 * sum(df[w.decode()] for w in asked.to_pylist())
    terms = topk_search._terms(row).to_pylist()
    assert terms == sorted(w.encode() for w in df)  # every term of the corpus


def test_search_of_odd_rows(spark, odd, empty):
    queries = spark.createDataFrame([(1, "the CAT sat"), (2, None), (None, "the"), (3, "unrelated lorem")], "item_id long, text string")
    got = [(r["item_id"], r["rank"], r["doc_id"]) for r in topk_search.search(wide(odd), queries, 3).collect()]
    assert sorted(got) == [(1, 1, 5), (1, 2, 6), (1, 3, 7), (3, 1, 11), (3, 2, 9), (3, 3, 9)]
    assert topk_search.search(empty, queries).count() == 0
    assert topk_search.search(odd, queries.limit(0)).count() == 0


# --- BPE ---


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton.from_file()


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(automaton, texts):
    tokens, counts = automaton.encode_texts(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    return [tokens[e - n : e].tolist() for e, n in zip(ends, counts)]


def test_tokens_are_the_librarys(automaton, library, small):
    texts = [r["text"] for r in small.collect()] + [t or "" for _, t, *_ in ODD if not t or len(t) < 10_000] + ["a" * 300, "don't they'LL we've\t\n\n  x  ", "１２３ ٣٤٥ é ​", "=" * 200 + " " * 50]
    assert encode(automaton, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abes '\n\tthing1290.,é東 dlv"), max_size=40), max_size=4))
def test_random_texts_are_the_librarys(automaton, library, texts):
    assert encode(automaton, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=50))
def test_decoding_spells_the_text(automaton, text):
    (tokens,) = encode(automaton, [text])
    assert automaton.decode(np.array(tokens, np.int64)).tobytes().decode() == text


def pairs_merged(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if r == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("seed", range(12))
def test_automata_of_small_vocabularies(seed):
    """Made-up merges over few letters, where every gadget meets every other; all words up to a length."""
    rng = np.random.default_rng(seed)
    tokens = [bytes([b]) for b in range(256)]
    for _ in range(25):
        pool = [t for t in tokens if set(t) <= set(b"abc")]
        new = pool[rng.integers(len(pool))] + pool[rng.integers(len(pool))]
        if new not in tokens and len(new) <= 6:
            tokens.append(new)
    ranks = {t: i for i, t in enumerate(tokens)}
    a = bpe.Automaton(tokens, bpe.merges_of(tokens))
    words = [bytes(w) for n in range(1, 8) for w in np.array(np.meshgrid(*[list(b"abc")] * n)).reshape(n, -1).T.tolist()]
    flat, offsets = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in words])))
    out, counts = a.encode_words(flat, offsets)
    ends = np.cumsum(counts)
    for k, w in enumerate(words):
        want = pairs_merged(w, ranks)
        assert out[ends[k] - counts[k] : ends[k]].tolist() == want
        assert a.encode_word(w) == want


def test_the_rank_file_is_a_setting(spark, odd):
    spark.conf.set(bpe.SETTING, "/no/such/file")
    try:
        with pytest.raises(FileNotFoundError, match=bpe.SETTING):
            bpe.encoded(odd)
    finally:
        spark.conf.unset(bpe.SETTING)


def test_bpe_of_odd_rows(odd, empty):
    rows = bpe.encoded(wide(odd)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, *_ in LIVE)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    back = bpe.decoded(bpe.encoded(odd)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((i, t or "") for i, t, *_ in LIVE)
    assert bpe.encoded(empty).count() == bpe.decoded(bpe.encoded(empty)).count() == 0


# --- toxicity ---


def made_up(n, seed, words=("idiot", "moron", "scumbag")):
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}{c}" for a in ("ba", "ko", "ti", "lu") for b in ("ra", "ne", "so") for c in ("m", "n", "t", "x", "y")]
    texts, labels = [], []
    for k in range(n):
        body = list(rng.choice(plain, int(rng.integers(20, 120))))
        toxic = k % 3 == 0
        if toxic:
            for _ in range(2 + len(body) // 40):
                body.insert(int(rng.integers(len(body))), str(rng.choice(words)))
        texts.append(" ".join(body))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def judge():
    return toxicity.train(*made_up(900, 1))


def test_held_out_texts(judge):
    texts, labels = made_up(600, 2)
    hit, y = judge.score(pa.array(texts)) >= judge.threshold, np.array(labels)
    assert hit[y == 1].mean() >= 0.95 and hit[y == 0].mean() <= 0.02


def test_unseen_misspellings(judge):
    texts, labels = made_up(600, 3, ("idiott", "moronn", "xscumbag", "iidiot", "scumbagg"))
    hit, y = judge.score(pa.array(texts)) >= judge.threshold, np.array(labels)
    assert hit[y == 1].mean() >= 0.8 and hit[y == 0].mean() <= 0.02


def buckets_by_force(word):
    """One n-gram at a time, in whole numbers."""
    raw, out = b"<" + word.encode() + b">", []
    for k in toxicity.NGRAMS:
        for at in range(len(raw) - k + 1):
            h = 0
            for c in raw[at : at + k]:
                h = h * 0x01000193 % (1 << 32) ^ c
            x = ((h ^ h >> 15) * 0x2C1B3C6D + k - 1) % (1 << 32)
            out.append((x ^ x >> 13) % toxicity.BUCKETS)
    whole = sum((c + 1) * pow(0x100000001B3, at, 1 << 64) for at, c in enumerate(raw)) % (1 << 64)
    whole = (whole ^ whole >> 31) * 0x9E3779B97F4A7C15 % (1 << 64)
    return [*out, (whole >> 40) % toxicity.BUCKETS]


def test_toxicity_by_force(judge):
    """Every word the mean of its n-grams, a text the weighted mean of its words and of PRIOR words of no meaning."""
    texts = made_up(40, 9)[0] + ["", "idiot", "idiot idiot idiot the naïve 東京", "x " * 3000]
    for t, got in zip(texts, judge.score(pa.array(texts))):
        weight = {w: math.sqrt(n) for w, n in Counter(t.lower().split()).items()}
        mean = sum(v * np.mean([float(judge.weight[b]) for b in buckets_by_force(w)]) for w, v in weight.items()) / (sum(weight.values()) + toxicity.PRIOR)
        assert got == pytest.approx(1 / (1 + math.exp(-(toxicity.GAIN * mean + judge.bias))) if weight else 0, abs=1e-9)


def test_features_of_words_stand_apart():
    words = pa.array(["the", "thé", "a", "toxic"], pa.string())
    bucket, each = toxicity.features(words)
    at = np.concatenate(([0], np.cumsum(each)))
    for k in range(4):
        alone, n = toxicity.features(words.slice(k, 1))
        assert n[0] == each[k] and alone.tolist() == bucket[at[k] : at[k + 1]].tolist()


def test_toxicity_of_odd_rows(spark, odd, empty, judge):
    labels = spark.createDataFrame([(5, 1), (5, 0), (9, 0), (9, None), (None, 1), (777, 1), (10, 0)], "doc_id long, toxic int")
    for out in (toxicity.scored(wide(odd), labels), toxicity.scored(odd, model=judge)):
        rows = {r["doc_id"]: r for r in out.collect()}
        assert set(rows) == {i for i, *_ in LIVE}
        assert all(rows[i]["toxicity"] == 0 and not rows[i]["toxic"] for i in (1, 2, 3))
        assert all(0 <= r["toxicity"] <= 1 for r in rows.values())
    one_class = toxicity.scored(odd, labels.where("doc_id <> 5"))
    assert {(r["toxicity"], r["toxic"]) for r in one_class.collect()} == {(0.0, False)}
    assert toxicity.scored(empty, labels).count() == 0
    assert toxicity.scored(odd, labels.limit(0)).where("toxic").count() == 0


# --- language ID ---


def test_languages_of_the_test_table(spark):
    import os

    at = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    docs = spark.read.parquet(at)
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    kept = [r for r in rows if not r["rejected"]]
    assert len(rows) == docs.count() and len(kept) >= 0.97 * len(rows)
    assert sum(r["language"] == r["lang"] for r in kept) >= 0.98 * len(kept)


def test_languages_by_force(spark, small):
    """Every text, block by block, with a compressor made for the block; the smallest sum, and how narrow it is."""
    import zstandard

    dictionaries = language_id.fit(small)
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()] + [(10_001, "bien " * 4000 + "the end"), (10_002, "1")]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), dictionaries).collect()}
    for i, text in rows:
        raw, sizes = text.lower().encode(), []
        for name, d in dictionaries.items():
            params = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, source_size=language_id.BLOCK, dict_size=len(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            coder = lambda: zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))  # noqa: B023, E731
            sizes.append((sum(len(coder().compress(raw[k : k + language_id.BLOCK])) for k in range(0, len(raw), language_id.BLOCK)), name))
        (best, name), (second, _) = sorted(sizes)[:2]
        margin = (second - best) / second
        want = (None, 0.0, True) if not text.strip() else (name, margin, margin <= language_id.MIN_MARGIN)
        assert (got[i]["language"], got[i]["margin"], got[i]["rejected"]) == pytest.approx(want) if want[0] else got[i]["rejected"], i


def test_dictionaries_hold_whole_texts(table):
    docs = table([(k, f"text {k} " + "äx" * (10 * k), "de", "s") for k in range(12)] + [(50, "y" * 5000, "fr", "s"), (51, "z" * 6000, "fr", "s"), (52, "", "en", "s")])
    found = language_id.fit(docs, dictionary_bytes=600)
    assert set(found) == {"de", "fr"} and found["fr"] == b"y" * 5000
    texts = {r["text"] for r in docs.collect()}
    assert 300 < len(found["de"]) <= 600 and set(found["de"].decode().split("\n")) <= texts


def test_language_of_odd_rows(odd, empty):
    rows = {r["doc_id"]: r for r in language_id.identify(wide(odd)).collect()}
    assert set(rows) == {i for i, *_ in LIVE}
    assert all(rows[i]["language"] is None and rows[i]["rejected"] and rows[i]["margin"] == 0 for i in (1, 2, 3))
    stay = language_id.accepted(wide(odd))
    assert stay.columns == wide(odd).columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(i for i, *_ in LIVE if not rows[i]["rejected"])
    assert language_id.identify(empty).count() == language_id.accepted(empty).count() == 0
    assert language_id.identify(odd, {}).where("not rejected").count() == 0
