"""What must not grow with the input in a single task, row or worker."""

import numpy as np
import pytest

from siltstone import registry
from siltstone.catalog import Manifest
from siltstone.fs import Files
from siltstone.functions import stats
from siltstone.operators import joins, text
from siltstone.session import Session
from siltstone.sources import mixed


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exact_counts_stand_apart_from_sketches(spark, tmp_path):
    rows = [(i % 700, i % 30 or None, i % 3) for i in range(3000)]
    for name, kept in (("some", rows), ("none", [])):
        spark.createDataFrame(kept, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        df = registry.QUERIES["approx_ndv_within_tolerance"](spark, f"{tmp_path}/{name}")
        want = [(f"l_{c}key", len({r[i] for r in kept} - {None}), True) for i, c in enumerate(("order", "part", "supp"))]
        assert sorted(map(tuple, df.collect())) == sorted(want)
        # a value's row in the aggregate of all at once would have held the registers of three sketches
        assert "Expand" not in plan_of(df)


def test_statistics_of_files_sort_no_rows(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"t{i % 9}") for i in range(100)], "k long, t string").repartition(3).write.parquet(f"{tmp_path}/x")
    df, plans = spark.read.parquet(f"{tmp_path}/x"), []
    own = type(df).toLocalIterator
    monkeypatch.setattr(type(df), "toLocalIterator", lambda self, *a, **k: plans.append(self._jdf.queryExecution().executedPlan().toString()) or own(self, *a, **k))
    found = stats.file_stats(df)
    assert len(plans) == 1 and "Sort" not in plans[0]
    assert sum(s["rows"] for s in found.values()) == 100 and {s["stats"]["t"]["min"] for s in found.values()} == {"t0"}


@pytest.mark.parametrize("name", ["manifest_prune_equiv", "iceberg_read"])
def test_a_larger_table_has_more_files_of_the_same_size(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(registry, "FILE_ROWS", 500)
    df = registry.QUERIES[name](spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(df.columns)
    want = lines.where("l_orderkey < 1000") if name == "manifest_prune_equiv" else lines
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    made = registry._made[-1]
    files = [p for p, _ in registry.Files(spark).data_files(f"{made}/data/live" if name == "iceberg_read" else made)]
    assert len(files) == -(-lines.count() // 500)


def test_embedders_get_few_texts_at_a_time(spark):
    class Counting:
        def embed(self, texts):
            assert len(texts) <= 512
            return [[float(len(t)), 1.0] for t in texts]

    chunks = spark.range(0, 1500, 1, 1).selectExpr("id", "repeat('x', cast(id % 7 as int)) AS text")
    rows = text.embedded(chunks, Counting()).collect()
    assert sorted((r["id"], r["text"], tuple(r["embedding"])) for r in rows) == [(i, "x" * (i % 7), (i % 7, 1.0)) for i in range(1500)]
    vectors = text.HashEmbedder(4).embed(["a", ""])
    assert vectors[1] == [0.0] * 4 and abs(sum(x * x for x in vectors[0]) - 1) < 1e-12


@pytest.mark.parametrize("piece", [100_000, 7])
def test_totals_in_range(spark, monkeypatch, piece):
    monkeypatch.setattr(joins, "PIECE_ROWS", piece)
    rng = np.random.default_rng(piece)
    points = [None if i == 3 else float(rng.integers(-20, 20)) for i in range(90)] + [1e17, 0.0, -0.0]
    ranges = [(i, float(a), float(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-25, 20, 40), rng.integers(-2, 30, 40)))] + [(90, None, 1.0), (91, 0.0, None), (92, -0.0, 0.0), (92, -0.0, 0.0), (93, float("-inf"), float("inf"))]
    got = joins.totals_in_range(spark.createDataFrame([(x,) for x in points], "x double"), spark.createDataFrame(ranges, "r long, low double, high double"), "x", "low", "high")
    inside = [(r, a, z, [x for x in points if None not in (x, a, z) and a <= x <= z]) for r, a, z in ranges]
    assert sorted(map(tuple, got.collect())) == sorted((r, a, z, len(x), sum(x)) for r, a, z, x in inside if x)
    assert "x" not in got.columns


def test_corpora_embed_few_texts_at_a_time(spark, tmp_path):
    class Counting:
        def embed(self, texts):
            assert len(texts) <= 512
            return [[1.0] for _ in texts]

    session = Session(spark, str(tmp_path), embedder=Counting())
    assert session.ingest_corpus("c", spark.createDataFrame([(i, "x" * 100) for i in range(1200)], "doc_id long, text string").coalesce(1)) == 1200


def test_paths_of_files_with_values(spark, tmp_path):
    for k in range(3):
        spark.range(k, k + 1, 1, 1).write.parquet(f"{tmp_path}/p={k}")
    files = [p for k in range(3) for p, _ in Files(spark).data_files(f"{tmp_path}/p={k}")]
    odd = [files[0], files[1].replace("/p=1/", "//p=1/"), files[2].replace("/p=2/", "/./p=2/")]
    schema = "id long, p long"
    for paths in (files, odd):
        df = mixed.read(spark, spark.createDataFrame([], schema).schema, [Manifest(p, "delta", {"p": k}) for k, p in enumerate(paths)])
        assert sorted(map(tuple, df.collect())) == [(0, 0), (1, 1), (2, 2)]


def test_corpora_cut_and_embed_in_one_worker(spark, tmp_path):
    rows = [(i, None if i == 3 else " " * (i % 2) + "añ b. " * (i * i * 9)) for i in range(40)] + [(40, "short one")] * 700
    docs, embedder = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), text.HashEmbedder(16)
    both, one = text.embedded(text.chunked(docs), embedder), text.chunked(docs, embedder=embedder)
    assert both.schema == one.schema
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, one.collect()))
    assert plan_of(one).count("MapInArrow") == 1
    session, plans = Session(spark, str(tmp_path), embedder=embedder), []
    own = type(docs).mapInArrow
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, *a, **k: plans.append(own(self, *a, **k)) or plans[-1])
        assert session.ingest_corpus("c", docs) == one.count()
    assert len(plans) == 1
    got = session.corpora.chunks("c").select("doc_id", "chunk_index", "text", "embedding")
    want = both.selectExpr("cast(doc_id as string)", "chunk_index", "text", "embedding")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
