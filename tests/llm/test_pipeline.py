"""The pipeline's stages against brute force, and what the entry module registers."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siltstone.llm import bpe, language_id, queries
from tests.llm.conftest import ODD, SCHEMA
from tests.llm.test_corpus import clashing, components_by_force, least_of_equals, pairs_by_force, shares_by_force

pipeline = pytest.importorskip("corpus_pipeline")


def by_force(spark, docs):
    """doc_id -> how often it is in the end."""
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    dictionaries = language_id.fit(docs)
    names, coders = list(dictionaries), language_id.compressors(dictionaries)
    rows = [r for r in rows if not language_id.judge(r["text"], names, coders, language_id.MIN_MARGIN)[2]]
    stay = set(least_of_equals([(r["doc_id"], r["text"]) for r in rows]))
    rows = list({r["doc_id"]: r for r in rows if r["doc_id"] in stay}.values())
    gone = components_by_force(pairs_by_force([(r["doc_id"], r["text"]) for r in rows]))
    rows = [r for r in rows if r["doc_id"] not in gone]
    import hashlib

    from siltstone.llm import mixing

    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["n_chars"]
    share = shares_by_force(dict(sizes), {s: queries.WEIGHTS.get(s, 1.0) for s in sizes}, sum(sizes.values()), mixing.MAX_EPOCHS)
    out = Counter()
    for r in rows:
        repeats = share[r["source"]] / sizes[r["source"]]
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[r["doc_id"]] = int(repeats) + (u < repeats - int(repeats))
    return +out


def test_run_against_brute_force(spark, sf_dir, small):
    rows = pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == by_force(spark, small)
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    automaton = bpe.Automaton.from_file()
    for r in rows[:50]:
        assert automaton.decode(__import__("numpy").array(r["tokens"], "int64")).tobytes().decode() == texts[r["doc_id"]]


def test_stages(spark, tmp_path, sf_dir, small):
    """With further columns, named like what the operators use inside."""
    assert len(pipeline.STAGES) == 5
    docs = clashing(small).withColumn("copy", F.lit(4)).withColumn("language", F.lit("x")).withColumn("tokens", F.lit(6)).withColumn("left", F.lit(7))
    ids, columns = {r["doc_id"] for r in small.collect()}, docs.columns
    plain = small
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, k
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        stage(spark, plain, sf_dir).write.parquet(f"{tmp_path}/plain-{k}")
        plain = spark.read.parquet(f"{tmp_path}/plain-{k}")
        rows = docs.collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in plain.collect()) and {r["doc_id"] for r in rows} <= ids
        assert {(r["digest"], r["_row"], r["times"], r["a"], r["copy"], r["language"], r["left"]) for r in rows} == {(1, "x", 2, None, 4, "x", 7)}


def _written(spark, at, rows):
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)
    df.write.parquet(f"{at}/documents.parquet")
    return df


def test_odd_tables_against_brute_force(spark, tmp_path):
    """Enough text for the languages' dictionaries, next to null ids, texts, labels and sources, copies and repeated rows."""
    rows = [*ODD, *((100 + k, " ".join(f"{w}{(k * j) % 17}" for j in range(1, 60)), lang, f"s{k % 4}") for k, (w, lang) in enumerate([("der", "de"), ("the", "en"), ("les", "fr"), ("los", "es")] * 5))]
    docs = _written(spark, tmp_path, rows)
    got = Counter(r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect())
    assert got and got == by_force(spark, docs)


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    _written(spark, tmp_path, [])
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "tokens"]


def test_each_operator_has_its_query():
    names = [re.match(r"op(\d+)_", q) for q in __spark_entry__.queries()]
    assert sorted(int(m[1]) for m in names if m) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall()))) == sorted(map(repr, map(tuple, got)))
