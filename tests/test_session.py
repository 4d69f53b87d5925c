"""The engine as a whole: catalog, queries, cache, history, profiles, questions, research, corpora."""

import datetime as dt
import json

import pytest

from siltstone import nl, research
from siltstone.errors import EngineError
from siltstone.operators import text
from siltstone.session import Session, from_ipc, query_file, to_ipc


@pytest.fixture
def session(spark, tmp_path):
    return Session(spark, str(tmp_path / "engine"))


@pytest.fixture
def visits(spark):
    rows = [(k, ["flu", "cold", "ache"][k % 3], float(10 * k), dt.date(2024, 1, 1 + k % 20)) for k in range(60)]
    return spark.createDataFrame(rows, "visit long, cause string, cost double, day date")


def test_append_overwrite_and_earlier_snapshots(session, visits):
    first = session.ingest("visits", visits)
    session.ingest("visits", visits.where("visit < 10"))
    assert session.frame("visits").count() == 70
    assert session.frame("visits", first.id).count() == 60
    session.ingest("visits", visits.where("visit < 5"), "overwrite")
    assert session.frame("visits").count() == 5
    assert [d.name for d in session.datasets()] == ["visits"]


def test_workspaces_do_not_see_each_other(session, visits):
    session.ingest("visits", visits)
    other = Session(session.spark, session.root, "other")
    assert other.datasets() == []
    with pytest.raises(EngineError):
        other.query("visits", "SELECT * FROM visits")


def test_query_cache_and_history(session, visits):
    session.ingest("visits", visits)
    sql = "SELECT cause, COUNT(*) AS n, AVG(cost) AS mean FROM visits GROUP BY cause ORDER BY cause"
    a, b = session.query("visits", sql), session.query("visits", "SELECT cause, count(*) n, avg(cost) mean FROM visits GROUP BY cause ORDER BY cause")
    assert [tuple(r.values()) for r in a.rows()] == [("ache", 20, 305.0), ("cold", 20, 295.0), ("flu", 20, 285.0)]
    assert not a.cache_hit and b.cache_hit and a.rows() == b.rows()
    session.ingest("visits", visits)
    assert not session.query("visits", sql).cache_hit
    with pytest.raises(EngineError):
        session.query("visits", "SELECT missing FROM visits")
    past = session.history()
    assert len(past) == 4 and "failed" in json.dumps(past[0]) and "succeeded" in json.dumps(past[1])
    assert from_ipc(to_ipc(a.table)).equals(a.table) and to_ipc(None) == b"" and from_ipc(b"") is None


def test_explain_counts_files_that_stay(session, visits):
    session.ingest("visits", visits.repartitionByRange(4, "visit"), partition_by=["cause"])
    e = session.explain("visits", "SELECT cost FROM visits WHERE cause = 'flu' AND visit < 10")
    assert 0 < e.files_after < e.files_before and not e.cache_hit and "Scan" in e.tree
    assert session.history() == []
    assert session.query("visits", "SELECT COUNT(*) AS n FROM visits WHERE cause = 'flu'").rows() == [{"n": 20}]


def test_csv_and_files(session, visits, tmp_path):
    visits.drop("day").coalesce(1).write.csv(f"{tmp_path}/c", header=True)
    session.ingest_csv("c", f"{tmp_path}/c")
    assert session.query("c", "SELECT SUM(cost) AS s FROM c").rows() == [{"s": 17700.0}]
    with pytest.raises(EngineError):
        session.query("nowhere", "SELECT 1 AS x FROM nowhere")
    visits.write.parquet(f"{tmp_path}/p.parquet")
    assert query_file(session.spark, f"{tmp_path}/p.parquet", "SELECT MAX(visit) AS m FROM t").to_pylist() == [{"m": 59}]


def test_profiles(session, visits):
    session.ingest("visits", visits)
    s = session.summary("visits").to_dict()
    assert json.loads(json.dumps(s, default=str))
    found = session.insights("visits")
    assert {"summary", "quality", "outlier"} <= set(found) and found["outlier"]["group_column"] == "cause"
    with pytest.raises(EngineError):
        session.analyze("visits", "mood")


def test_questions(session, visits):
    session.ingest("visits", visits)
    with pytest.raises(EngineError):
        session.query_nl("visits", "How many?")
    session.provider = nl.Canned({"How many flu visits?": f"```json\n{_plan(session)}\n```"})
    assert session.query_nl("visits", "How many flu visits?").rows() == [{"n": 20}]


def _plan(session):
    from siltstone.plans import ir

    return ir.to_json(session.parse("visits", "SELECT COUNT(*) AS n FROM visits WHERE cause = 'flu'").plan)


def test_corpus_replaces_and_retrieves(session):
    docs = session.spark.createDataFrame([("a", "rain and wind in spring " * 100), ("b", "prices of grain")], "doc_id string, text string")
    assert session.ingest_corpus("papers", docs) >= 3
    session.ingest_corpus("papers", session.spark.createDataFrame([("b", "prices of copper")], "doc_id string, text string"))
    found = session.corpora.retrieve("prices of copper", "papers")
    assert found[0].doc_id == "b" and "copper" in found[0].text
    assert session.corpora.retrieve("x", "") == [] == session.corpora.retrieve("x", "missing")


@pytest.mark.parametrize("block", [7, 2048])
def test_nearest_of_each_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(text, "BLOCK", block)
    rows = [(k, [float(k * 7 % 11 - 5), float(k % 5 - 2), float(k % 3)]) for k in range(40)]
    rows += [(100, [0.0, 0.0, 0.0]), (101, None), (102, rows[3][1]), (103, rows[3][1])]
    got = text.nearest_of_each(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    live = [(i, v) for i, v in rows if v and any(v)]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = []
    for q, a in live:
        best = sorted((-round(sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b), 6), i) for i, b in live)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r["query_id"] for r in got} == {i for i, _ in live}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    some = text.nearest_of_each(vectors, vectors.where("vec_id % 10 = 0")).collect()
    assert sorted(map(tuple, some)) == sorted(r for r in want if r[0] % 10 == 0)


def test_charts_and_citations():
    assert research.choose_chart([])["kind"] == "table"
    assert research.choose_chart([{"n": 1}])["kind"] == "stat"
    assert research.choose_chart([{"day": dt.date(2024, 1, k), "n": k} for k in (1, 2)])["kind"] == "line"
    assert research.choose_chart([{"cause": "flu", "n": 1}, {"cause": "cold", "n": 2}])["kind"] == "bar"
    text = "Costs rose. [data] Others agree. [literature:p1] The end."
    assert [(c["text"], c["source"]) for c in research.citations(text)] == [("Costs rose.", {"kind": "data"}), ("Others agree.", {"kind": "literature", "id": "p1"}), ("The end.", None)]
