"""Joins on order against brute force; changes of datasets; functions of one's own."""

import numpy as np
import pytest

from siltstone.errors import EngineError
from siltstone.operators import joins
from siltstone.session import Session

LEFT, RIGHT = "id long, k string, j long, t double", "t double, k string, j long, v string"


def asof_by_force(left, right, tolerance=None):
    out = []
    for i, k, j, t in left:
        fits = [r for r in right if None not in (k, j, t, r[0]) and r[1:3] == (k, j) and r[0] <= t and (tolerance is None or t - r[0] <= tolerance)]
        best = max(fits, key=lambda r: (r[0], r[3] is not None, r[3] or ""), default=(None,) * 4)
        out.append((i, k, j, t, best[0], best[3]))
    return out


@pytest.mark.parametrize(("piece", "tolerance"), [(100_000, None), (7, None), (3, 4.0), (100_000, 0.0)])
def test_asof(spark, monkeypatch, piece, tolerance):
    monkeypatch.setattr(joins, "PIECE_ROWS", piece)
    rng = np.random.default_rng(piece)
    some = lambda p, x: None if rng.random() < p else x
    row = lambda: (some(0.05, ["hot", "hot", "hot", "b", "c"][rng.integers(5)]), some(0.05, int(rng.integers(2))), some(0.1, float(rng.integers(40))))
    left = [(i, k, j, t) for i in range(80) for k, j, t in [row()]]
    right = [(t, k, j, some(0.1, f"v{i:03}")) for i in range(60) for k, j, t in [row()]]
    got = joins.asof(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(2), "t", ["k", "j"], tolerance)
    assert got.columns == ["id", "k", "j", "t", "right_t", "right_v"]
    assert sorted(map(tuple, got.collect())) == asof_by_force(left, right, tolerance)


def test_asof_of_empty_tables(spark):
    left, right = spark.createDataFrame([(1, "a", 1, 5.0)], LEFT), spark.createDataFrame([], RIGHT)
    assert [tuple(r) for r in joins.asof(left, right, "t", ["k", "j"]).collect()] == [(1, "a", 1, 5.0, None, None)]
    assert joins.asof(left.limit(0), right, "t", ["k", "j"]).count() == 0


@pytest.mark.parametrize("width", [None, 0.5, 1000.0])
def test_in_range(spark, width):
    rng = np.random.default_rng(4)
    points = [(i, None if i == 3 else float(rng.integers(-20, 20))) for i in range(60)]
    ranges = [(i, float(a), float(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-25, 20, 30), rng.integers(-2, 9, 30)))] + [(90, None, 1.0), (91, 0.0, None)]
    got = joins.in_range(spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(ranges, "r long, low double, high double"), "x", "low", "high", width)
    want = [(p, r) for p, x in points for r, a, z in ranges if None not in (x, a, z) and a <= x <= z]
    assert sorted((r["p"], r["r"]) for r in got.collect()) == sorted(want) and got.columns == ["p", "x", "r", "low", "high"]


@pytest.fixture
def session(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    s.ingest("t", spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k long, g string, v double").coalesce(1))
    s.ingest("t", spark.createDataFrame([(3, "c", 3.0), (4, None, 4.0), (None, "e", 5.0)], "k long, g string, v double").coalesce(1))
    return s


def rows(session):
    return sorted(map(tuple, session.frame("t").collect()), key=repr)


def test_delete_and_update(session):
    before = session.catalog.current(session.catalog.get("t"))
    files = {m.path for m in session.catalog.manifests(before)}
    session.delete("t", "v > 3.5 AND v < 5")
    assert rows(session) == sorted([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (None, "e", 5.0)], key=repr)
    assert len(files & {m.path for m in session.catalog.manifests(session.catalog.current(session.catalog.get("t")))}) == 1  # the file that can't hold such a row stays
    session.update("t", {"v": "v * 10", "g": "upper(g)"}, "v < 4")
    assert rows(session) == sorted([(1, "A", 10.0), (2, "b", None), (3, "C", 30.0), (None, "e", 5.0)], key=repr)
    session.delete("t", "k IS NULL OR length(g) > 5")  # beyond the plan language: all files are read
    assert rows(session) == sorted([(1, "A", 10.0), (2, "b", None), (3, "C", 30.0)], key=repr)
    assert len(session.frame("t", before.id).collect()) == 5
    with pytest.raises(EngineError):
        session.update("t", {"nope": "1"})


def test_merge(session, spark):
    source = spark.createDataFrame([(2, "B", 20.0), (9, "new", 9.0), (None, "null", 0.0)], "k long, g string, v double")
    session.merge("t", source, ["k"])
    assert rows(session) == sorted([(1, "a", 1.0), (2, "B", 20.0), (3, "c", 3.0), (4, None, 4.0), (None, "e", 5.0), (9, "new", 9.0), (None, "null", 0.0)], key=repr)
    session.merge("t", source.where("k IS NOT NULL"), ["k"], "delete", insert=False)
    assert {r[0] for r in rows(session)} == {1, 3, 4, None}
    session.merge("t", spark.createDataFrame([(1, "x", 0.0), (7, "y", 7.0)], "k long, g string, v double"), ["k"], "keep")
    assert (1, "a", 1.0) in rows(session) and (7, "y", 7.0) in rows(session)
    with pytest.raises(EngineError, match="same keys"):
        session.merge("t", source.union(source), ["k"])


def test_a_change_from_an_old_snapshot_fails(session, spark):
    dataset = session.catalog.get("t")
    old = session.catalog.current(dataset)
    session.ingest("t", spark.createDataFrame([(5, "f", 1.0)], "k long, g string, v double"))
    with pytest.raises(EngineError, match="another process"):
        session.catalog.commit(dataset, [], "overwrite", base=old)
    assert len(rows(session)) == 6


def test_functions(session):
    class Twice:
        def eval(self, k):
            yield k, None if k is None else 2 * k

    session.register_function("plus_one", lambda v: v + 1, "double")
    session.register_function("spread", lambda v: v.max() - v.min(), "double", "aggregate")
    session.register_function("twice", Twice, "k long, double long", "table")
    assert session.query("t", "SELECT k, plus_one(v) AS w FROM t WHERE k < 3 ORDER BY k").rows() == [{"k": 1, "w": 2.0}, {"k": 2, "w": None}]
    assert session.query("t", "SELECT spread(v) AS s FROM t").rows() == [{"s": 4.0}]
    assert session.query("t", "SELECT k, upper(g) AS u FROM t WHERE k = 3").rows() == [{"k": 3, "u": "C"}]
    assert session.query("t", "SELECT t.k, double FROM t, LATERAL twice(t.k) WHERE t.k IN (3, 4) ORDER BY t.k").rows() == [{"k": 3, "double": 6}, {"k": 4, "double": 8}]
    with pytest.raises(EngineError):
        session.register_function("x", len, "long", "other")
