import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siltstone.errors import InvalidPlan, UnsupportedSql
from siltstone.plans import ir, lower, sqlfront

COLUMNS = ["age", "name", "cost"]


@pytest.fixture(scope="module")
def people(spark):
    rows = [(30, "ann", 10.0), (41, "bob", None), (None, "cat", 7.5), (30, None, 2.5), (41, "ann", 0.0)]
    return spark.createDataFrame(rows, "age long, name string, cost double")


def run(plan, df):
    return [tuple(r) for r in lower.lower(plan, lambda s: df).collect()]


def sql(spark, df, text):
    parsed = sqlfront.parse(spark, text, "people", df.columns)
    assert parsed.plan is not None, text
    return parsed.plan


SHAPES = [
    "SELECT * FROM people",
    "SELECT name, age + 1 AS next FROM t WHERE cost >= 2.5",
    "SELECT name, COUNT(*) AS n, SUM(cost) AS total, AVG(age) AS mean, MIN(cost) AS lo, MAX(name) AS hi FROM people GROUP BY name",
    "SELECT COUNT(*) AS n FROM people WHERE age = 30 AND (name = 'ann' OR cost < 5)",
    "SELECT age FROM people WHERE 35 < age ORDER BY age DESC LIMIT 1",
    "SELECT name AS who FROM people p WHERE p.cost <> 7.5 AND age > -1",
    "SELECT age, COUNT(cost) AS n FROM people GROUP BY 1 ORDER BY 2 DESC, age NULLS LAST LIMIT 2",
]


@pytest.mark.parametrize("text", SHAPES)
def test_sql_json_and_optimiser_keep_the_rows(spark, people, text):
    plan = sql(spark, people, text)
    assert ir.from_json(ir.to_json(plan)) == plan
    schemas = {"people": people.columns}
    ir.validate(plan, schemas)
    best = ir.optimize(plan, schemas)
    assert ir.optimize(best, schemas) == best
    assert sorted(map(repr, run(plan, people))) == sorted(map(repr, run(best, people)))
    people.createOrReplaceTempView("people")
    people.createOrReplaceTempView("t")
    assert sorted(map(repr, map(tuple, spark.sql(text).collect()))) == sorted(map(repr, run(plan, people)))


@pytest.mark.parametrize("text", SHAPES)
def test_many_files_give_what_one_gives(spark, people, text):
    parts = [people.limit(0)] + [people.where(f"coalesce(age, 0) % 3 = {k}") for k in range(3)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    plan = sql(spark, people, text)
    assert sorted(map(repr, run(plan, union))) == sorted(map(repr, run(plan, people)))


@pytest.mark.parametrize("text", ["SELECT DISTINCT age FROM people", "SELECT age FROM people GROUP BY age HAVING COUNT(*) > 1", "SELECT age FROM people LIMIT 2 OFFSET 1", "SELECT COUNT(DISTINCT age) FROM people", "SELECT COUNT(*) FILTER (WHERE age > 1) FROM people", "SELECT ROW_NUMBER() OVER (ORDER BY age) FROM people", "SELECT a.age FROM people a JOIN people b ON a.age = b.age", "WITH x AS (SELECT age FROM people) SELECT * FROM x", "SELECT age FROM people UNION SELECT cost FROM people", "SELECT age FROM (SELECT age FROM people)", "SELECT upper(name) FROM people", "SELECT age FROM people WHERE name IS NULL", "SELECT age FROM people WHERE age IN (1, 2)", "SELECT age % 2 FROM people"])
def test_what_the_plan_language_cannot_say_is_never_dropped(spark, people, text):
    assert sqlfront.parse(spark, text, "people", people.columns).plan is None


@pytest.mark.parametrize("text", ["DELETE FROM people", "SELECT FROM WHERE", "SELECT 1", "SELECT age FROM other", "SELECT age, COUNT(*) FROM people", "DROP TABLE people", "SELECT age FROM people ORDER BY 7", "INSERT INTO people VALUES (1)"])
def test_refused_sql(spark, people, text):
    with pytest.raises(UnsupportedSql):
        sqlfront.parse(spark, text, "people", people.columns)


def test_select_order_aliases_and_equal_names(spark, people):
    df = lower.lower(sql(spark, people, "SELECT COUNT(*), name AS who, COUNT(age) FROM people GROUP BY name"), lambda s: people)
    assert df.columns == ["count", "who", "count_2"]


def test_nulls_sort_last_both_ways(spark, people):
    for way in ("ASC", "DESC"):
        ages = [r[0] for r in run(sql(spark, people, f"SELECT age FROM people ORDER BY age {way}"), people)]
        assert ages[-1] is None and None not in ages[:-1]


def test_division(spark):
    df = spark.createDataFrame([(7, 2, 1.0, 0.0), (-7, 2, -1.0, 0.0), (0, 2, 0.0, 0.0), (1, 2, None, 0.0)], "a int, b long, x double, y double")
    plan = ir.Project(ir.Scan("d"), (ir.Binary(ir.Column("a"), "Div", ir.Column("b")), ir.Binary(ir.Column("x"), "Div", ir.Column("y"))), ("whole", "real"))
    got = run(plan, df)
    assert [g[0] for g in got] == [3, -3, 0, 0]
    assert got[0][1] == math.inf and got[1][1] == -math.inf and math.isnan(got[2][1]) and got[3][1] is None
    zero = ir.Project(ir.Scan("d"), (ir.Binary(ir.Column("a"), "Div", ir.literal(0)),), ("z",))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        run(zero, df)


def test_empty_input(spark, people):
    none = people.limit(0)
    assert run(sql(spark, people, "SELECT COUNT(*) AS n, SUM(age) AS s, AVG(cost) AS a FROM people"), none) == [(0, None, None)]
    assert run(sql(spark, people, "SELECT name, COUNT(*) AS n FROM people GROUP BY name"), none) == []


def test_or_with_null_keeps_true(spark, people):
    assert len(run(sql(spark, people, "SELECT age FROM people WHERE cost > 100 OR name = 'bob'"), people)) == 1


def test_pushing_a_filter_below_a_renaming_projection():
    scan = ir.Scan("d")
    plan = ir.Filter(ir.Project(scan, (ir.Binary(ir.Column("age"), "Add", ir.literal(1)), ir.Column("name")), ("age2", "age")), ir.Binary(ir.Column("age"), "Eq", ir.literal("x")))
    best = ir.push_filters(plan)
    assert isinstance(best, ir.Project)
    assert best.input == ir.Filter(scan, ir.Binary(ir.Column("name"), "Eq", ir.literal("x")))


def test_filters_above_aggregates_stay():
    grouped = ir.Aggregate(ir.Scan("d"), (ir.Column("age"),), (ir.Agg("Count", None, "n"),))
    plan = ir.Filter(grouped, ir.Binary(ir.Column("n"), "Gt", ir.literal(1)))
    assert ir.push_filters(plan) == plan


def test_column_pruning():
    plan = ir.prune_columns(ir.Aggregate(ir.Filter(ir.Scan("d"), ir.Binary(ir.Column("cost"), "Gt", ir.literal(1))), (ir.Column("name"),), (ir.Agg("Count", None, "n"),)), {"d": COLUMNS})
    assert next(ir.scans(plan)).columns == ("name", "cost")
    count = ir.prune_columns(ir.Aggregate(ir.Scan("d"), (), (ir.Agg("Count", None, "n"),)), {"d": COLUMNS})
    assert next(ir.scans(count)).columns == ("age",)
    assert ir.prune_columns(ir.Scan("d"), {"d": COLUMNS}) == ir.Scan("d")


BAD = [
    ("[]", "exactly one key"),
    ('{"Scan":{}}', "lacks 'dataset'"),
    ('{"Nope":{}}', "unknown node"),
    ('{"Limit":{"input":{"Scan":{"dataset":"d"}},"n":-1}}', "whole number"),
    ('{"Limit":{"input":{"Scan":{"dataset":"d"}},"n":true}}', "whole number"),
    ('{"Sort":{"input":{"Scan":{"dataset":"d"}},"keys":[]}}', "at least 1"),
    ('{"Aggregate":{"input":{"Scan":{"dataset":"d"}},"group_by":[],"aggregates":[]}}', "at least 1"),
    ('{"Aggregate":{"input":{"Scan":{"dataset":"d"}},"group_by":[],"aggregates":[{"func":"Sum","arg":null,"alias":"s"}]}}', "needs an argument"),
    ('{"Filter":{"input":{"Scan":{"dataset":"d"}},"predicate":{"Literal":{"Int":true}}}}', "is no Int"),
    ('{"Filter":{"input":{"Scan":{"dataset":"d"}},"predicate":{"Binary":{"left":{"Column":"age"},"op":"Like","right":{"Column":"age"}}}}}', "unknown operator"),
    ('{"Project":{"input":{"Scan":{"dataset":"d"}},"exprs":[{"Column":"age"}],"aliases":[]}}', "1 expressions but 0"),
    ("{", "not JSON"),
]


@pytest.mark.parametrize(("text", "why"), BAD)
def test_bad_plans_say_why(text, why):
    with pytest.raises(InvalidPlan, match=why):
        ir.from_json(text)


def test_unknown_columns_are_named_with_their_place():
    plan = ir.Sort(ir.Aggregate(ir.Scan("d"), (ir.Column("name"),), (ir.Agg("Count", None, "n"),)), (ir.SortKey(ir.Column("cost")),))
    with pytest.raises(InvalidPlan, match=r"plan\.Sort\.keys\[0\]: unknown column 'cost'; there are name, n"):
        ir.validate(plan, {"d": COLUMNS})


def test_render():
    plan = ir.Limit(ir.Sort(ir.Filter(ir.Scan("d"), ir.Binary(ir.Column("age"), "GtEq", ir.literal(3))), (ir.SortKey(ir.Column("age"), True),)), 2)
    assert ir.render(plan).splitlines() == ["Limit 2", "  Sort age DESC", "    Filter (age >= 3)", "      Scan d"]


literals = st.one_of(st.integers(-5, 5), st.floats(-5, 5, allow_nan=False).map(lambda x: round(x, 2))).map(ir.literal)
comparisons = st.builds(ir.Binary, st.sampled_from(["age", "cost"]).map(ir.Column), st.sampled_from(ir.COMPARISONS), literals)
predicates = st.recursive(comparisons, lambda x: st.builds(ir.Binary, x, st.sampled_from(ir.LOGIC), x), max_leaves=4)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(predicates)
def test_random_predicates_equal_duckdb(spark, predicate):
    import duckdb
    import pandas as pd

    rows = [(a, c) for a in (None, -3, 0, 2, 4) for c in (None, -2.5, 0.0, 3.25)]
    df = spark.createDataFrame(rows, "age long, cost double")
    got = run(ir.Filter(ir.Scan("x"), predicate), df)
    con = duckdb.connect()
    con.register("x", pd.DataFrame(rows, columns=["age", "cost"]).astype({"age": "Int64"}))
    want = con.execute(f"SELECT * FROM x WHERE {ir._shown(predicate)}").fetchall()
    key = lambda r: [(v is None or v != v, 0 if v is None or v != v else v) for v in r]
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(want, key=key)]


def test_plan_of_whole_stage(spark, sf_dir):
    """Two of eleven columns are read, the filter reaches the scan, the aggregate is partial before its only exchange."""
    from siltstone import registry

    plan = registry.compiled(spark, registry.table(spark, sf_dir, "lineitem"), "lineitem", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
    text = registry.run_plan(spark, sf_dir, plan)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text.replace("\n", "")
    assert "GreaterThan(l_quantity,25.0)" in text and text.count("Exchange") == 1 and "partial_count" in text
    assert json.loads(ir.to_json(plan))
