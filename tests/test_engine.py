import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern import functions
from quern.engine import Engine
from quern.errors import ModelError, QuernError, RequestError
from quern.expr import build, fold, parse, substitute
from quern.expr.tree import lit
from quern.model import load
from quern.operators import relational
from quern.request import request
from quern.types import finer_or_equal, parse_type

YAML = """
semantic_model:
  name: shop
  dimensions:
    - {name: region, data_type: string}
  measures:
    - {name: revenue, agg: sum, data_type: double, expr: amount}
  datasets:
    - name: orders
      dimensions:
        - ref: region
        - {name: day, data_type: date, type: {temporal: {grains: [day, month]}}}
        - {name: market, data_type: string, expr: {upper: region}}
      measures:
        - ref: revenue
        - {name: order_count, agg: count, expr: id}
        - {name: distinct_days, agg: count_distinct, expr: day, constraints: {dimensions: {none_of: [day]}}}
        - {name: sold, agg: sum, expr: amount, constraints: {dimensions: {one_of: [region, market]}}}
      metrics:
        - {name: aov, expr: "revenue / order_count", constraints: {dimensions: {all: [region]}}}
      filters:
        - {name: live, expr: "status != 'deleted'"}
      keys: {primary: [id]}
      extras: {storage: {format: parquet, paths: [/nowhere]}}
"""
ROWS = [(1, "US", dt.date(2024, 1, 1), 100.0, "ok"), (2, "US", dt.date(2024, 1, 2), 150.0, "ok"), (3, "EU", dt.date(2024, 2, 1), 200.0, "ok"), (4, "EU", dt.date(2024, 2, 9), 7.0, "deleted"), (5, None, dt.date(2024, 2, 9), 5.0, "ok")]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, load(YAML), {"orders": spark.createDataFrame(ROWS, "id long, region string, day date, amount double, status string")})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_model_from_yaml_answers(engine):
    assert rows(engine.query({"from": "orders", "select": ["region", "revenue", "order_count", "aov"]})) == rows_of([("US", 250.0, 2, 125.0), ("EU", 200.0, 1, 200.0), (None, 5.0, 1, 5.0)])
    assert rows(engine.query({"from": "orders", "select": ["market", "revenue"], "filters": [("region", "eq", "US")]})) == [("US", 250.0)]
    assert rows(engine.query({"select": ["order_count"]})) == [(4,)]
    assert rows(engine.query({"from": "orders", "select": ["day", "revenue"], "grain": "month"})) == rows_of([(dt.date(2024, 1, 1), 250.0), (dt.date(2024, 2, 1), 205.0)])


def rows_of(x):
    return sorted(x, key=str)


def test_star_lists_everything_and_counts_of_nothing_are_zero(engine):
    names = engine.query({"from": "orders", "select": ["*"], "filters": [("region", "eq", "nowhere")]} | {"select": ["region", "revenue"]}).columns
    assert names == ["region", "revenue"]
    assert rows(engine.query({"from": "orders", "select": ["order_count", "revenue"], "filters": [("region", "eq", "nowhere")]})) == [(0, None)]
    assert engine.schema()["orders"]["metrics"] == ["aov"]


@pytest.mark.parametrize("raw, code", [
    ({"from": "none", "select": ["revenue"]}, "PLAN_E_SOURCE"), ({"from": "orders", "select": ["nope"]}, "PLAN_E_UNKNOWN"), ({"select": ["nope"]}, "PLAN_E_UNKNOWN"), ({"from": "orders", "select": []}, "PLAN_E_EMPTY"),
    ({"from": "orders", "select": ["revenue", "revenue"]}, "PLAN_E_DUPLICATE"), ({"from": "orders", "select": ["day", "distinct_days"]}, "PLAN_E_CONSTRAINT"), ({"from": "orders", "select": ["sold"]}, "PLAN_E_CONSTRAINT"),
    ({"from": "orders", "select": ["market", "aov"]}, "PLAN_E_CONSTRAINT"), ({"from": "orders", "select": ["revenue"], "filters": ["dead"]}, "PLAN_E_FILTER"), ({"from": "orders", "select": ["revenue"], "filters": [("region", "about", 1)]}, "PLAN_E_FILTER"),
    ({"from": "orders", "select": ["revenue"], "filters": [("region", "in", [])]}, "PLAN_E_FILTER"), ({"from": "orders", "select": ["day", "revenue"], "grain": "year"}, "PLAN_E_GRAIN"), ({"from": "orders", "select": ["region", "revenue.previous"]}, "PLAN_E_ACCESSOR"),
    ({"from": "orders", "select": ["revenue"], "limit": -1}, "PLAN_E_LIMIT"), ({"from": "orders", "select": ["revenue"], "order_by": ["region"]}, "PLAN_E_ORDER"),
])
def test_requests_that_cannot_be_answered(engine, raw, code):
    with pytest.raises(RequestError) as e:
        engine.query(raw)
    assert e.value.code == code
    assert engine.validate(raw) == [str(e.value)]


def test_requests_that_can(engine):
    assert engine.validate({"from": "orders", "select": ["region", "sold"], "filters": ["live"]}) == []
    text = engine.explain({"from": "orders", "select": ["region", "revenue"], "filters": [("region", "eq", "US")]})
    assert "scan orders" in text and "group by region: revenue" in text


def test_drift(engine):
    now = engine.columns()["orders"]
    assert engine.drift({"orders": now}) == []
    assert len(engine.drift({"orders": {**{k: v for k, v in now.items() if k != "id"}, "old": "int", "amount": "float"}})) == 3


def base(**more):
    return {"datasets": [{"name": "d", "dimensions": [{"name": "x", "data_type": "string"}], "measures": [{"name": "m", "agg": "sum"}], **more}]}


@pytest.mark.parametrize("model, code", [
    (base(metrics=[{"name": "a", "expr": "b"}, {"name": "b", "expr": "a"}]), "MODEL_E_CYCLE"),
    (base(metrics=[{"name": "a", "expr": "m"}, {"name": "b", "expr": "a"}, {"name": "c", "expr": "b"}, {"name": "e", "expr": "c"}, {"name": "f", "expr": "e"}]), "MODEL_E_DEPTH"),
    (base(metrics=[{"name": "a", "expr": "zzz"}]), "MODEL_E_UNKNOWN"), (base(metrics=[{"name": "a"}]), "MODEL_E_METRIC"), (base(measures=[{"name": "m"}, {"name": "m"}]), "MODEL_E_DUPLICATE"), (base(measures=[{"name": "x"}]), "MODEL_E_DUPLICATE"),
    (base(measures=[{"name": "m", "agg": "sum", "expr": "SELECT amount FROM t"}]), "EXPR_E_RAW_SQL"), (base(measures=[{"name": "m", "agg": "sum", "expr": "sum(amount)"}]), "EXPR_E_AGGREGATE"), (base(measures=[{"name": "m", "agg": "mode"}]), "MODEL_E_AGG"),
    (base(measures=[{"name": "m"}, {"name": "n", "expr": "m + 1"}]), "MODEL_E_MEASURE"), (base(dimensions=[{"name": "x", "data_type": "text"}]), "MODEL_E_TYPE"), (base(dimensions=[{"name": "x", "expr": {"window": {}}}]), "EXPR_E_WINDOW"), (base(dimensions=[{"name": "x", "type": "colour"}]), "MODEL_E_DIMENSION"),
    (base(dimensions=[{"name": "x", "type": {"bucketed": {}}}]), "MODEL_E_BUCKETS"), (base(dimensions=[{"name": "x", "type": {"temporal": {"grains": ["eon"]}}}]), "MODEL_E_GRAIN"), (base(dimensions=[{"ref": "y"}]), "MODEL_E_REF"), (base(extras={"storage": {"format": "parquet"}}), "MODEL_E_STORAGE"),
    (base(extras={"storage": {"paths": ["a"], "tables": ["b"]}}), "MODEL_E_STORAGE"), (base(extras={"storage": {"paths": ["a"], "format": "xls"}}), "MODEL_E_STORAGE"), (base(extras={"temporal": {"scd": {"valid_from": "x"}}}), "MODEL_E_TEMPORAL"), (base(measures=[{"name": "m", "additivity": {"semi": {"axes": ["x"], "strategy": "loudest"}}}]), "MODEL_E_ADDITIVITY"),
    ({"unionsets": [{"name": "u", "datasets": []}]}, "MODEL_E_CHILDREN"), ({"unionsets": [{"name": "u", "mode": "some", "datasets": [{"name": "d"}]}]}, "MODEL_E_MODE"), ({"datasets": [{"name": "d"}, {"name": "d"}]}, "MODEL_E_DUPLICATE"),
    ({"joinsets": [{"name": "j", "datasets": [{"name": "a"}, {"name": "b"}], "relationships": [{"name": "r", "from": "a", "to": "c", "keys": [{"from": "x", "to": "y"}]}]}]}, "MODEL_E_RELATIONSHIP"),
    ({"joinsets": [{"name": "j", "datasets": [{"name": "a"}, {"name": "b"}], "relationships": [{"name": "r", "from": "a", "to": "b", "keys": []}]}]}, "MODEL_E_RELATIONSHIP"),
    ({"datasets": [{"name": "a"}, {"name": "b"}], "relationships": [{"from": "a", "to": "b", "cardinality": "many_to_many", "keys": [{"from": "x", "to": "y"}]}]}, "MODEL_E_RELATIONSHIP"),
    ({"unionsets": [{"name": "u", "datasets": [{"name": "d"}]}, {"name": "v", "unionsets": [{"ref": "u"}]}]}, "MODEL_E_NESTING"),
])
def test_models_that_cannot_be_right(model, code):
    with pytest.raises(ModelError) as e:
        load(model)
    assert e.value.code == code


@pytest.mark.parametrize("text", ["a +", "a b", "(a", "f(", "a in ()", "CASE END", "unknown_fn(a)", "a ; b", "", "a is 3", "not", "a not 3"])
def test_text_that_is_no_expression(text):
    with pytest.raises(ModelError):
        parse(text)


@pytest.mark.parametrize("block", [{}, {"in": {"col": "a", "list": []}}, {"case": {"when": []}}, {"coalesce": []}, {"eq": ["a"]}, {"nonsense": "a"}, {"upper": "a", "lower": "b"}, {"lit": {"colour": 1}}])
def test_blocks_that_are_no_expression(block):
    with pytest.raises(ModelError):
        parse(block)


@pytest.mark.parametrize("text, want", [("1 + 2 * 3 - 4 / 2", 5.0), ("-(2 - 5) % 2", 1), ("not 1 > 2 and (3 <= 3 or 1 <> 1)", True), ("case when 1 = 2 then 'a' when 2 = 2 then 'b' else 'c' end", "b"), ("coalesce(null, 'x') || 'y'", "xy"), ("1 / 0", None), ("'it''s' like 'it%'", True), ("cast('12' as int) + 1", 13), ("try_cast('q' as int)", None), ("3 between 1 and 5 and 3 not in (4, 5)", True), ("date '2024-02-29'", dt.date(2024, 2, 29)), ("nullif(3, 3) is null", True), ("substring('hello', 2, 3)", "ell")])
def test_text_has_the_usual_meaning(spark, text, want):
    assert spark.range(1).select(build(parse(text), F.col).alias("x")).first().x == want


def test_known_values_fold_branches_away():
    n = parse({"case": {"when": [{"condition": {"eq": ["party", {"lit": "a"}]}, "then": "only_a"}], "else": {"lit": "other"}}})
    assert fold(substitute(n, {"party": lit("b")})) == lit("other")
    assert fold(substitute(n, {"party": lit("a")})).value == "only_a"
    assert fold(parse("1 = 1 and x > 2")) == parse("x > 2")


def test_functions_are_registered_once(spark):
    functions.register("shout", 1, 1, lambda x: F.concat(F.upper(x), F.lit("!")))
    assert spark.range(1).select(build(parse("shout('a')"), F.col).alias("x")).first().x == "A!"
    with pytest.raises(ModelError):
        functions.register("shout", 1, 1, F.upper)
    with pytest.raises(ModelError):
        build(parse("upper('a', 'b')"), F.col)


def test_types_and_grains():
    assert parse_type("decimal(10,2)").simpleString() == "decimal(10,2)" and parse_type("f64").simpleString() == "double"
    assert finer_or_equal("day", "month") and not finer_or_equal("week", "month") and not finer_or_equal("month", "day")


def test_relational_checks(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "b")], "a int, b string")
    assert relational.union([df, df], distinct=True).count() == 2
    for bad in (lambda: relational.union([df]), lambda: relational.union([df, df.select("a")]), lambda: relational.join(df, df, []), lambda: relational.project(df, []), lambda: relational.values(spark, "a int", [(1, 2)]), lambda: relational.sort(df, [("z", True, None)]), lambda: relational.aggregate(df, ["a"], [("a", F.count("*"))])):
        with pytest.raises(RequestError):
            bad()


def test_averages_of_totals_are_refused(spark):
    model = {"datasets": [{"name": "t", "dimensions": [{"name": "g"}], "measures": [{"name": "v", "agg": "avg"}], "extras": {"pre_aggregated": True}}]}
    with pytest.raises(RequestError) as e:
        Engine(spark, model, {"t": spark.createDataFrame([("a", 1.0)], "g string, v double")}).query({"from": "t", "select": ["g", "v"]})
    assert e.value.code == "PLAN_E_2304"


def test_fanout_without_a_key_is_refused(spark):
    model = {"joinsets": [{"name": "j", "dimensions": [{"name": "g"}], "measures": [{"name": "v", "agg": "sum"}], "datasets": [{"name": "f", "extras": {"semantic_mapping": {"g": "g"}}}, {"name": "o", "extras": {"semantic_mapping": {"v": "v"}}}], "relationships": [{"from": "f", "to": "o", "keys": [{"from": "k", "to": "k"}]}]}]}
    frames = {"f": spark.createDataFrame([(1, "a"), (1, "b")], "k int, g string"), "o": spark.createDataFrame([(1, 2.0)], "k int, v double")}
    with pytest.raises(RequestError) as e:
        Engine(spark, model, frames).query({"from": "j", "select": ["g", "v"]})
    assert e.value.code == "PLAN_E_FANOUT"
    assert rows(Engine(spark, model, frames, fanout="raw").query({"from": "j", "select": ["v"]})) == [(4.0,)]


def test_two_equal_ways_to_join_are_refused(spark):
    d = lambda n, *f: {"name": n, "dimensions": [{"name": x} for x in f], "measures": []}
    r = lambda n, a, b: {"name": n, "from": a, "to": b, "keys": [{"from": "k", "to": "k"}]}
    model = {"datasets": [d("a", "x"), d("b", "y")], "relationships": [r("one", "a", "b"), r("two", "a", "b")]}
    frames = {"a": spark.createDataFrame([(1, "x")], "k int, x string"), "b": spark.createDataFrame([(1, "y")], "k int, y string")}
    with pytest.raises(RequestError) as e:
        Engine(spark, model, frames).query({"select": ["x", "y"]})
    assert e.value.code == "PLAN_E_0500"


def test_files_of_several_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, g string")
    for fmt in ("parquet", "orc", "json", "csv"):
        df.coalesce(1).write.format(fmt).option("header", True).save(f"{tmp_path}/x.{fmt}")
        model = {"datasets": [{"name": "t", "dimensions": [{"name": "g", "data_type": "string"}], "measures": [{"name": "n", "agg": "sum", "expr": "k"}], "extras": {"storage": {"paths": [f"{tmp_path}/x.{fmt}"]}}}]}
        assert rows(Engine(spark, model).query({"from": "t", "select": ["g", "n"]})) == rows_of([("a", 1), (None, 2)])
    for k in (1, 2):
        df.createOrReplaceTempView(f"quern_part_{k}")
    model["datasets"][0]["extras"] = {"storage": {"tables": ["quern_part_*"]}}
    assert rows(Engine(spark, model).query({"from": "t", "select": ["n"]})) == [(6,)]
    with pytest.raises(QuernError):
        Engine(spark, {"datasets": [{"name": "t", "measures": [{"name": "n", "expr": "k"}], "extras": {"storage": {"paths": ["a.csv", "b.orc"]}}}]}).query({"from": "t", "select": ["n"]})


def test_requests_are_parsed_once():
    r = request({"from": "a", "select": ["x", {"name": "d", "grain": "day"}], "order_by": ["-x", ("d", "asc", "last")]})
    assert request(r) is r and r.grains == (("d", "day"),) and r.order_by[0].descending and r.order_by[1].nulls == "last"


@pytest.mark.parametrize("agg", ["first", "last"])
def test_first_and_last_are_no_aggregates(agg):
    """They would need an order of rows; the least and greatest values are something else."""
    with pytest.raises(ModelError) as e:
        load({"name": "m", "datasets": [{"name": "d", "dimensions": [], "measures": [{"name": "x", "agg": agg}]}]})
    assert e.value.code == "MODEL_E_AGG"
    with pytest.raises(ModelError):
        build(parse(f"{agg}(v)"), F.col)
