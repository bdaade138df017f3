"""What newer features refuse, and the plans that they make."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from quern import catalogue
from quern.catalogue import _FAN, child, dataset, joinset, model, rel
from quern.engine import Engine
from quern.errors import ModelError, QuernError, RequestError
from quern.model import load
from quern.sources import token
from quern.types import widest

DIR = "/root/testdata/sf0.001"
T0 = "timestamp_ntz'2024-01-01'"


def snapshots(spark):
    return spark.range(5).selectExpr("id", f"{T0} + make_dt_interval(cast(id as int)) AS day")


def daily(**temporal):
    return model(dataset("daily", [("id", "long"), ("day", "timestamp")], [("n", "count", "id")], extras={"temporal": temporal}))


def test_a_time_before_the_first_snapshot_is_an_error(spark):
    e = Engine(spark, daily(snapshot={"snapshotted_at": "day"}, grain="day"), {"daily": snapshots(spark)})
    assert e.query({"from": "daily", "select": ["n"], "as_of": "2024-01-03 09:00:00"}).first().n == 1
    with pytest.raises(PySparkException, match="PLAN_E_1730"):
        e.query({"from": "daily", "select": ["n"], "as_of": "2023-12-31"}).collect()


def test_versions_without_an_end_need_a_key(spark):
    frame = snapshots(spark).selectExpr("id", "day", f"{T0} AS until")
    e = Engine(spark, daily(scd={"valid_from": "day", "valid_to": "until", "open_ended": "none"}), {"daily": frame})
    with pytest.raises(RequestError, match="PLAN_E_1731"):
        e.query({"from": "daily", "select": ["n"]})


def test_types_without_history_say_so(spark):
    e = Engine(spark, daily(scd={"scd_type": "type1", "valid_from": "day"}), {"daily": snapshots(spark)})
    assert "PLAN_W_1730" in e.explain({"from": "daily", "select": ["n"], "as_of": "2024-01-02"})


def related(left, right, **more):
    ends = [{"name": "a", "extras": {"semantic_mapping": {"n": "id", "at": "day"}} | ({"temporal": left} if left else {})}, {"name": "b", "extras": {"semantic_mapping": {"other": "id", "since": "day", "until": "day"}} | ({"temporal": right} if right else {})}]
    return joinset([("other", "long")], [("n", "count")], ends, [rel("a", "b", [("id", "id")], as_of=True, **more)])


_EVENTS, _SNAPSHOT, _SCD = {"events": {"event_time": "at"}}, {"snapshot": {"snapshotted_at": "since"}}, {"scd": {"valid_from": "since", "valid_to": "until"}}


@pytest.mark.parametrize("left, right, more, code", [
    (_EVENTS, None, {}, "PLAN_E_1721"), (None, _SNAPSHOT, {}, "PLAN_E_1721"), (_EVENTS, {"events": {"event_time": "since"}}, {}, "PLAN_E_1720"), ({"scd": {"valid_from": "at", "valid_to": "at"}}, _SNAPSHOT, {}, "PLAN_E_1720"),
    ({"snapshot": {"snapshotted_at": "at"}}, _SNAPSHOT, {}, "PLAN_E_1720"), (_EVENTS, {"scd": {"scd_type": "type1", "valid_from": "since"}}, {}, "PLAN_E_1720"), (_EVENTS, _SCD, {"how": "full"}, "PLAN_E_1720"),
])
def test_as_of_joins_that_have_no_meaning(spark, left, right, more, code):
    e = Engine(spark, related(left, right, **more), {"a": snapshots(spark), "b": snapshots(spark)})
    with pytest.raises(RequestError, match=code):
        e.query({"from": "j", "select": ["other", "n"]})


@pytest.mark.parametrize("change, code", [
    ({"dimensions": [{"name": "x", "data_type": "string", "filter": "x = 'a'"}]}, "MODEL_E_FILTER"), ({"keys": {"primary": {"fields": ["x"], "filters": ["x = 'a'"]}}}, "MODEL_E_FILTER"),
    ({"measures": [{"name": "m", "agg": "sum", "expr": "x"}]}, "MODEL_E_AGG"), ({"measures": [{"name": "m", "agg": "median", "expr": "x"}]}, "MODEL_E_AGG"),
    ({"extras": {"storage": {"paths": ["a.parquet"], "partition_def": {"type": "hash", "column": "x"}}}}, "MODEL_E_STORAGE"), ({"extras": {"storage": {"paths": ["a.parquet"], "partition_def": {"type": "range", "column": "x", "values": ["a"]}}}}, "MODEL_E_STORAGE"),
])
def test_models_that_are_refused(change, code):
    base = {"name": "d", "dimensions": [{"name": "x", "data_type": "string"}], "measures": [{"name": "n", "agg": "count", "expr": "x"}, {"name": "least", "agg": "min", "expr": "x"}, {"name": "kinds", "agg": "count_distinct", "expr": "x"}]}
    load({"name": "m", "datasets": [base]})
    with pytest.raises(ModelError, match=code):
        load({"name": "m", "datasets": [base | change]})


def test_cross_filters_are_four():
    ends = [child(catalogue.ORDERS, n="o_orderkey"), child(catalogue.CUSTOMER, s="c_mktsegment")]
    for x in ("none", "left", "right", "both"):
        load(joinset([("s", "string")], [("n", "count")], ends, [rel("orders", "customer", [("o_custkey", "c_custkey")], cross_filter=x)]))
    with pytest.raises(ModelError, match="MODEL_E_RELATIONSHIP"):
        load(joinset([("s", "string")], [("n", "count")], ends, [rel("orders", "customer", [("o_custkey", "c_custkey")], cross_filter="up")]))


def test_declared_partitions_must_be_columns(spark, tmp_path):
    spark.range(4).selectExpr("id", "id % 2 AS half").write.partitionBy("half").parquet(f"{tmp_path}/t")
    ask = lambda column: Engine(spark, model(dataset("t", [("half", "int")], [("n", "count", "id")], extras={"storage": {"format": "parquet", "paths": [f"{tmp_path}/t"], "partition_def": {"type": "list", "column": column, "values": ["0", "1"]}}}))).query({"from": "t", "select": ["half", "n"], "filters": [("half", "eq", 1)]})
    assert [tuple(r) for r in ask("half").collect()] == [(1, 2)]
    assert "PartitionFilters: [isnotnull(half" in ask("half")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ModelError, match="SRC_E_PARTITION"):
        ask("third")


@pytest.mark.parametrize("a, b, want", [
    (T.IntegerType(), T.DoubleType(), T.DoubleType()), (T.LongType(), T.ByteType(), T.LongType()), (T.DateType(), T.TimestampNTZType(), T.TimestampNTZType()), (T.NullType(), T.StringType(), T.StringType()), (T.StringType(), T.NullType(), T.StringType()),
    (T.DecimalType(10, 2), T.IntegerType(), T.DecimalType(12, 2)), (T.DecimalType(10, 2), T.DecimalType(8, 4), T.DecimalType(12, 4)), (T.DecimalType(10, 2), T.FloatType(), T.DoubleType()), (T.BooleanType(), T.BooleanType(), T.BooleanType()),
])
def test_types_widen(a, b, want):
    assert widest("x", a, b) == widest("x", b, a) == want


def test_types_without_a_common_one_are_refused():
    with pytest.raises(QuernError, match="PLAN_E_TYPE"):
        widest("x", T.StringType(), T.LongType())


@pytest.mark.parametrize("at, kind, index, want", [
    ("s3://bucket/a/x=1/y=2", "path", 0, "bucket"), ("s3a://bucket/a", "path", 1, "a"), ("/data/a.parquet", "path", 2, "a.parquet"), ("file:///data/a", "path", 1, "data"), ("/data/*/a", "path", 3, None), ("/data/*/a", "path", 1, "data"),
    ("s3://b/x=1/y=2", "partition", 2, "2"), ("s3://b/x=1/y=*", "partition", 1, None), ("s3://b", "partition", 1, None), (None, "path", 0, None), ("/a", "path", 9, None),
])
def test_places_are_counted_as_an_author_writes_them(at, kind, index, want):
    assert token(at, kind, index) == want


def test_sources_that_contradict_the_request_are_not_read(spark, tmp_path):
    for k in "ab":
        spark.range(3).write.parquet(f"{tmp_path}/{k}/t")
    at = len(str(tmp_path).split("/"))
    d = dataset("t", [{"name": "folder", "data_type": "string", "type": {"metadata": {"path_token": at}}}], [("n", "count", "id")], extras={"storage": {"format": "parquet", "paths": [f"{tmp_path}/*/t", f"{tmp_path}/none*"]}})
    e = Engine(spark, model(d))
    request = {"from": "t", "select": ["folder", "n"], "filters": [("folder", "eq", "b")]}
    assert [tuple(r) for r in e.query(request).collect()] == [("b", 3)]
    plan = e.explain(request)
    assert "skip 1 of 2 sources" in plan and f"{tmp_path}/a/t" not in plan
    assert any(w.startswith("SRC_W001") for w in e.sources.warnings)


def test_the_guard_reads_a_join_once(spark):
    for name in ("join_multi_key", "join_fanout_guard"):
        plan = catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == 1


def test_types_that_do_not_fit_are_told(spark):
    e = Engine(spark, _FAN, catalogue.read(spark, DIR, "orders", "customer"))
    assert e.validate({"from": "j", "select": ["segment", "revenue"]}) == []
    d = model(dataset("orders", [("o_orderkey", "long"), ("bad", "boolean", "o_orderdate AND o_orderkey")], [("n", "count", "o_orderkey")]))
    assert Engine(spark, d, catalogue.read(spark, DIR, "orders")).validate({"from": "orders", "select": ["bad", "n"]})


def test_catalogs_tell_what_they_hold(spark, tmp_path):
    from quern.sources.catalogs import Catalog, open_catalogs

    for name in ("cat_sales_a", "cat_sales_b", "cat_other"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.range(3).selectExpr("id", "date'2024-01-01' AS day").write.partitionBy("day").option("path", f"{tmp_path}/{name}").saveAsTable(name)
    try:
        c = Catalog(spark)
        assert c.list_tables("default", "cat_sales_?") == ["cat_sales_a", "cat_sales_b"] and "cat_other" in c.list_tables()
        assert c.exists("default.cat_other") and not c.exists("default.cat_none")
        assert c.schema("default.cat_other") == {"id": ("bigint", True), "day": ("date", True)}
        m = c.metadata("default.cat_other")
        assert m.location.endswith("cat_other") and m.provider == "parquet" and m.partitions == ("day",) and m.grain == "day"
        for ask in (c.schema, c.metadata):
            with pytest.raises(ModelError, match="CAT_E_TABLE"):
                ask("default.cat_none")
        d = dataset("sales", [("day", "date")], [("n", "count", "id")], extras={"storage": {"tables": ["default.cat_sales_*"]}})
        assert [r.n for r in Engine(spark, model(d)).query({"from": "sales", "select": ["n"]}).collect()] == [6]
    finally:
        for name in ("cat_sales_a", "cat_sales_b", "cat_other"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    opened = open_catalogs(spark, {"catalogs": [{"name": "lake", "spark_catalog": "lake_rest", "uri": "http://${HOST:-localhost}:1", "type": "rest"}]})
    assert opened["lake"].name == "lake_rest" and spark.conf.get("spark.sql.catalog.lake_rest.uri") == "http://localhost:1"


def test_drift_sees_nulls(spark):
    e = Engine(spark, model(dataset("t", [("id", "long")], [("n", "count", "id")])), {"t": spark.range(2)})
    stored = e.columns(nullable=True)
    assert stored == {"t": {"id": ["bigint", False]}} and e.drift(stored) == e.drift(e.columns()) == []
    later = Engine(spark, model(dataset("t", [("id", "long")], [("n", "count", "id")])), {"t": spark.range(2).selectExpr("nullif(id, 0) AS id")})
    assert later.drift(stored) == ["t: id may be null"]
