"""More registered queries: functions at their edges, time, storage, and grains. They join those of catalogue.py."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import (
    _DAILY, _VERSIONS, CUSTOMER, EVENTS, LINES, ORDERS, PART, child, computed, daily, dataset, joinset, model, one, plain, read, register, rel, rounded, versions,
)
from .engine import Engine
from .operators import relational

# functions at their edges; rows with nulls are among them

computed("edge_date_add", "events", "event_id", {
    "day_later": ("timestamp", {"date_add": {"col": "ts", "days": 1}}), "week_ago": ("timestamp", {"date_sub": {"col": "ts", "days": 7}}), "hour_later": ("timestamp", {"date_add": {"col": "ts", "days": 1, "unit": "hour"}}),
    "by_row": ("timestamp", "date_add(ts, event_id % 5)"), "as_date": ("date", "date_add(cast(ts as date), 1)"), "none": ("timestamp", "date_add(CASE WHEN event_type = 'view' THEN ts END, 1)"),
}, {"day_later": "ts + INTERVAL 1 DAY", "week_ago": "ts - INTERVAL 7 DAY", "hour_later": "ts + INTERVAL 1 HOUR", "by_row": "ts + to_days((event_id % 5)::INT)", "as_date": "ts::DATE + 1", "none": "CASE WHEN event_type = 'view' THEN ts + INTERVAL 1 DAY END"})
computed("edge_mod_zero", "part", "p_partkey", {
    "m": ("int", {"mod": ["p_size", {"subtract": ["p_size", 7]}]}), "op": ("int", "p_size % (p_size - 7)"), "f": ("int", "mod(p_size, CASE WHEN p_size > 10 THEN 3 END)"),
}, {"m": "CASE WHEN p_size <> 7 THEN p_size % (p_size - 7) END", "op": "CASE WHEN p_size <> 7 THEN p_size % (p_size - 7) END", "f": "CASE WHEN p_size > 10 THEN p_size % 3 END"})
computed("edge_null_safe_equality", "customer", "c_custkey", {
    "same": ("boolean", {"eq_null_safe": [{"guard": {"condition": "c_nationkey > 9", "col": "c_nationkey"}}, {"guard": {"condition": "c_nationkey < 15", "col": "c_nationkey"}}]}), "other": ("boolean", {"is_distinct_from": [{"nullif": {"col": "c_nationkey", "null_expr": 3}}, 4]}),
    "block": ("boolean", {"eq_null_safe": [{"nullif": {"col": "c_nationkey", "null_expr": 3}}, {"nullif": {"col": "c_nationkey", "null_expr": 3}}]}), "plain_eq": ("boolean", "nullif(c_nationkey, 3) = nullif(c_nationkey, 3)"),
}, {"same": "(CASE WHEN c_nationkey > 9 THEN c_nationkey END) IS NOT DISTINCT FROM (CASE WHEN c_nationkey < 15 THEN c_nationkey END)", "other": "nullif(c_nationkey, 3) IS DISTINCT FROM 4", "block": "TRUE", "plain_eq": "CASE WHEN c_nationkey <> 3 THEN TRUE END"})


def texts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = [(1, "click", "cl%"), (2, "click\n", "click"), (3, "a click", "%ck"), (4, None, "%"), (5, "c_ick", r"c\_ick"), (6, "zzz", None), (7, "", "")]
    return {"texts": relational.values(spark, "id int, t string, p string", rows)}


_TEXTS = r"(VALUES (1, 'click', 'cl%'), (2, 'click' || chr(10), 'click'), (3, 'a click', '%ck'), (4, NULL, '%'), (5, 'c_ick', 'c\_ick'), (6, 'zzz', NULL), (7, '', '')) AS texts(id, t, p)"
register("edge_text_patterns", model(dataset("texts", [("id", "int"), ("full", "boolean", {"regexp_match": {"col": "t", "pattern": "click", "full_match": True}}), ("found", "boolean", {"regexp_match": {"col": "t", "pattern": "click"}}), ("like_col", "boolean", "t LIKE p"), ("ilike_col", "boolean", "upper(t) ILIKE p"), ("at", "int", "position(p, t)")], [("n", "count", "id")])),
         {"from": "texts", "select": ["id", "full", "found", "like_col", "ilike_col", "at"]},
         rf"SELECT id, CASE WHEN t IS NOT NULL THEN t = 'click' END AS full, contains(t, 'click') AS found, t LIKE p ESCAPE '\' AS like_col, upper(t) ILIKE p ESCAPE '\' AS ilike_col, strpos(t, p)::INT AS at FROM {_TEXTS}", frames=texts)


@plain("edge_values_decimal", "SELECT * FROM (VALUES (1, 1.25::DOUBLE, 'a,b'), (2, NULL, NULL)) AS t(id, price, tag)")
def edge_values_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decimal import Decimal

    df = relational.values(spark, "id int, price decimal(10,2), tag string", [(1, Decimal("1.25"), "a,b"), (2, None, None)])
    return df.withColumn("price", F.col("price").cast("double"))


_BRANDS = PART | {"dimensions": PART["dimensions"] + [{"name": "big_brand", "data_type": "string", "expr": "CASE WHEN p_size > 25 THEN p_brand END"}]}
one("request_null_dimension", _BRANDS, {"select": ["p_size", "parts_listed"], "filters": [("big_brand", "is_null")]}, "SELECT p_size, count(*) AS parts_listed FROM part WHERE p_size <= 25 GROUP BY 1")
one("safe_divide_values", dataset("orders", [("o_orderpriority", "string")], [("revenue", "sum", "o_totalprice"), {"name": "late", "agg": "count", "expr": "o_orderkey", "filters": ["o_orderstatus = 'P'"]}], [("per_late", {"safe_divide": ["revenue", "late"]}, "double")]),
    {"select": ["o_orderpriority", "per_late"]}, "SELECT o_orderpriority, round(sum(o_totalprice) / nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0), 4) AS per_late FROM orders GROUP BY 1", rounded("per_late"))
_ACTORS = EVENTS | {"measures": EVENTS["measures"] + [{"name": "buyers", "agg": "count_distinct", "expr": "user_id", "filters": ["event_type = 'purchase'"]}, {"name": "spent", "agg": "avg", "expr": "value", "filters": ["event_type = 'purchase'", "value > 10"]}]}
one("measure_filters_beside_others", _ACTORS, {"select": [{"name": "ts", "grain": "day"}, "users", "buyers", "spent", "event_count"]}, "SELECT date_trunc('day', ts) AS ts, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers, round(avg(value) FILTER (WHERE event_type = 'purchase' AND value > 10), 4) AS spent, count(*) AS event_count FROM events GROUP BY 1", rounded("spent"))
register("approx_distinct_bound", model(EVENTS), {"from": "events", "select": ["event_type", "approx_users", "users"]}, "SELECT DISTINCT event_type, TRUE AS near FROM events", ("events",), then=lambda df: df.select("event_type", (F.abs(F.col("approx_users") - F.col("users")) <= 0.15 * F.col("users")).alias("near")))
_RANKED = dataset("lineitem", [("l_linestatus", "string"), ("l_returnflag", "string")], [("mid", "median", "l_extendedprice"), {"name": "low_q", "agg": {"percentile_cont": [0.25]}, "expr": "l_extendedprice - 20000"}, {"name": "top", "agg": {"percentile_cont": [1.0]}, "expr": "l_quantity"}, {"name": "some", "agg": "median", "expr": "l_quantity", "filters": ["l_quantity > 25"]}, {"name": "none", "agg": "median", "expr": "l_quantity", "filters": ["l_quantity > 1000"]}])
_RANKS = "round(median(l_extendedprice), 4) AS mid, round(quantile_cont(l_extendedprice - 20000, 0.25), 4) AS low_q, max(l_quantity) AS top, median(l_quantity) FILTER (WHERE l_quantity > 25) AS some, NULL::DOUBLE AS none"
one("percentiles_by_group", _RANKED, {"select": ["l_linestatus", "l_returnflag", "mid", "low_q", "top", "some", "none"]}, f"SELECT l_linestatus, l_returnflag, {_RANKS} FROM lineitem GROUP BY 1, 2", rounded("mid", "low_q"))
one("percentiles_grand_total", _RANKED, {"select": ["mid", "low_q", "top", "some", "none"]}, f"SELECT {_RANKS} FROM lineitem", rounded("mid", "low_q"))

# grains: children of one grain stand beside each other


def halves(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders of two times as tables of daily totals; only the later has customers' numbers."""
    o = read(spark, sf_dir, "orders")["orders"]
    out = {}
    for name, part in (("early", o.filter("o_orderdate < '1998-01-01'")), ("late", o.filter("o_orderdate >= '1998-01-01'"))):
        out[name] = part.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day"), "o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("orders_n"), F.max("o_custkey").alias("top"))
    return out


def _half(name: str, **more: str) -> dict:
    return {"name": name, "extras": {"pre_aggregated": True, "semantic_mapping": {"when": "day", "status": "o_orderstatus", "revenue": "total", "order_count": "orders_n"} | more, "temporal": {"events": {"event_time": "when"}, "grain": "day"}}}


_SIBLINGS = {"name": "m", "grainsets": [{"name": "sales", "dimensions": [{"name": "when", "data_type": "timestamp", "type": {"temporal": {}}}, {"name": "status", "data_type": "string"}], "measures": [{"name": "revenue", "agg": "sum", "data_type": "double"}, {"name": "order_count", "agg": "count"}, {"name": "top", "agg": "max"}], "datasets": [_half("early"), _half("late", top="top")]}]}
register("grainset_siblings", _SIBLINGS, {"from": "sales", "select": [{"name": "when", "grain": "month"}, "status", "revenue", "order_count"]}, "SELECT date_trunc('month', o_orderdate) AS \"when\", o_orderstatus AS status, round(sum(o_totalprice), 2) AS revenue, count(*) AS order_count FROM orders GROUP BY 1, 2", frames=halves, then=rounded("revenue", n=2))
register("grainset_siblings_total", _SIBLINGS, {"from": "sales", "select": ["revenue", "order_count", "top"]}, "SELECT round(sum(o_totalprice), 2) AS revenue, count(*) AS order_count, max(o_custkey) FILTER (WHERE o_orderdate >= '1998-01-01') AS top FROM orders", frames=halves, then=rounded("revenue", n=2))
register("unionset_widened", {"name": "m", "unionsets": [{"name": "sizes", "dimensions": [{"name": "what", "data_type": "string"}], "measures": [{"name": "total", "agg": "sum"}, {"name": "most", "agg": "max"}], "datasets": [{"name": "part", "extras": {"semantic_mapping": {"what": {"lit": "part"}, "total": "p_size", "most": "p_size"}}}, {"name": "lineitem", "extras": {"semantic_mapping": {"what": {"lit": "line"}, "total": "l_quantity", "most": "l_quantity"}}}]}]},
         {"from": "sizes", "select": ["what", "total", "most"]}, "SELECT 'part' AS what, sum(p_size)::DOUBLE AS total, max(p_size)::DOUBLE AS most FROM part UNION ALL SELECT 'line', sum(l_quantity)::DOUBLE, max(l_quantity)::DOUBLE FROM lineitem", ("part", "lineitem"), then=lambda df: df.select("what", F.col("total").cast("double").alias("total"), F.col("most").cast("double").alias("most")))

# time, through requests

_STOCK = dataset("daily", [("user_id", "long"), {"name": "day", "data_type": "timestamp", "type": {"temporal": {}}}], [("stock", "sum", "v", "double"), ("held", "count", "user_id")], extras={"temporal": {"snapshot": {"snapshotted_at": "day"}, "grain": "day"}})
register("snapshot_rollup", model(_STOCK), {"from": "daily", "select": [{"name": "day", "grain": "week"}, "stock", "held"], "between": ("2024-01-03", "2024-01-25")},
         f"{_DAILY}, r AS (SELECT *, max(day) OVER (PARTITION BY date_trunc('week', day)) AS z FROM d WHERE day >= TIMESTAMP '2024-01-03' AND day < TIMESTAMP '2024-01-25') SELECT date_trunc('week', day) AS day, round(sum(v), 2) AS stock, count(*) AS held FROM r WHERE day = z GROUP BY 1", frames=daily, then=rounded("stock", n=2))
_SERIES = dataset("daily", [("user_id", "long"), {"name": "day", "data_type": "timestamp", "type": {"temporal": {}}}], [("total", "sum", "v", "double")], extras={"temporal": {"events": {"event_time": "day"}, "grain": "day"}})
register("gap_fill_request", model(_SERIES), {"from": "daily", "select": ["user_id", "day", "total"], "grain": "day", "fill_gaps": True},
         f"{_DAILY}, s AS (SELECT user_id, min(day) AS a, max(day) AS z FROM d GROUP BY 1), e AS (SELECT user_id, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS day FROM s) SELECT e.user_id, e.day::TIMESTAMP AS day, d.v AS total FROM e LEFT JOIN d ON e.user_id IS NOT DISTINCT FROM d.user_id AND e.day = d.day", frames=daily)
_PROBES = {"name": "events", "keys": {"primary": ["event_id"]}, "dimensions": [], "measures": [], "extras": {"semantic_mapping": {"kind": "event_type", "event_count": "event_id", "at": "ts"}, "temporal": {"events": {"event_time": "at"}}}}


def _asof(target: dict, dims: list, measures: list, how: str | None) -> dict:
    return joinset(dims, measures, [_PROBES, target], [rel("events", target["name"], [("user_id", "user_id")], how, as_of=True)])


def later_versions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Versions of users that begin half an hour after the events that made them."""
    v = versions(spark, sf_dir)["versions"]
    late = lambda c: (F.col(c) + F.expr("interval 30 minutes")).alias(c)
    return {"versions": v.select("user_id", "state", late("ts"), late("until")).withColumnsRenamed({"ts": "since"})}


_LATER = f"{_VERSIONS}, l AS (SELECT user_id, state, ts + INTERVAL 30 MINUTE AS since, until + INTERVAL 30 MINUTE AS until FROM v)"
_TARGET = {"name": "versions", "extras": {"semantic_mapping": {"state": "state", "since": "since", "until": "until"}, "temporal": {"scd": {"scd_type": "type2", "valid_from": "since", "valid_to": "until"}}}}
register("asof_relationship_scd", _asof(_TARGET, [("kind", "string"), ("state", "string"), ("at", "timestamp")], [("event_count", "count")], "left"), {"from": "j", "select": ["kind", "state", "event_count"]},
         f"{_LATER} SELECT event_type AS kind, state, count(*) AS event_count FROM events e LEFT JOIN l ON e.user_id = l.user_id AND since <= e.ts AND (l.until > e.ts OR l.until IS NULL) GROUP BY 1, 2", ("events",), later_versions)
_SNAPSHOT = {"name": "daily", "extras": {"semantic_mapping": {"seen": "day"}, "temporal": {"snapshot": {"snapshotted_at": "day"}, "grain": "day"}}}
register("asof_relationship_snapshot", _asof(_SNAPSHOT, [("kind", "string"), ("seen", "timestamp"), ("at", "timestamp")], [("event_count", "count")], "inner"), {"from": "j", "select": ["kind", "seen", "event_count"]},
         f"{_DAILY} SELECT event_type AS kind, d.day AS seen, count(*) AS event_count FROM events e ASOF JOIN (SELECT * FROM d WHERE day < TIMESTAMP '2024-01-20') d ON e.user_id = d.user_id AND e.ts >= d.day GROUP BY 1, 2", ("events",), lambda s, d: {"daily": daily(s, d)["daily"].filter("day < timestamp_ntz'2024-01-20'")})
_STATES = [("user_id", "long"), ("state", "string")]
register("scd1_ignores_asof", model(dataset("versions", _STATES, [("users", "count", "user_id")], extras={"temporal": {"scd": {"scd_type": "type1", "valid_from": "ts"}}})), {"from": "versions", "select": ["state", "users"], "as_of": "2024-01-10"}, f"{_VERSIONS} SELECT state, count(*) AS users FROM v GROUP BY 1", frames=versions)
register("scd2_current_flag", model(dataset("versions", _STATES, [("users", "count", "user_id")], extras={"temporal": {"scd": {"valid_from": "ts", "valid_to": "until", "current_flag": "flag"}}})), {"from": "versions", "select": ["state", "users"]},
         f"{_VERSIONS} SELECT state, count(*) AS users FROM v WHERE until IS NULL GROUP BY 1", frames=lambda s, d: {"versions": versions(s, d)["versions"].withColumn("flag", F.col("until").isNull()).withColumn("until", F.lit(None).cast("timestamp_ntz"))})
register("scd2_last_version", model(dataset("versions", _STATES, [("users", "count", "user_id")], keys={"primary": ["user_id"]}, extras={"temporal": {"scd": {"valid_from": "ts", "valid_to": "until", "open_ended": "none"}}})), {"from": "versions", "select": ["state", "users"]},
         f"{_VERSIONS} SELECT state, count(*) AS users FROM v WHERE until IS NULL GROUP BY 1", frames=lambda s, d: {"versions": versions(s, d)["versions"].withColumn("until", F.coalesce("until", F.col("ts") + F.expr("interval 1 hour")))})
register("scd2_sentinel", model(dataset("versions", _STATES, [("users", "count", "user_id")], extras={"temporal": {"scd": {"valid_from": "ts", "valid_to": "until", "open_ended": "9999-12-31"}}})), {"from": "versions", "select": ["state", "users"]},
         f"{_VERSIONS} SELECT state, count(*) AS users FROM v WHERE until IS NULL GROUP BY 1", frames=lambda s, d: {"versions": versions(s, d)["versions"].withColumn("until", F.coalesce("until", F.expr("timestamp_ntz'9999-12-31'")))})

# storage


def place(spark: SparkSession) -> str:
    """A folder of its own for files that a query writes to read them again."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='quern-')}"
    return f"{base.rstrip('/')}/quern-files/{uuid.uuid4().hex}"


def stored(name: str, dims: list, measures: list, select: list, sql: str, write, storage: dict, filters: list = (), then=None) -> None:
    """A query over files that write(spark, dir, folder) makes; storage's paths are under that folder."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = place(spark)
        write(spark, sf_dir, folder)
        d = dataset("files", dims(folder) if callable(dims) else dims, measures, extras={"storage": storage | {"paths": [f"{folder}/{p}" for p in storage["paths"]]}})
        out = Engine(spark, model(d)).query({"from": "files", "select": select, "filters": list(filters)})
        return then(out) if then else out

    plain(name, sql)(run)


def _nations(fmt: str, **options):
    def write(spark: SparkSession, sf_dir: str, folder: str) -> None:
        df = read(spark, sf_dir, "nation")["nation"].select("n_nationkey", "n_name", "n_regionkey")
        df = df.withColumn("n_name", F.when(F.col("n_nationkey") == 3, None).otherwise(F.col("n_name")))
        df.coalesce(1).write.format(fmt).options(**options).save(f"{folder}/nations")
    return write


_READ_NATIONS = "SELECT n_regionkey, count(*) AS n, sum(n_nationkey)::BIGINT AS keys, count(CASE WHEN n_nationkey <> 3 THEN n_name END) AS named FROM nation GROUP BY 1"
_COUNTED = [("n", "count", "n_nationkey"), ("keys", "sum", "n_nationkey", "long"), ("named", "count", "n_name")]
for _fmt, _write, _storage in (
    ("csv", _nations("csv", sep=";", header="false", nullValue="nil"), {"format": "csv", "delimiter": ";", "has_header": False, "null_sentinel": "nil", "schema": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}}),
    ("csv_header", _nations("csv", header="true", quote="'"), {"format": "csv", "has_header": True, "quote": "'"}),
    ("json", _nations("json"), {"format": "json", "sample_rows": 3}), ("orc", _nations("orc"), {"format": "orc"}), ("parquet", _nations("parquet"), {"format": "parquet"}),
):
    stored(f"storage_{_fmt}", [("n_regionkey", "int")], _COUNTED, ["n_regionkey", "n", "keys", "named"], _READ_NATIONS, _write, _storage | {"paths": ["nations"]})


def _json_array(spark: SparkSession, sf_dir: str, folder: str) -> None:
    df = read(spark, sf_dir, "nation")["nation"]
    parts = F.struct("n_nationkey", F.struct(F.col("n_regionkey").alias("region")).alias("nested"), F.array("n_nationkey").alias("many"))
    df.agg(F.to_json(F.array_sort(F.collect_list(parts))).alias("value")).write.text(f"{folder}/array")


stored("storage_json_nested", [("n_nationkey", "long"), ("nested", "string"), ("many", "string")], [("n", "count", "n_nationkey")], ["n_nationkey", "nested", "many", "n"], "SELECT n_nationkey::BIGINT AS n_nationkey, '{\"region\":' || n_regionkey || '}' AS nested, '[' || n_nationkey || ']' AS many, 1::BIGINT AS n FROM nation", _json_array, {"format": "json", "shape": "array", "paths": ["array"]})


def _by_status(spark: SparkSession, sf_dir: str, folder: str) -> None:
    o = read(spark, sf_dir, "orders")["orders"].select("o_orderkey", "o_totalprice", "o_orderstatus")
    for status in ("F", "O", "P"):
        o.filter(F.col("o_orderstatus") == status).drop("o_orderstatus").coalesce(1).write.parquet(f"{folder}/part-{status}/level={status.lower()}")


def _placed(folder: str) -> list:
    """The path's tokens are counted without its scheme, as an author writes them."""
    at = len(folder.split("://", 1)[-1].removeprefix("file:").split("/"))
    return [{"name": "part", "data_type": "string", "type": {"metadata": {"path_token": at}}}, {"name": "level", "data_type": "string", "type": {"metadata": {"partition_level": 1}}}]


_PLACED = "SELECT 'part-' || o_orderstatus AS part, lower(o_orderstatus) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders"
stored("storage_glob_places", _placed, [("n", "count", "o_orderkey"), ("total", "sum", "o_totalprice")], ["part", "level", "n", "total"], f"{_PLACED} GROUP BY 1, 2", _by_status, {"format": "parquet", "paths": ["part-*/level=*", "nothing-*"]}, then=rounded("total", n=2))
stored("storage_places_pruned", _placed, [("n", "count", "o_orderkey"), ("total", "sum", "o_totalprice")], ["part", "level", "n", "total"], f"{_PLACED} WHERE o_orderstatus = 'O' GROUP BY 1, 2", _by_status, {"format": "parquet", "paths": ["part-*/level=*"]}, [("part", "eq", "part-O")], rounded("total", n=2))

# relationships whose kind of join follows from what is trusted

_SALES = [child(ORDERS, status="o_orderstatus", revenue="o_totalprice", order_count="o_orderkey"), child(CUSTOMER, segment="c_mktsegment", customer_count="c_custkey")]
_FIELDS = ([("segment", "string"), ("status", "string")], [("revenue", "sum"), ("order_count", "count"), ("customer_count", "count")])
for _name, _rel, _kind in (("enforced", rel("orders", "customer", [("o_custkey", "c_custkey")], integrity="enforced"), "JOIN"), ("none", rel("orders", "customer", [("o_custkey", "c_custkey")], integrity="none"), "LEFT JOIN"), ("one_to_many", rel("customer", "orders", [("c_custkey", "o_custkey")], card="one_to_many"), "LEFT JOIN")):
    _tables = "customer LEFT JOIN orders ON c_custkey = o_custkey" if _name == "one_to_many" else f"orders {_kind} customer ON o_custkey = c_custkey"
    register(f"join_default_{_name}", joinset(*_FIELDS, _SALES, [_rel]), {"from": "j", "select": ["segment", "status", "order_count"]}, f"SELECT c_mktsegment AS segment, o_orderstatus AS status, count(o_orderkey) AS order_count FROM {_tables} GROUP BY 1, 2", ("orders", "customer"))
register("join_guard_averages", joinset([("segment", "string")], [("mean_order", "avg"), ("balance", "sum"), ("revenue", "sum")], [child(ORDERS, mean_order="o_totalprice", revenue="o_totalprice"), child(CUSTOMER, segment="c_mktsegment", balance="c_acctbal")], [rel("orders", "customer", [("o_custkey", "c_custkey")])]), {"from": "j", "select": ["segment", "mean_order", "balance", "revenue"]},
         "WITH j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT c_mktsegment AS segment, round(sum(c_acctbal), 2) AS balance FROM (SELECT DISTINCT c_custkey, c_mktsegment, c_acctbal FROM j) GROUP BY 1) SELECT segment, mean_order, balance, revenue FROM (SELECT c_mktsegment AS segment, round(avg(o_totalprice), 4) AS mean_order, round(sum(o_totalprice), 2) AS revenue FROM j GROUP BY 1) JOIN c USING (segment)", ("orders", "customer"), then=lambda df: rounded("mean_order")(rounded("balance", "revenue", n=2)(df)))
one("accessor_of_dimension", ORDERS, {"select": ["o_orderdate", "order_count", "o_orderdate.previous"], "grain": "month"}, "SELECT o_orderdate, n AS order_count, lag(o_orderdate) OVER (ORDER BY o_orderdate) AS before FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, count(*) AS n FROM orders GROUP BY 1)", then=lambda df: df.withColumnRenamed("o_orderdate.previous", "before"))
_LINES = LINES | {"measures": LINES["measures"] + [{"name": "first_shipped", "agg": "min", "expr": "l_shipdate"}]}
one("aggregate_over_dimension", _LINES, {"select": ["l_returnflag", "first_shipped"]}, "SELECT l_returnflag, min(l_shipdate) AS first_shipped FROM lineitem GROUP BY 1")
