"""Registered queries over the driver's tables, each with SQL that must give the same rows.

A query is a model, the frames that stand for its datasets, and a request. SQL is written by hand for each, from what the
request means, so that it checks the engine rather than repeats it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .operators import relational, temporal, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def dataset(name: str, dims: list, measures: list, metrics: list = (), mapping: dict | None = None, **more) -> dict:
    """A dataset's declaration; dims and measures may be written (name, type[, expr]) and (name, agg, expr[, type])."""
    def dim(d):
        if isinstance(d, dict):
            return d
        return {"name": d[0], "data_type": d[1]} | ({"expr": d[2]} if len(d) > 2 else {})

    def measure(m):
        if isinstance(m, dict):
            return m
        return {"name": m[0], "agg": m[1]} | ({"expr": m[2]} if len(m) > 2 and m[2] is not None else {}) | ({"data_type": m[3]} if len(m) > 3 else {})

    extras = more.pop("extras", {}) | ({"semantic_mapping": mapping} if mapping else {})
    return {"name": name, "dimensions": [dim(d) for d in dims], "measures": [measure(m) for m in measures], "metrics": [m if isinstance(m, dict) else {"name": m[0], "expr": m[1]} | ({"data_type": m[2]} if len(m) > 2 else {}) for m in metrics], "extras": extras, **more}


def register(name: str, model: dict | Callable, request: dict, sql: str, tables: tuple[str, ...] = (), frames: Callable | None = None, then: Callable | None = None, **options) -> None:
    """model: a declaration, or its datasets' name. frames: (spark, dir) -> more frames by name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        have = read(spark, sf_dir, *tables) | (frames(spark, sf_dir) if frames else {})
        out = Engine(spark, model() if callable(model) else model, have, **options).query(request)
        return then(out) if then else out

    QUERIES[name] = run
    if sql:
        SQL[name] = nudged(sql)


def plain(name: str, sql: str | None):
    """Register a function (spark, dir) -> DataFrame."""
    def wrap(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


#: Added before means are rounded to 4 places, here and in SQL: an exact half would go either way with the order of a sum.
NUDGE = 3e-8


def rounded(*cols: str, n: int = 4) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(F.col(c) + F.lit(NUDGE if n == 4 else 0.0), n) + F.lit(0.0) for c in cols})


def nudged(sql: str) -> str:
    """SQL with NUDGE in each round(..., 4)."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if sql[:end].endswith(", 4)"):
            sql = f"{sql[: end - 4]} + {NUDGE}, 4){sql[end:]}"
        at += 6
    return sql


# models on the tables as they are

ORDERS = dataset(
    "orders",
    [("o_orderkey", "long"), ("o_custkey", "long"), ("o_orderstatus", "string"), ("o_orderpriority", "string"), {"name": "o_orderdate", "data_type": "timestamp", "type": {"temporal": {"grains": ["day", "week", "month", "quarter", "year"]}}}],
    [("revenue", "sum", "o_totalprice", "double"), ("order_count", "count", "o_orderkey", "long"), ("customers", "count_distinct", "o_custkey", "long"), ("largest", "max", "o_totalprice", "double"), ("smallest", "min", "o_totalprice", "double"),
     {"name": "urgent_revenue", "agg": "sum", "expr": "o_totalprice", "filters": ["o_orderpriority = '1-URGENT'"]}, {"name": "open_count", "agg": "count", "expr": "o_orderkey", "filters": [{"eq": ["o_orderstatus", {"lit": "O"}]}]}],
    [("avg_order_value", "revenue / order_count", "double"), ("open_share", "open_count / order_count"), ("double_share", "open_share * 2"), ("share_label", {"case": {"when": [{"condition": {"gt": ["open_share", 0.34]}, "then": {"lit": "high"}}], "else": {"lit": "low"}}}),
     {"name": "late_value", "expr": "revenue / order_count", "filters": ["o_orderstatus = 'F'"]}],
    keys={"primary": ["o_orderkey"], "foreign": [{"fields": ["o_custkey"], "references": "customer", "target_fields": ["c_custkey"]}]},
)
LINES = dataset(
    "lineitem", [("l_returnflag", "string"), ("l_linestatus", "string"), ("l_orderkey", "long"), ("l_partkey", "long"), ("l_suppkey", "long"), ("l_shipdate", "timestamp")],
    [("quantity", "sum", "l_quantity"), ("gross", "sum", "l_extendedprice"), ("net", "sum", "l_extendedprice * (1 - l_discount)"), ("avg_price", "avg", "l_extendedprice"), ("lines", "count", "l_orderkey"), ("parts", "count_distinct", "l_partkey"), ("median_price", "median", "l_extendedprice"),
     ("sd", "std_dev", "l_extendedprice"), ("sd_pop", "stddev_pop", "l_extendedprice"), ("var_q", "variance", "l_quantity"), ("var_q_pop", "var_pop", "l_quantity"), {"name": "p90", "agg": {"percentile_cont": [0.9]}, "expr": "l_quantity"}, ("low", "min", "l_extendedprice"), ("high", "max", "l_extendedprice")],
    [("discount_share", "1 - net / gross"), ("net_per_line", "net / lines"), ("kept_share", "1 - discount_share"), ("safe", {"safe_divide": ["net", {"subtract": ["lines", "lines"]}]})],
    keys={"primary": ["l_orderkey", "l_linenumber"]},
)
CUSTOMER = dataset("customer", [("c_custkey", "long"), ("c_name", "string"), ("c_mktsegment", "string"), ("c_nationkey", "int")], [("balance", "sum", "c_acctbal"), ("customer_count", "count", "c_custkey")], keys={"primary": ["c_custkey"]})
NATION = dataset("nation", [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")], [("nations", "count", "n_nationkey"), {"name": "nation_names", "agg": {"string_agg": ["|"]}, "expr": "n_name"}], keys={"primary": ["n_nationkey"]})
REGION = dataset("region", [("r_regionkey", "int"), ("r_name", "string")], [("regions", "count", "r_regionkey")], keys={"primary": ["r_regionkey"]})
PART = dataset("part", [("p_partkey", "long"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int")], [("parts_listed", "count", "p_partkey"), ("avg_retail", "avg", "p_retailprice")], keys={"primary": ["p_partkey"]})
EVENTS = dataset("events", [("user_id", "long"), ("event_type", "string"), {"name": "ts", "data_type": "timestamp", "type": {"temporal": {"grains": ["minute", "hour", "day", "week", "month"]}}}], [("total", "sum", "value"), ("mean", "avg", "value"), ("event_count", "count", "event_id"), ("users", "count_distinct", "user_id"), ("approx_users", "approx_count_distinct", "user_id")])


def model(*datasets: dict, **more) -> dict:
    return {"name": "tables", "datasets": list(datasets), **more}


def one(name: str, d: dict, request: dict, sql: str, then=None, **options) -> None:
    register(name, model(d), {"from": d["name"]} | request, sql, (d["name"],), then=then, **options)


# simple datasets, aggregates, filters

one("simple_sum_by_dim", ORDERS, {"select": ["o_orderpriority", "revenue", "order_count", "avg_order_value"]}, "SELECT o_orderpriority, round(sum(o_totalprice), 4) AS revenue, count(*) AS order_count, round(sum(o_totalprice) / count(*), 4) AS avg_order_value FROM orders GROUP BY 1", rounded("revenue", "avg_order_value"))
one("grand_total", LINES, {"select": ["quantity", "net", "lines"]}, "SELECT sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, count(*) AS lines FROM lineitem", rounded("net", n=2))
one("all_aggregates", LINES, {"select": ["l_returnflag", "quantity", "avg_price", "low", "high", "lines", "parts", "median_price", "sd", "sd_pop", "var_q", "var_q_pop", "p90"]},
    "SELECT l_returnflag, sum(l_quantity) AS quantity, round(avg(l_extendedprice), 4) AS avg_price, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS lines, count(DISTINCT l_partkey) AS parts, round(median(l_extendedprice), 4) AS median_price, round(stddev(l_extendedprice), 4) AS sd, round(stddev_pop(l_extendedprice), 4) AS sd_pop, round(variance(l_quantity), 4) AS var_q, round(var_pop(l_quantity), 4) AS var_q_pop, round(quantile_cont(l_quantity, 0.9), 4) AS p90 FROM lineitem GROUP BY 1",
    rounded("avg_price", "median_price", "sd", "sd_pop", "var_q", "var_q_pop", "p90"))
one("string_agg_measure", NATION, {"select": ["n_regionkey", "nation_names"]}, "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS nation_names FROM nation GROUP BY 1")
one("approx_distinct", EVENTS, {"select": ["event_type", "approx_users"]}, "")
one("measure_filter", ORDERS, {"select": ["o_orderstatus", "urgent_revenue", "open_count", "order_count"]}, "SELECT o_orderstatus, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 4) AS urgent_revenue, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_count, count(*) AS order_count FROM orders GROUP BY 1", rounded("urgent_revenue"))
one("entity_filter", ORDERS | {"filters": [{"name": "not_final", "expr": "o_orderstatus != 'F'"}]}, {"select": ["o_orderstatus", "o_orderpriority", "order_count"], "filters": ["not_final"]}, "SELECT o_orderstatus, o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2")
for _name, _op, _value, _sql in (
    ("eq", "eq", "F", "o_orderstatus = 'F'"), ("not_eq", "not_eq", "F", "o_orderstatus <> 'F'"), ("in", "in", ["F", "P"], "o_orderstatus IN ('F', 'P')"), ("not_in", "not_in", ["F", "P"], "o_orderstatus NOT IN ('F', 'P')"), ("is_null", "is_null", None, "o_orderstatus IS NULL"), ("is_not_null", "is_not_null", None, "o_orderstatus IS NOT NULL"),
    ("lt", "lt", 700, "o_custkey < 700"), ("lt_eq", "lt_eq", 700, "o_custkey <= 700"), ("gt", "gt", 700, "o_custkey > 700"), ("gt_eq", "gt_eq", 700, "o_custkey >= 700"), ("between", "between", [100, 700], "o_custkey BETWEEN 100 AND 700"),
):
    one(f"request_filters_{_name}", ORDERS, {"select": ["o_orderpriority", "order_count"], "filters": [{"field": _sql.split()[0], "op": _op, "value": _value}]}, f"SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE {_sql} GROUP BY 1")
one("having_filter", ORDERS, {"select": ["o_custkey", "order_count"], "filters": [("order_count", "gt", 12), ("avg_order_value", "gt", 1000)]}, "SELECT o_custkey, count(*) AS order_count FROM orders GROUP BY 1 HAVING count(*) > 12 AND sum(o_totalprice) / count(*) > 1000")
one("order_limit_offset", PART, {"select": ["p_brand", "p_size", "parts_listed"], "order_by": [("parts_listed", "desc"), "p_brand", "p_size"], "limit": 20, "offset": 5}, "SELECT p_brand, p_size, count(*) AS parts_listed FROM part GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20 OFFSET 5")
one("topk_nulls", PART | {"dimensions": PART["dimensions"] + [{"name": "big_brand", "data_type": "string", "expr": "CASE WHEN p_size > 25 THEN p_brand END"}]}, {"select": ["big_brand", "parts_listed"], "order_by": [("big_brand", "asc", "first")], "limit": 4}, "SELECT CASE WHEN p_size > 25 THEN p_brand END AS big_brand, count(*) AS parts_listed FROM part GROUP BY 1 ORDER BY 1 NULLS FIRST LIMIT 4")
one("dimensions_only", PART, {"select": ["p_brand", "p_type"]}, "SELECT DISTINCT p_brand, p_type FROM part")
one("metric_nested", LINES, {"select": ["l_returnflag", "discount_share", "kept_share"]}, "SELECT l_returnflag, round(1 - sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) AS discount_share, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) AS kept_share FROM lineitem GROUP BY 1", rounded("discount_share", "kept_share", n=6))
one("metric_case", ORDERS, {"select": ["o_orderpriority", "share_label", "double_share"]}, "SELECT o_orderpriority, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') / count(*) > 0.34 THEN 'high' ELSE 'low' END AS share_label, round(2 * count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 6) AS double_share FROM orders GROUP BY 1", rounded("double_share", n=6))
one("metric_filtered", ORDERS, {"select": ["o_orderpriority", "late_value", "revenue"]}, "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / count(*) FILTER (WHERE o_orderstatus = 'F'), 4) AS late_value, round(sum(o_totalprice), 4) AS revenue FROM orders GROUP BY 1", rounded("late_value", "revenue"))
one("safe_divide", LINES, {"select": ["l_linestatus", "safe", "lines"]}, "SELECT l_linestatus, NULL::DOUBLE AS safe, count(*) AS lines FROM lineitem GROUP BY 1")
one("agg_filter_clause", EVENTS, {"select": ["users", "event_count"], "filters": [("event_type", "in", ["view", "click"])]}, "SELECT count(DISTINCT user_id) AS users, count(*) AS event_count FROM events WHERE event_type IN ('view', 'click')")

# computed dimensions: one dataset for each group of functions


def computed(name: str, table: str, key: str, dims: dict[str, tuple], sql: dict[str, str], then=None) -> None:
    """dims: name -> (type, expr); the result is one row for each key."""
    d = dataset(table, [(key, "long"), *((n, t, e) for n, (t, e) in dims.items())], [("row_count", "count", key)])
    one(name, d, {"select": [key, *dims]}, f"SELECT {key}, {', '.join(f'{x} AS {n}' for n, x in sql.items())} FROM {table}", then)


computed("computed_string_case", "customer", "c_custkey", {
    "up": ("string", {"upper": "c_name"}), "low": ("string", {"lower": "c_mktsegment"}), "len": ("int", {"length": "c_name"}), "sub": ("string", {"substr": {"col": "c_name", "start": 3, "length": 4}}), "rest": ("string", {"substring": {"col": "c_name", "start": 5}}), "rev": ("string", {"reverse": "c_mktsegment"}), "first3": ("string", {"left": {"col": "c_name", "length": 3}}), "last3": ("string", {"right": {"col": "c_name", "length": 3}}),
}, {"up": "upper(c_name)", "low": "lower(c_mktsegment)", "len": "length(c_name)", "sub": "substr(c_name, 3, 4)", "rest": "substr(c_name, 5)", "rev": "reverse(c_mktsegment)", "first3": "left(c_name, 3)", "last3": "right(c_name, 3)"})
computed("computed_string_build", "customer", "c_custkey", {
    "label": ("string", {"concat": ["c_name", {"lit": " - "}, "c_mktsegment"]}), "ws": ("string", {"concat_ws": {"separator": "/", "args": ["c_name", "c_mktsegment"]}}), "rep": ("string", {"replace": {"col": "c_name", "old": "Customer", "new": "C"}}), "lp": ("string", {"lpad": {"col": "c_mktsegment", "length": 12, "pad": "*"}}), "rp": ("string", {"rpad": {"col": "c_mktsegment", "length": 12, "pad": "*"}}), "pos": ("int", {"position": {"substring": "0", "col": "c_name"}}), "part": ("string", {"split_part": {"col": "c_name", "delimiter": "#", "index": 2}}), "twice": ("string", {"repeat": {"col": "c_mktsegment", "count": 2}}), "bar": ("string", "c_name || '|' || c_mktsegment"),
}, {"label": "c_name || ' - ' || c_mktsegment", "ws": "concat_ws('/', c_name, c_mktsegment)", "rep": "replace(c_name, 'Customer', 'C')", "lp": "lpad(c_mktsegment, 12, '*')", "rp": "rpad(c_mktsegment, 12, '*')", "pos": "strpos(c_name, '0')", "part": "split_part(c_name, '#', 2)", "twice": "repeat(c_mktsegment, 2)", "bar": "c_name || '|' || c_mktsegment"})
computed("computed_string_trim", "customer", "c_custkey", {
    "t": ("string", {"trim": {"concat": [{"lit": "  "}, "c_name", {"lit": " "}]}}), "l": ("string", {"ltrim": {"col": {"concat": [{"lit": "xx"}, "c_name"]}, "chars": "x"}}), "r": ("string", {"rtrim": {"col": {"concat": ["c_name", {"lit": "yy"}]}, "chars": "y"}}), "sw": ("boolean", {"starts_with": {"col": "c_mktsegment", "prefix": "B"}}), "ew": ("boolean", {"ends_with": {"col": "c_mktsegment", "suffix": "G"}}), "has": ("boolean", {"contains": {"col": "c_mktsegment", "substring": "UI"}}),
}, {"t": "trim('  ' || c_name || ' ')", "l": "ltrim('xx' || c_name, 'x')", "r": "rtrim(c_name || 'yy', 'y')", "sw": "starts_with(c_mktsegment, 'B')", "ew": "ends_with(c_mktsegment, 'G')", "has": "contains(c_mktsegment, 'UI')"})
one("computed_initcap", dataset("customer", [("segment", "string", {"initcap": {"lower": "c_mktsegment"}})], [("n", "count", "c_custkey")]), {"select": ["segment", "n"]}, "SELECT upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment, count(*) AS n FROM customer GROUP BY 1")
computed("computed_math_basic", "part", "p_partkey", {
    "a": ("double", {"abs": {"subtract": ["p_retailprice", 1000]}}), "r": ("double", {"round": {"col": "p_retailprice", "scale": 1}}), "c": ("long", {"ceil": "p_retailprice"}), "f": ("long", {"floor": "p_retailprice"}), "s": ("int", {"sign": {"subtract": ["p_size", 25]}}), "m": ("int", {"mod": ["p_size", 7]}), "neg": ("int", {"negate": "p_size"}), "ex": ("double", "p_size * 2 + p_size / 4 - (1 - 3)"),
}, {"a": "abs(p_retailprice - 1000)", "r": "round(p_retailprice, 1)", "c": "ceil(p_retailprice)::BIGINT", "f": "floor(p_retailprice)::BIGINT", "s": "sign(p_size - 25)::INT", "m": "p_size % 7", "neg": "-p_size", "ex": "(p_size * 2 + p_size / 4 + 2)::DOUBLE"})
computed("computed_math_powers", "part", "p_partkey", {
    "q": ("double", {"sqrt": "p_retailprice"}), "p": ("double", {"power": ["p_size", 2]}), "e": ("double", {"exp": {"divide": ["p_size", 10]}}), "n": ("double", {"ln": "p_retailprice"}), "l2": ("double", {"log": [2, "p_retailprice"]}), "l10": ("double", {"log10": "p_retailprice"}),
}, {"q": "round(sqrt(p_retailprice), 6)", "p": "round(power(p_size, 2), 6)", "e": "round(exp(p_size / 10), 6)", "n": "round(ln(p_retailprice), 6)", "l2": "round(log(2, p_retailprice), 6)", "l10": "round(log10(p_retailprice), 6)"}, rounded("q", "p", "e", "n", "l2", "l10", n=6))
computed("computed_date_parts", "events", "event_id", {
    "y": ("long", {"year": "ts"}), "mo": ("long", {"month": "ts"}), "d": ("long", {"day": "ts"}), "h": ("long", {"hour": "ts"}), "mi": ("long", {"minute": "ts"}), "s": ("long", {"second": "ts"}), "q": ("long", {"date_part": {"part": "quarter", "col": "ts"}}), "x": ("long", {"extract": {"part": "day", "col": "ts"}}),
}, {"y": "year(ts)", "mo": "month(ts)", "d": "day(ts)", "h": "hour(ts)", "mi": "minute(ts)", "s": "second(ts)", "q": "quarter(ts)", "x": "day(ts)"})
computed("computed_date_math", "orders", "o_orderkey", {
    "plus": ("date", {"date_add": {"col": {"cast": {"col": "o_orderdate", "to": "date"}}, "days": 30}}), "minus": ("date", {"date_sub": {"col": {"cast": {"col": "o_orderdate", "to": "date"}}, "days": 7}}), "later": ("timestamp", {"date_add": {"col": "o_orderdate", "days": 2, "unit": "month"}}), "gap": ("long", {"date_diff": {"part": "day", "start": "o_orderdate", "end": {"lit": {"timestamp": "2002-01-01"}}}}), "months": ("long", {"date_diff": {"part": "month", "start": "o_orderdate", "end": {"lit": {"timestamp": "2002-01-01"}}}}), "mon": ("timestamp", {"date_trunc": {"grain": "month", "col": "o_orderdate"}}), "td": ("date", {"to_date": {"lit": "2024-02-29"}}), "tt": ("timestamp", {"to_timestamp": {"lit": "2024-02-29 10:11:12"}}),
}, {"plus": "(o_orderdate::DATE + 30)::DATE", "minus": "(o_orderdate::DATE - 7)::DATE", "later": "o_orderdate + INTERVAL 2 MONTH", "gap": "date_sub('day', o_orderdate::TIMESTAMP, TIMESTAMP '2002-01-01')", "months": "date_sub('month', o_orderdate::TIMESTAMP, TIMESTAMP '2002-01-01')", "mon": "date_trunc('month', o_orderdate)", "td": "DATE '2024-02-29'", "tt": "TIMESTAMP '2024-02-29 10:11:12'"})
computed("computed_regex", "events", "event_id", {
    "find": ("boolean", {"regexp_match": {"col": "props", "pattern": "[0-9]{2}"}}), "full": ("boolean", {"regexp_match": {"col": "event_type", "pattern": "v.*|c.*", "full_match": True}}), "num": ("string", {"regexp_extract": {"col": "props", "pattern": "([0-9]+)", "group": 1}}), "rep": ("string", {"regexp_replace": {"col": "props", "pattern": "[0-9]", "replacement": "#"}}),
}, {"find": "regexp_matches(props, '[0-9]{2}')", "full": "regexp_full_match(event_type, 'v.*|c.*')", "num": "regexp_extract(props, '([0-9]+)', 1)", "rep": "regexp_replace(props, '[0-9]', '#', 'g')"})
computed("computed_predicates", "customer", "c_custkey", {
    "i": ("boolean", {"in": {"col": "c_mktsegment", "list": [{"lit": "BUILDING"}, {"lit": "MACHINERY"}]}}), "ni": ("boolean", {"not_in": {"col": "c_nationkey", "list": [1, 2, 3]}}), "b": ("boolean", {"between": {"col": "c_acctbal", "low": 0, "high": 1000}}), "nb": ("boolean", {"not": {"between": {"col": "c_acctbal", "low": 0, "high": 1000}}}), "l": ("boolean", {"like": {"col": "c_name", "pattern": "%1"}}), "il": ("boolean", {"ilike": {"col": "c_mktsegment", "pattern": "b%"}}), "nl": ("boolean", "c_mktsegment NOT LIKE 'A%'"), "an": ("boolean", {"and": [{"gt": ["c_acctbal", 0]}, {"lte": ["c_nationkey", 10]}]}), "o": ("boolean", "c_acctbal < 0 OR c_nationkey >= 20"), "no": ("boolean", {"not": {"eq": ["c_nationkey", 3]}}), "nn": ("boolean", {"is_not_null": "c_name"}), "isn": ("boolean", {"is_null": "c_name"}),
}, {"i": "c_mktsegment IN ('BUILDING', 'MACHINERY')", "ni": "c_nationkey NOT IN (1, 2, 3)", "b": "c_acctbal BETWEEN 0 AND 1000", "nb": "NOT c_acctbal BETWEEN 0 AND 1000", "l": "c_name LIKE '%1'", "il": "c_mktsegment ILIKE 'b%'", "nl": "c_mktsegment NOT LIKE 'A%'", "an": "c_acctbal > 0 AND c_nationkey <= 10", "o": "c_acctbal < 0 OR c_nationkey >= 20", "no": "c_nationkey <> 3", "nn": "c_name IS NOT NULL", "isn": "c_name IS NULL"})
computed("computed_conditional", "customer", "c_custkey", {
    "cs": ("string", {"case": {"when": [{"condition": {"lt": ["c_acctbal", 0]}, "then": {"lit": "debt"}}, {"condition": "c_acctbal < 5000", "then": {"lit": "some"}}], "else": {"lit": "much"}}}), "iff": ("string", {"if": [{"gt": ["c_nationkey", 12]}, {"lit": "late"}, {"lit": "early"}]}), "g": ("double", {"guard": {"condition": {"gt": ["c_acctbal", 0]}, "col": "c_acctbal"}}), "co": ("double", {"coalesce": [{"guard": {"condition": {"gt": ["c_acctbal", 0]}, "col": "c_acctbal"}}, 0]}), "nu": ("double", {"nullif": {"col": "c_nationkey", "null_expr": 3}}), "gr": ("double", {"greatest": ["c_acctbal", 100]}), "le": ("double", {"least": ["c_acctbal", 100]}), "sd": ("double", {"safe_divide": ["c_acctbal", {"subtract": ["c_nationkey", 3]}]}),
}, {"cs": "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END", "iff": "CASE WHEN c_nationkey > 12 THEN 'late' ELSE 'early' END", "g": "CASE WHEN c_acctbal > 0 THEN c_acctbal END", "co": "CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END", "nu": "nullif(c_nationkey, 3)::DOUBLE", "gr": "greatest(c_acctbal, 100)", "le": "least(c_acctbal, 100)", "sd": "c_acctbal / nullif(c_nationkey - 3, 0)"})
computed("cast_modes", "events", "event_id", {
    "n": ("long", {"cast": {"col": {"regexp_extract": {"col": "props", "pattern": "([0-9]+)", "group": 1}}, "to": "long"}}), "t": ("double", {"cast": {"col": "event_type", "to": "double", "on_failure": "null"}}), "dec": ("decimal(12,2)", "cast(value as decimal(12,2))"), "txt": ("string", "cast(user_id as string)"),
}, {"n": "regexp_extract(props, '([0-9]+)', 1)::BIGINT", "t": "TRY_CAST(event_type AS DOUBLE)", "dec": "round(value, 2)::DECIMAL(12,2)", "txt": "user_id::VARCHAR"}, lambda df: df.withColumn("dec", F.round(F.col("dec").cast("double"), 1)))
SQL["cast_modes"] = SQL["cast_modes"].replace("round(value, 2)::DECIMAL(12,2)", "round(value::DECIMAL(12,2)::DOUBLE, 1)")

# buckets, literals, places

one("bucketed_dim", dataset("orders", [{"name": "tier", "data_type": "string", "type": {"bucketed": {"column": "o_totalprice", "buckets": [{"name": "small", "upper": {"int": 50000}}, {"name": "medium", "lower": {"int": 50000}, "upper": {"int": 200000}}, {"name": "large", "start": 200000, "end": 400000}]}}}], [("n", "count", "o_orderkey")]), {"select": ["tier", "n"]}, "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium' WHEN o_totalprice < 400000 THEN 'large' END AS tier, count(*) AS n FROM orders GROUP BY 1")
one("literal_dim", dataset("orders", [("tenant", "string"), ("version", "int"), ("o_orderstatus", "string")], [("n", "count", "o_orderkey"), ("weight", "sum")], mapping={"tenant": {"lit": "acme"}, "version": {"lit": {"int": 3}}, "weight": {"lit": 2}}), {"select": ["tenant", "version", "o_orderstatus", "n", "weight"]}, "SELECT 'acme' AS tenant, 3 AS version, o_orderstatus, count(*) AS n, (2 * count(*))::BIGINT AS weight FROM orders GROUP BY 3")


@plain("metadata_path_dim", "SELECT 'orders.parquet' AS file, count(*) AS n FROM orders")
def metadata_path_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last token of the path, read through the engine's own storage."""
    path = f"{sf_dir}/orders.parquet"
    token = len(path.split("://", 1)[-1].split("/")) - 1
    d = dataset("orders", [{"name": "file", "data_type": "string", "type": {"metadata": {"path_token": token}}}], [("n", "count", "o_orderkey")], extras={"storage": {"format": "parquet", "paths": [path]}})
    return Engine(spark, model(d)).query({"from": "orders", "select": ["file", "n"]})


# unions

PARTIES = {"unionsets": [{
    "name": "parties", "mode": "all", "dimensions": [{"name": "party", "data_type": "string"}, {"name": "nation", "data_type": "int"}, {"name": "segment", "data_type": "string"}],
    "measures": [{"name": "balance", "agg": "sum", "data_type": "double"}, {"name": "members", "agg": "count"}, {"name": "mean_balance", "agg": "avg"}, {"name": "nations", "agg": "count_distinct"}, {"name": "customer_balance", "agg": "sum"}],
    "metrics": [{"name": "balance_per_member", "expr": "balance / members"}],
    "datasets": [
        {"name": "customer", "extras": {"semantic_mapping": {"party": {"lit": "customer"}, "nation": "c_nationkey", "segment": "c_mktsegment", "balance": "c_acctbal", "members": "c_custkey", "mean_balance": "c_acctbal", "nations": "c_nationkey", "customer_balance": "c_acctbal"}}},
        {"name": "supplier", "extras": {"semantic_mapping": {"party": {"lit": "supplier"}, "nation": "s_nationkey", "balance": "s_acctbal", "members": "s_suppkey", "mean_balance": "s_acctbal", "nations": "s_nationkey"}}},
    ],
}]}
_BOTH = "(SELECT 'customer' AS party, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS bal, c_acctbal AS cbal FROM customer UNION ALL SELECT 'supplier', s_nationkey, NULL, s_acctbal, NULL FROM supplier)"


def parties(name: str, request: dict, sql: str, then=None, mode: str = "all") -> None:
    register(name, {"name": "m", "unionsets": [PARTIES["unionsets"][0] | {"mode": mode}]}, {"from": "parties"} | request, sql, ("customer", "supplier"), then=then)


parties("unionset_all", {"select": ["nation", "balance", "members"]}, f"SELECT nation, round(sum(bal), 2) AS balance, count(*) AS members FROM {_BOTH} GROUP BY 1", rounded("balance", n=2))
parties("unionset_nullfill", {"select": ["segment", "members", "customer_balance"]}, f"SELECT segment, count(*) AS members, round(sum(cbal), 2) AS customer_balance FROM {_BOTH} GROUP BY 1", rounded("customer_balance", n=2))
parties("unionset_metric", {"select": ["nation", "balance_per_member"]}, f"SELECT nation, round(sum(bal) / count(*), 4) AS balance_per_member FROM {_BOTH} GROUP BY 1", rounded("balance_per_member"))
parties("unionset_avg_exact", {"select": ["party", "mean_balance", "nations"]}, f"SELECT party, round(avg(bal), 4) AS mean_balance, count(DISTINCT nation) AS nations FROM {_BOTH} GROUP BY 1", rounded("mean_balance"))
parties("unionset_grand_total", {"select": ["mean_balance", "nations", "members"]}, f"SELECT round(avg(bal), 4) AS mean_balance, count(DISTINCT nation) AS nations, count(*) AS members FROM {_BOTH}", rounded("mean_balance"))
parties("unionset_pruned", {"select": ["nation", "members"], "filters": [("party", "eq", "supplier")]}, "SELECT s_nationkey AS nation, count(*) AS members FROM supplier GROUP BY 1")
parties("unionset_unique", {"select": ["nation", "members"]}, "SELECT nation, sum(members)::BIGINT AS members FROM (SELECT c_nationkey AS nation, count(*) AS members FROM customer GROUP BY 1 UNION SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY 1", mode="unique")
register("multi_source_dataset", lambda: model(dataset("all_orders", [("o_orderstatus", "string")], [("n", "count", "o_orderkey"), ("avg_price", "avg", "o_totalprice"), ("customers", "count_distinct", "o_custkey")], extras={"storage": {"tables": ["early", "late"]}})), {"from": "all_orders", "select": ["o_orderstatus", "n", "avg_price", "customers"]},
         "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1", then=rounded("avg_price"), frames=lambda s, d: {"early": read(s, d, "orders")["orders"].filter("o_orderdate < '1998-01-01'"), "late": read(s, d, "orders")["orders"].filter("o_orderdate >= '1998-01-01'")})

# joins


def rel(a: str, b: str, keys: list, how: str | None = None, card: str = "many_to_one", **more) -> dict:
    return {"name": f"{a}_{b}", "from": a, "to": b, "keys": [{"from": x, "to": y} for x, y in keys], "cardinality": card, **({"type": how} if how else {}), **more}


def joinset(dims: list, measures: list, children: list, rels: list, metrics: list = (), **more) -> dict:
    d = dataset("j", dims, measures, metrics)
    return {"name": "m", "joinsets": [{**d, "datasets": children, "relationships": rels, **more}]}


def child(d: dict, **mapping: str) -> dict:
    return {"name": d["name"], "keys": d.get("keys", {}), "dimensions": [], "measures": [], "extras": {"semantic_mapping": mapping}}


def few(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers of some nations, so that outer joins have something to miss."""
    return {"customer": read(spark, sf_dir, "customer")["customer"].filter("c_nationkey < 5")}


_J = joinset([("segment", "string"), ("status", "string")], [("revenue", "sum"), ("order_count", "count")], [child(ORDERS, status="o_orderstatus", revenue="o_totalprice", order_count="o_orderkey"), child(CUSTOMER, segment="c_mktsegment")], [rel("orders", "customer", [("o_custkey", "c_custkey")])], [("aov", "revenue / order_count")])
for _how, _kind in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    _m = {**_J, "joinsets": [_J["joinsets"][0] | {"relationships": [rel("orders", "customer", [("o_custkey", "c_custkey")], _how)]}]}
    register(f"join_{_how}", _m, {"from": "j", "select": ["segment", "status", "revenue", "order_count"]}, f"SELECT c_mktsegment AS segment, o_orderstatus AS status, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS order_count FROM orders {_kind} (SELECT * FROM customer WHERE c_nationkey < 5) c ON o_custkey = c_custkey GROUP BY 1, 2", ("orders",), few, rounded("revenue", n=2))
register("join_metric", _J, {"from": "j", "select": ["segment", "aov"], "filters": [("status", "eq", "F")]}, "SELECT c_mktsegment AS segment, round(sum(o_totalprice) / count(*), 4) AS aov FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1", ("orders", "customer"), then=rounded("aov"))
_CHAIN = joinset([("region", "string"), ("nation", "string"), ("segment", "string")], [("revenue", "sum"), ("order_count", "count")],
                 [child(ORDERS, revenue="o_totalprice", order_count="o_orderkey"), child(CUSTOMER, segment="c_mktsegment"), child(NATION, nation="n_name"), child(REGION, region="r_name")],
                 [rel("orders", "customer", [("o_custkey", "c_custkey")]), rel("customer", "nation", [("c_nationkey", "n_nationkey")]), rel("nation", "region", [("n_regionkey", "r_regionkey")], "left")])
register("join_four_way", _CHAIN, {"from": "j", "select": ["region", "nation", "revenue", "order_count"]}, "SELECT r_name AS region, n_name AS nation, round(sum(o_totalprice), 2) AS revenue, count(*) AS order_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", ("orders", "customer", "nation", "region"), then=rounded("revenue", n=2))
register("join_multi_key", joinset([("flag", "string")], [("quantity", "sum"), ("stock", "sum")], [child(LINES, flag="l_returnflag", quantity="l_quantity"), {"name": "stock", "keys": {"primary": ["k_part", "k_supp"]}, "extras": {"semantic_mapping": {"stock": "on_hand"}}}], [rel("lineitem", "stock", [("l_partkey", "k_part"), ("l_suppkey", "k_supp")])]),
         {"from": "j", "select": ["flag", "quantity", "stock"]}, "WITH s AS (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS on_hand FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), j AS (SELECT * FROM lineitem JOIN s ON l_partkey = p AND l_suppkey = s) SELECT q.flag, q.quantity, t.stock FROM (SELECT l_returnflag AS flag, sum(l_quantity) AS quantity FROM j GROUP BY 1) q JOIN (SELECT flag, sum(on_hand)::BIGINT AS stock FROM (SELECT DISTINCT l_returnflag AS flag, p, s, on_hand FROM j) GROUP BY 1) t USING (flag)",
         ("lineitem",), lambda s, d: {"stock": read(s, d, "lineitem")["lineitem"].filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("k_part"), F.col("l_suppkey").alias("k_supp")).agg(F.count("*").alias("on_hand"))})
_FAN = joinset([("segment", "string"), {"name": "year", "data_type": "timestamp", "type": {"temporal": {"grains": ["year"]}}}], [("revenue", "sum"), ("balance", "sum"), ("members", "count"), ("mean_balance", "avg")], [child(ORDERS, revenue="o_totalprice", year="o_orderdate"), child(CUSTOMER, segment="c_mktsegment", balance="c_acctbal", members="c_custkey", mean_balance="c_acctbal")], [rel("orders", "customer", [("o_custkey", "c_custkey")])])
register("join_fanout_guard", _FAN, {"from": "j", "select": ["segment", {"name": "year", "grain": "year"}, "revenue", "balance", "members", "mean_balance"]}, "WITH j AS (SELECT *, date_trunc('year', o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey), d AS (SELECT DISTINCT c_mktsegment, year, c_custkey, c_acctbal FROM j) SELECT * FROM (SELECT c_mktsegment AS segment, year, round(sum(o_totalprice), 2) AS revenue FROM j GROUP BY 1, 2) JOIN (SELECT c_mktsegment AS segment, year, round(sum(c_acctbal), 2) AS balance, count(*) AS members, round(avg(c_acctbal), 4) AS mean_balance FROM d GROUP BY 1, 2) USING (segment, year)", ("orders", "customer"), then=lambda df: rounded("mean_balance")(rounded("revenue", "balance", n=2)(df)))
register("join_fanout_raw", _FAN, {"from": "j", "select": ["segment", "balance"]}, "SELECT c_mktsegment AS segment, round(sum(c_acctbal), 0) AS balance FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", ("orders", "customer"), then=rounded("balance", n=0), fanout="raw")
register("join_filtered_relationship", {**_J, "joinsets": [_J["joinsets"][0] | {"relationships": [rel("orders", "customer", [("o_custkey", "c_custkey")], "left", filter="customer.c_acctbal > 0")]}]}, {"from": "j", "select": ["segment", "order_count"]}, "SELECT c_mktsegment AS segment, count(*) AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 GROUP BY 1", ("orders", "customer"))
register("join_expression_key", joinset([("group", "int")], [("order_count", "count"), ("seats", "sum")], [child(ORDERS, order_count="o_orderkey"), {"name": "groups", "keys": {"primary": ["g"]}, "extras": {"semantic_mapping": {"group": "g", "seats": "n"}}}], [rel("orders", "groups", [("o_custkey % 10", "g")])]), {"from": "j", "select": ["group", "order_count", "seats"]}, "SELECT (o_custkey % 10)::INT AS \"group\", count(*) AS order_count, (o_custkey % 10) * 10 AS seats FROM orders WHERE o_custkey % 10 < 7 GROUP BY 1, 3", ("orders",), lambda s, d: {"groups": s.range(7).select(F.col("id").cast("int").alias("g"), (F.col("id") * 10).alias("n"))})

# without a source

_ADHOC = model(ORDERS, CUSTOMER, NATION, REGION, relationships=[rel("orders", "customer", [("o_custkey", "c_custkey")]), rel("customer", "nation", [("c_nationkey", "n_nationkey")]), rel("nation", "region", [("n_regionkey", "r_regionkey")])])
_ALL = ("orders", "customer", "nation", "region")
register("adhoc_single", _ADHOC, {"select": ["o_orderstatus", "order_count"]}, "SELECT o_orderstatus, count(*) AS order_count FROM orders GROUP BY 1", _ALL)
register("adhoc_two", _ADHOC, {"select": ["c_mktsegment", "order_count"]}, "SELECT c_mktsegment, count(*) AS order_count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", _ALL)
register("adhoc_bridge", _ADHOC, {"select": ["r_name", "revenue", "balance"]}, "WITH j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT * FROM (SELECT r_name, round(sum(o_totalprice), 2) AS revenue FROM j GROUP BY 1) JOIN (SELECT r_name, round(sum(c_acctbal), 2) AS balance FROM (SELECT DISTINCT r_name, c_custkey, c_acctbal FROM j) GROUP BY 1) USING (r_name)", _ALL, then=rounded("revenue", "balance", n=2))

# grains

for _g in ("day", "week", "month", "quarter", "year"):
    one(f"grain_{_g}", ORDERS, {"select": ["o_orderdate", "order_count"], "grain": _g}, f"SELECT date_trunc('{_g}', o_orderdate)::TIMESTAMP AS o_orderdate, count(*) AS order_count FROM orders GROUP BY 1")
for _g in ("minute", "hour"):
    one(f"grain_{_g}", EVENTS, {"select": [{"name": "ts", "grain": _g}, "event_count"]}, f"SELECT date_trunc('{_g}', ts) AS ts, count(*) AS event_count FROM events GROUP BY 1")


def monthly(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as a monthly table of totals."""
    o = read(spark, sf_dir, "orders")["orders"]
    return {"monthly": o.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month_start"), "o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("orders_n"), F.max("o_totalprice").alias("biggest"))}


_GRAINSET = {"name": "sales", "dimensions": [{"name": "when", "data_type": "timestamp", "type": {"temporal": {"grains": ["day", "month", "quarter", "year"]}}}, {"name": "status", "data_type": "string"}, {"name": "priority", "data_type": "string"}],
             "measures": [{"name": "revenue", "agg": "sum", "data_type": "double"}, {"name": "order_count", "agg": "count", "data_type": "long"}, {"name": "largest", "agg": "max"}, {"name": "customers", "agg": "count_distinct"}], "metrics": [{"name": "aov", "expr": "revenue / order_count"}],
             "datasets": [
                 {"name": "orders", "extras": {"semantic_mapping": {"when": "o_orderdate", "status": "o_orderstatus", "priority": "o_orderpriority", "revenue": "o_totalprice", "order_count": "o_orderkey", "largest": "o_totalprice", "customers": "o_custkey"}, "temporal": {"events": {"event_time": "when"}, "grain": "day"}}},
                 {"name": "monthly", "extras": {"pre_aggregated": True, "semantic_mapping": {"when": "month_start", "status": "o_orderstatus", "revenue": "total", "order_count": "orders_n", "largest": "biggest"}, "temporal": {"events": {"event_time": "when"}, "grain": "month"}}},
             ]}
_GM = {"name": "m", "grainsets": [_GRAINSET]}
register("grainset_route_coarse", _GM, {"from": "sales", "select": [{"name": "when", "grain": "quarter"}, "status", "revenue", "order_count", "largest"]}, "SELECT date_trunc('quarter', o_orderdate) AS \"when\", o_orderstatus AS status, round(sum(o_totalprice), 2) AS revenue, count(*) AS order_count, max(o_totalprice) AS largest FROM orders GROUP BY 1, 2", ("orders",), monthly, rounded("revenue", n=2))
register("grainset_route_fine", _GM, {"from": "sales", "select": [{"name": "when", "grain": "month"}, "priority", "order_count"]}, "SELECT date_trunc('month', o_orderdate) AS \"when\", o_orderpriority AS priority, count(*) AS order_count FROM orders GROUP BY 1, 2", ("orders",), monthly)
register("grainset_mixed", _GM, {"from": "sales", "select": [{"name": "when", "grain": "year"}, "revenue", "aov", "customers"]}, "SELECT date_trunc('year', o_orderdate) AS \"when\", round(sum(o_totalprice), 2) AS revenue, round(sum(o_totalprice) / count(*), 4) AS aov, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1", ("orders",), monthly, lambda df: rounded("aov")(rounded("revenue", n=2)(df)))
register("nested_union_of_grainset", {"name": "m", "grainsets": [_GRAINSET], "unionsets": [{"name": "all", "dimensions": [{"name": "when", "data_type": "timestamp", "type": {"temporal": {}}}, {"name": "status", "data_type": "string"}], "measures": [{"name": "revenue", "agg": "sum"}, {"name": "order_count", "agg": "count"}],
         "grainsets": [{"ref": "sales"}], "datasets": [{"name": "events", "extras": {"semantic_mapping": {"when": "ts", "status": "event_type", "revenue": "value", "order_count": "event_id"}}}]}]},
         {"from": "all", "select": ["status", "revenue", "order_count"]}, "SELECT status, round(sum(v), 2) AS revenue, count(*) AS order_count FROM (SELECT o_orderstatus AS status, o_totalprice AS v FROM orders UNION ALL SELECT event_type, value FROM events) GROUP BY 1", ("orders", "events"), monthly, rounded("revenue", n=2))

# measures that don't add up over time

_SEMI = dataset("daily", [("user_id", "long"), {"name": "day", "data_type": "timestamp", "type": {"temporal": {"grains": ["day", "week", "month"]}}}],
                [{"name": "closing", "agg": "sum", "expr": "v", "data_type": "double", "additivity": {"semi": {"axes": ["day"], "strategy": "latest"}}}, {"name": "opening", "agg": "sum", "expr": "v", "data_type": "double", "additivity": {"semi": {"non_additive_dimensions": ["day"], "resolution_strategy": "earliest"}}}, {"name": "typical", "agg": "sum", "expr": "v", "data_type": "double", "additivity": {"semi": {"axes": ["day"], "strategy": "average"}}}, ("flow", "sum", "v", "double")])


def daily(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e = read(spark, sf_dir, "events")["events"]
    return {"daily": e.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.round(F.sum("value"), 2).alias("v"))}


_DAILY = "WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, round(sum(value), 2) AS v FROM events GROUP BY 1, 2)"
register("semi_latest", model(_SEMI), {"from": "daily", "select": ["user_id", "closing", "flow"]}, f"{_DAILY} SELECT user_id, round(arg_max(v, day), 2) AS closing, round(sum(v), 2) AS flow FROM d GROUP BY 1", frames=daily, then=rounded("closing", "flow", n=2))
register("semi_earliest", model(_SEMI), {"from": "daily", "select": [{"name": "day", "grain": "week"}, "opening"]}, f"{_DAILY}, w AS (SELECT *, date_trunc('week', day) AS wk FROM d), m AS (SELECT wk, min(day) AS a FROM w GROUP BY 1) SELECT w.wk AS day, round(sum(v), 2) AS opening FROM w JOIN m ON w.wk = m.wk AND w.day = m.a GROUP BY 1", frames=daily, then=rounded("opening", n=2))
register("semi_average", model(_SEMI), {"from": "daily", "select": ["typical", "closing", "opening", "flow"]}, f"{_DAILY}, t AS (SELECT day, sum(v) AS s FROM d GROUP BY 1) SELECT round(avg(s), 2) AS typical, round(arg_max(s, day), 2) AS closing, round(arg_min(s, day), 2) AS opening, round(sum(s), 2) AS flow FROM t", frames=daily, then=rounded("typical", "closing", "opening", "flow", n=2))

# accessors and windows

_M = "WITH m AS (SELECT date_trunc('month', o_orderdate) AS o_orderdate, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)"
for _a, _sql in {"previous": "lag(n) OVER w", "next": "lead(n) OVER w", "lag(2)": "lag(n, 2) OVER w", "lead(3)": "lead(n, 3) OVER w", "delta": "n - lag(n) OVER w", "percent_change": "round((n - lag(n) OVER w) / lag(n) OVER w, 6)", "first": "first_value(n) OVER f", "last": "last_value(n) OVER f"}.items():
    _col = f"order_count.{_a}"
    one(f"acc_{_a.split('(')[0]}", ORDERS, {"select": ["o_orderdate", "o_orderstatus", "order_count", _col], "grain": "month"}, f"{_M} SELECT o_orderdate, o_orderstatus, n AS order_count, ({_sql})::DOUBLE AS acc FROM m WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate), f AS (PARTITION BY o_orderstatus ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        (lambda c, a: lambda df: df.withColumn("acc", F.round(F.col(f"`{c}`").cast("double"), 6)).drop(c))(_col, _a))


@plain("window_ranks", "SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")["orders"]
    df = windows.window(df, "rn", "row_number", ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    for n, f in (("rk", "rank"), ("dr", "dense_rank")):
        df = windows.window(df, n, f, ["o_custkey"], [F.asc("o_orderpriority")])
    return df.select("o_custkey", "o_orderkey", "rn", "rk", "dr")


@plain("window_frames", "SELECT o_orderkey, sum(o_orderkey) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS rows3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS groups2, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS range1000, first_value(o_orderkey) OVER w AS first, (lead(o_orderkey, 2) OVER w)::DOUBLE AS lead2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")["orders"]
    key, order = F.col("o_orderkey"), [F.asc("o_orderdate"), F.asc("o_orderkey")]
    df = windows.window(df, "rows3", "sum", ["o_custkey"], order, key, ("rows", -2, 0))
    df = windows.window(df, "groups2", "count", ["o_custkey"], [F.asc("o_orderpriority")], F.lit(1), ("groups", -1, 0))
    df = windows.window(df, "range1000", "count", ["o_custkey"], [F.asc("o_orderkey")], F.lit(1), ("range", -500, 500))
    df = windows.window(df, "first", "first_value", ["o_custkey"], order, key)
    df = windows.window(df, "lead2", "lead", ["o_custkey"], order, key, n=2)
    return df.select("o_orderkey", "rows3", "groups2", "range1000", "first", F.col("lead2").cast("double").alias("lead2"))


# time

_SPAN = EVENTS | {"extras": {"temporal": {"events": {"event_time": "ts"}, "grain": "minute"}}}
one("events_range", _SPAN, {"select": ["event_type", "event_count"], "between": ("2024-01-05", "2024-01-12")}, "SELECT event_type, count(*) AS event_count FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1")
_SNAP = dataset("daily", [("user_id", "long"), ("day", "timestamp")], [("stock", "sum", "v", "double"), ("held", "count", "user_id")], extras={"temporal": {"snapshot": {"snapshotted_at": "day"}, "grain": "day"}})
register("snapshot_asof", model(_SNAP), {"from": "daily", "select": ["day", "stock", "held"], "as_of": "2024-01-15 12:00:00"}, f"{_DAILY} SELECT day, round(sum(v), 2) AS stock, count(*) AS held FROM d WHERE day = (SELECT max(day) FROM d WHERE day <= TIMESTAMP '2024-01-15 12:00:00') GROUP BY 1", frames=daily, then=rounded("stock", n=2))
register("snapshot_latest", model(_SNAP), {"from": "daily", "select": ["day", "held"]}, f"{_DAILY} SELECT day, count(*) AS held FROM d WHERE day = (SELECT max(day) FROM d) GROUP BY 1", frames=daily)


def versions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Each user's events as versions that hold until the next."""
    e = read(spark, sf_dir, "events")["events"].groupBy("user_id", "ts").agg(F.min("event_type").alias("state"))
    return {"versions": e.withColumn("until", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")))}


_VERSIONS = "WITH e AS (SELECT user_id, ts, min(event_type) AS state FROM events GROUP BY 1, 2), v AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM e)"
_SCD = dataset("versions", [("user_id", "long"), ("state", "string")], [("users", "count", "user_id")], extras={"temporal": {"scd": {"scd_type": "type2", "valid_from": "ts", "valid_to": "until"}}})
register("scd2_asof", model(_SCD), {"from": "versions", "select": ["state", "users"], "as_of": "2024-01-10"}, f"{_VERSIONS} SELECT state, count(*) AS users FROM v WHERE ts <= TIMESTAMP '2024-01-10' AND (until > TIMESTAMP '2024-01-10' OR until IS NULL) GROUP BY 1", frames=versions)
register("scd2_current", model(_SCD), {"from": "versions", "select": ["state", "users"]}, f"{_VERSIONS} SELECT state, count(*) AS users FROM v WHERE until IS NULL GROUP BY 1", frames=versions)
register("scd2_range", model(_SCD), {"from": "versions", "select": ["state", "users"], "between": ("2024-01-10", "2024-01-11")}, f"{_VERSIONS} SELECT state, count(*) AS users FROM v WHERE ts < TIMESTAMP '2024-01-11' AND (until > TIMESTAMP '2024-01-10' OR until IS NULL) GROUP BY 1", frames=versions)


@plain("asof_join_scd", f"{_VERSIONS} SELECT p.event_id, v.state FROM (SELECT event_id, user_id, ts + INTERVAL 90 MINUTE AS at FROM events WHERE event_type = 'purchase') p LEFT JOIN v ON p.user_id = v.user_id AND v.ts <= p.at AND (v.until > p.at OR v.until IS NULL)")
def asof_join_scd(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = read(spark, sf_dir, "events")["events"].filter("event_type = 'purchase'").select("event_id", "user_id", (F.col("ts") + F.expr("interval 90 minutes")).alias("at"))
    return temporal.asof_join(probes, versions(spark, sf_dir)["versions"], ["user_id"], "at", "ts", ["state"], "until").select("event_id", "state")


@plain("asof_join_snapshot", f"{_DAILY} SELECT e.event_id, d.day AS seen_day, d.v AS seen FROM events e ASOF LEFT JOIN (SELECT * FROM d WHERE day < TIMESTAMP '2024-01-20' AND v > 0) d ON e.user_id = d.user_id AND e.ts >= d.day")
def asof_join_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)["daily"].filter("day < timestamp_ntz'2024-01-20' AND v > 0").select("user_id", F.col("day"), F.col("day").alias("seen_day"), F.col("v").alias("seen"))
    return temporal.asof_join(read(spark, sf_dir, "events")["events"], d, ["user_id"], "ts", "day", ["seen_day", "seen"]).select("event_id", "seen_day", "seen")


@plain("snapshot_period_end", f"{_DAILY}, w AS (SELECT *, max(day) OVER (PARTITION BY user_id, date_trunc('week', day)) AS z FROM d) SELECT user_id, day, v FROM w WHERE day = z")
def snapshot_period_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.last_in_period(daily(spark, sf_dir)["daily"], "day", "week", ["user_id"])


@plain("gap_fill", f"{_DAILY}, s AS (SELECT user_id, min(day) AS a, max(day) AS z FROM d GROUP BY 1), e AS (SELECT user_id, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS day FROM s) SELECT e.user_id, e.day::TIMESTAMP AS day, d.v FROM e LEFT JOIN d ON e.user_id = d.user_id AND e.day = d.day")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.fill_gaps(daily(spark, sf_dir)["daily"], "day", "day", ["user_id"]).select("user_id", "day", "v")


# relational operators

@plain("values_source", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS t(id, name)")
def values_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.values(spark, "id int, name string", [(1, "a"), (2, None), (3, "c")])


@plain("set_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "customer", "supplier")
    return relational.union([t["customer"].select(F.col("c_nationkey").alias("nation")), t["supplier"].select(F.col("s_nationkey").alias("nation"))], distinct=True)


@plain("plan_nodes", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10 OFFSET 2")
def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "customer", "nation")
    joined = relational.join(t["customer"], t["nation"], [("c_nationkey", "n_nationkey")])
    out = relational.aggregate(joined, ["n_name"], [("customers", F.count("*"))])
    return relational.fetch(relational.sort(out, [("customers", True, "last"), ("n_name", False, None)]), 10, 2)


from . import catalogue_features  # noqa: E402, F401 - registers more queries
