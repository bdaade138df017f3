import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quern import catalogue, manifest, streaming
from quern.__main__ import main
from quern.engine import Engine
from quern.errors import ModelError, RequestError
from quern.model import load

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_manifests_survive_storage(tmp_path):
    m = manifest.compile_model(catalogue._ADHOC, {"orders": {"o_orderkey": "bigint"}})
    assert m.adjacency["customer"] == ["orders", "nation"] and "revenue" in m.coverage["orders"]
    assert m.metric_order["orders"].index("open_share") < m.metric_order["orders"].index("double_share")
    for store in (manifest.Memory(), manifest.Folder(tmp_path / "m")):
        store.put("a", m)
        assert store.get("a") == m and store.names() == ["a"] and store.get("a").model.kinds.keys() == m.model.kinds.keys()
        with pytest.raises(ModelError):
            store.get("b")
    broken = json.loads(m.to_json()) | {"digest": "0"}
    with pytest.raises(ModelError):
        manifest.Manifest.from_json(json.dumps(broken))


def test_catalog_settings_take_the_environment():
    text = "catalogs:\n- {name: lake, spark_catalog: prod, properties: {uri: 'http://${HOST}:${PORT:-80}', type: rest}}\n"
    names, conf = manifest.catalogs(text, {"HOST": "h"})
    assert names == {"lake": "prod"} and conf == {"spark.sql.catalog.prod.uri": "http://h:80", "spark.sql.catalog.prod.type": "rest"}
    with pytest.raises(ModelError):
        manifest.catalogs(text, {})
    assert manifest.inferred_grain(["bucket(16, id)", "days(ts)", "year(ts)"]) == "day" and manifest.inferred_grain(["identity"]) is None


def test_partition_folders_are_metadata(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k int, g string").write.partitionBy("g").parquet(f"{tmp_path}/t")
    d = {"name": "t", "dimensions": [{"name": "folder", "data_type": "string", "type": {"metadata": {"partition_level": 1}}}], "measures": [{"name": "n", "agg": "count", "expr": "k"}], "extras": {"storage": {"format": "parquet", "paths": [f"{tmp_path}/t"]}}}
    assert sorted(map(tuple, Engine(spark, {"datasets": [d]}).query({"from": "t", "select": ["folder", "n"]}).collect())) == [("a", 1), ("b", 2)]


def test_the_command_line(spark, tmp_path, capsys):
    p = tmp_path / "m.yaml"
    p.write_text(f"datasets:\n- name: events\n  dimensions: [{{name: event_type, data_type: string}}]\n  measures: [{{name: n, agg: count, expr: event_id}}]\n  extras: {{storage: {{format: parquet, paths: ['{EVENTS}']}}}}\n")
    assert main(["compile", str(p)]) == 0 and '"digest"' in capsys.readouterr().out
    assert main(["schema", str(p)]) == 0
    assert main(["validate", str(p), '{"from": "events", "select": ["n"]}']) == 0
    assert main(["validate", str(p), '{"from": "events", "select": ["x"]}']) == 1
    capsys.readouterr()
    assert main(["query", str(p), '{"from": "events", "select": ["event_type", "n"]}']) == 0
    assert "click" in capsys.readouterr().out
    assert main(["explain", str(p), '{"from": "events", "select": ["n"]}']) == 0


def kind():
    return load({"datasets": [catalogue.EVENTS | {"measures": [*catalogue.EVENTS["measures"], {"name": "clicks", "agg": "count", "expr": "event_id", "filters": ["event_type = 'click'"]}]}]}).kinds["events"]


def drained(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_stream_windows_equal_the_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drained(streaming.rollup(stream, kind(), "ts", "day", ["event_type"], ["event_count", "total", "clicks"], "40 days"), "complete", "quern_days")
    want = batch.groupBy(F.date_trunc("day", "ts").alias("ts"), "event_type").agg(F.count("*").alias("event_count"), F.sum("value").alias("total"), F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"))
    rows = lambda df: sorted((r.ts, r.event_type, r.event_count, round(r.total, 4), r.clicks) for r in df.collect())
    assert rows(got) == rows(want)
    weeks = drained(streaming.rollup(stream, kind(), "ts", "week", [], ["event_count"], "40 days"), "complete", "quern_weeks")
    assert all(r.ts.weekday() == 0 and r.ts.time() == dt.time(0) for r in weeks.collect())


def test_late_rows_and_sessions(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    first = [(1, t, "u"), (2, t + dt.timedelta(minutes=5), "u"), (3, t + dt.timedelta(hours=9), "u")]
    late = [(4, t + dt.timedelta(minutes=1), "u"), (5, t + dt.timedelta(hours=20), "u")]
    schema = "event_id long, ts timestamp, event_type string"
    for k, rows in enumerate((first, late)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in0")
    assert drained(streaming.rollup(stream, kind(), "ts", "hour", ["event_type"], ["event_count"], "1 hour"), "append", "quern_hours").collect()[0].event_count == 2
    got = drained(streaming.sessions(stream, kind(), "ts", "30 minutes", ["event_type"], ["event_count"], "1 hour"), "append", "quern_sessions").collect()
    assert [(r.event_count, r.session_start) for r in got] == [(2, t)]


def test_what_cannot_stream(spark):
    stream = spark.readStream.format("rate").load().withColumnRenamed("timestamp", "ts")
    with pytest.raises(RequestError):
        streaming.rollup(stream, kind(), "ts", "month", [], ["event_count"])
    with pytest.raises(RequestError):
        streaming.rollup(stream, kind(), "ts", "day", [], ["users"])
