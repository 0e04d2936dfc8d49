"""Stateful operators against plain models, at exact boundaries; functions, sources, and streams against batch."""

import datetime as dt
import json
import random

from argusframe.functions import fields as fn
from argusframe.operators import behaviour as bh
from argusframe.sources import cloud
from argusframe.streaming import alerts as st
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), r, k, "warning") for i, (s, r, k) in enumerate(rows)], "event_id long, ts timestamp, rule_id string, k string, severity string")


def test_limiter_boundaries(spark):
    rows = [(0, "r", "a"), (4.999999, "r", "a"), (5, "r", "a"), (9, "r", "b"), *[(10 + i, "r", f"c{i}") for i in range(9)], (60, "r", "z"), (60.5, "r", "y")]
    found = bh.limited(frame(spark, rows), "rule_id", ["k"]).select("event_id").collect()
    assert sorted(r.event_id for r in found) == [0, 2, 3, *range(4, 11), 14]


def test_limiter_random(spark):
    r = random.Random(1)
    rows = sorted((r.choice(range(0, 300)), r.choice("xy"), r.choice("abc")) for _ in range(400))
    want, last, log = [], {}, {}
    for i, (s, rule, k) in enumerate(rows):
        recent = [x for x in log.get(rule, []) if x >= s - 60]
        if (rule, k) in last and s - last[rule, k] < 5 or len(recent) >= 10:
            continue
        last[rule, k], log[rule] = s, [*recent, s]
        want.append(i)
    assert sorted(x.event_id for x in bh.limited(frame(spark, rows), "rule_id", ["k"]).collect()) == want


def test_aggregation_and_incident_boundaries(spark):
    rows = frame(spark, [(0, "r", "a"), (60, "r", "a"), (60.000001, "r", "a"), (121, "r", "a"), (500, "r", "b")])
    assert sorted((r.k, r.n) for r in bh.aggregated(rows, ["k"]).collect()) == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r.k, r.n) for r in bh.incidents(rows, ["k"]).collect()) == [("a", 1), ("a", 3), ("b", 1)]


def test_limiter_and_aggregation_walk_in_batches(spark):
    """State is carried over batches much smaller than a key's rows, no group is held whole, and the limiter forgets what no longer matters."""
    r = random.Random(3)
    rows = frame(spark, sorted((r.choice(range(0, 900)), r.choice("xy"), r.choice("abcd")) for _ in range(700)))
    results = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found, folded = bh.limited(rows, "rule_id", ["k"]), bh.aggregated(rows, ["rule_id", "k"])
        results.append((sorted(x.event_id for x in found.collect()), sorted(tuple(x) for x in folded.collect())))
        plans = [x._jdf.queryExecution().toString() for x in (found, folded)]
        assert all("FlatMapGroupsInPandas" not in p and "MapInPandas" in p for p in plans)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert results[0] == results[1] and sum(x[-1] for x in results[0][1]) == 700
    local = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(x.event_id for x in bh.limited(local, "rule_id", ["k"]).collect()) == results[0][0] and bh.aggregated(local, ["rule_id", "k"]).count() == len(results[0][1])
    limiter = bh.Limiter(5.0, 10, 60.0)
    for i in range(5000):
        limiter.admit(i * 7.0, (i,))
    assert len(limiter.last) == 1 and len(limiter.log) <= 10


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(2)
    rows = frame(spark, sorted((r.choice(range(0, 200)), r.choice("xy"), r.choice("ab")) for _ in range(150)))
    rows.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = st.stream_limited(source, "rule_id", "k").writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    out.awaitTermination()
    want = sorted(x.event_id for x in bh.limited(rows, "rule_id", ["k"]).collect())
    assert sorted(x.event_id for x in spark.table("limited").collect()) == want


def test_functions(spark):
    row = spark.createDataFrame([("/usr/123/x/lib.so.1", "aabb", "abcd", "a.b.example.org", "192.168.1.255")], "p string, a string, b string, q string, ip string").select(
        fn.directory(F.col("p")).alias("d"), fn.extension(F.col("p")).alias("e"), fn.path_prefix(F.col("p")).alias("x"), fn.entropy(F.col("a")).alias("ea"), fn.entropy(F.col("b")).alias("eb"), fn.base_domain(F.col("q")).alias("base"),
        fn.ipv4_number(F.col("ip")).alias("n"), fn.ipv4_number(F.lit("1.2.3.256")).alias("bad"), fn.truncated(F.lit("abcdef"), 4).alias("t"), fn.masked(F.lit("Cookie"), F.lit("abc"), ["cookie"]).alias("m"), fn.directory(F.lit("x")).alias("root"), fn.size_bucket(F.lit(1024)).alias("s"),
    ).first()
    assert tuple(row) == ("/usr/123/x", ".1", "/usr/*", 1.0, 2.0, "abexample", 3232236031, None, "abc…", "***", "/", 10)


def test_cloud_sources(spark):
    aws = json.dumps({"Records": [{"eventID": "1", "eventSource": "s3.amazonaws.com", "eventName": "Get", "userIdentity": {"arn": "", "principalId": "p"}, "resources": [{"ARN": "x"}]}, {"eventID": "2"}]})
    gcp = json.dumps({"insertId": "g", "resource": {"labels": {"zone": "z"}}, "protoPayload": {"serviceName": "s", "status": {"code": 7}}})
    azure = json.dumps({"records": [{"id": "i", "operationName": "A/b", "claims": {"upn": "u"}, "level": "Error", "resultType": "403", "resourceId": "/subscriptions/1/resourceGroups/rg/x"}]})
    text = lambda x: spark.createDataFrame([(x,)], "value string")
    a = cloud.cloudtrail(text(aws)).collect()
    assert (a[0].service, a[0].principal, a[0].resource) == ("s3", "p", "x") and a[1].principal == ""
    g, z = cloud.gcp_audit(text(gcp)).first(), cloud.azure_activity(text(azure)).first()
    assert (g.error_code, g.region) == ("CODE_7", "z") and (z.service, z.principal, z.error_code, z.region, z.event_id) == ("A", "u", "403", "rg", "i")
    lines = spark.createDataFrame([("5.6.0.0/16 # x",), ("# only",), ("Pool.example ",), ("10.0.0.0/8",)], "value string")
    assert {tuple(r) for r in cloud.indicator_lines(lines).collect()} == {("cidr", "5.6.0.0/16"), ("domain", "pool.example")}
