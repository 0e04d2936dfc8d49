"""What differs only on larger tables: numbers beyond those of the small tables, tables in many files, streams of many keys."""

import hashlib

import pytest
from argusframe.functions import tls
from argusframe.operators import behaviour as bh
from argusframe.plans import along_time, queries
from argusframe.streaming import state as st
from pyspark.sql import functions as F


def test_codes_of_more_than_four_digits(spark):
    """Codes are padded to four digits, not cut to them."""
    numbers = [89_999, 0, 7, 65_535, 65_536, 49_199, 1 << 40]
    row = spark.createDataFrame([(numbers,), ([],)], "c array<long>").select(tls.sorted_digest(F.col("c")).alias("d")).collect()
    assert [x.d for x in row] == [hashlib.sha256(",".join(sorted(f"{n:04x}" for n in own)).encode()).hexdigest()[:12] for own in (numbers, [])]


def test_stream_batches_of_many_files(spark, small, tmp_path):
    """Rows are not late because other files of their batch were read before."""
    spark.read.parquet(f"{small}/events.parquet").repartition(16).write.parquet(f"{tmp_path}/events.parquet")
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(c) for c in sizes]
    try:
        for c in sizes:
            spark.conf.set(c, "1048576")
        found = along_time.stream_drift(spark, str(tmp_path))
    finally:
        for c, value in zip(sizes, before, strict=True):
            spark.conf.set(c, value)
    want = bh.drift(queries.events(spark, small), "user_id", "k", "7 days").select("user_id", "k", "first_seen")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def many_keys(spark, tmp_path, n):
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 50).alias("ts"), F.lit("w").alias("w"), F.col("id").alias("v"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")


@pytest.mark.parametrize("name", ["drift", "folded"])
def test_state_is_kept_by_buckets(spark, tmp_path, name):
    """The calls to the state store follow the buckets, not the keys."""
    source = many_keys(spark, tmp_path, 10_000)
    operator = {"drift": lambda x: st.stream_drift(x, "v", "w", 10), "folded": lambda x: st.stream_aggregated(x, ["v", "w"], 20)}[name]
    with st.with_rocksdb(spark):
        query = operator(source).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    told = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]]
    assert told and 0 < max(told) < 8_000


def test_values_of_a_workload_are_dealt_out(spark, tmp_path):
    """One workload's rows wait in all partitions of the state."""
    st.replay(many_keys(spark, tmp_path, 1000), lambda x: st.stream_first_seen(x, ["w"], "v"), f"{tmp_path}/run")
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/run/checkpoint")
    assert waiting.select("partition_id").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
