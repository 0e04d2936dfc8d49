"""Event logs as JSON lines, a synthetic source, and queue messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import events


def read_since(spark: SparkSession, path: str | list[str], since: str | None = None, schema: str = events.SCHEMA) -> DataFrame:
    """Events of one or more log files or folders (an older rotated file among them) after ``since``; lines that are no events are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("ts is not null and event_id is not null")
    return rows.where(F.col("ts") > F.lit(since).cast("timestamp")) if since else rows


def stream_since(spark: SparkSession, path: str, late: str = "10 minutes", files: int = 100, schema: str = events.SCHEMA) -> DataFrame:
    """The same as a stream of the files that come; at most ``files`` a batch, which is also what holds back a flood."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files).json(path).withWatermark("ts", late)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds events to a log folder, a folder a day, so that a later read of some days reads only those."""
    rows.withColumn("day", F.to_date("ts")).write.partitionBy("day").mode("append").json(path)


def char_array(codes):
    """Text of an array of byte numbers up to the first 0, as logs of fixed-width fields hold it."""
    shown = F.slice(codes, 1, F.when(F.array_position(codes, F.lit(0)) > 0, F.array_position(codes, F.lit(0)) - 1).otherwise(F.size(codes)).cast("int"))
    return F.array_join(F.transform(shown, lambda c: F.char(c)), "")


def synthetic(spark: SparkSession, n: int, seed: int = 1, start: str = "2024-01-01", span_s: int = 86_400) -> DataFrame:
    """``n`` events of the common kinds for dry runs, the same for one seed: a function of the row number, so any task makes any part."""
    r = lambda salt, most: F.pmod(F.xxhash64(F.col("id"), F.lit(seed * 1000 + salt)), F.lit(most))
    pick = lambda salt, values: F.element_at(F.array(*[F.lit(v) for v in values]), (r(salt, len(values)) + 1).cast("int"))
    kind = pick(1, ["syscall", "syscall", "network", "file", "file", "dns", "tls", "privesc"])
    null = lambda t: F.lit(None).cast(t)
    kinds = dict(spark.createDataFrame([], events.SCHEMA).dtypes)
    when = lambda k, s: F.when(F.col("event_type") == k, s.cast(kinds[k])).otherwise(null(kinds[k]))
    rows = spark.range(n).select(
        "id", F.col("id").alias("event_id"), kind.alias("event_type"), F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + r(2, span_s * 1_000_000)).alias("ts"),
        (r(3, 500) + 100).alias("pid"), (r(4, 50) + 1).alias("ppid"), pick(5, [0, 0, 33, 1000]).cast("long").alias("uid"), pick(6, ["bash", "nginx", "curl", "python3", "sshd", "postgres"]).alias("comm"),
    )
    address = F.concat(pick(7, ["10.0.", "192.168.", "93.184.", "203.0."]), r(8, 256).cast("string"), F.lit("."), r(9, 256).cast("string"))
    built = {
        "syscall": F.struct(r(10, 340).alias("nr"), F.lit(0).alias("ret"), F.array(*[r(20 + i, 9).cast("decimal(20,0)") for i in range(6)]).alias("args")),
        "network": F.struct(F.lit("10.0.0.1").alias("saddr"), address.alias("daddr"), (r(11, 50_000) + 1024).cast("int").alias("sport"), pick(12, [22, 53, 80, 443, 3333, 9001]).alias("dport"), F.lit(6).alias("proto"), F.lit("ipv4").alias("family")),
        "file": F.struct(F.concat(pick(13, ["/etc/", "/tmp/", "/usr/bin/", "/var/log/"]), r(14, 40).cast("string"), pick(15, ["", ".conf", ".so", ".log"])).alias("filename"), r(16, 3).cast("int").alias("flags"), F.lit(420).alias("mode"), pick(17, ["open", "read", "write"]).alias("op"), null("string").alias("fd_path"), F.lit(False).alias("fd_path_truncated")),
        "dns": F.struct(F.concat(F.left(F.sha2(r(18, 200).cast("string"), 256), (r(19, 14) + 4).cast("int")), pick(21, [".example.org", ".example.com", ".xyz"])).alias("qname"), pick(22, [1, 16, 28]).alias("qtype"), pick(23, [0, 0, 3]).alias("rcode"), r(24, 2).cast("int").alias("direction"), null("array<string>").alias("response_ips")),
        "tls": F.struct(F.lit(1).alias("direction"), F.lit(4).alias("data_len"), F.lit("GET ").alias("data"), null("string").alias("ja3"), null("string").alias("ja4"), null("string").alias("ja3s")),
        "privesc": F.struct(F.lit(0).alias("old_caps"), r(25, 1 << 22).alias("new_caps")),
    }
    rows = rows.select("*", *[when(k, s).alias(k) for k, s in built.items()])
    return rows.select(*[F.col(c) if c in rows.columns else null(t).alias(c) for c, t in kinds.items()])


def queue_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """(bucket, key) of storage notifications, within a notification envelope or bare."""
    records = "array<struct<s3:struct<bucket:struct<name:string>,object:struct<key:string>>>>"
    body = F.coalesce(F.get_json_object(column, "$.Message"), F.col(column).cast("string"))
    old = F.from_json(body, f"s3Bucket string, s3ObjectKey array<string>, Records {records}")
    rows = raw.select(old.alias("m"))
    listed = rows.where("m.s3Bucket is not null").select(F.col("m.s3Bucket").alias("bucket"), F.explode("m.s3ObjectKey").alias("key"))
    return listed.unionByName(rows.select(F.explode("m.Records").alias("r")).select(F.col("r.s3.bucket.name").alias("bucket"), F.col("r.s3.object.key").alias("key")))


def indicator_frames(raw: DataFrame, provider: str, column: str = "value") -> DataFrame:
    """(type, value) of pulled threat feeds, one JSON document a row: attribute lists (misp), pattern lists (stix)."""
    kinds = F.create_map(*[F.lit(x) for pair in {"ip-dst": "ip", "ip-src": "ip", "domain": "dns", "hostname": "dns", "ipv4-addr": "ip", "ipv6-addr": "ip", "domain-name": "dns"}.items() for x in pair])
    if provider == "misp":
        rows = raw.select(F.explode(F.from_json(column, "response struct<Attribute:array<struct<type:string,value:string>>>")["response"]["Attribute"]).alias("a"))
        rows = rows.select(F.try_element_at(kinds, F.col("a.type")).alias("type"), F.col("a.value").alias("value"))
    else:
        rows = raw.select(F.explode(F.from_json(column, "objects array<struct<pattern:string>>")["objects"]).alias("o"))
        part = lambda i: F.regexp_extract("o.pattern", r"\[\s*([a-z0-9-]+):value\s*=\s*'([^']*)'\s*\]", i)
        rows = rows.select(F.try_element_at(kinds, part(1)).alias("type"), part(2).alias("value"))
    return rows.where("type is not null and value <> '' and octet_length(value) <= 253").select("type", F.lower("value").alias("value")).distinct()
