"""Shared folder, tables and small DataFrame helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that the Python operators take; bounds what a worker holds at once.
BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (local runs only) a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="argusframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers each that one written file holds.
FILE_ROWS = 200_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, so a lost executor costs no rerun. rows: how many rows of a few
    numbers it has at most, where that is known; few rows go to few files, as each file makes the executor start a process to set its mode."""
    if rows is not None and (files := rows // FILE_ROWS + 1) < partitions(df.sparkSession):
        df = df.coalesce(files)
    spark, path, done = df.sparkSession, scratch(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(done, "false")
    spark.conf.set(done, "true")  # its shuffle files go when it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(done, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and at most 16 MB, so that long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


#: Bits of the filter of ``maybe_in``, at most (16 MB), and for each id.
MOST_BITS, BITS_PER_ID = 1 << 27, 16


def maybe_in(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` with __maybe: false where ``key`` surely isn't among the doc_id of ``ids`` (a written table), so that the others need no
    shuffle. The filter is a bitmap of hashed ids, sized by their number and broadcast; it tells less above MOST_BITS / 2 ids."""
    slots = min(MOST_BITS, max(1 << 15, 1 << (BITS_PER_ID * ids.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(slots)) + 1
    own = ids.where("doc_id is not null").select(slot("doc_id").alias("s"))
    maps = own.groupBy(F.bitmap_bucket_number("s").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    rows = rows.withColumns({"__bucket": F.bitmap_bucket_number(slot(key)), "__at": F.bitmap_bit_position(slot(key))}).join(F.broadcast(maps), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.expr("int(__at div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("int(pow(2, __at % 8))")
    return rows.withColumn("__maybe", F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop("__bucket", "__bits", "__at")


def id_bounds(df: DataFrame, key: str, buckets: int) -> list:
    """At most ``buckets`` - 1 ascending cut points that deal the rows of ``df`` evenly by ``key`` (a bounded list)."""
    cuts = df.agg(F.percentile_approx(key, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(20 * buckets)).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def bucket_of(key: Column, bounds: list) -> Column:
    """How many of ``bounds`` are <= ``key``, by binary search (log2 steps a row, no join)."""
    steps = max(1, len(bounds).bit_length())
    padded = F.lit([*bounds, *[2**63 - 1] * ((1 << steps) - len(bounds))])
    jumps = F.lit([1 << k for k in reversed(range(steps))])
    return F.aggregate(jumps, F.lit(0), lambda at, jump: at + F.when(F.get(padded, at + jump - 1) <= key, jump).otherwise(0)) if bounds else F.lit(0)
