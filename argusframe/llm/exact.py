"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt into runs by a hash of their id. Within a run, equal keys collapse to one entry (identifier to keep,
count). In each round neighbouring runs meet: run numbers are shifted by RADIX bits, entries are sorted by key, and
equal keys merge; after log rounds one entry a key is left. The verdict then walks to the lowest level, where a key
has at most one entry a run, so a key that holds a third of all rows is never gathered in one task. A key is the
SHA-256 of the text, verified at every level by its length and a second, independent 64-bit hash.

Nulls count as empty texts (so null and empty are equal). Rows that repeat both id and text count in group_size, and
one of them is kept. Input columns that share a name with a result column are replaced; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Bits of the run number that one round removes: 4 runs meet in each.
RADIX = 2
MOST_RUNS = 4096
KEY = ["__sha", "__bytes", "__check"]


def run_count(n: int) -> int:
    """The power of two from n up, at most MOST_RUNS."""
    return min(MOST_RUNS, 1 << max(1, (n - 1).bit_length()))


def tree_merge(entries: DataFrame, key: list[str], rounds: int, best) -> DataFrame:
    """Merges (__run, key, __best, __size) over ``rounds`` rounds; returns the lowest level and the root's verdicts."""
    level = entries
    for _ in range(rounds):
        level = level.withColumn("__run", F.shiftright("__run", RADIX)).groupBy("__run", *key).agg(best("__best").alias("__best"), F.sum("__size").alias("__size"))
    return level.drop("__run")


def assign(rows: DataFrame, id_col: Column, key: list[str], keep: str = "min", runs: int | None = None) -> DataFrame:
    """Adds __keep (the id that stays of the rows with equal ``key``), __size and __first (of rows repeated with their id)."""
    best = {"min": F.min, "max": F.max}[keep]
    runs = run_count(runs or partitions(rows.sparkSession))
    rounds = -(-(runs.bit_length() - 1) // RADIX)
    rows = rows.withColumn("__id", id_col).withColumn("__run", F.pmod(F.xxhash64("__id"), F.lit(runs)).cast("int"))
    # a struct as the retained value makes Spark merge sorted runs (sort aggregate) instead of filling hash maps
    lowest = rows.groupBy("__run", *key).agg(best(F.struct("__id")).alias("__best"), F.count(F.lit(1)).alias("__size"))
    root = tree_merge(lowest, key, rounds, best).where("__size > 1")
    down = lowest.select("__run", *key).join(root, key)
    same = Window.partitionBy("__run", *key, "__id").orderBy("__id")
    joined = rows.join(down, ["__run", *key], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.when(F.col("__size") > 1, F.col("__best.__id")).otherwise(F.col("__id")).alias("__keep"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("__size"),
        F.row_number().over(same).alias("__first"),
    )


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", runs: int | None = None) -> DataFrame:
    """The rows of ``docs`` with keep_id, group_size, kept and text_sha256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    rows = docs.drop(*[c for c in added if c in docs.columns])
    names = rows.columns
    rows = rows.withColumns({"__sha": F.unhex(F.sha2(text, 256)), "__bytes": F.octet_length(text).cast("long"), "__check": F.xxhash64(text)})
    found = assign(rows, F.col(id_col), KEY, keep, runs)
    kept = F.col("__keep").eqNullSafe(F.col("__id")) & (F.col("__first") == 1)
    return found.select(*names, F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` with one row of each group of equal texts, its columns unchanged."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    return mark(docs.toDF(*names), at[id_col], at[text_col], keep).where("kept").select(*names).toDF(*docs.columns)
