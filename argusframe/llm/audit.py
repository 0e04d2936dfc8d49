"""Which filters remove what, in every order in which they can be applied.

The orders of the filters form a trie; a node's survivors depend only on the set of filters above it, not on their order. The trie is walked
depth first: a set that is met for the first time has its survivors kept (persisted), counts what each filter still to come removes from
them, and hands them on to its children; a set that was met before is not entered again. Counts go to one written table, by part; no more
survivors are kept at once than a path has nodes. What is kept of a document is its part, its labels and its verdicts, not its text.

Verdicts are formed once a document. A null text is empty, a null source the part ''. Rows without an id count, have no label, and are
neither a copy nor a copy's original; rows that repeat an id count each, and none is a copy of another with the same id. A document is good
or toxic if any of its label rows says so. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import materialize, scratch
from .exact import KEY, assign

WORD = r"[\x20\x09-\x0D]++"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of one text (fixed values): few words, repeated words, capitals, signs."""
    distinct = F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * distinct < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, A, B, C, D, E) of every row; E: identical to the text of a smaller doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", WORD), lambda w: w != ""))
    rows = rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias(KEY[0]), F.octet_length("text").cast("long").alias(KEY[1]), F.xxhash64("text").alias(KEY[2]),
        *[c.alias(n) for n, c in text_filters(F.col("text"), F.col("words")).items()],
    )
    known = assign(rows.where("doc_id is not null"), F.col("doc_id"), KEY)
    known = known.withColumn("E", F.col("__keep") < F.col("doc_id"))
    names = ["doc_id", "part", *"ABCDE"]
    rows = known.select(*names).union(rows.where("doc_id is null").withColumn("E", F.lit(False)).select(*names))
    says = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(says, "doc_id", "left")
    return rows.select("part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], *"ABCDE")


def walk(rows: DataFrame, filters: str, path: str) -> None:
    """Writes to ``path`` a row for each part, set of filters applied and filter next: (part, state, filter, before, removed, good_lost, toxic_lost)."""
    entered = set()

    def count(kept: DataFrame, state: str, left: str) -> None:
        lost = lambda f, *also: F.count_if(reduce(lambda a, b: a & b, [F.col(f), *map(F.col, also)]))
        edges = F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"{f}0").alias("removed"), F.col(f"{f}1").alias("good_lost"), F.col(f"{f}2").alias("toxic_lost")) for f in left])
        sums = kept.groupBy("part").agg(F.count(F.lit(1)).alias("before"), *[c for f in left for c in (lost(f).alias(f"{f}0"), lost(f, "good").alias(f"{f}1"), lost(f, "toxic").alias(f"{f}2"))])
        sums.select("part", F.lit(state).alias("state"), "before", F.inline(edges)).write.mode("append").parquet(path)

    def enter(kept: DataFrame, state: str) -> None:
        left = "".join(f for f in filters if f not in state)
        if state in entered or not left:
            return
        entered.add(state)
        kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
        count(kept, state, left)
        for f in left:
            enter(kept.where(~F.col(f)), "".join(sorted(state + f)))
        kept.unpersist()

    enter(rows, "")


def audit(docs: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step, zeros included: (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley)."""
    spark = docs.sparkSession
    rows = materialize(verdicts(docs, labels), "verdicts")
    path = scratch(spark, "edges")
    walk(rows, filters, path)
    edges = spark.read.schema("part string, state string, before long, filter string, removed long, good_lost long, toxic_lost long").parquet(path)
    alone = lambda f: F.count_if(reduce(lambda a, b: a & b, [F.col(g) if g == f else ~F.col(g) for g in filters]))
    by_filter = F.create_map(*[x for f in filters for x in (F.lit(f), F.struct(F.count_if(F.col(f)).alias("fails"), alone(f).alias("alone")))])
    orders = F.lit(["".join(p) for p in permutations(filters)])
    steps = rows.groupBy("part").agg(by_filter.alias("of")).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumns({"filter": F.expr("substring(filter_order, step, 1)"), "state": F.array_join(F.array_sort(F.split(F.expr("substring(filter_order, 1, step - 1)"), "")), "")})
    steps = steps.join(edges, ["part", "state", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    steps = steps.withColumns({c: zero(c) for c in ("before", "removed", "good_lost", "toxic_lost")}).withColumn("own", F.element_at("of", F.col("filter")))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("before") - F.col("removed")).alias("kept"), "removed", (F.col("own.fails") - F.col("removed")).alias("redundant"),
        F.col("own.alone").alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
