"""Threshold-scaled sketches of documents: every word-shingle hash below a fixed fraction of the hash space is kept.

Sketches of parts merge by union into the sketch of the whole and estimate containment between very unequal documents,
because what is kept depends on the hash alone. A text's shingles are its runs of K words (ASCII white space apart; all
its words if it has fewer). Beside these hashes (low) a sketch has the smallest of all its hashes (least), which merges
too and stands in for low in comparisons where low is empty; only a text without words has neither. Everything runs in
DataFrame functions; the arrays of one row are as long as its text.

Nulls count as empty. Two empty sketches have likeness 1, an empty and another 0. Ties of an id are ordered by text.
Rows without an id are left out. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, id_bounds, partitions, text_or_empty

K = 5
#: One in SCALE hashes is kept.
SCALE = 4
#: Buckets of neighbouring ids, between which only one row each is handed over: bytes of text in each, and how many at most.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 1 << 16


def sketch(text: Column, k: int = K, scale: int = SCALE) -> Column:
    """low, the sorted distinct 63-bit hashes that are kept of the shingles of ``text``, and least, the smallest of all (null without words)."""
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), 1))
        few = F.array(F.shiftrightunsigned(F.xxhash64(w), 1))
        return F.when(F.size(w) >= k, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))

    def kept(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < (1 << 63) // scale)))
        return F.struct(low.alias("low"), F.array_min(h).alias("least"))

    return let(let(words, hashes), kept)


def let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def compared(s: Column) -> Column:
    """The hashes that a sketch is compared by."""
    return F.when((F.size(s["low"]) == 0) & s["least"].isNotNull(), F.array(s["least"])).otherwise(s["low"])


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(compared(s), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1."""
    a, b = compared(a), compared(b)
    both, one, two = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return F.when((one == 0) & (two == 0), F.lit(1.0)).otherwise(F.try_divide(both.cast("double"), (one + two - both).cast("double")))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    a, b = compared(a), compared(b)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(a), F.lit(1)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of all shingles of both."""
    return F.struct(F.array_sort(F.array_union(a["low"], b["low"])).alias("low"), F.least(a["least"], b["least"]).alias("least"))


def with_next(docs: DataFrame, id_col: str, tie: str, made: dict[str, Column], buckets: int, descending: bool = True) -> DataFrame:
    """Adds to each row the columns ``made`` and, as next_<column>, these and ``tie`` of the next row by id; the first row follows the last one.

    Rows are dealt into buckets of neighbouring ids at cut points from a quantile sketch. The first row of each
    bucket is copied to the end of the bucket before it, so each bucket finds its rows' successors by itself."""
    spark, key = docs.sparkSession, F.col(id_col).cast("long")
    rows = docs.where(F.col(id_col).isNotNull())
    bounds = id_bounds(rows.select(key.alias("k")), "k", min(MOST_BUCKETS, buckets))
    rows = rows.withColumn("__key", -key if descending else key)
    cuts = sorted(-b for b in bounds) if descending else bounds
    rows = rows.withColumn("__bucket", bucket_of(F.col("__key"), cuts))
    heads = sorted((r["b"], r["k"]) for r in rows.groupBy(F.col("__bucket").alias("b")).agg(F.min("__key").alias("k")).collect())  # at most MOST_BUCKETS rows
    goes = spark.createDataFrame([(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)], "__key long, __to int")
    ties = Window.partitionBy("__bucket").orderBy("__ghost", "__key", tie)
    ghosts = rows.join(F.broadcast(goes), "__key").withColumns({"__bucket": F.col("__to"), "__ghost": F.lit(1)}).drop("__to")
    both = rows.withColumn("__ghost", F.lit(0)).unionByName(ghosts).withColumns(made)
    # plain columns, not a struct of them: a struct would go through the shuffle beside what it is made of
    both = both.withColumns({f"next_{c}": F.lead(c).over(ties) for c in (tie, *made)})
    return both.where("__ghost = 0").drop("__key", "__bucket", "__ghost")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, scale: int = SCALE) -> DataFrame:
    """Sketches of every text and of its edited text: its last third replaced by the beginning of the next document's."""
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = with_next(rows, id_col, "text", {"sketch": sketch(F.col("text"), k, scale)}, max(8 * partitions(docs.sparkSession), size // BUCKET_BYTES))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.substr(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": edited})
    return rows.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("sketch").alias("text_sketch"), sketch(F.col("edited"), k, scale).alias("edited_sketch"), F.col("next_sketch"))
