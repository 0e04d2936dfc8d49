"""Corpus preparation: the stages in order, each written and read again before the next.

Every stage takes an empty table, and rows with nulls in any column. A null text counts as empty: it has the classifier's score of an
empty text, is equal to other empty texts, links with nothing, loses nothing, and packs as its end id alone. Rows without an id are
judged by text alone: they link with nothing and lose nothing to the suffix stage. Of repeated rows the exact stage keeps one. All
columns of the input, whatever their names, leave each stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.llm import exact, ngram, packing, quality, suffix
from argusframe.llm.common import materialize, table
from argusframe.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects (score below 0.3)."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # a column of the input may be named score
    scored = quality.score(docs.toDF(*names), model, names[docs.columns.index("text")])
    return scored.where("score >= 0.3").select(*names).toDF(*docs.columns)


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of documents that share at least 0.8 of their five-word shingles."""
    found = ngram.link(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes or more that an earlier document has; n_chars follows the text."""
    cut = suffix.remove(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary()).drop("ids")


STAGES = [("quality", keep_quality), ("exact", keep_one_of_equal), ("ngram", keep_one_of_near), ("suffix", cut_repeats), ("packing", pack)]
#: Classifier, similarity join and packing have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
