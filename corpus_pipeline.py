"""Preparing the documents for training: stages that each apply one operator to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelfx.llm import bpe, decontaminate, pii, simhash, toxicity
from panelfx.llm.components import reliable
from panelfx.llm.queries import table, tokenizer_path
from panelfx.plans.stage import stage


#: Number of a row within a stage; ids can be missing or repeated.
_ROW = "_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written once with a number for every row, so that all passes over it see the same numbers."""
    return stage(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")


def _without(numbered: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose number is not among ``rows``. These are written first, so that the join is chosen by their size."""
    return numbered.join(reliable(rows.select(_ROW).distinct()), _ROW, "left_anti").drop(_ROW)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.5 or more) go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(F.col("text"), model) < 0.5)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id; rows without an id come last.

    Near copies are texts whose fingerprints (SimHash over four words) links of four bits or fewer lead to. Rows with
    equal ids are texts of their own: those that are no copies all stay.
    """
    numbered = _numbered(docs)
    found = simhash.near_duplicates(numbered, _ROW, width=4, distance=4).select(F.col("doc_id").alias(_ROW), "component_id")
    found = reliable(found.join(numbered.select(_ROW, "doc_id"), _ROW))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", _ROW)).alias("first"), F.count("*").alias("n"))
    again = found.join(first.where("n > 1"), "component_id").where(F.col(_ROW) != F.col(f"first.{_ROW}"))
    return _without(numbered, again)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, those without an id too; every row is a text of its own."""
    numbered = _numbered(docs)
    found = decontaminate.contaminated(numbered, table(spark, sf_dir, "benchmark"), _ROW)
    return _without(numbered, found.select(F.col("doc_id").alias(_ROW)))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; every document stays."""
    scanned = pii.scan(docs)
    spans = pii.found(scanned, pii.fit(scanned))
    text = F.when(F.size("spans") > 0, pii.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = spans.withColumn("text", text)
    n_chars = F.when(F.size("spans") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text decoded from them."""
    return bpe.recode(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("near_copies", near_copies), ("decontamination", leaks), ("pii", private), ("bpe", tokens)]
#: Classifiers, fingerprints and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each but the last kept is written once, so that later stages do not repeat the work."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
