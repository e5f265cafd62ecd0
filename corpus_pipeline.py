"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run``
writes each result as Parquet to the shared folder and reads it again, and then removes what the stage
stored on its way. All stages but the last return the columns of documents.

Decisions are on rows, not on ids. Defined cases, for each stage: a null text is empty (and fails the
quality rules); null, repeated and clashing ids are kept or dropped row by row; rows that are equal
throughout get the same verdict, but for near duplicates, where one stays; an empty table gives an
empty table; further columns of the input are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netweft.llm import classifier, jaccard, mixing, packing, rules
from netweft.llm.queries import vocabulary
from netweft.llm.shared import cut, documents, release
from netweft.session import scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of predicted quality 1 stay. A null or empty text is scored like any other; without labels of both kinds all rows or none stay."""
    return classifier.keep(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and the threshold table stay; null and empty texts fail."""
    return rules.keep(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of the smallest id stays (null last; of rows with that id any one); so do texts without words, which are in none."""
    return jaccard.keep(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; texts without words are never taken, a null source is a source."""
    return mixing.sample(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in the training sequences; a null text is one end token."""
    return packing.pack(packing.pieces(docs, vocabulary()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Stages 1, 3 and 5 (a fitted model, similarity components, a tokenizer) have no SQL form; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        release(spark)
    return docs
