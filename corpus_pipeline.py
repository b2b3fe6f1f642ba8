"""The corpus pipeline: language identification, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
reads again as the next stage's docs. All stages but the last return the columns of documents, whatever their names.

Every stage decides row by row: repeated rows and rows that share a doc_id, a null one too, are documents of their own. Empty
tables give empty tables. Very long texts are treated whole (the operators state the memory that they take).
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm import decontamination, jaccard, language, packing
from quarterdeck.llm.storage import free_name, saved


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told. Null texts and texts without any letter are rejected, and all of them if no
    row has a lang to learn from; a null lang is predicted as any other; ties in length of code count as told."""
    rows = language.identified(docs, language.fitted(docs), whole_rows=True)
    predicted = rows.columns[-2]
    return rows.where(F.col(predicted) != language.UNKNOWN).select(docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that the Jaccard join links: that of the smallest doc_id; null is the largest, and rows that tie
    go by their place. Texts without a word link with nothing and stay."""
    row, other = free_name("row_id", docs.columns), free_name("gone_id", docs.columns)
    # written with the number, so that each row has the same one in the join and here
    docs, _ = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    gone = jaccard.joined(docs, row=row).where(~F.col("kept")).select(F.col(row).alias(other))
    return docs.join(gone.hint("merge"), F.col(row) == F.col(other), "left_anti").drop(row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts, and all if the benchmark is empty, stay."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in training sequences; a null or empty text is the end id alone."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_identification", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the trees, the paths or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
