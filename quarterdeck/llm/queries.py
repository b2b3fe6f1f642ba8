"""The queries of this package: thin calls of its operators over whole tables, and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarterdeck.llm import alignment, decontamination, embeddings, html, jaccard, language, licenses, multi_index, oracles, packing, repair, sharding, simple8b, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), _tokenizer())


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identified(docs, language.fitted(docs))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(_table(spark, sf_dir, "embeddings"))


def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(_table(spark, sf_dir, "documents"), _tokenizer())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard_id")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(_table(spark, sf_dir, "documents"))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.searched(_table(spark, sf_dir, "embeddings"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(_table(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.compared(_table(spark, sf_dir, "documents"), _tokenizer(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = (
    op1_warc, op2_packing, op3_html, op4_language, op5_licenses,
    op6_embeddings, op7_simple8b, op8_decontamination, op9_sharding, op10_jaccard,
    op11_multi_index, op12_repair, op13_alignment,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.ORACLE_SQL,
        "op5_licenses": oracles.licenses(licenses.TEMPLATES, licenses.PHRASES, licenses.THRESHOLD),
        "op6_embeddings": oracles.COSINE,
        "op8_decontamination": oracles.CONTAINMENT,
        "op9_sharding": sharding.oracle("documents", "doc_id"),
        "op10_jaccard": oracles.JACCARD,
    }
