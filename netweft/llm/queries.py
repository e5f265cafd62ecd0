"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, classifier, counting, jaccard, licenses, matroska, mixing, packing, rules, scoring, sharding, trie, warc
from .shared import documents


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(matroska.store(documents(spark, sf_dir)))


def op2_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of every stored file: track, time, byte range, cluster."""
    return matroska.packets(matroska.store(documents(spark, sf_dir)))


def op2_matroska_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every index entry of every stored file."""
    return matroska.cues(matroska.store(documents(spark, sf_dir)))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).drop("n_links")


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.records(warc.write(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), vocabulary()))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.as_files(documents(spark, sf_dir)))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count(documents(spark, sf_dir), vocabulary())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_matroska, op2_matroska_packets, op2_matroska_cues, op3_jaccard_join, op3_jaccard_links, op4_mixing, op5_sharding, op6_warc,
        op7_quality_classifier, op8_packing, op9_license_scan, op10_lm_scoring, op11_filter_audit, op12_conversation_trie, op13_token_counts, pipeline,
    )
}

#: SQL where it can say the same.
SQL: dict[str, str] = {
    "op1_quality_rules": rules.SQL, "op3_jaccard_join": jaccard.SQL, "op3_jaccard_links": jaccard.LINKS_SQL, "op4_mixing": mixing.SQL, "op6_warc": warc.SQL, "op9_license_scan": licenses.SQL,
    "op11_filter_audit": audit.SQL, "op12_conversation_trie": trie.SQL,
}
