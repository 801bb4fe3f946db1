"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablesmith.llm import decontaminate, fingerprints, jaccard, language, licenses, packing, prefix_trie, repair, sharding, squares, token_counts, url_filter, warc
from tablesmith.llm import sql


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    labels = url_filter.text_labels(pages, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return url_filter.filter_urls(pages, labels)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.rank_order(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=decontaminate.SLOP)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group_similar(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(sharding.shuffle_shards(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, token_counts.fit(docs, _vocabulary("piece_bpe_32k.model"))).drop("text")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents"))


def op11_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squares.digests(squares.pack_online(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(_table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filter, op2_best_fit_packing, op3_warc, op4_license_scan, op5_language_id, op6_decontamination, op7_ngram_jaccard, op8_sharding, op9_token_counts, op10_fingerprints, op11_online_packing, op12_structure_repair, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
