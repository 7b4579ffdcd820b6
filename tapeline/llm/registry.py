"""The queries of this subpackage: ``opN_<name>`` and their DuckDB text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tapeline.plans.registry import Query

from . import bpe, classify, codes, decontam, extract, lm, near_vectors, pii, quality, secrets, simhash, substrings, trie

QUERIES: dict[str, Query] = {}


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers import this package too, wherever the driver was started.
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = Query(name, "llm", run, sql)


register("op1_quality_rules", lambda spark, d: quality.quality_rules(table(spark, d, "documents")), quality.SQL)
register("op8_simhash_dedup", lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")))
register("op2_decontamination", lambda spark, d: decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")), decontam.SQL)
register("op5_byte_bpe", lambda spark, d: bpe.encode_digests(table(spark, d, "documents")))
register("op10_lm_scoring", lambda spark, d: lm.score_texts(table(spark, d, "documents")))
register("op3_pii", lambda spark, d: pii.find(table(spark, d, "documents")))
register("op7_secret_scan", lambda spark, d: secrets.scan(table(spark, d, "documents")))
register("op6_quality_classifier", lambda spark, d: classify.quality(table(spark, d, "documents"), table(spark, d, "labels")))
register("op4_html_extraction", lambda spark, d: extract.extract(table(spark, d, "pages")))
register("op9_substring_dedup", lambda spark, d: substrings.repeated_units(table(spark, d, "documents")))
register("op11_near_vectors", lambda spark, d: near_vectors.near_duplicates(table(spark, d, "embeddings")), near_vectors.SQL)
register("op12_vector_codes", lambda spark, d: codes.compress(table(spark, d, "embeddings")), codes.SQL)
register("op13_prefix_trie", lambda spark, d: trie.prefix_trie(table(spark, d, "conversations")), trie.SQL)
