"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelight.llm import bpe, html, lempel, oracles, packing, quality, secrets, sharding, simhash, spelling, spotsigs, toxicity, trie, urls
from cuelight.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), bpe.word_bpe_path())


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.byte_bpe_files())


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.with_shared_heads(trie.turn_lists(table(spark, sf_dir, "conversations"))))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel.digest(lempel.without_duplicates(table(spark, sf_dir, "documents")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.noisy_words(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_secrets": op2_secrets,
        "op3_sharding": op3_sharding,
        "op4_bpe": op4_bpe,
        "op5_packing": op5_packing,
        "op6_spotsigs": op6_spotsigs,
        "op7_html": op7_html,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_urls": op10_urls,
        "op11_trie": op11_trie,
        "op12_substrings": op12_substrings,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": oracles.secrets_sql(), "op6_spotsigs": oracles.spotsigs_sql(), "op10_urls": oracles.urls_sql(), "op11_trie": oracles.trie_sql(), "op13_spelling": oracles.spelling_sql()}
