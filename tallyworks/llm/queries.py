"""Queries of this subpackage by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fim, line_dedup, mil, passages, pii, quality_rules, secrets, shards, simhash, spelling, token_files, url_filter
from .common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    docs = table(spark, sf_dir, "documents")
    manifest, folder = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return token_files.read_documents(manifest, folder)


#: Key of the surrogates; production runs pass their own secret.
PII_KEY = b"demonstration key"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents")
    trees = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.score_documents(docs, trees)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return mil.score_documents(docs, mil.train(docs, table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all documents that stand earlier in the corpus."""
    return line_dedup.repeated_units(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in forty shards near equal in bytes."""
    return shards.assign_shards(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-copy components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle outputs of all documents, as digests, with the texts restored from them."""
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the forms that they are variants of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of fifty words or more of all documents that stand earlier in the corpus, whatever their sentences."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_secrets": op5_secrets,
    "op6_attention_mil": op6_attention_mil,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_histogram_shards": op9_histogram_shards,
    "op10_simhash": op10_simhash,
    "op11_fim": op11_fim,
    "op12_url_filter": op12_url_filter,
    "op13_spelling": op13_spelling,
    "repeated_passages": repeated_passages,
}
ORACLE: dict[str, str] = {"op7_line_dedup": line_dedup.SQL, "op11_fim": fim.SQL, "op12_url_filter": url_filter.SQL, "op13_spelling": spelling.SQL, "repeated_passages": passages.SQL}
