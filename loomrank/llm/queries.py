"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm import divergence, flac, html_text, langid, lexsearch, linededup, metricjoin, packing, piece, quality, simhash, tokenbin, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.piece_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenbin.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenbin.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_scores(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_lines", "n_removed")


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.block_features(flac.stored_blocks(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, sequence=1024)
    return got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_sentencepiece, op3_toxicity, op4_token_files, op5_language, op6_html_text, op7_quality, op8_line_dedup, op9_flac, op10_packing, op11_lexical_search, op12_metric_join, op13_divergence)
}
#: The first ten can't be put in DuckDB's SQL as a whole (XXH64, tokenizers, fitted models, media); their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op11_lexical_search": lexsearch.SEARCH_SQL, "op13_divergence": divergence.DIVERGENCE_SQL}
