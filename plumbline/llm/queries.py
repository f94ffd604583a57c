"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    alignment,
    decontaminate,
    html_main,
    ngram_join,
    packing,
    piece_codec,
    quality,
    secrets,
    suffix_dedup,
    toxicity,
    url_filter,
    warc,
    whitening,
)
from plumbline.llm.url_filter import rule
from plumbline.sources.tables import load


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(load(spark, sf_dir, "documents"), 4, 85).members

URL_RULES = [
    rule("allow", "org/"),
    rule("block", "example.org/es/"),
    rule("block", "example.org/en/1"),
    rule("allow", "com/fr/"),
    rule("block", "com/de/"),
]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return packing.best_fit_packing(docs, tokenizer_path(), 1024, 2)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(load(spark, sf_dir, "documents")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(load(spark, sf_dir, "pages"), URL_RULES)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, benchmark)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels).drop("passages")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(load(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.write_and_read(load(spark, sf_dir, "pages")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(load(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(load(spark, sf_dir, "embeddings"), 4)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return piece_codec.digest(piece_codec.round_trip(docs, tokenizer_path("piece_bpe_32k.model")))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return alignment.alignment(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secret_scans": op3_secret_scans,
    "op4_url_filters": op4_url_filters,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_html_extraction": op10_html_extraction,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
ORACLES: dict[str, str] = {
    "op4_url_filters": url_filter.oracle(URL_RULES),
    "op5_benchmark_decontamination": decontaminate.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op9_warc": warc.ORACLE,
}
