"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, jaccard, likelihood, merkle, mixing, phrases, pii, quality, repeats, secrets, sharding, wavelet
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sharding.compacted(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.BASE_KINDS)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(repeats.repeated_spans(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, manifest = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_by_document(documents, manifest).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_pii": op4_pii,
    "op5_secret_scans": op5_secret_scans,
    "op6_token_ids": op6_token_ids,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_phrases": op11_phrases,
    "op12_merkle_proofs": op12_merkle_proofs,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op2_sharding": "SELECT doc_id, lang, source, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents",
    "op11_phrases": phrases.SQL,
    "op12_merkle_proofs": merkle.SQL,
    "op13_exact_dedup": exact.SQL,
}
