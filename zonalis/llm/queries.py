"""Registered queries of the corpus operators, each over its whole table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table of fewer input splits than cores, such as one small file, dealt to all cores; a larger table
    stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.simhash import components

    return components(documents(spark, sf_dir))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.warc import archive_and_read

    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.bpe import encode_texts

    return encode_texts(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path(), with_ids=False).drop("text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer_path())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.licenses import scan

    return scan(documents(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.mixing import repetition_rates

    out = repetition_rates(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.substrings import remove_repeats

    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.lz_fingerprints import compare_with_edits

    return compare_with_edits(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.quality_rules import judge

    out = judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[F.round(c, 4).alias(c) for c in ("class_distance", "word_distance")])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.site_quality import score

    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.spelling import group_variants

    return group_variants(documents(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.whitening import entries, whiten

    out = whiten(entries(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))))
    return out.withColumn("deviation", F.col("deviation").cast("bigint"))


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.llm.chat import format_windows, read_back, with_probe

    return read_back(format_windows(with_probe(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")))))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash_near_duplicates": op1_simhash_near_duplicates,
        "op2_warc_round_trip": op2_warc_round_trip,
        "op3_bpe_encode_decode": op3_bpe_encode_decode,
        "op4_token_counts": op4_token_counts,
        "op5_license_scan": op5_license_scan,
        "op6_mix_sources": op6_mix_sources,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_document_fingerprints": op8_document_fingerprints,
        "op9_quality_rules": op9_quality_rules,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_chat_windows": op13_chat_windows,
    }


def oracle_sql() -> dict[str, str]:
    from zonalis.llm import chat, licenses, mixing, quality_rules, spelling, substrings, warc

    return {
        "op2_warc_round_trip": warc.ORACLE,
        "op5_license_scan": licenses.oracle(),
        "op6_mix_sources": mixing.ORACLE,
        "op7_substring_dedup": substrings.ORACLE,
        "op9_quality_rules": quality_rules.oracle(),
        "op11_spelling_variants": spelling.oracle(),
        "op13_chat_windows": chat.oracle(),
    }
