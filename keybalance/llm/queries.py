"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keybalance.llm import (
    chat_format,
    classifier,
    decontaminate,
    divergence,
    lexical_search,
    packing,
    pii,
    quality,
    secret_scan,
    simhash,
    substring_dedup,
    suffix_dedup,
    url_filter,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substring_dedup.digest(substring_dedup.remove_repeats(docs, with_text=False))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix_dedup.digest(suffix_dedup.remove_repeats(docs, with_text=False))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, test = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.contamination(docs, test))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-1, 0, "user", control), (-1, 1, "assistant", control)],
        "conv_id long, turn long, role string, text string",
    )
    return chat_format.digest(chat_format.format_chats(turns.unionByName(added)))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.components(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures get their fetch day, and the lists their entries, from the pages table."""
    pages = table(spark, sf_dir, "pages")
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), day)
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    found = url_filter.filter_captures(captures, url_filter.dated_entries(pages))
    return found.select(
        "page_id",
        "url",
        F.col("fetched").cast("string").alias("fetched"),
        F.array_join("blocked_by", ",").alias("blocked_by"),
        (F.size("blocked_by") > 0).alias("blocked"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical_search.search(docs, items)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classifier.score_quality(docs, labels)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = [
    op1_secret_scans,
    op2_substring_dedup,
    op3_suffix_dedup,
    op4_decontamination,
    op5_pii,
    op6_chat_formatting,
    op7_simhash_dedup,
    op8_quality_rules,
    op9_packing,
    op10_url_filters,
    op11_lexical_search,
    op12_quality_classifier,
    op13_source_divergence,
]
