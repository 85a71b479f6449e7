"""The operators' queries with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import decontamination, fingerprints, html_extraction, language_id, license_scan, near_dedup, packing, quality, substring_dedup, url_filter
from tessella.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.fitted(docs)
    judged = language_id.identify(docs.select("doc_id", "text"), net)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target texts are labelled as good and not toxic; as large a share is sampled as they have of all labelled rows."""
    labels = table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    share = labels.agg(F.avg(good.cast("double"))).first()[0]
    return quality.resample(table(spark, sf_dir, "documents"), labels.filter(good), 1.0 if share is None else share)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "common", "total")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, width=35, keep_text=False).withColumnRenamed("kept", "kept_sha256")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


#: The rules that the query applies.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels that carry a page's id: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), URL_RULES)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_near_dedup": op4_near_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_packing": op8_packing,
    "op9_url_filter": op9_url_filter,
    "op10_fingerprints": op10_fingerprints,
    "pipeline": pipeline,
}
ORACLE_SQL = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op4_near_dedup": near_dedup.oracle_sql(k=4, percent=80),
    "op5_decontamination": decontamination.oracle_sql(),
    "op6_substring_dedup": substring_dedup.oracle_sql(width=35),
    "op9_url_filter": url_filter.oracle_sql(URL_RULES),
}
